"""Benchmark decontamination by a generalised suffix automaton over the words of test items.

The automaton holds every run of words of every item. Training texts stream through it: each word either follows the current match or shortens it to its longest suffix that goes on, so that the length of the longest match that ends at each word is known after one pass. Where it reaches the window, the words of the window are hit; the window's state names the items.

Words whose neighbour never follows them in an item end every match of two words, so only runs of known neighbours enter the automaton.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batches_by_bytes, row_keys, written
from .spans import LOWER, U64, buffers, byte_class, span_hashes, word_spans

#: Words of lower-cased text: figures, letters and everything beyond ASCII.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Item words of one automaton, about 500 bytes each in a worker. More items are matched in several passes.
BLOCK_WORDS = 200_000
PAIR = U64(0x9E3779B97F4A7C15)
#: Bits of the table that most pairs of neighbours are sought in first.
PAIR_BITS = 20

SPAN = "struct<first_word:long,end_word:long,first_byte:long,end_byte:long,longest:long>"
SCANNED = f"doc_id long, key_1 long, key_2 long, n_words long, spans array<{SPAN}>, items array<string>"
SCANNED_ARROW = pa.schema([("doc_id", pa.int64()), ("key_1", pa.int64()), ("key_2", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "first_byte", "end_byte", "longest")]))), ("items", pa.list_(pa.string()))])


class Automaton:
    """Suffix automaton of several sequences of word hashes, with the items of each window."""

    def __init__(self, sequences: list[np.ndarray], names: list[str | None], window: int):
        self.window, self.names = window, names
        self.vocabulary = np.unique(np.concatenate([*sequences, np.zeros(0, dtype=U64)]))
        self.size = max(1, len(self.vocabulary))
        self.go: dict[int, int] = {}  # state * size + word -> state
        self.length, self.link = [0], [-1]
        self.leaving: list[list[int]] = [[]]  # words that lead on from each state, until it is built
        words = [np.searchsorted(self.vocabulary, s).tolist() for s in sequences]
        for sequence in words:
            last = 0
            for word in sequence:
                last = self._extended(last, word)
        del self.leaving
        self.least = min([window, *map(len, words)])
        self.items: dict[int, set[int]] = defaultdict(set)  # of windows, by state
        self.short: dict[int, set[int]] = defaultdict(set)  # whole items below the window, by state
        for item, sequence in enumerate(words):
            for end, (length, state) in enumerate(self.lengths(sequence), 1):
                if length >= window:
                    self.items[self._window_state(state)].add(item)
                elif end == len(sequence):
                    self.short[state].add(item)
        pairs = [s[:-1] * PAIR + s[1:] for s in sequences if len(s) > 1]
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, dtype=U64)]))
        self.seen = np.zeros(1 << PAIR_BITS, dtype=bool)
        self.seen[self.pairs >> U64(64 - PAIR_BITS)] = True

    def _new(self, length: int, link: int, like: int | None = None) -> int:
        state = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.leaving.append([])
        for word in self.leaving[like] if like is not None else ():
            self._set(state, word, self.go[like * self.size + word])
        return state

    def _set(self, state: int, word: int, to: int) -> None:
        key = state * self.size + word
        if key not in self.go:
            self.leaving[state].append(word)
        self.go[key] = to

    def _split(self, state: int, word: int, to: int) -> int:
        """The state of `state`'s strings and a word: `to`, or a copy of it for these if it also holds longer ones."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._new(self.length[state] + 1, self.link[to], like=to)
        self.link[to] = copy
        while state != -1 and self.go.get(state * self.size + word) == to:
            self.go[state * self.size + word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: int) -> int:
        there = self.go.get(last * self.size + word)
        if there is not None:
            return self._split(last, word, there)
        state = self._new(self.length[last] + 1, 0)
        while last != -1 and last * self.size + word not in self.go:
            self._set(last, word, state)
            last = self.link[last]
        if last != -1:
            self.link[state] = self._split(last, word, self.go[last * self.size + word])
        return state

    def _window_state(self, state: int) -> int:
        """The state of the last `window` words of a match that is no shorter."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def lengths(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word, the length of the longest match that ends there, and its state. All words are of the vocabulary."""
        go, link, size, state, length = self.go, self.link, self.size, 0, 0
        for word in words:
            to = go.get(state * size + word)
            while to is None:
                state = link[state]
                length = self.length[state]
                to = go.get(state * size + word)
            state, length = to, length + 1
            yield length, state

    def runs(self, hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of the runs that a window can lie in: each two neighbours stand side by side in an item. No run crosses two texts."""
        if not len(hashes) or not len(self.vocabulary):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pairs = hashes[:-1] * PAIR + hashes[1:]
        linked = self.seen[pairs >> U64(64 - PAIR_BITS)]
        borders = begins[1:-1] - 1
        linked[borders[(borders >= 0) & (borders < len(linked))]] = False
        maybe = np.flatnonzero(linked)
        linked[maybe] = among(self.pairs, pairs[maybe])
        ends = np.append(np.flatnonzero(~linked) + 1, len(hashes))
        firsts = np.concatenate(([0], ends[:-1]))
        long_enough = ends - firsts >= self.least
        firsts, ends = firsts[long_enough], ends[long_enough]
        if self.least == 1:
            known = (ends - firsts > 1) | among(self.vocabulary, hashes[firsts])
            firsts, ends = firsts[known], ends[known]
        return firsts, ends

    def found(self, hashes: np.ndarray) -> tuple[list[list[int]], set[int]]:
        """Of one run: [first word, end, longest match] of its hit spans, and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[int] = set()
        for end, (length, state) in enumerate(self.lengths(np.searchsorted(self.vocabulary, hashes).tolist()), 1):
            width = 0
            if length >= self.window:
                width = self.window
                items |= self.items[self._window_state(state)]
            if self.short:
                at = state if self.length[state] <= length else self.link[state]
                while at > 0:
                    if at in self.short:
                        width = max(width, self.length[at])
                        items |= self.short[at]
                    at = self.link[at]
            if width:
                first, longest = end - width, length if length >= self.window else width
                while spans and spans[-1][1] >= first:
                    before = spans.pop()
                    first, longest = min(first, before[0]), max(longest, before[2])
                spans.append([first, end, longest])
        return spans, items


def among(values: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Which of some numbers are among sorted values."""
    if not len(values):
        return np.zeros(len(sought), dtype=bool)
    at = np.searchsorted(values, sought)
    return values[np.minimum(at, len(values) - 1)] == sought


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, where each text's begin in them, their first bytes and ends, and where each text's bytes begin."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, begins = word_spans(data, offsets, WORD)
    return span_hashes(data, starts, ends), begins, starts, ends, offsets


def item_pieces(items: DataFrame, window: int) -> DataFrame:
    """item (text of item_id, or null) and hashes: the words of each item, in pieces of a quarter block at most that overlap by a window less one word."""
    most = max(window, BLOCK_WORDS // 4)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, begins, *_ = words_of(batch.column("text"))
            hashes = hashes.view(np.int64)
            names, parts = [], []
            for row, name in enumerate(batch.column("item").to_pylist()):
                for at in range(int(begins[row]), int(begins[row + 1]), most):
                    end = min(at + most + window - 1, int(begins[row + 1]))
                    if at == begins[row] or end - at >= window:
                        names.append(name)
                        parts.append(hashes[at:end])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.list_(pa.int64()))], names=["item", "hashes"])

    return items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, "item string, hashes array<long>")


def scanned(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, key_1 and key_2 (128 bits of doc_id and text), n_words, spans (hit words: first_word, end_word, first_byte, end_byte, and the longest match in it; in order, apart from each other), items (ids as text of the items whose windows occur, sorted).

    A window is `window` consecutive words of an item, or all words of one that has fewer. Items of one item_id are one item; those without item_id hit words but aren't named. Null and empty texts have no words; rows that repeat are judged alike; other columns are ignored. Up to BLOCK_WORDS words of items are one automaton and one pass; more are cut into blocks by a hash, one pass each, of which all but the first return only documents that are hit. The driver holds one block's words at a time.
    """
    spark = docs.sparkSession
    pieces = written(item_pieces(items, window), "item-words")
    total = pieces.agg(F.sum(F.size("hashes"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item", "hashes"), F.lit(n_blocks))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", "text", *row_keys(docs, "doc_id", "text"))
    passes = []
    for k in range(n_blocks):
        words = pieces.where(block == k).toArrow()
        sequences = [np.asarray(h, dtype=np.int64).view(U64) for h in words.column("hashes").to_pylist()]
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, sequences, words.column("item").to_pylist(), window))
        passes.append(docs.mapInArrow(scan(sent, every=not k), SCANNED))
    if n_blocks == 1:
        return passes[0]
    first, *rest = (written(p, "hit") for p in passes)
    more = rest[0]
    for p in rest[1:]:
        more = more.unionByName(p)
    more = more.groupBy("key_1", "key_2").agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
    both = first.join(more, ["key_1", "key_2"], "left")
    spans = F.array_sort(F.concat("spans", F.coalesce("more_spans", F.array().cast(f"array<{SPAN}>"))))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))))
    return both.select("doc_id", "key_1", "key_2", "n_words", F.when(F.col("more_spans").isNull(), F.col("spans")).otherwise(joined(spans)).alias("spans"), items.alias("items"))


def joined(spans: Column) -> Column:
    """Sorted spans, with those that overlap or touch made one."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first_word"].alias("first_word"), F.greatest(last["end_word"], s["end_word"]).alias("end_word"), last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], s["end_byte"]).alias("end_byte"), F.greatest(last["longest"], s["longest"]).alias("longest"))
        touch = (F.size(done) > 0) & (last["end_word"] >= s["first_word"])
        return F.when(touch, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)


#: The automaton that this Python worker built last, by its block's name.
_BUILT: dict[str, Automaton] = {}


def scan(sent, every: bool):
    """A pass over documents with the automaton of one block; with `every`, documents that aren't hit come back too."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sequences, names, window = sent.value
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Automaton(sequences, names, window)
        automaton = _BUILT[name]
        for batch in batches_by_bytes(batches, "text"):
            hashes, begins, starts, ends, offsets = words_of(batch.column("text"))
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for first, end in zip(*(x.tolist() for x in automaton.runs(hashes, begins)), strict=True):
                found, whose = automaton.found(hashes[first:end])
                if found:
                    row = int(np.searchsorted(begins, first, "right")) - 1
                    at, byte = first - int(begins[row]), int(offsets[row])
                    for a, b, longest in found:
                        span = {"first_word": at + a, "end_word": at + b, "first_byte": int(starts[first + a]) - byte, "end_byte": int(ends[first + b - 1]) - byte, "longest": longest}
                        if spans[row] and spans[row][-1]["end_word"] == at + a:  # one run ends where the next begins
                            before = spans[row].pop()
                            span |= {"first_word": before["first_word"], "first_byte": before["first_byte"], "longest": max(longest, before["longest"])}
                        spans[row].append(span)
                    items[row] |= {automaton.names[i] for i in whose}
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key_1", "key_2")), pa.array(np.diff(begins), pa.int64()), pa.array(spans, SCANNED_ARROW.field("spans").type), pa.array([sorted(i - {None}) for i in items], pa.list_(pa.string()))],
                schema=SCANNED_ARROW,
            )
            yield out if every else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return passed


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])


def digest(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, joined by commas), contaminated, n_spans."""
    return found.select("doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans"))


def cleaned(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5) -> DataFrame:
    """Documents without what benchmark items hold: hit spans are cut out of the text (a space in their place), and documents of whose words more than `coverage` are hit go. Documents that aren't hit stay as they are, null texts too; columns are those given, whatever they are called; rows that repeat are treated alike."""
    found = scanned(docs, items, window).where("size(spans) > 0").dropDuplicates(["key_1", "key_2"])
    hits = written(found.select(F.struct("key_1", "key_2").alias("key"), F.struct("n_words", "spans").alias("hit")), "hits")
    key_1, key_2 = row_keys(docs, "doc_id", "text")
    both = docs.select(F.struct(F.struct(key_1, key_2).alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")).alias("left")).join(hits, F.col("left.key") == F.col("key"), "left")
    both = both.where(F.col("hit").isNull() | (n_hit(F.col("hit.spans")) <= coverage * F.col("hit.n_words")))
    raw = F.col("left.doc.text").cast("binary")
    gaps = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.transform("hit.spans", lambda s: s["end_byte"])), F.concat(F.transform("hit.spans", lambda s: s["first_byte"]), F.array(F.octet_length(raw).cast("long"))), lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "utf-8"))
    text = F.when(F.col("hit").isNull(), F.col("left.doc.text")).otherwise(F.array_join(gaps, " "))
    return both.select(*[(text if c == "text" else F.col(f"left.doc.`{c}`")).alias(c) for c in docs.columns])


def oracle(window: int = 10) -> str:
    """The digest in DuckDB."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        i AS (SELECT item_id, {words} AS w FROM benchmark),
        shingles AS (SELECT item_id, least(len(w), {window}) AS n, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS p, w FROM i WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS phrase FROM shingles),
        places AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
        found AS (SELECT r, p, windows.n AS n, item_id FROM (SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS phrase FROM places) AS x JOIN windows USING (n, phrase)),
        hit AS (SELECT r, list_distinct(flatten(list(range(p, p + n)))) AS h, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM found GROUP BY r),
        marks AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM (SELECT r, unnest(h) AS p FROM hit)),
        spans AS (SELECT r, count(*) FILTER (WHERE q IS NULL OR q < p - 1) AS n_spans FROM marks GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(h), 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, h IS NOT NULL AS contaminated, coalesce(n_spans, 0)::BIGINT AS n_spans
        FROM d LEFT JOIN hit USING (r) LEFT JOIN spans USING (r)"""
