"""Lexical retrieval packing: windows of neighbours from a sharded BM25 inverted index.

1. Documents become ids, and the document frequencies of the whole corpus are counted (the vocabulary bounds that table).
2. Documents are dealt into shards of about SHARD_TOKENS ids so that lexical neighbours meet: a document's key is the first of its tokens in a random order in which rare tokens (that two documents have, at least) tend to come first, a MinHash weighted by squared inverse document frequency; the second such token orders those of one key. Shards are equal cuts of that order by tokens. A key or a pair of keys with many documents takes as many shards as it needs, its documents spread evenly.
3. A shard's task builds an inverted index of its documents' tokens, weighted by BM25. Then it fills one window after the other: the window's seed is the document that the last window cut, or the first unused one; its best unused neighbours by all its tokens follow until the window is full, and what doesn't fit opens the next window. So only a shard's last window has padding.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing_tokens import codec
from .shared import batches_by_bytes, copies, documents, ids_for_join, rows_at_most, sorted_groups, written
from .token_counts import ragged

WINDOW, END = 4096, 2
SHARD_TOKENS = 2 << 20
#: BM25's constants.
K1, B = 1.2, 0.75
#: Second tokens of a key's documents fall into so many cells for each shard that the key fills.
CELLS = 4
TOKENS = "doc_id long, n_tokens long, ids binary, frequencies binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """doc_id, n_tokens and ids (16 or 32 bits each, the end id included) of each document; besides, one row of each task with the document frequencies of its documents' tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        frequencies = np.zeros(code.library.get_vocab_size(), dtype=np.int32)
        tail = np.array([end], dtype=code.kind).tobytes()
        size = code.kind.itemsize
        for batch in batches_by_bytes(batches, "text", 1 << 19):
            ids, places = code.encode(batch.column("text"))
            content, rows = ids.tobytes(), []
            for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
                frequencies[np.unique(ids[a:b])] += 1
                rows.append(content[a * size : b * size] + tail)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(places) + 1, pa.int64()), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], names=["doc_id", "n_tokens", "ids", "frequencies"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([frequencies.tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids", "frequencies"])

    return documents(docs).mapInArrow(run, TOKENS)


def document_frequencies(tokens: DataFrame, n_ids: int) -> np.ndarray:
    """How many documents hold each id: one row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, dtype=np.int64)
        for batch in batches:
            for row in batch.column("frequencies").to_pylist():
                total += np.frombuffer(row, dtype=np.int32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counted = tokens.where("frequencies IS NOT NULL").select("frequencies").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(n_ids, dtype=np.int64)
    for row in rows_at_most(counted, n_ids):
        out[row["id"]] = row["n"]
    return out


class Shard:
    """An inverted index over some documents' ids, and which of them are used."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts = zip(*(np.unique(x[:-1], return_counts=True) for x in texts), strict=True)
        sizes = np.array([len(x) for x in terms])
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.terms, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        length = np.array([len(x) for x in texts], dtype=np.float64)
        weights = idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
        order = np.argsort(self.terms, kind="stable")
        self.owners, self.impacts = owner[order], weights[order]
        self.posting = np.searchsorted(self.terms[order], np.arange(len(idf) + 1))
        self.unused = np.ones(len(texts), dtype=bool)
        self.n = self.indexed = self.left = len(texts)

    def use(self, document: int) -> None:
        """Take a document out; when half of the indexed ones are out, the index is rid of them."""
        self.unused[document] = False
        self.left -= 1
        if 2 * self.left < self.indexed:
            still = self.unused[self.owners]
            self.posting = np.concatenate(([0], np.cumsum(still)))[self.posting]
            self.owners, self.impacts, self.indexed = self.owners[still], self.impacts[still], self.left

    def neighbours(self, seed: int) -> list[int]:
        """The unused documents that share tokens with the seed, by their BM25 score, best first."""
        terms = self.terms[self.begins[seed] : self.begins[seed + 1]]
        low, high = self.posting[terms], self.posting[terms.astype(np.int64) + 1]
        at = ragged(low, high - low)
        score = np.bincount(self.owners[at], self.impacts[at], minlength=self.n) * self.unused
        found = np.flatnonzero(score > 0)
        return found[np.lexsort((found, -score[found]))].tolist()


def packed_order(texts: list[np.ndarray], idf: np.ndarray, mean: float) -> Iterator[int]:
    """The documents of a shard in the order in which they fill its windows."""
    shard = Shard(texts, idf, mean)
    filled, first, seed = 0, 0, -1
    while True:
        if seed < 0:
            while first < shard.n and not shard.unused[first]:
                first += 1
            if first == shard.n:
                return
            seed = first
            shard.use(seed)
            filled += len(texts[seed])
            yield seed
        if filled >= WINDOW:  # the seed's rest opens the next window, and asks for it
            filled %= WINDOW
            seed = seed if filled else -1
            continue
        last = -1
        for last in shard.neighbours(seed):
            shard.use(last)
            filled += len(texts[last])
            yield last
            if filled >= WINDOW:
                break
        seed = last if filled >= WINDOW else -1


def pieces(ids: list[int | None], texts: list[np.ndarray], order: Iterator[int], shard: int, window: int = WINDOW) -> list[tuple]:
    """The pieces of documents laid end to end in an order and cut into windows."""
    out, at = [], 0
    for i in order:
        text, start = texts[i], 0
        while start < len(text):
            length = min(len(text) - start, window - at % window)
            content = text[start : start + length].astype("<u4").tobytes()
            out.append((ids[i], start, length, zlib.crc32(content), len(text), (shard << 32) + at // window, at % window))
            start, at = start + length, at + length
    return out


def token_order(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """Each token's place in a random order in which a token comes before another in proportion to its squared inverse document frequency; tokens that fewer than two documents have, or all, come last."""
    draws = -np.log1p(-np.random.default_rng(len(frequencies)).random(len(frequencies)))
    weight = np.log(max(1, n_docs) / np.maximum(frequencies, 1)) ** 2
    shared = (frequencies > 1) & (weight > 0)
    place = np.empty(len(frequencies), dtype=np.int64)
    place[np.lexsort((draws / np.where(shared, weight, 1), ~shared))] = np.arange(len(frequencies))
    return place


def with_keys(tokens: DataFrame, places: np.ndarray, kind: str) -> DataFrame:
    """tokens (doc_id, n_tokens, ids, spread) and the places of each document's first and second token in the order (the number of tokens, where it has none)."""
    none = len(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "ids", 8 << 20):
            texts = [np.frombuffer(x, dtype=kind)[:-1] for x in batch.column("ids").to_pylist()]
            sizes = np.array([len(x) for x in texts])
            keys = np.full((2, len(texts)), none, dtype=np.int64)
            some = np.flatnonzero(sizes)
            if len(some):
                own = places[np.concatenate(texts)]
                begins = (np.cumsum(sizes) - sizes)[some]
                keys[0, some] = np.minimum.reduceat(own, begins)
                own[own == np.repeat(keys[0], sizes)] = none
                keys[1, some] = np.minimum.reduceat(own, begins)
            yield batch.append_column("first", pa.array(keys[0])).append_column("second", pa.array(keys[1]))

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, ids binary, spread double, first long, second long")


def spread_out(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids and spread: an even number from 0 to 1 that follows doc_id, ids and, among equal rows, the number of the row, so that every run deals alike and copies are spread as well as others."""
    keys = F.xxhash64("doc_id", "ids"), F.xxhash64(F.lit(1), "doc_id", "ids")
    rows = rows.select("doc_id", "n_tokens", "ids", F.struct(keys[0].alias("a"), keys[1].alias("b")).alias("key"))
    repeats = ids_for_join(written(rows.groupBy("key").count().where("count > 1"), "repeats"))
    ones = rows.join(repeats, "key", "left_anti").withColumn("number", F.lit(1).cast("long"))
    several = rows.join(repeats, "key").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("ids").alias("ids"), F.first("count").alias("n"), F.lit(1).cast("long").alias("first"))
    every = ones.unionByName(copies(written(several, "repeated-rows"), "first", "n", "number"))
    spread = F.pmod(F.xxhash64("key.b", "number"), F.lit(1 << 30)) / float(1 << 30)
    return every.select("doc_id", "n_tokens", "ids", spread.alias("spread"))


def dealt(keyed: DataFrame, n_tokens: int, n_shards: int, n_keys: int) -> DataFrame:
    """Rows of with_keys() with their shard: equal cuts, by tokens, of the documents in order of first, then of a cell of second, then of spread (0 to 1, even)."""
    spark = keyed.sparkSession
    size = n_tokens / n_shards
    keys = sorted(rows_at_most(keyed.groupBy("first").agg(F.sum("n_tokens").alias("n")), n_keys))  # one row for each token of the vocabulary
    starts = [0, *itertools.accumulate(r["n"] for r in keys)]
    table = spark.createDataFrame([(r["first"], at, r["n"], max(1, math.ceil(CELLS * r["n"] / size)) if r["n"] > size / CELLS else 1) for r, at in zip(keys, starts)], "first long, start long, n long, n_cells int")
    rows = keyed.join(F.broadcast(table), "first").withColumn("cell", F.when(F.col("n_cells") > 1, F.pmod(F.xxhash64("second"), F.col("n_cells"))))
    before = Window.partitionBy("first").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.where("n_cells > 1").groupBy("first", "cell", "start").agg(F.sum("n_tokens").alias("cell_n"))
    cells = written(cells.select("first", "cell", "cell_n", (F.col("start") + F.coalesce(F.sum("cell_n").over(before), F.lit(0))).alias("cell_start")), "cells")
    rows = rows.join(ids_for_join(cells), ["first", "cell"], "left")
    place = F.coalesce("cell_start", "start") + F.col("spread") * F.coalesce("cell_n", "n")
    return rows.select("doc_id", "ids", F.least(F.floor(place / size), F.lit(n_shards - 1)).cast("int").alias("shard"))


def packed(docs: DataFrame, vocabulary: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all documents: doc_id, start (its document's ids before it), length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id, offset (in the sequence).

    A null or empty text is the end id alone. Rows that repeat are packed as often as they are there, wherever their text belongs; ids, null or repeated, have no say in it. Other columns are ignored; an empty table gives no pieces.
    """
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    n_ids = codec(vocabulary).library.get_vocab_size()
    tokens = written(tokenised(docs, vocabulary, end), "tokens")
    rows = tokens.where("ids IS NOT NULL")
    n_docs, n_tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    frequencies = document_frequencies(tokens, n_ids)
    idf = np.log1p((n_docs - frequencies + 0.5) / (frequencies + 0.5))
    mean = n_tokens / max(1, n_docs)
    n_shards = max(1, round(n_tokens / shard_tokens))
    kind = codec(vocabulary).kind.str
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in sorted_groups(batches, ["shard"]):
            for a, b in zip(begins, [*begins[1:], table.num_rows], strict=True):
                ids = table.column("doc_id").slice(a, b - a).to_pylist()
                texts = [np.frombuffer(x, dtype=kind) for x in table.column("ids").slice(a, b - a).to_pylist()]
                found = pieces(ids, texts, packed_order(texts, idf, mean), table.column("shard")[a].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    keyed = with_keys(spread_out(rows), token_order(frequencies, n_docs), kind)
    return dealt(keyed, n_tokens, n_shards, n_ids + 1).repartitionById(n_shards, "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(run, PIECES)
