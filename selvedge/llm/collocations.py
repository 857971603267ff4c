"""Phrase collocations by sorted suffixes.

Every word of a piece of text begins a suffix of max_n words at most. Suffixes are shuffled by language and first word and sorted in reverse order, in which all suffixes with one beginning stand together; one stack of open beginnings then counts all phrases while the rows stream by. Parts of phrases are joined afterwards from the same counts.

Two things come before the shuffle, and neither changes a count that matters. A word that is too rare for any phrase ends a suffix and begins none: a table of bits, one for many words, says which may be frequent, and errs only by keeping rare ones. Equal suffixes of about a million words are counted as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_by_bytes, rows_at_most, written
from .spans import LOWER, U64, buffers, byte_class, mixed, span_hashes, word_spans
from .token_counts import ragged

#: Bytes of words: all but blanks between words and the marks that end a piece.
BLANK = byte_class((0x20, 0x20), (0x09, 0x09))
MARK = byte_class((0x0A, 0x0D)) | np.isin(np.arange(256), np.frombuffer(b".,;:!?", dtype=np.uint8))
WORD = ~(BLANK | MARK)
NOT_BLANK = ~byte_class((0x20, 0x20))
STEP = U64(0x9E3779B97F4A7C15)
#: Bits of the hash of a word and its language that find its bit among those of frequent words: a table of 2 MB.
WORD_BITS = 24
#: Bytes of text whose suffixes are counted together before the shuffle.
AT_ONCE = 2 << 20
#: Suffixes that are written out together.
WRITTEN = 20_000
#: Words whose suffixes one task sorts, about, while there are no more than MOST_PARTS tasks; beyond, tasks sort more, and spill.
PART_WORDS, MOST_PARTS = 1_000_000, 100_000


class Words:
    """The words of a batch of texts with languages."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = buffers(batch.column("text"))
        self.data = LOWER[data]
        self.starts, self.ends, begins = word_spans(self.data, offsets, WORD)
        languages = batch.column("lang").dictionary_encode()
        self.languages, code = languages.dictionary, languages.indices.to_numpy(zero_copy_only=False)
        name = np.frombuffer(b"".join(x.as_py().encode() + b" " for x in self.languages), dtype=np.uint8)
        at = np.cumsum([0, *(len(x.as_py().encode()) + 1 for x in self.languages)])
        owner = span_hashes(name, at[:-1], at[1:]) if len(self.languages) else np.zeros(0, dtype=U64)
        self.language = np.repeat(code, np.diff(begins))  # of each word
        self.keys = mixed(span_hashes(self.data, self.starts, self.ends) * STEP + owner[self.language])
        marks = np.concatenate(([0], np.cumsum(MARK[self.data], dtype=np.int32)))
        document = np.repeat(np.arange(batch.num_rows), np.diff(begins))
        #: Whether the next word follows in the same piece.
        self.followed = np.zeros(len(self.starts), dtype=bool)
        if len(self.starts) > 1:
            self.followed[:-1] = (marks[self.ends[:-1]] == marks[self.starts[1:]]) & (document[:-1] == document[1:])

    def texts(self, first: np.ndarray, n: np.ndarray) -> pa.Array:
        """The phrases of n words from the given first ones, each word with a blank after it. No phrase goes beyond its piece."""
        words = ragged(first, n)
        lengths = self.ends[words] - self.starts[words]
        ends = np.cumsum(lengths + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
        out[ragged(ends - lengths - 1, lengths)] = self.data[ragged(self.starts[words], lengths)]
        offsets = np.concatenate(([0], ends[np.cumsum(n) - 1])) if len(n) else np.zeros(1, dtype=np.int64)
        return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about AT_ONCE bytes of text."""
    held, size = [], 0
    for batch in batches_by_bytes(batches, "text", AT_ONCE):
        held.append(batch)
        size += int(pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
        if size >= AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table.combine_chunks().to_batches()[0]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (64 bits of the word and its language), n."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            words = Words(batch)
            keys, first, n = np.unique(words.keys, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([words.languages.take(pa.array(words.language[first])), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    return docs.mapInArrow(counted, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_bits(counts: DataFrame, least: int) -> np.ndarray:
    """A table of 2**WORD_BITS bits, set for the leading bits of every word that occurs so often. The driver gets 2**(WORD_BITS - 6) pairs of numbers at most."""
    slot = F.shiftrightunsigned("word", 64 - WORD_BITS)
    packed = counts.where(F.col("n") >= least).select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(word, {64 - WORD_BITS}) & 63 AS int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = packed.toArrow()
    words = np.zeros(1 << (WORD_BITS - 6), dtype=np.int64)
    words[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return words.view(np.uint8)


def suffixes(docs: DataFrame, bits, hot, max_n: int) -> DataFrame:
    """lang, suffix (words, each with a blank after it), n, hot (how many hot words it begins with), deal. A suffix is dealt by its language and its words up to the first that isn't hot, so that a frequent word's suffixes don't meet in one task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = bits.value, hot.value
        for batch in gathered(batches):
            words = Words(batch)
            slot = (words.keys >> U64(64 - WORD_BITS)).astype(np.int64)
            may = (frequent[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(may)
            if not len(at):
                continue
            on = words.followed & may & np.append(may[1:], False)  # whether the next word goes on a suffix
            length, reach = may.astype(np.int64), on.copy()
            for k in range(1, max_n):
                length += reach
                reach &= np.append(on[k:], np.zeros(k, dtype=bool))[: len(on)]
            length = length[at]
            own, ids = np.unique(words.keys[at], return_inverse=True)
            number = np.zeros(len(may) + max_n, dtype=np.int64)
            number[at] = ids + 1
            often_own = np.append(False, np.isin(own, often))  # by number
            code, size = number[at].astype(U64), len(own) + 1
            deal, n_hot = words.keys[at].copy(), often_own[number[at]].astype(np.int32)
            for k in range(1, max_n):
                follow = np.where(length > k, number[at + k], 0)
                if size * (len(own) + 1) >= 1 << 64:
                    code = np.unique(code, return_inverse=True)[1].astype(U64)
                    size = int(code.max()) + 1
                code, size = code * U64(len(own) + 1) + follow.astype(U64), size * (len(own) + 1)
                deeper = np.flatnonzero((n_hot == k) & (follow > 0))
                deal[deeper] = mixed(deal[deeper] * STEP + own[follow[deeper] - 1])
                n_hot[deeper] += often_own[follow[deeper]]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            for start in range(0, len(first), WRITTEN):
                some = first[start : start + WRITTEN]
                columns = [words.languages.take(pa.array(words.language[at[some]])), words.texts(at[some], length[some]), pa.array(n[start : start + WRITTEN], pa.int64()), pa.array(n_hot[some], pa.int32()), pa.array(deal[some].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "suffix", "n", "hot", "deal"])

    return docs.mapInArrow(made, "lang string, suffix string, n long, hot int, deal long")


class Stack:
    """The open beginnings of a sorted stream of suffixes, one for each number of words, with their counts so far."""

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.phrases: list[str | None] = [None] * max_n  # None where the last suffix has fewer words
        self.counts, self.hot = [0] * max_n, [0] * max_n
        self.keys = np.zeros(max_n, dtype=U64)
        self.codes: dict[str, int] = {}  # of languages
        self.lang: str | None = None
        self.out: list[tuple[str, str, int]] = []

    def close(self, k: int) -> None:
        """Give out what is open with k + 1 words, if it is counted often enough or counted by other tasks too."""
        if self.phrases[k] is not None and (self.counts[k] >= self.least or self.max_n - 1 > k < self.hot[k]):
            self.out.append((self.lang, self.phrases[k], self.counts[k]))

    def passed(self, batch: pa.RecordBatch) -> None:
        rows, hot = batch.num_rows, batch.column("hot").to_numpy()
        data, offsets = buffers(batch.column("suffix"))
        starts, ends, begins = word_spans(data, offsets, NOT_BLANK)
        n_words, hashes = np.diff(begins), span_hashes(data, starts, ends)
        encoded = batch.column("lang").dictionary_encode()
        languages = encoded.dictionary.to_pylist()
        code = np.array([self.codes.setdefault(x, len(self.codes)) for x in languages], dtype=U64)
        language = encoded.indices.to_numpy()
        sums = np.concatenate(([0], np.cumsum(batch.column("n").to_numpy())))
        keys = np.zeros((self.max_n, rows + 1), dtype=U64)  # of each row's beginnings, 0 where there is none; first those of the row before
        keys[:, 0] = self.keys
        beginning = lambda row, k: data[offsets[row] : ends[begins[row] + k]].tobytes().decode()
        for k in range(self.max_n):
            there = np.flatnonzero(n_words > k)
            before = keys[k - 1, there + 1] if k else code[language[there]]
            keys[k, there + 1] = mixed(before * STEP + hashes[begins[there] + k]) | U64(1)
            changed = np.flatnonzero(keys[k, 1:] != keys[k, :-1])  # rows where another beginning opens, or none
            self.counts[k] += int(sums[changed[0] if len(changed) else rows])
            if not len(changed):
                continue
            self.close(k)
            n = sums[np.append(changed[1:], rows)] - sums[changed]
            real = n_words[changed] > k
            for i in np.flatnonzero(real[:-1] & ((n[:-1] >= self.least) | (hot[changed[:-1]] > k) & (k < self.max_n - 1))).tolist():
                row = int(changed[i])
                self.out.append((languages[language[row]], beginning(row, k), int(n[i])))
            row = int(changed[-1])
            self.phrases[k], self.counts[k], self.hot[k] = beginning(row, k) if real[-1] else None, int(n[-1]), int(hot[row])
        self.keys, self.lang = keys[:, rows].copy(), languages[language[-1]]

    def taken(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        lang, phrase, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, max_n: int, least: int) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of all phrases of 1 to max_n words that occur `least` times or more; and lang, n (all words) of each language."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = written(word_counts(docs), "word-counts")
    sizes = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(usual, min(-(-total // PART_WORDS), MOST_PARTS))
    often = rows_at_most(counts.where(F.col("n") * usual >= total).select("word"), usual)
    hot = spark.sparkContext.broadcast(np.sort(np.array([w for (w,) in often], dtype=np.int64).view(U64)))
    bits = spark.sparkContext.broadcast(frequent_bits(counts, least))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least)
        for batch in batches:
            if batch.num_rows:
                stack.passed(batch)
                yield stack.taken()
        for k in range(max_n):
            stack.close(k)
        yield stack.taken()

    dealt = suffixes(docs, bits, hot, max_n).repartition(n_parts, "deal").sortWithinPartitions(F.desc("deal"), F.desc("lang"), F.desc("suffix"))
    found = dealt.select("lang", "suffix", "n", "hot").mapInArrow(counted, "lang string, phrase string, n long")
    return written(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases"), sizes


def decimal(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, inside_percent: int = 80, most: int = 2000) -> DataFrame:
    """Per language, the `most` phrases of highest score: lang, rank (from 1), phrase (words joined by a space), a (its occurrences), l and r (those of the parts of the cut that scores lowest, the first of several), n (all words of the language), score (floor of 2000000 a / (l + r)).

    Phrases have 2 to max_n words within a piece and `least` occurrences or more. One that lies in a longer phrase with `inside_percent` of its occurrences or more is dropped, be the longer one dropped or not. Ties in score go to more occurrences, then to the phrase in order of bytes. A null language is und; null and empty texts have no words; rows that repeat count each time; other columns are ignored; an empty table gives no rows.
    """
    phrases, sizes = phrase_counts(docs, max_n, least)
    words = F.split("phrase", " ")
    longer = phrases.withColumn("words", words).where(F.size("words") >= 2)
    join = lambda w, first, n: F.array_join(F.slice(w, first, n), " ")
    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join("words", F.lit(1), F.col("k")).alias("left"), join("words", F.col("k") + 1, F.size("words")).alias("right"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumns({"up": F.lit(2_000_000).cast("decimal(10,0)") * decimal("a"), "down": decimal("l") + decimal("r")}).withColumn("score", F.expr("CAST(up DIV down AS long)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = longer.where(F.size("words") >= 3).select("lang", "n", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inner = inner.select("lang", "n", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", join("words", F.col("at"), F.col("m")).alias("phrase")).agg(F.max("n").alias("over"))
    scored = scored.join(inner, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * decimal("over") < inside_percent * decimal("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def oracle() -> str:
    """The same in DuckDB, with the usual parameters."""
    return r"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents)),
        places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM pieces CROSS JOIN range(1, 5) AS r(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS phrase, count(*) AS n FROM places GROUP BY ALL),
        often AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n FROM f WHERE n >= 30),
        cuts AS (SELECT lang, phrase, w, n AS a, unnest(range(1, k)) AS c FROM often WHERE k >= 2),
        scored AS (
            SELECT cuts.lang, cuts.phrase, a, x.n AS l, y.n AS r, (2000000::HUGEINT * a) // (x.n + y.n) AS score,
                row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000::HUGEINT * a) // (x.n + y.n), c) AS place
            FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(list_slice(w, 1, c), ' ') JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(list_slice(w, c + 1, len(w)), ' ')),
        inner_places AS (SELECT lang, w, k, n, m, unnest(range(1, k - m + 2)) AS p FROM often CROSS JOIN range(2, 4) AS r(m) WHERE k > m),
        inside AS (SELECT lang, array_to_string(list_slice(w, p, p + m - 1), ' ') AS phrase, max(n) AS over FROM inner_places GROUP BY ALL),
        kept AS (SELECT scored.* FROM scored LEFT JOIN inside USING (lang, phrase) WHERE place = 1 AND (over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
        sizes AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""
