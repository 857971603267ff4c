"""Importance resampling towards a target distribution, by hashed features held in word tries.

A feature is a run of 1 to n words; its bucket is the CRC-32 of its bytes. Each partition keeps a trie of words: a node stands for a feature and holds its count and the CRC state after its bytes, so that a longer feature goes on from its parent's state and no feature is written out. Counts go to bucket totals, which are summed over partitions. A second pass walks the same paths with a gain attached to each node, and the best documents by gain and Gumbel noise are drawn.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_by_bytes, copies, row_keys, rows_at_most, unused, written
from .spans import LOWER, U64, buffers, byte_class, mixed, span_hashes, word_spans

#: Words of lower-cased text: figures, letters and everything beyond ASCII.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Nodes of one trie, about 200 bytes each; when there are more, its counts go to the totals and it begins anew.
NODES = 400_000
STEP = U64(0x9E3779B97F4A7C15)
#: Bits of the table of nodes that were met last.
MET_BITS = 19
#: Different scores there can be: a gain lies within 1000 * ln(2**63) of 0 on either side, noise adds 26,000.
SCORES = 200_000


class Trie:
    """Nodes by 64-bit keys of their paths."""

    def __init__(self, buckets: int, gains: np.ndarray | None = None):
        self.buckets, self.gains = buckets, gains
        self.totals = np.zeros(buckets, dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        """Counts go to the bucket totals; no node stays."""
        if getattr(self, "n", 0):
            np.add.at(self.totals, self.crc[: self.n] % self.buckets, self.count[: self.n])
        self.n, self.of = 0, {}
        self.crc, self.count, self.gain = (np.zeros(1 << 12, dtype=np.int64) for _ in range(3))
        self.met_key, self.met_node = np.zeros(1 << MET_BITS, dtype=U64), np.full(1 << MET_BITS, -1, dtype=np.int64)

    def nodes(self, keys: np.ndarray, parents: np.ndarray | None, data: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The node of each path. What is new is added: it goes on from its parent's CRC state, over a space and its last word."""
        slots = (keys >> U64(64 - MET_BITS)).astype(np.int64)
        found = self.met_node[slots]
        missed = np.flatnonzero((self.met_key[slots] != keys) | (found < 0))
        if len(missed):
            different, first, place = np.unique(keys[missed], return_index=True, return_inverse=True)
            known = np.fromiter((self.of.get(key, -1) for key in different.tolist()), dtype=np.int64, count=len(different))
            new = np.flatnonzero(known < 0)
            while self.n + len(new) > len(self.crc):
                self.crc, self.count, self.gain = (np.concatenate((x, np.zeros_like(x))) for x in (self.crc, self.count, self.gain))
            at = missed[first[new]]
            before = [0] * len(at) if parents is None else [zlib.crc32(b" ", state) for state in self.crc[parents[at]].tolist()]
            self.crc[self.n : self.n + len(new)] = [zlib.crc32(data[a:b], state) for a, b, state in zip(starts[at].tolist(), ends[at].tolist(), before, strict=True)]
            if self.gains is not None:
                self.gain[self.n : self.n + len(new)] = self.gains[self.crc[self.n : self.n + len(new)] % self.buckets]
            known[new] = np.arange(self.n, self.n + len(new))
            self.of.update(zip(different[new].tolist(), known[new].tolist(), strict=True))
            self.n += len(new)
            found[missed] = known[place]
            self.met_key[slots[missed]], self.met_node[slots[missed]] = keys[missed], found[missed]
        return found

    def walked(self, column: pa.Array, most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Of a batch of texts: where each text's words begin, and for each length of features their first words and nodes."""
        if self.n > NODES:
            self.clear()
        data, offsets = buffers(column)
        data = LOWER[data]
        starts, ends, begins = word_spans(data, offsets, WORD)
        hashes = span_hashes(data, starts, ends)
        left = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(starts))  # words from here to the text's end
        levels, at, keys, nodes = [], np.arange(len(starts)), np.zeros(len(starts), dtype=U64), None
        for k in range(most):
            inside = left[at] > k
            at, keys, nodes = at[inside], keys[inside], nodes if nodes is None else nodes[inside]
            keys = mixed(keys * STEP + hashes[at + k])
            nodes = self.nodes(keys, nodes, memoryview(data), starts[at + k], ends[at + k])
            levels.append((at, nodes))
        return begins, levels


def bucket_totals(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """bucket and n: the features of all texts in each bucket that holds some."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets)
        for batch in batches:
            for part in batches_by_bytes([batch], "text"):
                for _, nodes in trie.walked(part.column("text"), most)[1]:
                    sums = np.bincount(nodes, minlength=0)
                    trie.count[: len(sums)] += sums
        trie.clear()
        held = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(trie.totals[held], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most: int, buckets: int) -> np.ndarray:
    """The gain of each bucket: 1000 times the log of its share in the target over that in the documents, each with one more feature in every bucket, floored."""
    held = []
    for texts in (docs, target):
        counts = np.zeros(buckets, dtype=np.int64)
        for bucket, n in rows_at_most(bucket_totals(texts, most, buckets), buckets):
            counts[bucket] = n
        held.append(counts.tolist())
    of_docs, of_target = held
    all_docs, all_target = float(sum(of_docs) + buckets), float(sum(of_target) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * all_docs / ((s + 1) * all_target))) for s, t in zip(of_docs, of_target, strict=True)], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """Per document: doc_id, key_1 and key_2 (128 bits of doc_id and text), n_words, n_features, weight (floored mean gain of its features, 0 without any)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "key_1", "key_2", "n_words", "n_features", "weight")])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(sent.value), sent.value)
        for part in batches_by_bytes(batches, "text"):
            begins, levels = trie.walked(part.column("text"), most)
            n, total = np.zeros(part.num_rows, dtype=np.int64), np.zeros(part.num_rows, dtype=np.int64)
            for at, nodes in levels:
                borders = np.searchsorted(at, begins)
                sums = np.concatenate(([0], np.cumsum(trie.gain[nodes])))
                n += np.diff(borders)
                total += sums[borders[1:]] - sums[borders[:-1]]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key_1", "key_2")), *(pa.array(x, pa.int64()) for x in (np.diff(begins), n, total // np.maximum(n, 1)))], schema=out)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", *row_keys(docs, "doc_id", "text"), "text").mapInArrow(scored, "doc_id long, key_1 long, key_2 long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise of each doc_id, in thousandths, from the first 32 bits of sha256('seed:doc_id'); a null id is written null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Rows of weighted() with their score, written before, with rank: of the N rows with at least so many words, the floor(percent * N / 100) of highest score are numbered from 1; ties go to the smaller doc_id (null last), then by key.

    Scores are few (SCORES at most), so their counts give the lowest score that is drawn. Rows from there on are dealt by ranges in the order of ranks, and numbered in each range; rows that are equal are counted first.
    """
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    counts = sorted(rows_at_most(scored.where(able).groupBy("score").count(), SCORES), reverse=True)
    drawn = percent * sum(n for _, n in counts) // 100
    lowest, held = None, 0
    for score, n in counts:
        if held >= drawn:
            break
        lowest, held = score, held + n
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    inside = able & (F.col("score") >= lowest)
    columns = scored.columns
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key_1"), F.asc("key_2")]
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // 1_000_000))
    parts = scored.where(inside).groupBy(*columns).agg(F.count("*").alias("n")).repartitionByRange(n_parts, *order).withColumn("part", F.spark_partition_id())
    parts = written(parts, "drawn")
    before, starts = 0, []
    for part, n in sorted(rows_at_most(parts.groupBy("part").agg(F.sum("n")), 1_000_000)):
        starts.append((part, before))
        before += n
    so_far = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    numbered = parts.withColumn("so_far", F.coalesce(so_far, F.lit(0))).join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")
    numbered = copies(numbered.withColumn("first", F.col("start") + F.col("so_far") + 1), "first", "n", "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return numbered.select(*columns, rank.cast("long").alias("rank")).unionByName(scored.where(~inside).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every document: doc_id, key_1 and key_2 (128 bits of doc_id and text), n_words, n_features, weight, score (weight and noise), rank (of those drawn; else null).

    Null and empty texts have no features and weigh 0; rows that repeat are each drawn for themselves and rows of one doc_id have the same noise; other columns are ignored. An empty target or table is one without features. Totals are over all texts; the driver holds one number for each bucket and each score.
    """
    scored = weighted(docs, gains(docs, target, most, buckets), most)
    return ranked(written(scored.withColumn("score", F.col("weight") + noise(seed)), "scored"), percent, least_words)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that resampled() draws, with their columns, whatever these are called. Rows of one doc_id and text come together, if one of them is drawn."""
    found = resampled(docs, target, **options).where("rank IS NOT NULL").select(F.struct("key_1", "key_2").alias("drawn key")).distinct()
    return docs.join(found.withColumnRenamed("drawn key", unused("drawn key", docs)), F.struct(*row_keys(docs, "doc_id", "text")) == F.col(f"`{unused('drawn key', docs)}`"), "left_semi")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the result, without keys."""
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def crc32_sql(source: str, text: str) -> str:
    """CTEs that give crcs(f, crc) for the distinct values f of a column in DuckDB, which has no CRC-32: a table of 256 remainders, folded over the bytes."""
    return f"""remainders(b, k, v) AS (
            SELECT b::BIGINT, 0, b::BIGINT FROM range(256) AS r(b)
            UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM remainders WHERE k < 8),
        folding AS (SELECT list(v ORDER BY b) AS t FROM remainders WHERE k = 8),
        crcs AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
            FROM (SELECT DISTINCT {text} AS f FROM {source}), folding)"""


def oracle() -> str:
    """The digest in DuckDB, with features of one word."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        df AS (SELECT r, unnest(w) AS f FROM d),
        tf AS (SELECT unnest({words}) AS f FROM benchmark),
        {crc32_sql("(SELECT f FROM df UNION SELECT f FROM tf)", "f")},
        s AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM df JOIN crcs USING (f) GROUP BY 1),
        t AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM tf JOIN crcs USING (f) GROUP BY 1),
        sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS tt),
        gains AS (
            SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (ss + 10000) / ((coalesce(s.n, 0) + 1) * (tt + 10000))))::BIGINT AS gain
            FROM range(10000) AS g(b) CROSS JOIN sums LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
        weights AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN crcs USING (f) JOIN gains ON gains.bucket = crc % 10000 GROUP BY r),
        scored AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM d LEFT JOIN weights USING (r)),
        ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank, n_words FROM ranked"""
