"""Rendezvous hashing of stable record keys over weighted shards, in Spark expressions only.

A record goes to the shard with the least -ln(u) / weight, u in (0, 1) a hash of the key and the shard. A shard that is added takes records only to itself; one that goes gives its records to the others, and no other record moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import copies, written

MASK = (1 << 32) - 1
#: Different rows of a shard that one task numbers, about.
SLOT_BLOCK = 20_000


def mixed32(hashes: Column) -> Column:
    """Each of an array of 32-bit integers (as longs) through a bijection whose output bits depend on all input bits."""
    for _ in range(2):
        hashes = F.transform(hashes, lambda x: (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(0x45D9F3B)).bitwiseAND(F.lit(MASK)))
    return F.transform(hashes, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def key_hashes(key: Column, seeds: range) -> Column:
    """A 32-bit hash of a long key for each seed; a null key counts as -1."""
    key = F.coalesce(key, F.lit(-1).cast("long"))
    high = mixed32(F.array(F.shiftright(key, 32).bitwiseAND(F.lit(MASK))))
    base = mixed32(F.transform(high, lambda x: x.bitwiseXOR(key.bitwiseAND(F.lit(MASK)))))
    constants = F.array(*[F.lit(mixed_int(seed)).cast("long") for seed in seeds])
    return mixed32(F.transform(constants, lambda c: c.bitwiseXOR(F.get(base, F.lit(0)))))


def mixed_int(x: int) -> int:
    """mixed32() of a constant."""
    x = (x * 0x9E3779B1 + 0x7F4A7C15) & MASK
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 0x45D9F3B) & MASK
    return x ^ (x >> 16)


def rendezvous(hashes: Column, weights: list[float]) -> Column:
    """The shard of a key by its hashes, one for each shard (more are ignored); the lower one of two that tie."""
    scale = F.array(*[F.lit(float(w)) for w in weights])
    scores = F.zip_with(F.slice(hashes, 1, len(weights)), scale, lambda h, w: -F.log((h.cast("double") + 0.5) / float(1 << 32)) / w)
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")


def sharded(docs: DataFrame, weights: list[float] | None = None, added: float = 1.0) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('key'), shard, slot (its place in the shard, gapless from 0), grown_shard (its shard if one of weight `added` were there too).

    Slots follow a hash of doc_id and text_crc32, then doc_id, size and text_crc32. Rows that are equal in these are counted first and numbered as one, then come back in parts of COPIES, each a task's work of its own; the others are numbered in blocks of each shard, so that no task sees a whole shard, nor all rows of one id or text. Null texts are empty and null ids one more key; rows that repeat each have a slot; other columns are ignored.
    """
    weights = weights or [1.0] * 8
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key_hashes(doc_id, range(-1, len(weights) + 1)).alias("hashes"),
    )
    own = F.slice("hashes", 2, len(weights) + 1)
    place = F.get(mixed32(F.array(F.get("hashes", F.lit(0)).bitwiseXOR(F.col("text_crc32")))), F.lit(0))
    rows = rows.select("doc_id", "size", "text_crc32", rendezvous(own, weights).alias("shard"), rendezvous(own, [*weights, added]).alias("grown_shard"), place.alias("place"))
    rows = rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard", "place").agg(F.count("*").alias("n_alike"))
    n_blocks = max(1, -(-docs.count() // (SLOT_BLOCK * len(weights))))
    rows = rows.withColumn("block", F.floor(F.col("place") * n_blocks / float(1 << 32)).cast("long"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").agg(F.sum("n_alike").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).select("shard", "block", "start")
    within = Window.partitionBy("shard", "block").orderBy("place", F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("before", F.coalesce(F.sum("n_alike").over(within), F.lit(0))).join(starts, ["shard", "block"])
    numbered = written(numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("before")).alias("first"), "n_alike", "grown_shard"), "numbered")
    return copies(numbered, "first", "n_alike", "slot").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _mixed_sql(table: str, column: str, more: str) -> str:
    """The steps of mixed32() over a column, one subquery each, so that no expression is repeated."""
    for _ in range(2):
        table = f"(SELECT {more}, (xor({column}, {column} >> 16) * {0x45D9F3B}) & {MASK} AS {column} FROM {table})"
    return f"(SELECT {more}, xor({column}, {column} >> 16) AS {column} FROM {table})"


def oracle(n_shards: int = 8) -> str:
    """The same in DuckDB, for shards of equal weight: then the least -ln(u) is the greatest u. It has no CRC-32, so a table of 256 remainders is made and folded over the bytes."""
    seeds = ", ".join(f"({s}, {mixed_int(s)})" for s in range(-1, n_shards + 1))
    base = _mixed_sql(f"(SELECT doc_id, size, crc, coalesce(doc_id, -1) & {MASK} AS low, (coalesce(doc_id, -1) >> 32) & {MASK} AS k FROM sized)", "k", "doc_id, size, crc, low")
    base = _mixed_sql(f"(SELECT doc_id, size, crc, xor(low, k) AS k FROM {base})", "k", "doc_id, size, crc")
    each = _mixed_sql(f"(SELECT doc_id, size, crc, s, xor(k, seed) AS k FROM {base}, (VALUES {seeds}) AS seeds(s, seed))", "k", "doc_id, size, crc, s")
    return f"""
        WITH RECURSIVE remainders(b, k, v) AS (
            SELECT b::BIGINT, 0, b::BIGINT FROM range(256) AS r(b)
            UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM remainders WHERE k < 8),
        folding AS (SELECT list(v ORDER BY b) AS t FROM remainders WHERE k = 8),
        bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
        sized AS (
            SELECT doc_id, n + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
            FROM bytes, folding),
        placed AS (
            SELECT doc_id, size, crc, arg_max(s, (k, -s)) FILTER (WHERE s BETWEEN 0 AND {n_shards - 1}) AS shard, arg_max(s, (k, -s)) FILTER (WHERE s >= 0) AS grown, max(k) FILTER (WHERE s = -1) AS place
            FROM {each} GROUP BY doc_id, size, crc),
        spread AS (SELECT * FROM {_mixed_sql("(SELECT doc_id, size, crc, shard, grown, xor(place, crc) AS k FROM placed)", "k", "doc_id, size, crc, shard, grown")})
        SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST, size, crc) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
        FROM spread"""
