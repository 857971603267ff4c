"""Near-duplicate groups by HyperMinHash registers, banding and verification.

1. Each text becomes the set of its word shingles (64-bit hashes), the set a sketch: the hash range is cut into equal buckets, and of each bucket's least hash a register keeps the number of leading zeros and MANTISSA bits after them. Equal sets fall together by a 128-bit key of the set, so copies cost one row from then on.
2. Bands of registers are the keys of buckets of sets. The number of bands is such that two sets at the threshold share none in one of a million cases.
3. In the first bands, each bucket's first set (that of the least doc_id, so rather an original than a copy) is compared with the other members: the register estimate, corrected for chance collisions, discards pairs far below the threshold, and the rest is counted on the full sets. A bucket's members stream past its first set in parts of BLOCK, so no task holds a large group and no row carries two sets. The links' connected components are found.
4. Every bucket that still holds different components is then settled: each member outside the bucket's largest component is compared with the members of other components, inside tasks that hold a block of about BLOCK of the former and one of the latter; first by sketches, which gives out the members with any hopeful partner, then these on the full sets, which gives out only links that join components. Buckets that have become one component need no more pairs, and a large one with a few strays costs a row for each member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import batches_by_bytes, documents, ids_for_join, sorted_groups, written
from .spans import U64, mixed, word_hashes

MANTISSA = 10
#: Chance that two different least hashes give the same register: about a third for the zeros, then the mantissa.
CHANCE = 1 / 3 / (1 << MANTISSA)
#: Pairs whose estimate is so many standard deviations below the threshold are not verified.
DEVIATIONS = 6
#: Bands whose buckets are compared with their least member first, and members of a block.
FIRST_BANDS, BLOCK = 6, 512
#: Shingles of one block, about 60 bytes each where blocks are compared on full sets.
BLOCK_SHINGLES = 1_500_000
MULTIPLIERS = mixed(np.arange(1, 65, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)


class Shape:
    """Sizes of the sketch for a threshold in per cent."""

    def __init__(self, shingle: int, percent: int):
        self.shingle, self.percent = shingle, percent
        t = percent / 100
        self.rows = max(1, min(5, int(math.log(0.4) / math.log(t)) if t < 1 else 5))
        self.bands = math.ceil(math.log(1e-6) / math.log(1 - t**self.rows)) if t < 1 else 1
        self.registers = self.rows * self.bands
        self.bounds = np.array([-(-(i << 64) // self.registers) for i in range(self.registers)], dtype=U64)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a string column; of a text with fewer words, one hash of all."""
    hashes, begins = word_hashes(column)
    n = max(0, len(hashes) - k + 1)
    rolled = np.zeros(n, dtype=U64)
    for j in range(k):
        rolled += hashes[j : j + n] * MULTIPLIERS[j]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mixed(np.array([int((hashes[a:b] * MULTIPLIERS[: b - a]).sum(dtype=U64)) ^ (b - a)], dtype=U64)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def registers(sets: list[np.ndarray], shape: Shape) -> np.ndarray:
    """A row of 16-bit registers for each set; 0 is an empty bucket."""
    out = np.zeros((len(sets), shape.registers), dtype=np.uint16)
    least = np.zeros((len(sets), shape.registers), dtype=U64)
    full = np.zeros((len(sets), shape.registers), dtype=bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, shape.bounds)
            upto = np.append(at[1:], len(s))
            full[i] = at < upto
            least[i] = s[np.minimum(at, len(s) - 1)]
    values = ((least - shape.bounds[None, :]) * U64(shape.registers))[full]
    fraction, exponent = np.frexp(values.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    kept_bits = np.clip(((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0, (1 << MANTISSA) - 1)
    out[full] = (zeros * (1 << MANTISSA) + kept_bits + 1).astype(np.uint16)
    return out


def band_keys(sketch: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """A key of each band of each sketch, and whether the band has any full bucket."""
    parts = sketch.reshape(len(sketch), shape.bands, shape.rows).astype(U64)
    keys = np.broadcast_to(MULTIPLIERS[:1] * np.arange(1, shape.bands + 1, dtype=U64), parts.shape[:2]).copy()
    for j in range(shape.rows):
        keys = mixed(keys * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys, parts.any(axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketches (rows), corrected for chance collisions, and the number of buckets each is from."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    raw = equal / np.maximum(used, 1)
    return np.clip((raw - CHANCE) / (1 - CHANCE), 0, 1), used


def hopeful(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that the estimate doesn't rule out."""
    guess, used = estimate(a, b)
    t = percent / 100
    return (used < 16) | (guess >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


def linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + m - inter)


SIGNATURE = "doc_id long, n_shingles long, key1 long, key2 long, sketch binary, bands array<long>"


def signatures(docs: DataFrame, shape: Shape) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text"), shape.shingle)
            sketch = registers(sets, shape)
            keys, full = band_keys(sketch, shape)
            sizes = [len(s) for s in sets]
            key1, key2 = set_keys(sets)
            bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * shape.bands, pa.array(keys.view(np.int64).ravel(), mask=~full.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array([row.tobytes() for row in sketch], pa.binary()), bands], names=["doc_id", "n_shingles", "key1", "key2", "sketch", "bands"])

    return documents(docs).mapInArrow(run, SIGNATURE)


def set_id(key1: Column | str, key2: Column | str, n_shingles: Column | str) -> Column:
    """A set's id: 64 bits of its 128-bit key and size (of 10 million sets, two share one in about 3 cases of a million)."""
    return F.xxhash64(key1, key2, n_shingles)


def set_keys(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """The two halves of each set's key."""
    return [int(s.sum(dtype=U64).view(np.int64)) for s in sets], [int(np.bitwise_xor.reduce(mixed(s)).view(np.int64)) if len(s) else 0 for s in sets]


def full_sets(docs: DataFrame, wanted: DataFrame, shape: Shape) -> DataFrame:
    """id, sketch and hashes (8 bytes each, ascending) of the sets that are asked for (id, and doc_id of a document that has the set). Of several texts of that doc_id, only the one with this very set counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text"), shape.shingle)
            key1, key2 = set_keys(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([row.tobytes() for row in registers(sets, shape)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "key1", "key2", "n_shingles", "sketch", "hashes"])

    wanted = ids_for_join(written(wanted.select("doc_id", "id").distinct(), "wanted"))
    some = documents(docs).join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(run, "doc_id long, key1 long, key2 long, n_shingles long, sketch binary, hashes binary")
    some = some.withColumn("id", set_id("key1", "key2", "n_shingles")).join(wanted, ["doc_id", "id"], "left_semi")
    return written(some.select("id", "sketch", "hashes").dropDuplicates(["id"]), "full-sets")


def streamed(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Columns of `sets` (by id) for pairs (u, v), in rows that follow one another in a task: u's row (v is null), then those of its partners. The partners of one u come in parts of about BLOCK, each after a row of u's own."""
    many = written(pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_parts")).where("n_parts > 1"), "many")
    pairs = pairs.join(ids_for_join(many), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("n_parts", F.lit(1))).cast("int").alias("part"))
    heads = pairs.select("u", "part").distinct().join(sets.select(F.col("id").alias("u"), *columns), "u").withColumn("v", F.lit(None).cast("long"))
    tails = pairs.join(sets.select(F.col("id").alias("v"), *columns), "v")
    rows = heads.unionByName(tails).select("u", "part", "v", *columns)
    return rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())


def hopeful_pairs(pairs: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (u, v) that sizes and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch, sizes = sketches(batch.column("sketch")), batch.column("n_shingles").to_numpy()
            if head is not None:  # the last batch's last u may go on
                sketch, sizes = np.concatenate((head[0], sketch)), np.concatenate((head[1], sizes))
            is_head = np.concatenate((np.ones(len(sizes) - batch.num_rows, dtype=bool), batch.column("v").is_null().to_numpy(zero_copy_only=False)))
            at = np.maximum.accumulate(np.where(is_head, np.arange(len(sizes)), 0))
            fine = ~is_head & (100 * np.minimum(sizes, sizes[at]) >= shape.percent * np.maximum(sizes, sizes[at]))
            fine[fine] = hopeful(sketch[fine], sketch[at[fine]], shape.percent)
            fine, head = fine[len(fine) - batch.num_rows :], (sketch[at[-1:]], sizes[at[-1:]])
            yield batch.select(["u", "v"]).filter(pa.array(fine))

    return streamed(pairs, sets, "n_shingles", "sketch").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, full: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (u, v) that are links on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches_by_bytes(batches, "hashes", 16 << 20):
            found = []
            for i, (v, content) in enumerate(zip(batch.column("v").to_pylist(), batch.column("hashes"), strict=True)):
                own = np.frombuffer(content.as_py(), dtype=U64)
                if v is None:
                    head = own
                elif linked(len(np.intersect1d(head, own, assume_unique=True)), len(head), len(own), shape.percent):
                    found.append(i)
            yield batch.select(["u", "v"]).take(pa.array(found, pa.int64()))

    return streamed(pairs, full, "hashes").mapInArrow(run, "u long, v long")


def sketches(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint16).reshape(len(rows), -1)


def partners(x: int, ids: np.ndarray, groups: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, guests: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The guests that the host x is to be compared with: those of other groups, of its own block only those of higher id, without those that sizes or sketches rule out."""
    fits = (groups[guests] != groups[x]) & ((blocks[guests] != blocks[x]) | (ids[guests] > ids[x])) & (100 * sizes[guests] >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes[guests])
    at = guests[fits]
    return at[hopeful(sketch[at], sketch[x][None, :], percent)] if len(at) else at


def with_partners(ids: np.ndarray, groups: np.ndarray, blocks: np.ndarray, hosts: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have a partner at all."""
    guests, out = np.flatnonzero(~hosts), np.zeros(len(groups), dtype=bool)
    for x in np.flatnonzero(hosts):
        at = partners(x, ids, groups, blocks, sizes, guests, sketch, percent)
        out[at] = True
        out[x] |= len(at) > 0
    return out


def joined_within(ids: np.ndarray, groups: np.ndarray, blocks: np.ndarray, hosts: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different groups: groups that a link has joined count as one from then on, so there are fewer links than groups."""
    sizes = np.array([len(s) for s in sets])
    groups = np.unique(groups, return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    guests, flags, found = np.flatnonzero(~hosts), np.zeros(len(values), dtype=bool), []
    for x in np.flatnonzero(hosts):
        at = partners(x, ids, groups, blocks, sizes, guests, sketch, percent)
        if not len(at):
            continue
        own = flat[begins[x] : begins[x] + sizes[x]]
        flags[own] = True
        inter = np.add.reduceat(flags[flat], begins, dtype=np.int64)[at] if len(at) > 32 else np.array([np.count_nonzero(flags[flat[begins[y] : begins[y] + sizes[y]]]) for y in at])
        flags[own] = False
        at = at[linked(inter, sizes[x], sizes[at], percent)]
        for y in at[np.unique(groups[at], return_index=True)[1]]:
            found.append((int(ids[x]), int(ids[y])))
            groups[groups == groups[y]] = groups[x]
    return found


#: What tells one comparison of two blocks from the others.
TOGETHER = ["key", "host_block", "guest_block"]


def roles(members: DataFrame) -> DataFrame:
    """Members (key, id, component, n_shingles) of buckets that hold different components, once for each comparison that they take part in: host_block and guest_block name it, host says on which side they are, block is a host's own block (else -1).

    Hosts are the members outside the bucket's largest component. Each meets every member of that component once, and each pair of hosts meets once. With n members, r of them hosts, that is n + r rows up to a block of BLOCK hosts, and n * r / BLOCK beyond. Blocks hold BLOCK_SHINGLES shingles in all, about, where texts are long (or one longer set): a comparison holds two blocks.
    """
    open_ = members.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    sizes = members.join(open_, "key").groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("width"))
    buckets = sizes.groupBy("key").agg(F.max_by(F.struct("component", "n", "width"), F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.sum("width").alias("width"))
    n_hosts, host_width = F.col("n") - F.col("largest.n"), F.col("width") - F.col("largest.width")
    n_blocks = lambda n, width: F.greatest(F.ceil(n / BLOCK), F.ceil(width / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.select("key", F.col("largest.component").alias("largest"), n_hosts.alias("n_hosts"), n_blocks(n_hosts, host_width).alias("n_blocks"), n_blocks(F.col("n"), F.col("width")).alias("n_guest_blocks"))
    rows = members.join(buckets, "key").withColumn("host", F.col("component") != F.col("largest"))
    rows = rows.withColumn("block", F.when(F.col("host"), F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")).otherwise(-1)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n_guest_blocks")).cast("int"))
    as_host = rows.where("host").select("key", "id", "component", "host", "block", F.col("block").alias("host_block"), F.explode(F.sequence(F.lit(0), F.col("n_guest_blocks") - 1)).alias("guest_block"))
    as_guest = rows.where("NOT host OR n_hosts > 1").select("key", "id", "component", F.lit(False).alias("host"), "block", F.explode(F.sequence(F.greatest("block", F.lit(0)), F.col("n_blocks") - 1)).alias("host_block"), F.col("own").alias("guest_block"))
    return as_host.unionByName(as_guest)


def dealt(members: DataFrame, more: DataFrame, *columns: str) -> DataFrame:
    """roles() with columns of `more` (by id), the rows of one comparison together in one task."""
    rows = roles(members).join(more, "id").select(*TOGETHER, "id", "component", "block", "host", *columns)
    return rows.repartition(*TOGETHER).sortWithinPartitions(*TOGETHER, "id", "host")


def hopeful_members(members: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    """The members that the sketches leave a partner of another component in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in sorted_groups(batches, TOGETHER):
            ids, groups, blocks, sizes = (table.column(c).to_numpy() for c in ("id", "component", "block", "n_shingles"))
            hosts, sketch = table.column("host").to_numpy(), sketches(table.column("sketch"))
            marks = [with_partners(ids[a:b], groups[a:b], blocks[a:b], hosts[a:b], sizes[a:b], sketch[a:b], shape.percent) for a, b in zip(begins, [*begins[1:], table.num_rows], strict=True)]
            yield from table.select(["key", "id", "component", "n_shingles"]).filter(pa.array(np.concatenate(marks))).combine_chunks().to_batches()

    return dealt(members, sets.select("id", "n_shingles", "sketch"), "n_shingles", "sketch").mapInArrow(run, "key long, id long, component long, n_shingles long").distinct()


def settled(members: DataFrame, full: DataFrame, shape: Shape) -> DataFrame:
    """Links (u, v) between the different components of each bucket, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in sorted_groups(batches, TOGETHER):
            ids, groups, blocks = (table.column(c).to_numpy() for c in ("id", "component", "block"))
            hosts, sketch, content = table.column("host").to_numpy(), sketches(table.column("sketch")), table.column("hashes")
            found = []
            for a, b in zip(begins, [*begins[1:], table.num_rows], strict=True):
                sets = [np.frombuffer(x, dtype=U64) for x in content.slice(a, b - a).to_pylist()]
                found += joined_within(ids[a:b], groups[a:b], blocks[a:b], hosts[a:b], sketch[a:b], sets, shape.percent)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    return dealt(members, full, "sketch", "hashes").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links lead to, itself included), kept (doc_id = component_id), n_copies (documents with the same set).

    Texts are lower-cased (A-Z) and cut into words at white space; two are linked if 100 * intersection >= percent * union of their sets of `shingle` consecutive words. A text with fewer words has one shingle of all of them; a null, empty or blank text has none and links with nothing, not even with another such text. Rows that repeat come out as often as they went in; rows of one doc_id with different texts are linked each by its own text. A null doc_id can't be linked: its component is null and it is kept. Other columns are ignored.
    """
    shape = Shape(shingle, percent)
    signs = written(signatures(docs, shape), "signatures")
    sets = signs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("n_copies"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    sets = written(sets.withColumn("id", set_id("key1", "key2", "n_shingles")), "sets")
    rows = sets.select("id", "least_doc", "n_shingles", F.posexplode("bands").alias("band", "key")).where("key IS NOT NULL")
    buckets = rows.groupBy("key").agg(F.count("*").alias("n_members"), F.min_by("id", "least_doc").alias("first")).where("n_members > 1")
    members = written(rows.drop("least_doc").join(buckets, "key"), "members")
    pairs = members.where((F.col("band") < FIRST_BANDS) & (F.col("id") != F.col("first"))).select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    pairs = written(hopeful_pairs(written(pairs, "first-pairs"), sets, shape), "pairs")
    holders = sets.select("id", F.col("least_doc").alias("doc_id"))
    full = full_sets(docs, holders.join(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id"), shape)
    first = components(verified(pairs, full, shape))

    placed = members.select("key", "id", "n_shingles").join(first, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"), "n_shingles")
    unsettled = written(hopeful_members(placed, sets, shape), "unsettled")
    full = full_sets(docs, holders.join(unsettled.select("id").distinct(), "id"), shape)
    more = settled(unsettled, full, shape)
    found = components(more.unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    # The components' ids are sets' ids so far.
    classes = sets.join(found, F.col("id") == F.col("node"), "left").select("key1", "key2", "n_shingles", F.coalesce("component", "id").alias("component"), "least_doc", "n_copies")
    heads = classes.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    classes = classes.join(heads, "component").select("key1", "key2", "n_shingles", "component_id", "n_copies")
    whole = signs.select("doc_id", "n_shingles", "key1", "key2").join(classes, ["key1", "key2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
