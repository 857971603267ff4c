"""Approximate nearest neighbours by cosine, from a hash-prefix forest.

1. Equal vectors become one entry. Each of TREES trees gives an entry a long hash string: first the cross-polytope symbol of a random rotation (place and sign of the largest coordinate), then PAIRS symbols of two bits, each of two more directions.
2. A tree is the sorted array of its strings, written once. It is cut into parts of about PART_ROWS entries (by quantiles of a sample of strings, and only where there are more), so a task holds one part of one tree, and no task meets all entries or all queries.
3. A query descends each tree to its place in the sorted array. Its longest-prefix matches stand beside it: each tree gives `window` entries on either side with the number of symbols that they share.
4. All trees then ascend together, symbol by symbol from the longest match, until the entries found come to `budget` different ones; an entry's level is taken whole.
5. Candidates meet their vectors in shards and get the exact cosine in double precision.

Window and budget are WINDOW and BUDGET at least, and as much more as the table needs: PILOT of the queries are compared with all entries, the trees are asked for these queries with a wide window, and the narrowest window that finds TARGET of their true neighbours is taken for all (with a window as wide as a part as the last step). So recall holds whatever the table's size and shape, and its price shows in n_looked: vectors that lie in groups need the least window at any size, directions without any structure need more the more there are.

Work and shuffle are in proportion to the rows (TREES strings for each) and to `budget` for each query. An entry at a part's border sees the window's inner half only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import written
from .spans import U64, mixed

TREES, AXES, PAIRS = 224, 64, 28
#: Entries on either side that a tree gives, and different entries after which the trees stop ascending, at least.
WINDOW, BUDGET = 16, 4096
#: Queries that are compared with all entries, and the share of their neighbours that the trees have to find; the sampling error of 200 queries is about 0.01.
PILOT, TARGET = 200, 0.935
#: The first window that the pilot tries goes so many times beyond WINDOW.
WIDER = 4
#: Entries of a tree in one task, about; of a shard of vectors, at least and (beyond SHARDS shards) at most; queries that meet a shard at once. Strings sampled for each cut.
PART_ROWS, SHARD_ROWS, MOST_SHARD_ROWS, SHARDS, TOGETHER, SAMPLED = 1 << 18, 1024, 1 << 14, 64, 50_000, 256
#: Rows whose strings go together, and rows (or pairs) that are computed at a time, few enough for a core's own cache.
HASHED, CACHED = 4096, 512


@functools.lru_cache(maxsize=2)
def directions(dim: int) -> np.ndarray:
    """For each tree, AXES directions (fewer in fewer dimensions) of the first symbol and 2 * PAIRS of the others, at right angles as far as the dimension allows."""
    rng = np.random.default_rng(dim)

    def some(n: int) -> np.ndarray:
        blocks = [np.linalg.qr(rng.normal(size=(dim, min(dim, n))))[0] for _ in range(-(-n // dim))]
        return np.concatenate(blocks, axis=1)[:, :n]

    return np.stack([np.concatenate((some(min(dim, AXES)), some(2 * PAIRS)), axis=1) for _ in range(TREES)]).astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is between 0.5 and 1: squares neither overflow nor vanish, and cosines stay the same."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def strings(vectors: np.ndarray) -> np.ndarray:
    """The hash strings (tree, vector) as 63-bit integers, the first symbol highest."""
    units = scaled(vectors)
    units = (units / np.sqrt((units * units).sum(axis=1, keepdims=True))).astype(np.float32)
    axes, out = min(vectors.shape[1], AXES), np.empty((TREES, len(vectors)), dtype=np.int64)
    for a in range(0, len(units), CACHED):
        some = units[a : a + CACHED]
        n = len(some)
        packed, bits = np.empty((n, 8), dtype=np.uint8), np.empty((n, PAIRS, 2), dtype=bool)
        for tree, rotation in enumerate(directions(vectors.shape[1])):
            turned = some @ rotation
            place = np.abs(turned[:, :axes]).argmax(axis=1)
            packed[:, 0] = 2 * place + (turned[np.arange(n), place] > 0)
            first, second = turned[:, axes : axes + PAIRS], turned[:, axes + PAIRS :]
            np.greater(np.abs(second), np.abs(first), out=bits[:, :, 0])
            bits[:, :, 1] = np.where(bits[:, :, 0], second, first) > 0
            packed[:, 1:] = np.packbits(bits.reshape(n, 2 * PAIRS), axis=1)
            out[tree, a : a + n] = packed.view(">i8").ravel()
    return out


def shared_symbols(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols two strings have in common before the first that differs."""
    _, length = np.frexp((a ^ b).astype(np.float64))
    return np.maximum(0, 1 + (2 * PAIRS - length) // 2).astype(np.int8)


def sorted_tree(keys: np.ndarray, ids: np.ndarray, tree: int) -> np.ndarray:
    """The order of a tree's strings. Equal strings stand in an order of the tree's own."""
    return np.lexsort((mixed(ids.view(U64) ^ U64(tree + 1 << 40)), keys))


def matches(keys: np.ndarray, ids: np.ndarray, asked: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids asked for, and for each its longest-prefix matches in a sorted array of strings: ids and symbols shared (-1 where the array ends), in order of their places."""
    at = np.flatnonzero(asked)
    places = at[:, None] + np.concatenate((np.arange(-window, 0), np.arange(1, window + 1)))
    inside = (places >= 0) & (places < len(keys))
    places = np.clip(places, 0, len(keys) - 1)
    return ids[at], ids[places], np.where(inside, shared_symbols(keys[places], keys[at][:, None]), -1).astype(np.int8)


def ascended(ids: np.ndarray, levels: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """The different ids whose longest match over all trees has `level` symbols or more, and that level: the highest at which they are `budget`, else 0."""
    order = np.lexsort((-levels, ids))
    ids, levels = ids[order], levels[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    ids, levels = ids[first], levels[first]
    found = np.cumsum(np.bincount(levels, minlength=PAIRS + 2)[::-1])
    level = max(0, PAIRS + 1 - int(np.searchsorted(found, budget)))
    return ids[levels >= level], level


def shards_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (mixed(ids.view(U64)) % U64(n)).astype(np.int32)


def usable(vectors: Column) -> Column:
    """Neither null nor empty nor all zero, and every component finite."""
    fine = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vectors, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A row of doubles for each of some lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blobs(entries: DataFrame, cuts: dict[int, np.ndarray]) -> DataFrame:
    """The strings of entries (rep, dim, vector, asked) by dim, tree and part: keys, ids and flags, some rows of a task together. cuts: for lengths of several parts, where they begin (tree, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for start in range(0, own.num_rows, HASHED):
                    yield hashed(own.slice(start, HASHED), dim)

    def hashed(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        ids, asked = batch.column("rep").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
        rows = []
        for tree, keys in enumerate(strings(matrix(batch.column("vector")))):
            parts = np.searchsorted(cuts[dim][tree], keys, side="right") if dim in cuts else np.zeros(len(keys), dtype=np.int64)
            order = np.argsort(parts, kind="stable")
            begins = np.flatnonzero(np.diff(parts[order], prepend=-1)).tolist()
            for a, b in zip(begins, [*begins[1:], len(order)], strict=True):
                at = order[a:b]
                rows.append((dim, tree, int(parts[at[0]]), keys[at].tobytes(), ids[at].tobytes(), asked[at].tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 3 + [pa.binary()] * 3, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["dim", "tree", "part", "keys", "ids", "flags"])

    return entries.select("rep", "dim", "vector", "asked").mapInArrow(run, "dim int, tree int, part int, keys binary, ids binary, flags binary")


def joined(group: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), dtype=kind)


def quantiles(n_parts: int) -> Callable[[pa.Table], pa.Table]:
    """Where a tree's parts begin, by a sample of its strings."""

    def run(group: pa.Table) -> pa.Table:
        keys = np.sort(joined(group, "keys", "<i8"))
        cuts = keys[np.arange(1, n_parts) * len(keys) // n_parts]
        return pa.table({"tree": pa.array([group.column("tree")[0].as_py()], pa.int32()), "cuts": pa.array([cuts.tolist()], pa.list_(pa.int64()))})

    return run


def part_cuts(entries: DataFrame) -> dict[int, np.ndarray]:
    """For each length with more than PART_ROWS entries, where each tree's parts begin: quantiles of a sample's strings. One row for each PART_ROWS entries at most comes to the driver, and TREES numbers for each cut."""
    sizes = entries.groupBy("dim").count().where(F.col("count") > PART_ROWS).collect()
    out = {}
    for dim, n in sizes:
        n_parts = -(-n // PART_ROWS)
        some = entries.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLED * n_parts / n))))
        found = blobs(some, {}).groupBy("tree").applyInArrow(quantiles(n_parts), "tree int, cuts array<long>").collect()
        if found:
            out[dim] = np.array([r["cuts"] for r in sorted(found, key=lambda r: r["tree"])], dtype=np.int64)
    return out


def forest(entries: DataFrame) -> DataFrame:
    """The sorted arrays: a row for each part of each tree, with its keys, ids and flags (of entries that are asked for)."""

    def sort(group: pa.Table) -> pa.Table:
        keys, ids, flags = joined(group, "keys", "<i8"), joined(group, "ids", "<i8"), joined(group, "flags", "?")
        order = sorted_tree(keys, ids, group.column("tree")[0].as_py())
        return pa.table({"keys": pa.array([keys[order].tobytes()], pa.binary()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "flags": pa.array([flags[order].tobytes()], pa.binary())})

    return written(blobs(entries, part_cuts(entries)).groupBy("dim", "tree", "part").applyInArrow(sort, "keys binary, ids binary, flags binary"), "forest")


def descended(trees: DataFrame, window: int, only: np.ndarray | None = None) -> DataFrame:
    """query, ids and levels: what each part of each tree gives for the entries that are asked for (of these, `only` some, if given)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, ids, flags = (np.frombuffer(batch.column(c)[row].as_py(), dtype=kind) for c, kind in (("keys", "<i8"), ("ids", "<i8"), ("flags", "?")))
                query, found, levels = matches(keys, ids, flags if only is None else flags & np.isin(ids, only), window)
                for a in range(0, len(query), HASHED):
                    rows = slice(a, a + HASHED)
                    yield pa.RecordBatch.from_arrays([pa.array(query[rows], pa.int64()), pa.array([x.tobytes() for x in found[rows]], pa.binary()), pa.array([x.tobytes() for x in levels[rows]], pa.binary())], names=["query", "ids", "levels"])

    return trees.mapInArrow(search, "query long, ids binary, levels binary")


def exact(entries: DataFrame, pilot: list, top: int) -> dict[int, list[int]]:
    """The true neighbours (reps) of each of some entries (rep, dim, vector), by comparing them with all entries in blocks. The driver gets `top` for each."""
    spark = entries.sparkSession
    by_dim = {dim: (np.array([p["rep"] for p in own]), np.array([p["vector"] for p in own], dtype=np.float64)) for dim in {p["dim"] for p in pilot} for own in [[p for p in pilot if p["dim"] == dim]]}
    sent = spark.sparkContext.broadcast({dim: (reps, (lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True)))(scaled(vectors))) for dim, (reps, vectors) in by_dim.items()})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim, (reps, units) in sent.value.items():
                own = batch.filter(pa.array(dims == dim))
                if not own.num_rows:
                    continue
                ids, theirs = own.column("rep").to_numpy(), scaled(matrix(own.column("vector")))
                scores = units @ (theirs / np.sqrt((theirs * theirs).sum(axis=1, keepdims=True))).T
                scores[reps[:, None] == ids[None, :]] = -np.inf
                best = np.argpartition(-scores, min(top, scores.shape[1]) - 1, axis=1)[:, :top]
                found = np.take_along_axis(scores, best, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps, best.shape[1])), pa.array(ids[best].ravel()), pa.array(found.ravel())], names=["query", "rep", "score"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    rows = entries.select("rep", "dim", "vector").mapInArrow(compare, "query long, rep long, score double").where("score > double('-infinity')")
    out: dict[int, list[int]] = {p["rep"]: [] for p in pilot}
    for query, rep in rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).select("query", "rep").collect():
        out[query].append(rep)
    return out


def tuned(trees: DataFrame, entries: DataFrame, top: int) -> int:
    """The window that finds TARGET of the neighbours of PILOT queries, with a budget in proportion; WINDOW at least."""
    pilot = entries.where("asked").orderBy(F.xxhash64("rep")).limit(PILOT).select("rep", "dim", "vector").collect()
    truth = exact(entries, pilot, top)
    wanted, some = sum(map(len, truth.values())), np.sort(np.array(list(truth), dtype=np.int64))
    widest = WINDOW * WIDER
    while True:
        ladder = {w: budget_of(w) for k in range(64) for w in (WINDOW << k, 3 * WINDOW << k >> 1) if w <= widest}

        def hits(group: pa.Table) -> pa.Table:  # runs within this turn of the loop
            query = group.column("query")[0].as_py()
            ids, levels = (joined(group, c, kind).reshape(-1, 2 * widest) for c, kind in (("ids", "<i8"), ("levels", "i1")))
            found = []
            for window, budget in ladder.items():
                own, shared = (x[:, widest - window : widest + window].ravel() for x in (ids, levels))
                looked = ascended(own[shared >= 0], shared[shared >= 0], budget)[0] if (shared >= 0).any() else own[:0]
                found.append(int(np.isin(truth[query], looked).sum()))
            return pa.table({"window": pa.array(list(ladder), pa.int32()), "hits": pa.array(found, pa.int64())})

        counts = dict(descended(trees, widest, some).groupBy("query").applyInArrow(hits, "window int, hits long").groupBy("window").agg(F.sum("hits")).collect())
        enough = [w for w in ladder if counts.get(w, 0) >= TARGET * wanted]
        if enough or widest >= PART_ROWS or not wanted:
            return enough[0] if enough else max(WINDOW, widest if wanted else WINDOW)
        widest *= WIDER


def budget_of(window: int) -> int:
    return window * BUDGET // WINDOW


def candidates(trees: DataFrame, n_shards: int, window: int, budget: int) -> DataFrame:
    """For each entry that is asked for: query, shard, ids (its candidates of that shard, itself included), level (symbols shared where the trees stopped), n_looked (candidates of all shards, without itself)."""

    def ascend(group: pa.Table) -> pa.Table:
        query = group.column("query")[0].as_py()
        ids, levels = joined(group, "ids", "<i8"), joined(group, "levels", "i1")
        found, level = ascended(ids[levels >= 0], levels[levels >= 0], budget) if (levels >= 0).any() else (ids[:0], 0)
        every = np.append(found, np.int64(query))
        shards = shards_of(every, n_shards)
        order = np.argsort(shards, kind="stable")
        begins = np.flatnonzero(np.diff(shards[order], prepend=-1)).tolist()
        parts = [order[a:b] for a, b in zip(begins, [*begins[1:], len(order)], strict=True)]
        k = len(parts)
        return pa.table({"query": pa.array([query] * k, pa.int64()), "shard": pa.array([int(shards[p[0]]) for p in parts], pa.int32()), "ids": pa.array([every[p].tobytes() for p in parts], pa.binary()), "level": pa.array([level] * k, pa.int32()), "n_looked": pa.array([len(found)] * k, pa.int64())})

    return descended(trees, window).groupBy("query").applyInArrow(ascend, "query long, shard int, ids binary, level int, n_looked long")


def nearest_pairs(asked: pa.Table, own: pa.Table, dim: int, most: int) -> tuple[np.ndarray, ...]:
    """query, rep, score, level and n_looked of the `most` best candidates of each query among a shard's entries of one length."""
    asked, own = (t.filter(pc.equal(t.column("dim"), dim)).combine_chunks().sort_by(key) for t, key in ((asked, "query"), (own, "rep")))
    content = asked.column("ids").to_pylist()
    row = np.repeat(np.arange(asked.num_rows), [len(x) // 8 for x in content])
    ids, reps = np.frombuffer(b"".join(content), dtype="<i8"), own.column("rep").to_numpy()
    at = np.searchsorted(reps, ids)
    theirs, mine = (scaled(matrix(t.column("vector").combine_chunks())) for t in (own, asked))
    lengths = [np.sqrt((x * x).sum(axis=1)) for x in (theirs, mine)]
    score = np.empty(len(ids))
    for a in range(0, len(ids), CACHED):
        i, j = at[a : a + CACHED], row[a : a + CACHED]
        score[a : a + CACHED] = (theirs[i] * mine[j]).sum(axis=1) / (lengths[0][i] * lengths[1][j])
    order = np.lexsort((ids, -score, row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    best = order[place < most]
    query, level, n_looked = (asked.column(c).to_numpy()[row[best]] for c in ("query", "level", "n_looked"))
    return query, ids[best], score[best], level, n_looked


def cosines(found: DataFrame, entries: DataFrame, n_shards: int, n_blocks: int, most: int) -> DataFrame:
    """query, rep and score of each query's `most` nearest candidates of each shard, ties to the smaller rep; level and n_looked. A query's vector goes once to each shard that it has candidates in; of very many queries, a shard meets one block after the other."""

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("shard", pa.array(shards_of(batch.column("rep").to_numpy(), n_shards), pa.int32()))

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        found = [nearest_pairs(asked, own, dim, most) for dim in pc.unique(asked.column("dim")).to_pylist()] if own.num_rows else []
        names = ("query", "rep", "score", "level", "n_looked")
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
        return pa.table({n: pa.array(np.concatenate([f[k] for f in found]) if found else [], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    schema = StructType([*entries.schema.fields, StructField("shard", IntegerType())])
    own = entries.mapInArrow(sharded, schema).select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "rep", "dim", "vector")
    asked = found.join(entries.where("asked").select(F.col("rep").alias("query"), "dim", "vector"), "query").select("shard", F.pmod(F.xxhash64("query"), F.lit(n_blocks)).cast("int").alias("block"), "query", "dim", "ids", "vector", "level", "n_looked")
    return asked.groupBy("shard", "block").cogroup(own.groupBy("shard", "block")).applyInArrow(run, "query long, rep long, score double, level int, n_looked long")


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, budget: int | None = None) -> DataFrame:
    """For each row whose vec_id is divisible by `every`: query_id, rank (from 1), vec_id and score (cosine) of its `top` nearest other rows that were found, nearest first, ties to the smaller vec_id; level (symbols shared where the trees stopped) and n_looked (different vectors looked at).

    Rows with a null vec_id and vectors that are null, empty, zero or hold a null or a non-finite component take no part; vectors of different length aren't compared. Rows that repeat a vec_id with an equal vector count once; of different vectors under one vec_id, the first by number of components and then by their order stands for it. Other columns are ignored. With a `budget` the trees are asked for so many candidates, else for as many as TARGET takes (see tuned).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct(F.size("vector").alias("dim"), "vector")).alias("v")).select("vec_id", F.col("v.dim").alias("dim"), F.col("v.vector").alias("vector"))
    rows = written(rows.select("vec_id", "dim", "vector", F.xxhash64("vector").alias("same"), F.xxhash64(F.lit(1), "vector").alias("too"), (F.col("vec_id") % every == 0).alias("asked")), "vectors")
    reps = rows.groupBy("same", "too").agg(F.min("vec_id").alias("rep"), F.max("asked").alias("asked"))
    places = rows.where("asked").join(reps, ["same", "too"]).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    entries = rows.drop("asked").join(reps.withColumnRenamed("rep", "vec_id"), ["vec_id", "same", "too"]).select(F.col("vec_id").alias("rep"), "dim", "vector", "asked")
    entries = written(entries, "entries")
    n, n_asked = entries.agg(F.count("*"), F.count_if("asked")).first()
    n_shards = max(1, min(-(-n // SHARD_ROWS), SHARDS), -(-n // MOST_SHARD_ROWS))
    trees = forest(entries)
    # A table of some thousand entries is searched nearly whole.
    window = WINDOW if budget or n <= 2 * BUDGET or not n_asked else tuned(trees, entries, top)

    # One more than asked for, since a query's own row is among them.
    first = Window.partitionBy("same", "too").orderBy("vec_id")
    members = rows.select("same", "too", "vec_id").withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1).join(reps, ["same", "too"]).select("rep", "vec_id")
    by_rep = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = cosines(candidates(trees, n_shards, window, budget or budget_of(window)), entries, n_shards, max(1, -(-n_asked // TOGETHER)), top + 1).withColumn("n", F.row_number().over(by_rep)).where(F.col("n") <= top + 1)
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = best.drop("n").join(members, "rep").withColumn("n", F.row_number().over(by_row)).where(F.col("n") <= top + 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = places.join(best.drop("n", "rep"), "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.select("query_id", "rank", "vec_id", "score", "level", "n_looked")
