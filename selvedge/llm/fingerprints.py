"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is a closed syncmer if the least of its s-mers, by a fixed hash, is its first or its last. Whether a k-mer is chosen depends on its own bytes alone, so equal passages have the same anchors wherever they stand. A fingerprint is the SIZE least distinct 32-bit hashes of a text's anchors, as hexadecimal; the likeness of two is the Jaccard estimate over the least SIZE of their union (exact when both texts have fewer anchors). The anchors' places tell more: the alignment of a text with another one is the share of its anchors that stand in the other at one and the same shift.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, texts_of, written
from .spans import U64, mixed

#: Bytes of a k-mer and of an s-mer (8 at most), s-mers in a k-mer, hashes in a fingerprint.
K, S, SIZE = 12, 6, 64
WINDOW = K - S + 1
#: Long texts are searched in blocks of so many k-mers, which overlap by K - 1 bytes.
BLOCK = 1 << 16
#: Passages that have an anchor by which they are sought, at most, where they have enough of such.
RARE = 16


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) - K + 1
    padded = np.concatenate((data, np.zeros(8 - S, dtype=np.uint8)))
    order = np.ndarray((n + K - S,), dtype="<u8", buffer=padded, strides=(1,)) & U64((1 << 8 * S) - 1)
    order *= U64(0x9E3779B97F4A7C15)
    order ^= order >> U64(29)
    order *= U64(0xBF58476D1CE4E5B9)
    least, width = order, 1
    while 2 * width <= WINDOW:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:n], least[WINDOW - width : WINDOW - width + n])
    at = np.flatnonzero((order[:n] == least) | (order[WINDOW - 1 : WINDOW - 1 + n] == least))
    hashes = mixed(order[at] ^ (order[at + (K - S) // 2] * U64(0xD6E8FEB86659FD93)) ^ (order[at + K - S] * U64(0xA5CB9243F2CED5C1)))
    return at, (hashes >> U64(32)).astype(np.uint32)


def anchors(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's closed syncmers. A text that has none but isn't empty has itself as its one anchor."""
    found = []
    for at in range(0, max(0, len(content) - K + 1), BLOCK):
        places, hashes = _anchors(np.frombuffer(content, dtype=np.uint8)[at : at + BLOCK + K - 1])
        if len(places):
            found.append((places + at, hashes))
    if not found:
        whole = hashlib.blake2b(content, digest_size=4).digest()
        return (np.zeros(1, dtype=np.int64), np.frombuffer(whole, dtype=np.uint32)) if content else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def fingerprint(content: bytes) -> np.ndarray:
    return least_hashes(anchors(content)[1])


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) > 16 * SIZE:  # the least SIZE distinct ones are nearly always among the least 4 * SIZE
        least = np.unique(np.partition(hashes, 4 * SIZE)[: 4 * SIZE])
        if len(least) >= SIZE:
            return least[:SIZE]
    return np.unique(hashes)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints (two empty ones too), 0 if only one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def alignment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of a's distinct anchors (at their first places), the share that b has at the most frequent shift; 1 if both have none, 0 if one has."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    (own, first), (other, second) = (np.unique(x[1], return_index=True) for x in (a, b))
    at = np.searchsorted(other, own)
    at[at == len(other)] = 0
    both = other[at] == own
    if not both.any():
        return 0.0
    _, counts = np.unique(b[0][second[at[both]]] - a[0][first[both]], return_counts=True)
    return float(counts.max() / len(own))


def as_bytes(hashes: np.ndarray) -> bytes:
    return hashes.astype(">u4").tobytes()


#: What a task of next_document_likeness() writes: its results, and the first and the last text it has (which meet other tasks' texts later).
STEP = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, aligned_edited double, aligned_next double, task int, edge string, text string"
NAMES = [x.split()[0] for x in STEP.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]


def seen(text: str) -> tuple:
    """A text with its anchors and its fingerprint."""
    own = anchors(text.encode())
    return text, own, least_hashes(own[1])


def compared(doc_id: int | None, own: tuple, after: tuple) -> tuple:
    """The result of a document and the next one, both seen()."""
    text, places, prints = own
    n = len(text)
    edited, edited_places, edited_prints = seen(text[: n - n // 4] + after[0][: n // 4])
    return doc_id, n, hashlib.sha256(edited.encode()).digest(), as_bytes(prints), as_bytes(edited_prints), likeness(prints, edited_prints), likeness(prints, after[2]), alignment(places, edited_places), alignment(places, after[1])


def within_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    before = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            now = seen(text)
            if before is None:
                rows.append((doc_id, *[None] * 8, task, "first", text))
            else:
                rows.append((*compared(*before, now), None, None, None))
            before = doc_id, now
        yield as_batch(rows)
    if before is not None:
        yield as_batch([(before[0], *[None] * 8, task, "last", before[1][0])])


def across_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, after in zip(batch.column("doc_id").to_pylist(), texts_of(batch), texts_of(batch, "after"), strict=True):
            rows.append((*compared(doc_id, seen(text), seen(after)), None, None, None))
        yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, TYPES, strict=True)], names=NAMES)


def next_document_likeness(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, its likeness to that of the edited text (the last quarter of the characters replaced by the beginning of the next document), and to that of the next document, by ascending doc_id; the first document follows the last. Beside the likenesses of the fingerprints, the alignments of the anchors' places (aligned_edited, aligned_next).

    The texts are dealt once, by range of doc_id, then of a hash of the text and of the row's place, so that rows of one id are spread too; each task walks its own range; the pairs that two tasks share are formed afterwards from the tasks' first and last texts. Null texts are empty; a null doc_id comes before all others; rows of equal doc_id are ordered by that hash. Other columns are ignored. An empty table gives an empty result, and a single document is its own next one.
    """
    order = ("doc_id", "text_hash", "row")
    ranged = documents(docs).withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    steps = written(ranged.mapInArrow(within_task, STEP), "fingerprints")
    first = steps.where("edge = 'first'").select(F.col("task").alias("to"), F.col("text").alias("after"))
    last = steps.where("edge = 'last'").select("task", "doc_id", "text")
    # One row for each task that had rows: as many as Spark has partitions to schedule, not as many as there are documents.
    tasks = sorted(r.task for r in last.select("task").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, `to` int")
    borders = last.join(follows, "task").join(first, "to").select("doc_id", "text", "after").mapInArrow(across_tasks, STEP)
    hexadecimal = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return steps.where("edge IS NULL").unionByName(borders).select("doc_id", "n_chars", *hexadecimal, "near_edited", "near_next", "aligned_edited", "aligned_next")


def anchor_table(docs: DataFrame) -> DataFrame:
    """doc_id, place (byte offset) and hash of every anchor, for positional matching by a join on hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                places, hashes = anchors(text.encode())
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(hashes.astype(np.int64), pa.int64())], names=["doc_id", "place", "hash"])

    return documents(docs).mapInArrow(run, "doc_id long, place long, hash long")


def shared_passages(docs: DataFrame, passages: DataFrame, least: int = 3) -> DataFrame:
    """Places of `passages` (item_id, text) in the documents: doc_id, item_id, shift (document offset less passage offset), n_anchors on that shift, if at least `least`.

    A passage is sought by its anchors that RARE passages have at most, or by its 2 * `least` rarest if it has fewer of those, each at its first place; so an anchor that all texts share joins nothing by itself.
    """
    ours = anchor_table(docs)
    theirs = anchor_table(passages.select(F.col("item_id").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("item_id"), "hash").agg(F.min("place").alias("at"))
    common = theirs.groupBy("hash").agg(F.count("*").alias("n_passages"))
    rarest = Window.partitionBy("item_id").orderBy("n_passages", "at")
    theirs = theirs.join(common, "hash").withColumn("n", F.row_number().over(rarest)).where((F.col("n_passages") <= RARE) | (F.col("n") <= 2 * least)).select("item_id", "hash", "at")
    return ours.join(theirs, "hash").groupBy("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift")).agg(F.count("*").alias("n_anchors")).where(F.col("n_anchors") >= least)
