"""A quality classifier from weak labels.

1. Heuristic labellers vote good, bad or nothing on each text. The votes of all documents are counted by pattern, of which there are at most 3 ** 9.
2. On these counts, expectation-maximisation estimates the share of good texts and how each labeller votes on good and on bad ones; that gives every pattern a posterior.
3. The posteriors are the soft labels of a linear scorer over hashed words, word shapes and repeats, fitted on a bounded sample. The scorer decides. No human label is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_by_bytes, documents, rows_at_most, sample_at_most, written
from .spans import LOWER, U64, buffers, byte_class, span_hashes, word_spans

#: Rows of the sample that the scorer is fitted on, at most (about so many of a larger table), and hashed weights.
SAMPLE, WEIGHTS = 6000, 1 << 15
ROUNDS, STEP, DECAY = 150, 0.5, 1e-5
#: Weight of what is held of a labeller before the data, as a share of all documents.
PRIOR = 0.01

UPPER = byte_class((65, 90))
LETTER = byte_class((65, 90), (97, 122), (128, 255))
DIGIT = byte_class((48, 57))
SENTENCE = byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3B, 0x3B), (0x3A, 0x3A), (0x3F, 0x3F), (0x27, 0x29), (0x2D, 0x2D), (0x22, 0x22), (0x40, 0x40), (0x2F, 0x2F), (0x5F, 0x5F))
SYMBOL = ~(LETTER | DIGIT | SENTENCE | byte_class((0, 32), (127, 127)))
NOT_NEWLINE = ~byte_class((10, 10))
#: Classes of bytes in a word's shape: upper, lower, figure, sentence mark, other symbol.
SHAPE = np.where(UPPER, 1, np.where(LETTER, 2, np.where(DIGIT, 3, np.where(SENTENCE, 4, 5)))).astype(np.uint8)
#: Frequent short words of some languages.
FREQUENT = "the of and to in is that for with on as are this it was by be from der die und das von zu den mit ist ein eine auf nicht le la les de des et un une dans pour que qui sur pas el los las en por con una del se su y no al lo il di che per non è sono".split()

LABELLERS = ("upper", "symbols", "repeats", "variety", "lines", "digits", "length", "frequent", "sentences")


class Texts:
    """Words of a string column, and what the labellers and the scorer read from them."""

    def __init__(self, column: pa.Array):
        data, self.offsets = buffers(column)
        self.data = data
        self.starts, self.ends, self.begins = word_spans(data, self.offsets)
        lowered = LOWER[data]
        self.words = span_hashes(lowered, self.starts, self.ends)
        self.n_words = np.diff(self.begins)

    def per_text(self, values: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        """Sums of one value for each byte (or whatever begins count) over each text."""
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
        begins = self.offsets if begins is None else begins
        return sums[begins[1:]] - sums[begins[:-1]]

    def repeats(self) -> np.ndarray:
        """Whether each word equals the one before it in its text."""
        same = np.zeros(len(self.words), dtype=bool)
        same[1:] = self.words[1:] == self.words[:-1]
        same[self.begins[:-1][self.n_words > 0]] = False
        return same

    def shapes(self) -> np.ndarray:
        """A hash of each word's sequence of byte classes without repeats."""
        kinds = SHAPE[self.data]
        keep = np.ones(len(kinds), dtype=bool)
        keep[1:] = kinds[1:] != kinds[:-1]
        keep[self.starts] = True
        index = np.concatenate(([0], np.cumsum(keep)))
        return span_hashes(kinds[keep], index[self.starts], index[self.ends])

    def features(self) -> np.ndarray:
        """Three hashed features of each word: itself, its shape, and whether it repeats (with the shape)."""
        shapes = self.shapes()
        repeated = shapes * U64(2) + self.repeats().astype(U64) + U64(0x5851F42D4C957F2D)
        repeated = (repeated * U64(0x9E3779B97F4A7C15)) >> U64(40)
        return np.stack([self.words & U64(WEIGHTS - 1), (shapes >> U64(20)) & U64(WEIGHTS - 1), repeated & U64(WEIGHTS - 1)]).astype(np.int64)


def frequent_hashes() -> np.ndarray:
    data, offsets = buffers(pa.array(FREQUENT))
    return np.sort(span_hashes(data, offsets[:-1], offsets[1:]))


def votes(texts: Texts) -> np.ndarray:
    """A row for each text, a column for each labeller: 2 good, 0 bad, 1 nothing."""
    data, n = texts.data, texts.n_words
    words = np.maximum(n, 1)
    letters = texts.per_text(LETTER[data])
    solid = np.maximum(texts.per_text((data > 32).astype(np.uint8)), 1)
    many = n >= 20

    def vote(bad, good):
        return np.where(bad, 0, np.where(good, 2, 1)) + np.zeros(len(n), dtype=np.int64)

    upper = texts.per_text(UPPER[data]) / np.maximum(letters, 1)
    symbols = texts.per_text(SYMBOL[data]) / solid
    repeats = texts.per_text(texts.repeats(), texts.begins) / words
    distinct = np.array([len(np.unique(texts.words[a:b])) for a, b in zip(texts.begins[:-1].tolist(), texts.begins[1:].tolist(), strict=True)]) / words
    known = frequent_hashes()
    at = np.minimum(np.searchsorted(known, texts.words), len(known) - 1)
    frequent = texts.per_text(known[at] == texts.words, texts.begins) / words
    length = texts.per_text(texts.ends - texts.starts, texts.begins) / words
    starts, ends, begins = word_spans(data, texts.offsets, NOT_NEWLINE)
    lines = span_hashes(data, starts, ends)
    n_lines = np.diff(begins)
    own_lines = np.array([len(np.unique(lines[a:b])) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]) / np.maximum(n_lines, 1)
    digits = texts.per_text(DIGIT[data]) / solid
    last = SENTENCE[data[texts.ends - 1]] if len(texts.ends) else np.zeros(0, dtype=bool)
    sentences = texts.per_text(last, texts.begins) / words
    return np.stack(
        [
            vote((upper > 0.3) & many, (upper < 0.1) & many),
            vote(symbols > 0.04, (symbols < 0.01) & many),
            vote((repeats > 0.15) & many, (repeats < 0.05) & many),
            vote((distinct < 0.35) & many, (distinct > 0.5) & many),
            vote((own_lines < 0.5) & (n_lines > 3), (own_lines > 0.8) & (n_lines > 3)),
            vote((digits > 0.5) & many, (digits < 0.1) & many),
            vote((length > 12) | (length < 2), (length > 3.5) & (length < 8)),
            vote((frequent < 0.02) & many, (frequent > 0.08) & many),
            vote((sentences > 0.6) & many, (sentences > 0.01) & (sentences < 0.4) & many),
        ],
        axis=1,
    ).astype(np.uint8)


def as_patterns(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.int64) @ (3 ** np.arange(len(LABELLERS)))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of the patterns, each labeller's accuracies on bad and on good texts, and the share of good texts, by expectation-maximisation.

    A labeller that says nothing tells nothing. Each knows some kinds of bad text only: before the data it is held to find 3 in 10 bad ones and to be right on 9 in 10 good ones, with the weight of PRIOR of all documents, so that the data decide. At first, a text is the better the fewer labellers call it bad.
    """
    table = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    up, down = (table == 2).astype(np.float64), (table == 0).astype(np.float64)
    weight = PRIOR * counts.sum()
    good = 1 / (1 + np.exp(-(2 - 4 * down.sum(1))))
    for _ in range(rounds):
        share = (good @ counts + 1) / (counts.sum() + 2)
        for_good, for_bad = good * counts, (1 - good) * counts
        right = np.stack([(for_bad @ down + 0.3 * weight) / (for_bad @ (up + down) + weight), (for_good @ up + 0.9 * weight) / (for_good @ (up + down) + weight)])
        odds = np.log(share / (1 - share)) + up @ np.log(right[1] / (1 - right[0])) + down @ np.log((1 - right[1]) / right[0])
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return good, right, float(share)


@dataclass
class Scorer:
    """posterior: by pattern; weights: three rows of hashed weights for the mean over a text's words."""

    posterior: dict[int, float]
    weights: np.ndarray
    bias: float

    def scores(self, texts: Texts) -> np.ndarray:
        """Probability of a good text; a text without words has none of a good one's features: 0."""
        features = texts.features()
        each = self.weights[0][features[0]] + self.weights[1][features[1]] + self.weights[2][features[2]]
        z = texts.per_text(each, texts.begins) / np.maximum(texts.n_words, 1) + self.bias
        return np.where(texts.n_words > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id and pattern (the votes as a number in base 3) of each document; features and shares of about SAMPLE documents, chosen by a hash of doc_id and text, null for the others. One pass over the texts."""
    bound = F.lit(int((1 << 30) * min(1.0, SAMPLE / max(1, docs.count()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            texts = Texts(batch.column("text"))
            patterns, chosen = as_patterns(votes(texts)), batch.column("chosen").to_numpy(zero_copy_only=False)
            features = texts.features() if chosen.any() else None
            bags = [(None, None)] * batch.num_rows
            for i in np.flatnonzero(chosen):
                a, b = texts.begins[i : i + 2]
                flat = (features[:, a:b] + np.arange(3)[:, None] * WEIGHTS).ravel()
                ids, counts = np.unique(flat, return_counts=True)
                bags[i] = ids, counts / max(1, b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(patterns), pa.array([x for x, _ in bags], pa.list_(pa.int32())), pa.array([x for _, x in bags], pa.list_(pa.float32()))], names=["doc_id", "pattern", "features", "shares"])

    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < bound
    return written(documents(docs, chosen.alias("chosen")).mapInArrow(run, "doc_id long, pattern long, features array<int>, shares array<float>"), "labelled")


def fitted(docs: DataFrame) -> Scorer:
    """The label model over all documents and the scorer over the sample; on an empty table, a scorer without an opinion."""
    seen = labelled(docs)
    counted = rows_at_most(seen.groupBy("pattern").count(), 3 ** len(LABELLERS))
    if not counted:
        return Scorer({}, np.zeros((3, WEIGHTS), dtype=np.float32), 0.0)
    counted.sort(key=lambda r: r["pattern"])
    patterns, counts = np.array([r["pattern"] for r in counted]), np.array([r["count"] for r in counted], dtype=np.float64)
    good, _, _ = label_model(patterns, counts)
    bags = sample_at_most(seen.where("features IS NOT NULL"), SAMPLE)
    sizes = pc.list_value_length(bags.column("features")).to_numpy()
    ids, shares = (pc.list_flatten(bags.column(c)).to_numpy() for c in ("features", "shares"))
    target = good[np.searchsorted(patterns, bags.column("pattern").to_numpy())]
    some = sizes > 0
    return Scorer(dict(zip(patterns.tolist(), good.tolist(), strict=True)), *regression(np.repeat(np.arange(some.sum()), sizes[some]), ids, shares, target[some]))


def regression(owner: np.ndarray, ids: np.ndarray, shares: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes of equal weight, by full-batch steps scaled for each weight. Entry k says that text owner[k] has feature ids[k] in shares[k] of its words."""
    weights, bias, n = np.zeros(3 * WEIGHTS), 0.0, len(target)
    balance = 0.5 * target / max(target.sum(), 1e-9) + 0.5 * (1 - target) / max((1 - target).sum(), 1e-9)
    squares, bias_square = np.full(len(weights), 1e-12), 1e-12
    for _ in range(ROUNDS if n else 0):
        z = np.bincount(owner, weights[ids] * shares, minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * balance
        slope = np.bincount(ids, error[owner] * shares, minlength=len(weights)) + DECAY * weights
        squares += slope**2
        weights -= STEP * slope / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= STEP * error.sum() / np.sqrt(bias_square)
    return weights.reshape(3, WEIGHTS).astype(np.float32), float(bias)


def scored(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Per document: doc_id, pattern, posterior (label model; null for a pattern not seen at fitting), score (of the scorer) and good (score >= 0.5).

    Null, empty and blank texts get score 0 and are not good. Repeated rows come out as often as they went in; other columns are ignored.
    """
    scorer = scorer or fitted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            texts = Texts(batch.column("text"))
            patterns, scores = as_patterns(votes(texts)), scorer.scores(texts)
            posterior = [scorer.posterior.get(p) for p in patterns.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(patterns), pa.array(posterior, pa.float64()), pa.array(scores), pa.array(scores >= 0.5)], names=["doc_id", "pattern", "posterior", "score", "good"])

    return documents(docs).mapInArrow(run, "doc_id long, pattern long, posterior double, score double, good boolean")


def accepted(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """The rows of good documents, with all their columns, in one pass without a join."""
    scorer = scorer or fitted(docs)

    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # any name will do for a column
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, text):
            yield batch.filter(pa.array(scorer.scores(Texts(batch.column(text))) >= 0.5))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
