"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch that were not counted before stand in one ragged numpy array of symbols. In each round, every pre-token's pair of lowest rank is merged in all its places at once; pre-tokens without a ranked pair leave the array. What is left of a pre-token is its number of tokens. In a vocabulary where every merge of a token ranks after the merge that made it (checked when it is loaded), this gives the same symbols as merging one pair at a time.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .shared import documents, texts_of

NONE = np.int32(2**31 - 1)
#: A worker keeps the counts of so many pre-tokens of at most LONGEST characters; when there are more, it starts anew.
KEPT, LONGEST = 1_000_000, 64
#: Pre-tokens are merged when so many are new.
AT_ONCE = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: a printable byte stands for itself, the others count on from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), then the same for the next start."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """The ranked pairs of a byte-level vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first, self.last = np.zeros(256, dtype=np.int32), np.zeros(256, dtype=np.int32)  # of the bytes within and at the end of a word
        for letter, byte in byte_letters().items():
            self.first[byte], self.last[byte] = vocab[letter], vocab[letter + suffix]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.size = max(vocab.values()) + 1
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        rank_of = np.full(self.size, -1, dtype=np.int64)
        rank_of[self.made] = np.arange(len(pairs))
        if not ((rank_of[left] < np.arange(len(pairs))) & (rank_of[right] < np.arange(len(pairs)))).all() or len(np.unique(self.made)) != len(pairs):
            raise ValueError("a merge ranks before the one that makes its part")
        keys = left * self.size + right
        # An open table of twice the power of two above the number of pairs: rank and key by hash, then by the next places.
        self.bits = int(4 * len(pairs)).bit_length()
        self.table = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.probes = 1
        for rank, key in enumerate(keys.tolist()):
            at, n = int(self.slots(np.array([key]))[0]), 1
            while self.table[at] != -1:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.table[at], self.rank[at], self.probes = key, rank, max(self.probes, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it has none."""
        keys = left.astype(np.int64) * self.size + right
        at = self.slots(keys)
        found = self.table[at]
        out = np.where(found == keys, self.rank[at], NONE)
        left_over = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(left_over):
                break
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            found = self.table[at[left_over]]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.rank[at[left_over[hit]]]
            left_over = left_over[~hit & (found != -1)]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that remain of each word (none is empty)."""
        return self.merged(words)[1]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that remain of the words (none is empty), one word's after the other's, and their number for each word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        result = lengths.copy()
        content = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.first[content]
        owner = np.arange(len(words))  # of each sequence still in the array
        done: list[tuple[np.ndarray, np.ndarray]] = []  # owners and symbols of those that have left it
        begins = np.concatenate(([0], np.cumsum(lengths)))
        symbols[begins[1:] - 1] = self.last[content[begins[1:] - 1]]
        ranks = np.full(len(symbols), NONE, dtype=np.int32)  # of the pair that begins at each symbol
        inner = np.ones(len(symbols), dtype=bool)
        inner[begins[1:] - 1] = False
        at = np.flatnonzero(inner)
        ranks[at] = self.ranks(symbols[at], symbols[at + 1])
        while len(owner):
            lowest = np.minimum.reduceat(ranks, begins[:-1])
            alive = lowest != NONE
            if not alive.all():
                lengths = np.diff(begins)
                result[owner[~alive]] = lengths[~alive]
                keep = np.repeat(alive, lengths)
                done.append((owner[~alive], symbols[~keep]))
                symbols, ranks = symbols[keep], ranks[keep]
                owner, lengths, lowest = owner[alive], lengths[alive], lowest[alive]
                begins = np.concatenate(([0], np.cumsum(lengths)))
                if not len(owner):
                    break
            lengths = np.diff(begins)
            hit = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            # A symbol can't be in two merges: of a run of touching places, every second one counts, from the left.
            touching = np.flatnonzero(np.diff(hit) == 1)
            if len(touching):
                follows = np.concatenate(([False], np.diff(hit) == 1))
                index = np.arange(len(hit))
                run_start = np.maximum.accumulate(np.where(follows, 0, index))
                hit = hit[(index - run_start) % 2 == 0]
            symbols[hit] = self.made[ranks[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            gone = np.bincount(np.searchsorted(begins, hit, "right") - 1, minlength=len(owner))
            last = np.zeros(len(symbols), dtype=bool)
            last[begins[1:] - 1] = True
            last[hit] |= last[hit + 1]
            symbols, last = symbols[keep], last[keep]
            changed = np.zeros(len(keep), dtype=bool)
            changed[hit] = True
            ranks, changed = ranks[keep], changed[keep]
            begins = np.concatenate(([0], np.cumsum(lengths - gone)))
            # Only pairs with a merged symbol have other ranks than before.
            changed[:-1] |= changed[1:]
            ranks[changed] = NONE
            at = np.flatnonzero(changed & ~last)
            ranks[at] = self.ranks(symbols[at], symbols[at + 1])
        out = np.empty(result.sum(), dtype=np.int32)
        places = np.concatenate(([0], np.cumsum(result)))[:-1]
        for owner, symbols in done:
            out[ragged(places[owner], result[owner])] = symbols
        return out, result


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts of texts; what one worker has counted it needn't count again."""

    def __init__(self, path: str, pattern: str):
        self.merges = merges(path)
        self.split = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and their number."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def learn(self, words: set[str]) -> dict[str, int]:
        todo = list(words)
        return dict(zip(todo, self.merges.counts([w.encode() for w in todo]).tolist(), strict=True)) if todo else {}

    def counts(self, texts: list[str]) -> list[int]:
        out, known = [], self.known
        if len(known) > KEPT:
            known.clear()
        pending: list[tuple[int, list[list[str]]]] = []
        new: set[str] = set()

        def flush():
            learnt = self.learn(new)
            known.update(learnt)
            for special, lists in pending:
                out.append(special + sum(sum(map(known.__getitem__, words)) for words in lists))
            for word in learnt:
                if len(word) > LONGEST:
                    del known[word]
            pending.clear()
            new.clear()

        for text in texts:
            parts, special = self.segments(text)
            lists = [self.split(part) for part in parts if part]
            for words in lists:
                new.update(set(words).difference(known))
            pending.append((special, lists))
            if len(new) >= AT_ONCE or len(pending) >= 2000:
                flush()
        flush()
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def token_counts(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, limit: int = 1024) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A special string inside a text is one token, as by the library's default. Null and empty texts have no bytes and no tokens; repeated rows come out as often as they went in; other columns are ignored.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, pattern)
        for batch in batches:
            texts = texts_of(batch)
            tokens = count.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
