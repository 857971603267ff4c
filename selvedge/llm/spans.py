"""Words of many texts at once: spans in an Arrow string column, and 64-bit hashes of the spans, without a Python object per word.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2**64, then mixed. It depends on the word's bytes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed in one go; a longer word is hashed in pieces of this size.
PIECE = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=U64)
    out[0] = 1
    filled, step = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * U64(step)
        filled += more
        step = step * step % (1 << 64)
    return out


POWERS = _powers(BASE, PIECE + 1)
INVERSES = _powers(pow(BASE, -1, 1 << 64), PIECE + 1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table of 256 booleans, true in the given inclusive ranges of byte values."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words split at white space only.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 places where each text's words begin in them. No word crosses two texts."""
    inside = word_bytes[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    first = borders[borders < len(data)]
    starts[first] = inside[first]
    last = borders[borders > 0] - 1
    ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span; the spans are in order and don't overlap."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        if ends[j - 1] - base <= PIECE:
            block = VALUES[data[base : ends[j - 1]]]
            block *= POWERS[: len(block)]
            sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(block, dtype=U64)))
            out[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * INVERSES[starts[i:j] - base]
        else:
            total, scale = 0, 1
            for at in range(base, int(ends[i]), PIECE):
                block = VALUES[data[at : min(at + PIECE, int(ends[i]))]]
                total += int((block * POWERS[: len(block)]).sum(dtype=U64)) * scale
                scale = scale * int(POWERS[PIECE]) % (1 << 64)
            out[i] = U64(total % (1 << 64))
        i = j
    return mixed(out + (ends - starts).astype(U64))


def word_hashes(column: pa.Array, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of a string column, and where each text's begin in them."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, begins = word_spans(data, offsets, word_bytes)
    return span_hashes(data, starts, ends), begins
