"""Ids of whole texts in a vocabulary of words with ends, as the tokenizers library gives them, for many texts at once.

The library's pattern never joins what white space parts, nor a letter and the punctuation beside it (apostrophes aside). So a text is cut there, each distinct part is encoded once for each worker, and a text's ids are its parts' ids in order. Parts of letters only are merged by the arrays of token_counts, all others by the library itself, and so is a whole text with a special string in it.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .spans import LOWER, U64, buffers, byte_class, span_hashes
from .token_counts import merges, ragged

#: A worker remembers so many distinct parts (by their 64-bit hash); when there are more, it starts anew.
KEPT = 500_000
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ASCII_LETTER = byte_class((65, 90), (97, 122))
PUNCTUATION = byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of texts, and the places where each text's begin in them."""
    inside = NOT_SPACE[data]
    letter = ASCII_LETTER[data]
    # In UTF-8, 0xC3 and one more byte are U+00C0 to U+00FF, letters but for the signs of multiplication (0x97) and division (0xB7).
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    begins_letter, ends_letter = letter.copy(), letter.copy()
    begins_letter[:-1] |= latin
    ends_letter[1:] |= latin
    sign = PUNCTUATION[data]
    cut = (ends_letter[:-1] & sign[1:]) | (sign[:-1] & begins_letter[1:])
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut
    ends[:-1] &= ~inside[1:] | cut
    borders = offsets[1:-1]
    first, last = borders[borders < len(data)], borders[borders > 0] - 1
    starts[first], ends[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Codec:
    """Ids of texts, with an open hash table of the parts that were met."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.merges = merges(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.marks = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.bits = int(2 * KEPT).bit_length()
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(1 << self.bits, dtype=U64)
        self.numbers = np.full(1 << self.bits, -1, dtype=np.int32)
        self.flat, self.used = np.zeros(1 << 16, dtype=self.kind), 0
        self.starts, self.lengths, self.n = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each part, -1 for an unknown one."""
        at = (hashes >> U64(64 - self.bits)).astype(np.int64)
        out = self.numbers[at]
        left = np.flatnonzero((out >= 0) & (self.hashes[at] != hashes))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.numbers[at[left]]
            left = left[(out[left] >= 0) & (self.hashes[at[left]] != hashes[left])]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember distinct unknown parts and their ids."""
        numbers = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        for name, more, used in (("flat", len(ids), self.used), ("starts", len(hashes), self.n), ("lengths", len(hashes), self.n)):
            if used + more > len(getattr(self, name)):
                setattr(self, name, np.concatenate((getattr(self, name)[:used], np.zeros(used + 2 * more, dtype=getattr(self, name).dtype))))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(hashes)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(hashes)] = lengths
        self.used, self.n = self.used + len(ids), self.n + len(hashes)
        at = (hashes >> U64(64 - self.bits)).astype(np.int64)
        while len(at):
            free = self.numbers[at] < 0
            self.numbers[at[free]] = numbers[free]
            won = self.numbers[at] == numbers
            self.hashes[at[won]] = hashes[won]
            at, numbers, hashes = (at[~won] + 1) & ((1 << self.bits) - 1), numbers[~won], hashes[~won]

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, in order, and their number for each part. A part is in lower case for A-Z already."""
        texts = [w.decode() for w in words]
        plain = np.array([t.isalpha() and (t.isascii() or ("Σ" not in t and t.lower().isalpha() and unicodedata.is_normalized("NFC", t))) for t in texts], dtype=bool)
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        lengths = np.zeros(len(words), dtype=np.int64)
        easy_ids = np.zeros(0, dtype=np.int64)
        if len(easy):
            easy_ids, lengths[easy] = self.merges.merged([words[i] if texts[i].isascii() else texts[i].lower().encode() for i in easy.tolist()])
        hard_ids = [e.ids for e in self.library.encode_batch_fast([texts[i] for i in hard.tolist()], add_special_tokens=False)]
        lengths[hard] = list(map(len, hard_ids))
        out = np.empty(lengths.sum(), dtype=np.int64)
        places = np.cumsum(lengths) - lengths
        out[ragged(places[easy], lengths[easy])] = easy_ids
        out[ragged(places[hard], lengths[hard])] = [i for ids in hard_ids for i in ids]
        return out, lengths

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and the n + 1 places where each text's begin in them."""
        data, offsets = buffers(column)
        if self.n > KEPT:
            self.clear()
        n_texts = len(offsets) - 1
        special = np.unique(np.searchsorted(offsets, np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)), "right") - 1)
        special = [i for i in special.tolist() if any(m in data[offsets[i] : offsets[i + 1]].tobytes() for m in self.marks)]
        lowered = LOWER[data]
        starts, ends, begins = parts(lowered, offsets)
        hashes = span_hashes(lowered, starts, ends)
        numbers = self.find(hashes)
        if (missing := np.flatnonzero(numbers < 0)).size:
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            content = lowered.tobytes()
            self.add(new, *self.learn([content[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            numbers[missing] = self.find(hashes[missing])
        lengths = self.lengths[numbers].astype(np.int64)
        ids = self.flat[ragged(self.starts[numbers], lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        places = sums[begins]
        if special:
            lists = [ids[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
            for i in special:
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                lists[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind)
            ids, places = np.concatenate(lists), np.concatenate(([0], np.cumsum(list(map(len, lists)))))
        assert len(places) == n_texts + 1
        return ids, places


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)
