"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split at places where the pattern (the library's default one; with another one they stay whole) always ends a match, so the pieces' ids joined are the text's ids and no call holds a whole long text. Decoding joins the tokens' raw bytes; it never goes through characters, which tokens may cut.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from .shared import documents, texts_of

#: A piece of a long text has about so many characters.
PIECE_CHARS = 1 << 16
#: Where the pattern's matches always end, whatever stands around: before a blank or line end after something else; between letters, figures and other signs. (An apostrophe may begin a match with the letters after it; a single blank goes with what follows it.)
SAFE = regex.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[str]]:
    """The library's encoding of a rank file, and the decimal form of each id."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, file))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), list(map(str, range(max(ranks.values()) + 1)))


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at the first safe place after each `most` characters; whole where it has none."""
    at = 0
    while len(text) - at > most and (cut := SAFE.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(codec: tiktoken.Encoding, text: str, cut: bool = True) -> list[int]:
    if len(text) <= PIECE_CHARS or not cut:
        return codec.encode_ordinary(text)
    return [i for piece in pieces(text) for i in codec.encode_ordinary(piece)]


def round_trips(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes), n_bytes.

    Null and empty texts have no ids; repeated rows come out as often as they went in; other columns are ignored. `ranks` is a path that every executor can open, by default the multilingual vocabulary.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, decimal = encoding(ranks, pattern)
        cut = pattern == public_tokenizers.PATTERN
        for batch in batches:
            counts, digests, decoded, sizes = [], [], [], []
            for text in texts_of(batch):
                ids = encode(codec, text, cut)
                raw = codec.decode_bytes(ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def encoded(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each text."""
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = encoding(ranks, pattern)
        for batch in batches:
            ids = pa.array([encode(codec, text, pattern == public_tokenizers.PATTERN) for text in texts_of(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and content (binary) of each id array; null ids decode to nothing."""
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = encoding(ranks, pattern)
        for batch in batches:
            raw = pa.array([codec.decode_bytes(x or []) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), raw], names=["doc_id", "content"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")
