"""Operators that work row by row, against the libraries or brute force."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from selvedge.llm import fingerprints, license_scan, packing, packing_tokens, sharding, spans, token_counts, tokenizer_codec
from selvedge.llm.shared import ship

from .helpers import ROWS, empty, odd

TEXT = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t.,'sStTABab1éÉñ漢"), max_size=60)


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_key(rows, *keys):
    return sorted((tuple(r[k] for k in keys) for r in rows), key=repr)


def test_round_trips(spark, codec):
    got = by_key(tokenizer_codec.round_trips(odd(spark)).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = []
    for row in ROWS:
        text = row[1] or ""
        ids = codec.encode_ordinary(text)
        expected.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    assert tokenizer_codec.round_trips(empty(spark)).count() == 0
    back = tokenizer_codec.decoded(tokenizer_codec.encoded(odd(spark))).collect()
    assert by_key([{"i": r.doc_id, "c": bytes(r.content)} for r in back], "i", "c") == sorted(((r[0], (r[1] or "").encode()) for r in ROWS), key=repr)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_pieces_keep_ids(text):
    own, _ = tokenizer_codec.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    parts = list(tokenizer_codec.pieces(text, 5))
    assert "".join(parts) == text
    assert [i for p in parts for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


@pytest.mark.parametrize("text", ["漢字かな、交じり文。" * 20_000, "aGVsbG8gd29ybGQ0+/" * 9_000, "it's, 'tis: 'll've\r\n\r\n" * 9_000, "!?" * 70_000 + "a'b'" * 30_000])
def test_long_texts_without_blanks_are_cut(codec, text):
    parts = list(tokenizer_codec.pieces(text))
    assert "".join(parts) == text and max(map(len, parts)) < 2 * tokenizer_codec.PIECE_CHARS + 140_001
    assert len(parts) > 1 and [i for p in parts for i in codec.encode_ordinary(p)] == codec.encode_ordinary(text)


def test_token_counts(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = by_key(token_counts.token_counts(odd(spark)).collect(), "doc_id", "n_bytes", "n_tokens", "over_limit")
    expected = []
    for row in ROWS:
        n = len(library.encode(row[1] or "", add_special_tokens=False).ids)
        expected.append((row[0], len((row[1] or "").encode()), n, n > 1024))
    assert got == sorted(expected, key=repr)
    assert token_counts.token_counts(empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT | st.just("<|endoftext|>") | st.just("a<|endoftext|> b"), max_size=8))
def test_counts_are_the_librarys(texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT | st.just("x<|endoftext|>y") | st.just("ΑΣ Σ İstanbul é.ñ,"), max_size=8))
def test_word_ids_are_the_librarys(texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids, places = packing_tokens.codec(P.path("word_bpe_49k.json")).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_word_hashes(texts):
    hashes, begins = spans.word_hashes(pa.array(texts, pa.string()))
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold)) for t in texts]
    assert np.diff(begins).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    seen = dict(zip(flat, hashes.tolist()))
    assert [seen[w] for w in flat] == hashes.tolist() and len(set(seen.values())) == len(seen)


def test_giant_words():
    texts = ["y" * (3 * spans.PIECE + 5), "y" * (3 * spans.PIECE + 5) + " z", "y" * (3 * spans.PIECE + 4)]
    hashes, _ = spans.word_hashes(pa.array(texts))
    assert hashes[0] == hashes[1] != hashes[3]


def test_fingerprints(spark):
    rows = [r for r in ROWS if r[0] is not None]
    frame = odd(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
    got = {r.doc_id: r for r in fingerprints.next_document_likeness(frame).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    order = sorted(texts)
    assert sorted(got) == order
    for doc_id, after in zip(order, order[1:] + order[:1]):
        text, n = texts[doc_id], len(texts[doc_id])
        edited = text[: n - n // 4] + texts[after][: n // 4]
        row = got[doc_id]
        assert row.n_chars == n and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, changed = (fingerprints.fingerprint(t.encode()) for t in (text, texts[after], edited))
        assert row.fingerprint == fingerprints.as_bytes(own).hex() and row.edited_fingerprint == fingerprints.as_bytes(changed).hex()
        assert row.near_edited == fingerprints.likeness(own, changed) and row.near_next == fingerprints.likeness(own, other)
    assert got[0].fingerprint == got[8].fingerprint != ""
    assert fingerprints.next_document_likeness(empty(spark)).count() == 0
    alone = fingerprints.next_document_likeness(odd(spark).where("doc_id = 0")).first()
    assert alone.near_next == 1.0
    assert fingerprints.next_document_likeness(odd(spark)).count() == len(ROWS)


def test_syncmers_by_definition():
    rng = random.Random(4)
    content = bytes(rng.choice(b"acgt") for _ in range(400))
    places, _ = fingerprints.anchors(content)

    def order(s):
        x = int.from_bytes(s, "little") * 0x9E3779B97F4A7C15 % 2**64
        x ^= x >> 29
        return x * 0xBF58476D1CE4E5B9 % 2**64

    expected = []
    for i in range(len(content) - fingerprints.K + 1):
        inner = [order(content[j : j + fingerprints.S]) for j in range(i, i + fingerprints.WINDOW)]
        if min(inner) in (inner[0], inner[-1]):
            expected.append(i)
    assert places.tolist() == expected
    shifted, _ = fingerprints.anchors(b"other beginning " + content)
    assert set(p + 16 for p in expected) <= set(shifted.tolist())


def brute_anchors(content):
    """Places and hashes of closed syncmers, in plain integers, one k-mer at a time."""
    full, n = 2**64 - 1, len(content) - fingerprints.K + 1

    def order(at):
        x = int.from_bytes(content[at : at + fingerprints.S], "little") * 0x9E3779B97F4A7C15 & full
        return (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & full

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    found = []
    for i in range(n):
        inner = [order(j) for j in range(i, i + fingerprints.WINDOW)]
        if min(inner) in (inner[0], inner[-1]):
            middle = order(i + (fingerprints.K - fingerprints.S) // 2) * 0xD6E8FEB86659FD93 & full
            last = inner[-1] * 0xA5CB9243F2CED5C1 & full
            found.append((i, mixed(inner[0] ^ middle ^ last) >> 32))
    if not found and content:
        found = [(0, int.from_bytes(hashlib.blake2b(content, digest_size=4).digest(), "little"))]
    return found


def test_fingerprint_query_by_brute_force(spark):
    """Fingerprints, likenesses and alignments by their definitions; a third of the rows have one id, and one a text of its own."""
    rng = random.Random(6)
    texts = {}
    for i in range(40):
        base = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 3, 20, 150])))
        texts[2 * i], texts[2 * i + 1] = base, base.replace("w1", "v1") if i % 3 else "é" + base
    rows = list(texts.items())
    rng.shuffle(rows)
    got = {r.doc_id: r for r in fingerprints.next_document_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    order = sorted(texts)

    def near(a, b):
        a, b = ({h for _, h in x} for x in (a, b))
        a, b = set(sorted(a)[: fingerprints.SIZE]), set(sorted(b)[: fingerprints.SIZE])
        union = sorted(a | b)[: fingerprints.SIZE]
        return sum(h in a and h in b for h in union) / len(union) if a and b else float(not a and not b)

    def aligned(a, b):
        a, b = ({h: p for p, h in reversed(x)} for x in (a, b))
        if not a or not b:
            return float(not a and not b)
        shifts = [b[h] - p for h, p in a.items() if h in b]
        return max(map(shifts.count, set(shifts))) / len(a) if shifts else 0.0

    for doc_id, after in zip(order, order[1:] + order[:1]):
        text, n, r = texts[doc_id], len(texts[doc_id]), got[doc_id]
        edited = text[: n - n // 4] + texts[after][: n // 4]
        own, other, changed = (brute_anchors(t.encode()) for t in (text, texts[after], edited))
        assert r.fingerprint == "".join(f"{h:08x}" for h in sorted({h for _, h in own})[: fingerprints.SIZE])
        assert r.edited_fingerprint == "".join(f"{h:08x}" for h in sorted({h for _, h in changed})[: fingerprints.SIZE])
        assert (r.near_edited, r.near_next, r.aligned_edited, r.aligned_next) == (near(own, changed), near(own, other), aligned(own, changed), aligned(own, other))
    many = fingerprints.next_document_likeness(spark.createDataFrame([(None, f"text {i}") for i in range(300)] + [(1, "last")], "doc_id long, text string").repartition(4))
    assert many.count() == 301


def test_shared_passages_with_an_anchor_in_all(spark):
    common = "the same sentence stands in every one of the passages and documents here"
    texts = [f"{common} and then number {i * 7919} with words {i} of its own kind {i * 31}" for i in range(60)]
    docs = spark.createDataFrame([(i, "x " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = fingerprints.shared_passages(docs, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), least=2).collect()
    assert {(r.doc_id, r.item_id) for r in found if r["shift"] == 2} >= {(i, i) for i in range(60)}


def test_shared_passages(spark):
    passage = "a passage of some length that two documents share word for word, with figures 12345"
    docs = spark.createDataFrame([(1, "before it " + passage + " after"), (2, "nothing alike in this text at all, not one line of it")], "doc_id long, text string")
    found = fingerprints.shared_passages(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.shift) for r in found] == [(1, 7, 10)]


def brute_license(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    norm = f" {' '.join(words)} " if words else ""
    found = []
    for number, (label, priority, keyword, regex) in enumerate(license_scan.signatures()):
        if f" {keyword}" in norm:
            for m in re.finditer(f"(?<= ){regex}(?= )", norm):
                first = norm[: m.start()].count(" ") - 1
                found.append((first, first + m.group().count(" "), priority, number, label))
    kept = [d for d in found if not any(e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and ((e[0], e[1]) != (d[0], d[1]) or e[3] < d[3]))) for e in found)]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})), len(kept)


def test_license_scan(spark):
    rng = random.Random(5)
    vocabulary = "the MIT license License, licence apache 2.0 Apache-2.0 version 3 or later GNU General Public License v2 CC BY NC 4.0 cc-by-sa-3.0 CC0 creative commons attribution share alike under licensed released terms of see all rights reserved bsd 3-clause x é İ K \n -- lesser affero gplv3 GPL public domain".split(" ")
    texts = [r[1] for r in ROWS] + ["mit license mit license", "MIT\n\nLICENSE"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS norm", "1 AS n_words", "'y' AS base")
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scanned(frame)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.n_detections) == brute_license(text), text
        assert 0 <= r.score <= 1
    assert license_scan.scanned(empty(spark)).count() == 0


def alternatives(regex):
    """Every string that a signature's regex matches; of a class of characters its ends."""
    import itertools
    from re import _parser

    def of(tokens):
        return ["".join(x) for x in itertools.product(*[one(*t) for t in tokens])]

    def one(op, value):
        op = str(op)
        if op == "LITERAL":
            return [chr(value)]
        if op == "IN":
            return [chr(c) for kind, v in value for c in ([v] if str(kind) == "LITERAL" else v)]
        if op == "SUBPATTERN":
            return of(value[3])
        if op == "BRANCH":
            return [x for branch in value[1] for x in of(branch)]
        assert op == "MAX_REPEAT", op
        low, high, inner = value
        return ["".join(x) for n in range(low, high + 1) for x in itertools.product(of(inner), repeat=n)]

    return of(_parser.parse(regex))


def test_license_keywords_are_in_every_alternative():
    for _, _, keyword, regex in [*{s[3]: s for s in license_scan.signatures() if s[1] < 2}.values()]:
        assert all(f" {keyword}" in f" {x} " for x in alternatives(regex)), (keyword, regex)


def test_license_sentences_have_their_keywords():
    for _, keyword, regex in license_scan.TEXTS:
        plain = regex.replace("(?:[^ ]+ ){1,6}", "x ").replace("[^ ]+", "x").replace("[0-9]{4}", "2024").replace("[0-9]", "1")
        assert all(f" {keyword}" in f" {x} " for x in alternatives(plain)), (keyword, regex)


def test_long_license_dense_text(spark):
    """A megabyte in which every keyword stands is scanned whole within a minute, and like its parts."""
    rng = random.Random(8)
    lines = [alternatives(regex.replace("(?:[^ ]+ ){1,6}", "x ").replace("[^ ]+", "x").replace("[0-9]{4}", "2024").replace("[0-9]", "1"))[0] for _, _, _, regex in license_scan.signatures()]
    part = " and then ".join(rng.sample(lines, len(lines)))
    times = 1_000_000 // len(part) + 1
    frame = spark.createDataFrame([(1, part), (2, " and then ".join([part] * times))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scanned(frame)).collect()}
    assert time.time() - began < 60
    assert got[1].labels == got[2].labels and got[2].n_detections == times * got[1].n_detections and got[2].n_base == times * got[1].n_base


def test_license_alternatives_without_gate(spark, monkeypatch):
    """The scan against all regexes with no keyword, over a text of every fifteenth alternative and of those that keywords once missed."""
    texts = ["GNU Library General Public License version 2", "FreeBSD License", "for noncommercial use only", "see the licence", "licenced under"]
    texts += [x for _, priority, _, regex in license_scan.signatures() if priority < 2 for x in alternatives(regex)[::15]]
    rules = license_scan.signatures()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scanned(frame)).collect()}
    assert "lgpl-2.0" in got[0].labels and "bsd-2-clause" in got[1].labels
    monkeypatch.setattr(license_scan, "signatures", lambda: [(label, priority, "", regex) for label, priority, _, regex in rules])
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.n_detections) == brute_license(text), text


def test_license_gate_covers_signatures():
    """Whatever a signature can match has an anchor of the gate."""
    for _, _, keyword, regex in license_scan.signatures():
        assert any(a in f" {keyword}" or (a == "licen" and "licen" in regex) for a in license_scan.anchors())


def test_sharding(spark):
    frame = odd(spark).unionByName(odd(spark))
    many = spark.range(5000).selectExpr("id - 100 AS doc_id", "concat('t', id % 7) AS text")
    rows = sharding.sharded(many).collect()
    for r in rows:
        text = f"t{(r.doc_id + 100) % 7}"
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert max(sum(r.shard == s for r in rows) for s in range(8)) < 1.15 * 5000 / 8
    assert 0.08 < sum(r.grown_shard == 8 for r in rows) / 5000 < 0.15
    hot = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 7, id)) AS doc_id", "IF(id % 2 = 0, 'the same', concat('t', id)) AS text")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sharding, "SLOT_BLOCK", 50)
        rows = sharding.sharded(hot).collect()
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 == len({r.shard for r in rows if r.doc_id == 7})
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    weighted = sharding.sharded(many, [3.0, 1.0]).groupBy("shard").count().collect()
    assert 2.5 < dict((r.shard, r["count"]) for r in weighted)[0] / dict((r.shard, r["count"]) for r in weighted)[1] < 3.5
    assert sharding.sharded(frame).count() == 2 * len(ROWS) and sharding.sharded(empty(spark)).count() == 0


def check_pieces(rows, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    left = sorted(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes() for t in texts)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in left)
    return len(by_sequence), sum(len(x) // 4 for x in left)


def test_packing(spark):
    rows = packing.packed(odd(spark)).collect()
    n, tokens = check_pieces(rows, [r[1] for r in ROWS])
    assert n == -(-tokens // packing.WINDOW)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for doc_id, text in {r[0]: r[1] for r in ROWS}.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        if doc_id == 8:  # it is there twice
            assert [r.start for r in mine] == [0, 0] and len({(r.ids_crc32, r.length, r.doc_tokens) for r in mine}) == 1 and mine[0].ids_crc32 == zlib.crc32(ids.tobytes())
            continue
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in mine)
    assert packing.packed(empty(spark)).count() == 0


def test_shards_are_even_and_keep_neighbours_together(spark):
    """A third of all rows have one text, a third one id: shards stay even; near copies mostly share a shard; every piece is there."""
    rng = random.Random(5)
    words = sorted(w for w in Tokenizer.from_file(P.path("word_bpe_49k.json")).get_vocab() if w.isascii() and w.isalpha() and len(w) > 5)[:4000]
    rows = [(i, "the same text over and over again " * 8) for i in range(400)] + [(None, " ".join(rng.choice(words) for _ in range(60))) for _ in range(400)]
    near = []
    for i in range(200):
        base = [rng.choice(words) for _ in range(80)]
        near += [(10_000 + 2 * i, " ".join(base)), (10_001 + 2 * i, " ".join(base[:-6] + [rng.choice(words) for _ in range(6)]))]
    got = packing.packed(spark.createDataFrame(rows + near, "doc_id long, text string").repartition(4), shard_tokens=8192).collect()
    check_pieces(got, [t for _, t in rows + near])
    sizes = {}
    for r in got:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + r.length
    assert len(sizes) > 8 and max(sizes.values()) < 1.5 * 8192
    shard = {r.doc_id: r.sequence_id >> 32 for r in got}
    together = sum(shard[10_000 + 2 * i] == shard[10_001 + 2 * i] for i in range(200)) / 200
    assert together > 0.6 and packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens=8192).where("start = 0").count() == len(rows)


def test_packing_takes_neighbours():
    rng = np.random.default_rng(0)
    topics = [np.arange(100 * t, 100 * t + 100) for t in range(4)]
    texts = [np.append(rng.choice(topics[i % 4], 500), 2).astype("<u2") for i in range(64)]
    order = list(packing.packed_order(texts, np.ones(500), 500.0))
    class Whole(packing.Shard):  # never rid of used documents: the same neighbours
        def use(self, document):
            self.unused[document] = False

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "Shard", Whole)
        assert list(packing.packed_order(texts, np.ones(500), 500.0)) == order
    assert sorted(order) == list(range(64))
    same = np.mean([a % 4 == b % 4 for a, b in zip(order, order[1:])])
    assert same > 0.85
