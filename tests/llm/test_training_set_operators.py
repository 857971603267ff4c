"""Collocations, importance resampling and decontamination, against brute force and DuckDB; and that no column's name clashes."""

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from selvedge.llm import catalog, collocations, decontamination, language, packing, resampling, shared, sharding
from selvedge.llm.shared import ship
from selvedge.llm.spans import U64

from .helpers import ROWS, empty, odd

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship(spark)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


@needs_tables
@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_importance_resampling", "op13_benchmark_decontamination"])
def test_same_as_duckdb(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, SMALL), connection.sql(catalog.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = lambda rows, columns: sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    assert key([tuple(r) for r in ours.collect()], ours.columns) == key(theirs.fetchall(), theirs.columns)


# Collocations


def brute_collocations(rows, max_n, least, inside, most):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    over = collections.Counter()
    for (lang, p), a in often.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    over[lang, p[i:j]] = max(over[lang, p[i:j]], a)
    found = collections.defaultdict(list)
    for (lang, p), a in often.items():
        score, k, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if 100 * over[lang, p] < inside * a:
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, rows in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:most], 1)}


def corpus(seed, n):
    """Texts in a few languages with marks, odd blanks, repeats of phrases, and a pair of words that a third of all texts hold."""
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(12)] + ["É", "naïve\x01", "\x00z", "a\x1fb"]
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            words[5:5] = ["Hot", "pair"] + [rng.choice(common)]
        if i % 7 == 0:
            words += "new york city hall".split()
        rows.append(("".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "; "]) for w in words), rng.choice(["en", "fr", None, "x y"])))
    return rows + [(None, "en"), ("", None), (" \t\n", "de"), ("one " * 300, "en")]


@pytest.mark.parametrize("max_n, least", [(4, 8), (2, 5), (6, 6)])
def test_collocations(spark, monkeypatch, max_n, least):
    monkeypatch.setattr(collocations, "WRITTEN", 97)
    rows = corpus(3, 400)
    frame = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "doc_id long, text string, lang string").repartition(6)
    got = {tuple(r) for r in collocations.collocations(frame, max_n, least, 80, 50).collect()}
    assert got == brute_collocations(rows, max_n, least, 80, 50)


def test_stack_over_batches(spark):
    """Batches of any size give the same counts, also of beginnings that several tasks count."""
    frame = spark.createDataFrame([(t, c) for t, c in corpus(4, 200)], "text string, lang string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    results = []
    for size, parts in (("10000", 2), ("7", 9), ("1", 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        results.append(sorted(map(tuple, collocations.phrase_counts(frame.repartition(parts), 4, 5)[0].collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert results[0] == results[1] == results[2] and len(results[0]) > 50


def test_collocation_scores_are_exact(spark):
    """2000000 a passes 64 bits."""
    up, down = 5 * 10**17, 7 * 10**17
    got = spark.createDataFrame([(up, down, down + 1)], "a long, l long, r long").select((F.lit(2_000_000).cast("decimal(10,0)") * collocations.decimal("a")).alias("up"), (collocations.decimal("l") + collocations.decimal("r")).alias("down")).selectExpr("CAST(up DIV down AS long) AS s").first().s
    assert got == 2_000_000 * up // (2 * down + 1)


def test_collocations_odd_rows(spark):
    assert collocations.collocations(empty(spark)).collect() == []
    got = {tuple(r) for r in collocations.collocations(odd(spark), least=2).collect()}
    assert got == brute_collocations([(r[1], r[2]) for r in ROWS], 4, 2, 80, 2000)


# Importance resampling


def brute_resampled(docs, target, most, percent, least_words):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = collections.Counter(bucket(f) for _, text in docs for f in features(text))
    t = collections.Counter(bucket(f) for text in target for f in features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1) * (all_s + 10_000) / ((s[bucket(f)] + 1) * (all_t + 10_000))))
    out = []
    for doc_id, text in docs:
        own = features(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text)), text])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return out


@pytest.mark.parametrize("most, nodes", [(1, 400_000), (2, 50), (3, 400_000)])
def test_resampling(spark, monkeypatch, most, nodes):
    monkeypatch.setattr(resampling, "NODES", nodes)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["Alpha", "béta", "γ", "x1"]) if rng.random() < 0.3 else f"v{rng.randrange(300)}" for _ in range(rng.randrange(0, 80)))) for i in range(300)]
    target = ["alpha béta, γ gamma v1 v2 v3"] * 3 + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = {tuple(r) for r in resampling.digest(resampling.resampled(frame, items, most=most, percent=25)).collect()}
    expected = brute_resampled(docs, target, most, 25, 20)
    assert got == {tuple(r[:6]) for r in expected}
    drawn = {r[0] for r in expected if r[4]}
    assert len(drawn) > 30
    if most == 1:
        kept = resampling.drawn_documents(frame.withColumn("drawn key", F.lit(1)), items, percent=25)
        assert {r.doc_id for r in kept.collect()} == drawn and kept.columns == ["doc_id", "text", "drawn key"]


def test_resampling_ties_and_repeats(spark, monkeypatch):
    """Rows of one id and text are numbered each, a third of all rows included; rows of one id follow one another; a null id comes last of its score."""
    monkeypatch.setattr(shared, "COPIES", 7)
    text = " ".join(f"a{i % 5}" for i in range(30))
    docs = [(1, text)] * 100 + [(2, text), (None, text), (None, text)] + [(i, text + f" b{i}") for i in range(3, 200)]
    target = spark.createDataFrame([(1, "a1 a2")], "item_id long, text string")
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), target, percent=50).collect()
    assert len(got) == len(docs) and sorted(r.rank for r in got if r.rank) == list(range(1, len(docs) // 2 + 1))
    order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)]
    assert order == sorted(order)
    worst = max(order)
    assert all((-r.score, r.doc_id is None, r.doc_id or 0) >= worst for r in got if not r.rank)


def test_resampling_odd_rows(spark):
    target = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    assert resampling.resampled(empty(spark), target).collect() == []
    got = [tuple(r) for r in resampling.digest(resampling.resampled(odd(spark), target, percent=50)).collect()]
    expected = [tuple(r[:4]) for r in brute_resampled([(r[0], r[1]) for r in ROWS], ["the fox"], 1, 50, 20)]
    assert sorted(r[:4] for r in got if r[0] is not None) == sorted(r for r in expected if r[0] is not None)
    nothing = resampling.resampled(odd(spark), target.limit(0), percent=0).collect()
    assert len(nothing) == len(ROWS) and all(r.rank is None for r in nothing)


# Decontamination


def brute_hits(text, items, window):
    words, hit, whose = words_of(text), set(), set()
    for name, item in items:
        w = words_of(item)
        k = min(window, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                whose.add(name)
    return len(words), len(hit), whose - {None}


def planted(seed, alphabet, n_items, n_docs):
    """Items and texts over few words, so that matches overlap, end early and go on in other items."""
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(alphabet)}"
    items = [(rng.choice([i, None]) if i % 9 == 0 else i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 9, 12, 30])))) for i in range(n_items)]
    items += [(1, items[2][1]), (3, None), (4, ""), (5, items[6][1])]
    docs = []
    for i in range(n_docs):
        words = [word() if rng.random() < 0.5 else f"z{rng.randrange(9)}" for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            source = items[rng.randrange(n_items)][1].split()
            a = rng.randrange(len(source))
            at = rng.randrange(len(words) + 1)
            words[at:at] = source[a : a + rng.randrange(1, 20)]
        docs.append((i, rng.choice([" ", "  ", ", "]).join(words)))
    return items, docs


@pytest.mark.parametrize("alphabet, n_items, window, block", [(400, 60, 10, 200_000), (6, 40, 5, 200_000), (3, 20, 4, 200_000), (60, 60, 10, 120), (8, 40, 5, 90)])
def test_decontamination(spark, monkeypatch, alphabet, n_items, window, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)  # the last ones take several passes
    items, docs = planted(alphabet, alphabet, n_items, 150)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.digest(decontamination.scanned(frame, table, window)).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        n, hit, whose = brute_hits(text, items, window)
        names = sorted(map(str, whose))
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(20))
def test_longest_matches(seed):
    """After each word, the automaton knows the longest match that ends there."""
    rng = random.Random(seed)
    items = [[rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(6)]
    as_hashes = [np.array(x, dtype=U64) for x in items]
    automaton = decontamination.Automaton(as_hashes, [str(i) for i in range(6)], 3)
    words = [w for w in (rng.randrange(4) for _ in range(200)) if w in set(automaton.vocabulary.tolist())]
    inside = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i, len(x) + 1)}
    places = np.searchsorted(automaton.vocabulary, np.array(words, dtype=U64)).tolist()
    for end, (length, _) in enumerate(automaton.lengths(places), 1):
        assert length == max(k for k in range(end + 1) if tuple(words[end - k : end]) in inside)
    assert len(automaton.length) <= 2 * sum(map(len, items)) + 1


def test_cleaned_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before that, {item.upper()}! After."), (2, item), (3, None), (4, "nothing here"), (5, f"é {item} ü {item} ß and more words that stay as they were before this"), (1, f"Before that, {item.upper()}! After.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("hit", "key", "left", "spans", "a.b")})
    got = decontamination.cleaned(frame, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.8)
    assert got.columns == frame.columns
    rows = sorted((r.doc_id, r.text or "") for r in got.collect())
    assert rows == [(1, "Before that,  ! After."), (1, "Before that,  ! After."), (3, ""), (4, "nothing here"), (5, "é   ü   ß and more words that stay as they were before this")] or rows[0][1].split() == ["Before", "that,", "!", "After."]
    assert [r.text for r in got.where("doc_id = 3").collect()] == [None]
    stricter = decontamination.cleaned(frame, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.3)
    assert {r.doc_id for r in stricter.collect()} == {3, 4}


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox"), (None, "lorem ipsum"), (2, None), (3, "a b")], "item_id long, text string")
    assert decontamination.scanned(empty(spark), items).collect() == []
    got = decontamination.digest(decontamination.scanned(odd(spark), items)).collect()
    expected = [brute_hits(r[1], [(1, "quick brown fox"), (None, "lorem ipsum"), (3, "a b")], 10) for r in ROWS]
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items) for r in got) == sorted((r[0] or -1, n, hit, len(whose)) for r, (n, hit, whose) in zip(ROWS, expected))
    assert all(r.n_hit == 0 for r in decontamination.digest(decontamination.scanned(odd(spark), items.limit(0))).collect())


# What earlier operators promise about names, labels, markup and repeats


HELPERS = ("rejected", "removed", "row", "key", "second", "kept", "component", "id", "ok", "row key", "rejected_key", "removed_key", "key_1", "key_2", "shared", "least", "count", "number", "Rejected own", "x.y")


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_bear_any_column_name(spark, stage):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in HELPERS})
    plain = frame.select("doc_id", "text", "lang", "source", "n_chars")
    got, expected = stage(spark, frame, SMALL), stage(spark, plain, SMALL)
    assert got.columns == frame.columns
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in HELPERS)
    assert sorted(str(r[:5]) for r in rows) == sorted(str(tuple(r)) for r in expected.collect())


def test_of_repeated_rows_the_first_stays(spark):
    text = "some text that is long enough for a shingle"
    rows = [(1, text, "b", {"k": 2}), (1, text, "a", {"k": 3}), (1, text, "c", {"k": 1}), (2, "another text", "z", {})]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, more map<string,long>")
    for parts in (1, 3):
        got = corpus_pipeline.one_of_each(spark, frame.repartition(parts), SMALL).collect()
        assert sorted((r.doc_id, r.lang) for r in got) == [(1, "a"), (2, "z")]


def test_declarations_are_read_once():
    assert language.declared_in('<p lang="fr"><HTML class="x"\n xml:LANG = de-CH><html lang=es>') == "de"
    assert language.declared_in("<html><p lang=fr>") == "" and language.declared_in(None) == "" and language.declared_in("<html lang=en") == "en"
    began = time.time()
    assert language.declared_in("<html " * 200_000) == "" and language.declared_in("<html " + "lang " * 200_000) == ""
    assert time.time() - began < 1


def test_many_labels_are_few_classes(spark):
    rng = random.Random(1)
    names = ["en", "fr"] * 500 + [f"label {i}" for i in range(5000)] + [a + b + "x" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    rows = [(i, " ".join(rng.choice(["the", "of", "la", "und"]) for _ in range(20)), name) for i, name in enumerate(names)]
    model = language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) <= language.CLASSES + 2 and {"en", "fr", language.OTHER, language.UNKNOWN} <= set(model.languages)


def test_copies(spark):
    got = shared.copies(spark.createDataFrame([("a", 5, 25_001), ("b", 0, 1), ("c", 9, 10_000)], "name string, first long, n long"), "first", "n", "number")
    counts = {r.name: (r.n, r.low, r.high, r.different) for r in got.groupBy("name").agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.count_distinct("number").alias("different")).collect()}
    assert counts == {"a": (25_001, 5, 25_005, 25_001), "b": (1, 0, 0, 1), "c": (10_000, 9, 10_008, 10_000)}


def test_very_common_row_is_several_tasks_work(spark):
    rows = spark.range(300_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("other").alias("text")))
    got = sharding.sharded(rows)
    slots = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("different")).collect()
    assert all((r.low, r.high + 1, r.different) == (0, r.n, r.n) for r in slots) and sum(r.n for r in slots) == 300_050
    assert got.where("doc_id = 1 AND text_crc32 = crc32('same')").select(F.spark_partition_id()).distinct().count() > 1


@needs_tables
def test_packing_is_the_same_at_each_run(spark, tmp_path):
    docs = shared.table(spark, SMALL, "documents")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(1))
    results = []
    for parts in (2, 7):
        docs.repartition(parts).write.parquet(str(tmp_path / str(parts)))
        results.append(sorted(map(tuple, packing.packed(spark.read.parquet(str(tmp_path / str(parts))), shard_tokens=20_000).collect())))
    assert results[0] == results[1] and len({r[5] >> 20 for r in results[0]}) >= 1


def test_packed_order_follows_bm25():
    """In one shard: after each seed come its best unused neighbours by BM25 as defined, until the window is full."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, rng.integers(30, 200)).astype(np.uint16) for _ in range(60)]
    held = np.array([sum(i in set(t[:-1].tolist()) for t in texts) for i in range(40)])  # the last id ends a text
    idf = np.log1p((len(texts) - held + 0.5) / (held + 0.5))
    mean = sum(map(len, texts)) / len(texts)

    def bm25(seed, other):
        counts = collections.Counter(other[:-1].tolist())
        return sum(idf[i] * counts[i] * (packing.K1 + 1) / (counts[i] + packing.K1 * (1 - packing.B + packing.B * len(other) / mean)) for i in set(seed[:-1].tolist()) if counts[i])

    order = [int(i) for i in packing.packed_order(texts, idf, mean)]
    assert sorted(order) == list(range(60))
    used, at, room = {order[0]}, 0, packing.WINDOW - len(texts[order[0]])
    seed = order[0]
    for following in order[1:]:
        best = max(bm25(texts[seed], texts[j]) for j in range(60) if j not in used)
        assert math.isclose(bm25(texts[seed], texts[following]), best, rel_tol=1e-4), at
        used.add(following)
        room -= len(texts[following])
        at += 1
        if room <= 0:
            seed, room = following, packing.WINDOW + room
