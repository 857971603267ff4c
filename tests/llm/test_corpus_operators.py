"""Operators that compare or judge rows, against brute force and held-out labels."""

import collections
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from selvedge.llm import ann, catalog, components, language, near_dedup, quality
from selvedge.llm.shared import ship, table

from .helpers import ROWS, empty, odd

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship(spark)


def brute_components(rows, k, percent):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets[doc_id] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    holders = collections.defaultdict(list)
    for i in ids:
        shared = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80), (3, 100)])
def test_near_duplicates(spark, monkeypatch, k, percent):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # so that buckets here have several blocks
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 150]))]
        rows += [edited(rng, base, rng.randrange(0, 1 + len(base) // 12)) for _ in range(40 if group else 90)]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(120)] + ["", None, "  ", "one", "one", "one two", "A a A"]
    rng.shuffle(rows)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    expected = brute_components(list(enumerate(rows)), k, percent)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame, k, percent).collect()}
    assert len(got) == len(rows)
    for doc_id, (n, component) in expected.items():
        r = got[doc_id]
        assert (r.n_shingles, r.component_id, r.kept) == (n, component, component == doc_id)


def test_near_duplicates_odd_rows(spark):
    got = near_dedup.near_duplicates(odd(spark), 3, 85).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[8].component_id == 0 and not by_id[8].kept and by_id[0].n_copies == 3
    assert by_id[None].component_id is None and by_id[None].kept
    assert [by_id[i].n_shingles for i in (1, 2, 3, 9)] == [0, 0, 0, 1] and by_id[7].n_shingles == 1
    assert all(by_id[i].component_id == i for i in (1, 2, 3))
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_texts_of_one_id_are_linked_each_for_itself(spark):
    rng = random.Random(2)
    base = [" ".join(f"v{rng.randrange(500)}" for _ in range(80)) for _ in range(3)]
    rows = [(5, base[0]), (5, base[1]), (8, base[0] + " more"), (9, base[1] + " more"), (1, base[2]), (5, base[2])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (8, 5, False), (9, 5, False)]


@pytest.mark.parametrize("strays", [1, 30])
def test_large_buckets_cost_a_row_for_each_member(spark, monkeypatch, strays):
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    n = 4000
    members = spark.range(n).select(F.lit(7).cast("long").alias("key"), "id", F.when(F.col("id") < strays, F.col("id")).otherwise(n - 1).alias("component"))
    members = members.withColumn("n_shingles", F.lit(10).cast("long"))
    rows = near_dedup.roles(members).collect()
    assert len(rows) < 2 * n
    met = collections.Counter()
    together = collections.defaultdict(list)
    for r in rows:
        together[r.host_block, r.guest_block].append(r)
    for group in together.values():
        assert sum(r.host for r in group) <= 2 * 64 and sum(not r.host for r in group) <= 2 * 64
        for x in group:
            for y in group:
                if x.host and not y.host and x.component != y.component and (x.block != y.block or y.id > x.id):
                    met[min(x.id, y.id), max(x.id, y.id)] += 1
    expected = {(a, b) for a in range(strays) for b in range(a + 1, n)}
    assert set(met) == expected and set(met.values()) == {1}


def test_blocks_of_long_texts_are_small(spark, monkeypatch):
    """600 unlinked sets of 20,000 shingles in a bucket: no comparison holds more than two blocks of 1,500,000, about, and each pair meets once."""
    members = spark.range(600).select(F.lit(7).cast("long").alias("key"), "id", F.col("id").alias("component"), F.lit(20_000).cast("long").alias("n_shingles"))
    together, met = collections.defaultdict(list), collections.Counter()
    for r in near_dedup.roles(members).collect():
        together[r.host_block, r.guest_block].append(r)
    for group in together.values():
        assert 20_000 * len(group) < 2.7 * 2 * near_dedup.BLOCK_SHINGLES
        for x in group:
            for y in group:
                if x.host and not y.host and x.component != y.component and (x.block != y.block or y.id > x.id):
                    met[min(x.id, y.id), max(x.id, y.id)] += 1
    assert len(met) == 600 * 599 // 2 and set(met.values()) == {1}


def test_estimates():
    shape = near_dedup.Shape(3, 85)
    rng = np.random.default_rng(1)
    for overlap in (0.0, 0.5, 0.9):
        n, both = 4000, int(4000 * overlap)
        pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
        sketch = near_dedup.registers([a, b], shape)
        guess, used = near_dedup.estimate(sketch[:1], sketch[1:])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert used[0] == shape.registers and abs(guess[0] - true) < 5 * (0.25 / shape.registers) ** 0.5
    assert (1 - 0.85**shape.rows) ** shape.bands <= 1e-6


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@needs_tables
def test_quality_on_labels(spark):
    """No label is used at fitting, so all are held out."""
    data = SMALL.replace("0.001", "0.01")
    scored = quality.scored(table(spark, data, "documents")).join(table(spark, data, "labels"), "doc_id")
    right, total, lost = scored.agg(F.count_if(F.col("good") == (F.col("quality") == 1)), F.count("*"), F.count_if((F.col("quality") == 1) & ~F.col("good"))).first()
    assert right / total > 0.97 and lost / total < 0.005


def test_quality_odd_rows(spark):
    scorer = quality.fitted(odd(spark))
    got = quality.scored(odd(spark), scorer).collect()
    assert len(got) == len(ROWS)
    assert all(r.score == 0.0 and not r.good for r in got if r.doc_id in (1, 2, 3))
    kept = quality.accepted(odd(spark), scorer)
    assert kept.columns == odd(spark).columns and kept.count() == sum(r.good for r in got)
    assert quality.scored(empty(spark)).count() == 0 and quality.accepted(empty(spark)).count() == 0


@pytest.mark.parametrize("first, second", [(0.99, 0.97), (0.6, 0.8), (0.8, 0.6)])
def test_label_model_recovers_accuracies(first, second):
    """Of bad and of good texts, from votes alone; a labeller that is often wrong about good texts is found out."""
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    right = np.array([[0.3, first], [0.5, second], [0.7, 0.98], [0.2, 0.99], [0.4, 0.96], [0.6, 0.99], [0.5, 0.98], [0.3, 0.97], [0.6, 0.98]])
    table_ = np.stack([np.where(rng.random(20000) < np.where(truth, a[1], a[0]), np.where(truth, 2, 0), np.where(truth, 0, 2)) for a in right], axis=1)
    table_[rng.random(table_.shape) < 0.2] = 1
    patterns, index, counts = np.unique(quality.as_patterns(table_), return_inverse=True, return_counts=True)
    good, estimated, share = quality.label_model(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.03 and np.abs(estimated - right.T).max() < 0.06
    assert ((good[index] > 0.5) == truth).mean() > 0.95


def test_label_model_by_hand():
    """The same steps over single documents in plain Python."""
    rng = random.Random(1)
    n = len(quality.LABELLERS)
    votes = [[rng.choice([0, 1, 2, 2]) for _ in range(n)] for _ in range(60)]
    good = [1 / (1 + np.exp(-(2 - 4 * v.count(0)))) for v in votes]
    for _ in range(5):
        share = (sum(good) + 1) / (len(votes) + 2)
        weight = quality.PRIOR * len(votes)
        on_bad = [(sum(1 - g for g, v in zip(good, votes) if v[k] == 0) + 0.3 * weight) / (sum(1 - g for g, v in zip(good, votes) if v[k] != 1) + weight) for k in range(n)]
        on_good = [(sum(g for g, v in zip(good, votes) if v[k] == 2) + 0.9 * weight) / (sum(g for g, v in zip(good, votes) if v[k] != 1) + weight) for k in range(n)]
        good = []
        for v in votes:
            p, q = share, 1 - share
            for k in range(n):
                if v[k] != 1:
                    p *= on_good[k] if v[k] == 2 else 1 - on_good[k]
                    q *= on_bad[k] if v[k] == 0 else 1 - on_bad[k]
            good.append(p / (p + q))
    patterns, index, counts = np.unique(quality.as_patterns(np.array(votes, dtype=np.uint8)), return_inverse=True, return_counts=True)
    got, right, found = quality.label_model(patterns, counts.astype(float), rounds=5)
    assert np.abs(got[index] - good).max() < 1e-6 and abs(found - share) < 1e-9
    assert np.abs(right[0] - on_bad).max() < 1e-9 and np.abs(right[1] - on_good).max() < 1e-9


def brute_votes(text):
    """The labellers by their definitions, on one text."""
    data = text.encode()
    words, n = data.split(), len(data.split())
    letters = [c for c in data if chr(c).isascii() and chr(c).isalpha() or c > 127]
    solid = max(1, sum(c > 32 for c in data))
    marks = b",.;:?'()-\"@/_"
    symbols = sum(not (c in letters or 48 <= c <= 57 or c in marks or c <= 32 or c == 127) for c in data) / solid
    upper = sum(65 <= c <= 90 for c in data) / max(1, len(letters))
    repeats = sum(fold(a) == fold(b) for a, b in zip(words, words[1:])) / max(1, n)
    distinct = len({fold(w) for w in words}) / max(1, n)
    lines = [x for x in data.split(b"\n") if x]
    own_lines = len(set(lines)) / max(1, len(lines))
    digits = sum(48 <= c <= 57 for c in data) / solid
    length = sum(map(len, words)) / max(1, n)
    frequent = sum(fold(w).decode(errors="replace") in quality.FREQUENT for w in words) / max(1, n)
    ends = sum(w[-1] in marks for w in words) / max(1, n)
    many = n >= 20

    def vote(bad, good):
        return 0 if bad else 2 if good else 1

    return [
        vote(upper > 0.3 and many, upper < 0.1 and many),
        vote(symbols > 0.04, symbols < 0.01 and many),
        vote(repeats > 0.15 and many, repeats < 0.05 and many),
        vote(distinct < 0.35 and many, distinct > 0.5 and many),
        vote(own_lines < 0.5 and len(lines) > 3, own_lines > 0.8 and len(lines) > 3),
        vote(digits > 0.5 and many, digits < 0.1 and many),
        vote(length > 12 or length < 2, 3.5 < length < 8),
        vote(frequent < 0.02 and many, frequent > 0.08 and many),
        vote(ends > 0.6 and many, 0.01 < ends < 0.4 and many),
    ]


def fold(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def test_votes_by_definition():
    rng = random.Random(11)
    pieces = ["The", "the", "of", "and", "House", "river!", "$$$", "###", "12345", "99", "e\u0301t\u00e9", "buy", "BUY", "x" * 30, "it.", "is,", "\n", "\n", "was", "a"]
    texts = [" ".join(rng.choice(pieces[k % 5 :]) for _ in range(rng.choice([0, 3, 25, 120]))) for k in range(200)] + [r[1] or "" for r in ROWS]
    got = quality.votes(quality.Texts(pa.array(texts)))
    assert got.tolist() == [brute_votes(t) for t in texts]


@needs_tables
def test_quality_query_by_hand(spark):
    """Patterns, posteriors and scores of the query, each computed anew for one text at a time from the fitted model."""
    docs = table(spark, SMALL, "documents")
    scorer = quality.fitted(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.scored(docs, scorer).collect():
        data = quality.Texts(pa.array([texts[r.doc_id]]))
        assert r.pattern == quality.as_patterns(np.array([brute_votes(texts[r.doc_id])], dtype=np.uint8))[0]
        features = data.features()
        z = sum(float(scorer.weights[k][f]) for k in range(3) for f in features[k].tolist()) / max(1, features.shape[1]) + scorer.bias
        expected = 1 / (1 + np.exp(-z)) if features.shape[1] else 0.0
        assert abs(r.score - expected) < 1e-5 and r.posterior == scorer.posterior[r.pattern] and r.good == (r.score >= 0.5)


@needs_tables
def test_page_languages_without_or_against_the_declaration(spark):
    """What a page declares is held back, or falsified for one page in 17; then it is no evidence, and can judge the result."""
    data = SMALL.replace("0.001", "0.01")
    pages = table(spark, data, "pages").cache()
    truth = pages.select("page_id", F.regexp_extract("html", r'(?is)<html[^>]*lang\s*=\s*["\']?([a-z]{2})', 1).alias("truth"))
    hidden = pages.withColumn("html", F.regexp_replace("html", r"(?is)<html[^>]*>", "<html>"))
    got = language.page_languages(hidden, table(spark, data, "documents")).join(truth, "page_id").where("truth <> '' AND n_trigrams > 20")
    right, total, declared = got.agg(F.count_if(F.col("language") == F.col("truth")), F.count("*"), F.count_if(F.col("declared") != "")).first()
    assert declared == 0 and total > 50 and right / total > 0.95
    other = F.when(F.col("page_id") % 17 == 0, F.regexp_replace("html", r"(?is)<html[^>]*>", '<html lang="es">')).otherwise(F.col("html"))
    got = language.page_languages(pages.withColumn("html", other), table(spark, data, "documents")).join(truth, "page_id").where("truth <> '' AND truth <> 'es' AND page_id % 17 = 0 AND n_trigrams > 100")
    right, total = got.agg(F.count_if(F.col("language") == F.col("truth")), F.count("*")).first()
    assert total > 5 and right / total > 0.9


def test_fused_posteriors_by_hand(spark):
    """The posterior of each row of a small table, computed anew from the definitions in plain Python."""
    rows = [("a.x.org", "x.org", "en", 1, [-1.0, -3.0, -4.0]), ("a.x.org", "x.org", "", 1, [-2.0, -2.5, -6.0]), ("b.x.org", "x.org", "fr", 2, [-5.0, -1.0, -4.0]), ("c.y.org", "y.org", "fr", 2, [-1.0, -1.1, -1.2]), ("", "", "", 3, [0.0, 0.0, 0.0]), ("b.x.org", "x.org", "", 1, [0.0, 0.0, 0.0])]
    model = language.TextModel(["en", "fr", language.UNKNOWN], np.zeros((3, language.CELLS)))
    text = language.softmax(np.array([r[4] for r in rows]))
    found = spark.createDataFrame([(i, *r[:4], 0 if i > 3 else 9, r[4], p.tolist()) for i, (r, p) in enumerate(zip(rows, text))], "id long, host string, domain string, declared string, suffix int, n_trigrams long, logs array<double>, text_p array<double>")
    got = {r.id: r for r in language.fused(found, model).collect()}

    def total(place, value):
        return sum(p for r, p in zip(rows, text) if r[place] == value)

    general = (text.sum(axis=0) + 1) / (text.sum() + 3)
    for i, (host, domain, declared, suffix, logs) in enumerate(rows):
        dom = (total(1, domain) + language.PULL * general) / (total(1, domain).sum() + language.PULL)
        prior = (total(0, host) + language.PULL * dom) / (total(0, host).sum() + language.PULL)
        score = np.array(logs) + np.log(prior)
        for place, value in ((2, declared), (3, suffix)):
            n_values = len({r[place] for r in rows})
            score += np.log((total(place, value) + language.UNSEEN) / (text.sum(axis=0) + language.UNSEEN * n_values))
        expected = language.softmax(score[None, :])[0]
        if i == 4:  # neither text nor declaration nor host
            assert (got[i].language, got[i].confidence) == (language.UNKNOWN, 0.0)
        else:
            assert got[i].language == model.languages[expected.argmax()] and abs(got[i].confidence - expected.max()) < 1e-9


def test_labels_are_cut_to_their_codes(spark):
    rows = [(1, "the cat", "en"), (2, "the dog", "en-US"), (3, "le chat", " FR_ca "), (4, "x y z", "Klingonese"), (5, "nothing", None), (6, "nothing", "")]
    model = language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", "klingonese", language.UNKNOWN]


def test_long_unclosed_markup_takes_little_time():
    for piece in ("<script>a ", "<!-- a ", "<nav> b", "< ", "</script ", "<style></style>"):
        began = time.time()
        language.visible(piece * 100_000)
        assert time.time() - began < 3


def test_language_odd_rows(spark):
    kept = language.in_known_language(odd(spark))
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 4, 5, 8, 10} <= ids and not {3} & ids and kept.columns == odd(spark).columns
    pages = spark.createDataFrame([(1, "https://a.example.org/fr/1", "<html lang=fr><body>" + "l'élève est là " * 20), (2, None, None), (3, "not an address", "<p>the cat and the dog sat on the mat</p>"), (4, "https://b.example.org/", "<html lang='fr-CA'><p></p></html>"), (1, "https://a.example.org/fr/1", "x")], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("logs", F.lit(1))
    got = language.page_languages(pages, odd(spark)).collect()
    assert len(got) == 5
    assert [r.language for r in got if r.page_id == 2] == [language.UNKNOWN] and [r.declared for r in got if r.page_id == 4] == ["fr"]
    assert language.page_languages(pages.limit(0), odd(spark)).count() == 0
    assert language.page_languages(pages, empty(spark)).count() == 5
    assert language.in_known_language(empty(spark)).count() == 0


def test_rare_label_has_a_class(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = [(i, f"the cat and the dog sat on the mat number {i}", "en") for i in range(3000)] + [(4000, "l'élève naïf était là où ça va", "fr"), (4001, "où est l'élève", "fr")]
    model = language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", language.UNKNOWN]
    logs, _ = model.likelihoods(pa.array(["l'élève est là", "the dog and the cat"]))
    assert logs.argmax(axis=1).tolist() == [1, 0]


def test_priors_are_smoothed(spark):
    rows = [("h1", "d", [0.0, 1.0])] * 30 + [("h2", "d", [1.0, 0.0])] + [("h3", "e", [1.0, 0.0])] * 30
    found = spark.createDataFrame(rows, "host string, domain string, text_p array<double>")
    prior = {r.host: r.prior for r in language.priors(found, 2).collect()}
    assert all(abs(sum(p) - 1) < 1e-9 for p in prior.values())
    assert prior["h1"][1] > 0.95 and prior["h3"][0] > 0.95 and prior["h1"][0] < prior["h2"][0] < prior["h3"][0] and prior["h2"][0] < 0.5


def test_visible_text():
    page = "<html><head><style>p{}</style><script>var t='</p>'</script></head><body><nav>menu</nav><!-- ad --><p>caf&eacute; <b>noir</b></p><footer>end</footer></body>"
    assert language.visible(page).split() == ["café", "noir"] and language.visible(None) == ""
    assert language.visible("a<script>b<p>c</p>d").split() == ["a", "b", "c", "d"] and language.visible("a < b").split() == ["a", "<", "b"]
    assert language.visible("<STYLE>x</Style >y<!-- <p> -->z<!--->w").split() == ["y", "z", "w"]


def brute_nearest(rows, every, top):
    fine = {}
    for vec_id, v in rows:
        if vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault(vec_id, np.array(v, dtype=np.float32).astype(np.float64))
    out = {}
    for q in (i for i in fine if i % every == 0):
        scores = [(-(fine[q] @ v) / np.sqrt((fine[q] @ fine[q]) * (v @ v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])]
        out[q] = [(i, -s) for s, i in sorted(scores)[:top]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16)
    rows = [(i, (hot if i % 3 == 0 else rng.normal(size=16)).astype(float).tolist()) for i in range(600)]
    rows += [(700, None), (750, [0.0] * 16), (800, [1.0, None] + [0.0] * 14), (850, [float("nan")] + [1.0] * 15), (900, []), (None, [1.0] * 16), (950, [1.0, 2.0]), (1000, [2.0, 1.0]), (30, rows[30][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"vector": F.lit(1), "shard": F.lit(2), "dim": F.lit(3)})
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, 50, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    expected = brute_nearest(rows, 50, 5)
    assert sorted(got) == sorted(q for q in expected if expected[q])
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert found / sum(len(x) for x in expected.values()) > 0.9
    for q in got:
        if q % 3 == 0 and q < 600:  # the hot vector's copies tie: the smallest ids, exactly
            assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
    assert got[950] == [(1000, pytest.approx(0.8))]
    assert ann.nearest(frame.limit(0)).count() == 0


def share_found(spark, rows, top=5, every=10):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    units = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    asked = ids % every == 0
    cosines = units[asked] @ units.T
    cosines[np.arange(asked.sum()), np.flatnonzero(asked)] = -2.0
    least = dict(zip(ids[asked].tolist(), np.sort(cosines, axis=1)[:, -top]))
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), every, top).collect()
    assert len(got) == top * len(least)  # no query loses rows that exist
    assert all(r.vec_id != r.query_id for r in got) and len({(r.query_id, r.vec_id) for r in got}) == len(got)
    return sum(r.score >= least[r.query_id] - 1e-6 for r in got) / len(got)  # of equal scores any will do


@pytest.mark.parametrize("n", [50, 200, 1000])
def test_small_tables(spark, n):
    rng = np.random.default_rng(n)
    assert share_found(spark, [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(n)]) > 0.9


@pytest.mark.parametrize("copies", [2, 3, 5])
def test_groups_of_copies(spark, copies):
    rng = np.random.default_rng(copies)
    centres = rng.normal(size=(40, 64))
    bases = centres[rng.integers(0, 40, 2000 // copies)] + rng.normal(size=(2000 // copies, 64))
    assert share_found(spark, [(i, bases[i % len(bases)].astype(np.float32).tolist()) for i in range(len(bases) * copies)]) > 0.9


def test_a_third_are_near_copies(spark, monkeypatch):
    """Trees cut into several parts, and one very common vector with small changes."""
    monkeypatch.setattr(ann, "PART_ROWS", 700)
    rng = np.random.default_rng(8)
    common = rng.normal(size=32)
    rows = [(i, (common + 0.05 * rng.normal(size=32) if i % 3 == 0 else rng.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    assert share_found(spark, rows, every=50) > 0.9


def test_budget_bounds_what_is_looked_at(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(4000)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 100, 5, budget=400).collect()
    assert len(got) == 5 * 40 and all(400 <= r.n_looked < 2000 for r in got) and all(r.level > 0 for r in got)


def test_ascent_by_definition():
    """Against a plain walk over prefixes: all trees at one level, the first level with enough different ids."""
    rng = np.random.default_rng(3)
    keys, ids = rng.integers(0, 2**63, (5, 40)), np.arange(40)
    keys[:, :20] = keys[:, :1] ^ rng.integers(0, 2**40, (5, 20))
    flags = ids == 7

    def prefix(key, n):
        return key >> (2 * ann.PAIRS - 2 * (n - 1)) if n else 0

    orders = [ann.sorted_tree(keys[t], ids, t) for t in range(5)]
    found = [ann.matches(keys[t][o], ids[o], flags[o], ann.WINDOW) for t, o in enumerate(orders)]
    every, levels = (np.concatenate([f[k].ravel() for f in found]) for k in (1, 2))
    every, levels = every[levels >= 0], levels[levels >= 0]
    for budget in (1, 5, 15, 30, 100):
        got, level = ann.ascended(every, levels, budget)
        for n in range(ann.PAIRS + 1, -1, -1):
            expected = {int(i) for t in range(5) for i in ids if i != 7 and prefix(keys[t][i], n) == prefix(keys[t][7], n) and i in found[t][1]}
            if len(expected) >= budget or n == 0:
                break
        assert (set(got.tolist()), level) == (expected, n)


def test_extreme_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.choice([-200, 0, 200])).tolist()) for i in range(120)] + [(50, [1e-320] + [0.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first = {}
    for i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        first.setdefault(i, np.array(v) / np.abs(v).max())
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, 50, 5).orderBy("query_id", "rank").collect():
        assert np.isfinite(r.score)
        got[r.query_id].append((r.vec_id, pytest.approx(r.score)))
    for q in (0, 50, 100):
        scores = sorted((-(first[q] @ v) / np.sqrt((first[q] @ first[q]) * (v @ v)), i) for i, v in first.items() if i != q)[:5]
        assert [(i, -s) for s, i in scores] == got[q]


def test_rare_length(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3 if i % 100 == 0 else 16).astype(np.float32).tolist()) for i in range(1000)]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    expected = brute_nearest(rows, 50, 5)
    assert {q: [i for i, _ in x] for q, x in expected.items()} == got  # so few rows are all looked at


@pytest.mark.parametrize("groups", [0, 500])
def test_recall_holds_with_size(spark, monkeypatch, groups):
    """20,000 directions without structure, or in groups: with a least window that is too narrow for the first, the pilot widens it as far as needed, and no further for the second."""
    monkeypatch.setattr(ann, "WINDOW", 4)
    monkeypatch.setattr(ann, "BUDGET", 256)
    rng = np.random.default_rng(groups)
    vectors = rng.normal(size=(20_000, 32))
    if groups:
        vectors = rng.normal(size=(groups, 32))[rng.integers(0, groups, 20_000)] + 0.05 * vectors
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    seen = []
    monkeypatch.setattr(ann, "tuned", lambda *args, tuned=ann.tuned: seen.append(tuned(*args)) or seen[-1])
    assert share_found(spark, rows, every=100) >= 0.9
    assert (seen[0] > 4) == (groups == 0)


@needs_tables
def test_recall_on_the_table(spark):
    vectors = table(spark, SMALL.replace("0.001", "0.01"), "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    expected = brute_nearest(rows, 50, 5)
    got = collections.defaultdict(set)
    for r in ann.nearest(vectors).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in x}) for q, x in expected.items()) / sum(len(x) for x in expected.values()) >= 0.9


@needs_tables
def test_pipeline_stages(spark):
    """Each stage against brute force on its own input; run() is all of them."""
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = docs.cache(), stage(spark, docs, SMALL).cache()
        assert after.columns == before.columns and after.exceptAll(before).count() == 0
        if name == "near duplicates":
            expected = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in expected.items() if c == i}
        docs = after
    whole = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_stages_tell_rows_of_one_id_apart(spark):
    """Several rows without an id, and several texts of one id: each is judged for itself by every stage."""
    rng = random.Random(4)
    base = [" ".join(rng.choice(["the", "river", "house", "old", "green", "walks", "and", "morning", "they", "stone"]) for _ in range(60)) for _ in range(5)]
    near = base[1] + " indeed"
    fine = [(None, base[0]), (None, base[1]), (7, base[2]), (7, base[3]), (3, base[4]), (9, near), (None, base[0])]
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in fine], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each(spark, frame, SMALL)
    # base[1] has no id, so its near copy of id 9 stays in its place
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(None, base[0]), (7, base[2]), (7, base[3]), (3, base[4]), (9, near)]))
    odd_ones = [(None, "", None, "junk", 0), (7, "", None, "junk", 0)]
    both = frame.unionByName(spark.createDataFrame(odd_ones, frame.schema))
    assert sorted(map(str, ((r.doc_id, r.text) for r in corpus_pipeline.known_language(spark, both, SMALL).collect()))) == sorted(map(str, fine))
    scorer = quality.fitted(both)
    assert quality.accepted(both, scorer).count() == quality.scored(both, scorer).where("good").count()
    assert {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.sequences(spark, both, SMALL).collect()} >= {(None, 1), (7, 1)}
    assert corpus_pipeline.sequences(spark, both, SMALL).where("start = 0").count() == len(fine) + 2


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


@needs_tables
def test_sharding_oracle(spark):
    import duckdb

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    theirs = connection.sql(catalog.ORACLES["op7_rendezvous_shards"])
    ours = catalog.QUERIES["op7_rendezvous_shards"](spark, SMALL).select(*theirs.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())
