"""Rules, values that don't fit, roles of columns: hand-made tables and brute force."""

import itertools
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from selvedge.functions.fixed import FIELDS
from selvedge.operators import checks, roles, rolls

GOOD = {f: {"pieces": "4", "meters": "1,200.5", "net_weight": "0", "delivered_date": "2024-02-31"}.get(f, "x") for f in FIELDS}
BAD = {
    "good": ({}, []),
    "nothing in it": ({f: None for f in FIELDS}, []),
    "half a piece": ({"pieces": "1.5", "meters": "abc"}, ["pieces is no whole number", "meters is no number"]),
    "nonsense": ({"delivered_date": "7-Jan-26", "meters": "0", "pieces": "-2", "net_weight": "-1"}, ["not ISO", "meters must be > 0", "pieces must be > 0", "net_weight cannot be negative"]),
    "month": ({"delivered_date": "2024-13-01"}, ["month or day"]),
    "gone": ({"lot": ..., "color": ..., "meters": "-5"}, ["meters must be > 0", "lot is missing from the record", "color is missing from the record"]),
}


def records(spark):
    rows = [(name, {f: v for f, v in (GOOD | changes).items() if v is not ...}) for name, (changes, _) in BAD.items()]
    return spark.createDataFrame(rows, "doc_id string, values map<string,string>")


def test_joint_validation(spark):
    counts = Observation("violations")
    got = {r.doc_id: [e.message for e in r.errors] for r in checks.validated(records(spark), counts=counts).collect()}
    assert got == {name: errors for name, (_, errors) in BAD.items()}
    assert counts.get["records"] == len(BAD) and counts.get["rules: meters must be > 0"] == 2 and counts.get["schema: net_weight is no number"] == 0
    found = {(r["check"], r.message): r.n for r in checks.violations(checks.validated(records(spark))).collect()}
    assert {f"{c}: {m}": n for (c, m), n in found.items()} == {k: n for k, n in counts.get.items() if n and k != "records"}
    assert checks.validated(records(spark).limit(0)).count() == 0


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([(2, "rules", "lot", "{v} = 'x'", "second"), (1, "rules", "pieces", "{n} > 3", "first")], "ord int, check string, field string, condition string, message string")
    rules = checks.rule_table(table)
    got = checks.validated(records(spark), rules).where("doc_id = 'good'").first().errors
    assert [e.message for e in got] == ["first", "second"]


def test_values_that_dont_fit(spark):
    rows = [("d", i, str(i), 50.0 + i % 3, 25.0 + i % 3 / 2, 54.68 + 1.0936 * (i % 3)) for i in range(20)] + [("d", 20, "20", 5000.0, 2500.0, 5468.0), ("d", 21, "21", 51.0, 99.0, 55.77), ("d", 22, "22", 51.0, None, 51.0)]
    rows += [("few", i, str(i), 10.0 ** i, 1.0, None) for i in range(7)] + [("same", i, str(i), 10.0 if i else 11.0, None, None) for i in range(9)]
    lines = spark.createDataFrame(rows, "doc_id string, seq long, piece_number string, meters double, net_weight double, length_yds double")
    found = {(r.doc_id, r.piece_number, r.what) for r in rolls.inconsistent(lines).collect()}
    assert found == {("d", "20", "meters"), ("d", "21", "kgs per meter"), ("d", "22", "yards per meter"), ("same", "0", "meters")}
    notes = rolls.extraction_notes(lines.withColumn("lot", F.lit("L")), odd=rolls.inconsistent(lines)).where("doc_id = 'd'").first().notes
    assert notes == "rolls: 23; inconsistent: meters 5000.00 of roll 20, kgs per meter 1.94 of roll 21, yards per meter 1.00 of roll 22"


def brute_assignment(table):
    best = (0.0, {})
    for picked in itertools.product(range(-1, len(roles.ROLES)), repeat=len(table)):
        used = [r for r in picked if r >= 0]
        if len(used) == len(set(used)) and all(table[k][1][r] >= roles.LEAST for k, r in enumerate(picked) if r >= 0):
            best = max(best, (round(sum(table[k][1][r] for k, r in enumerate(picked) if r >= 0), 9), dict((table[k][0], r) for k, r in enumerate(picked) if r >= 0)), key=lambda x: x[0])
    return best[0]


@pytest.mark.parametrize("seed", range(8))
def test_best_assignment(seed):
    rng = random.Random(seed)
    table = [(c, [rng.choice([0.0, 0.2, rng.random()]) for _ in roles.ROLES]) for c in range(4)]
    got = roles.best_assignment(table)
    assert len(set(got.values())) == len(got)
    assert sum(dict(table)[c][r] for c, r in got.items()) == pytest.approx(brute_assignment(table))


@pytest.mark.parametrize("seed", range(3))
def test_shuffled_columns(spark, seed):
    """Sequences from any start, one lot and many, columns in any order, some cells odd or blank, columns that mean nothing."""
    rng = random.Random(seed)
    cells, expected = [], {}
    for t in range(6):
        start, lots = rng.randrange(0, 5000), rng.choice([1, 4])
        body = []
        for i in range(40):
            m = rng.randrange(20, 150)
            body.append({"piece_number": str(start + i) if t % 2 else f"{rng.randrange(10**9):09d}", "meters": f"{m}.00-FULL" if i == 3 else str(m), "length_yds": f"{m * 1.0936:.2f}", "net_weight": f"{m * 0.45:.2f}", "weight_gross_kgs": f"{m * 0.45 + 1.1:.2f}", "lot": f"07/{i * lots // 40}" if i * lots % 40 < lots else '"', "color": rng.choice("ABC"), "junk": rng.choice([f"note {i}", "", None])})
        body[7]["meters"], body[8]["net_weight"] = "n/a", ""
        order = list(body[0])
        rng.shuffle(order)
        expected |= {("d", t, c): name for c, name in enumerate(order) if name != "junk"}
        cells += [("d", t, i, c, row[name]) for i, row in enumerate(body) for c, name in enumerate(order)]
    frame = spark.createDataFrame(cells, "doc_id string, tbl int, row int, col int, text string")
    got = {(r.doc_id, r.tbl, r.col): r.role for r in roles.assigned(frame).collect()}
    assert {k: v for k, v in got.items() if k in expected} == expected
    assert roles.assigned(frame.limit(0)).count() == 0
