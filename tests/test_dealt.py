"""What is dealt by document once, and expressions that are cheap because they look first."""

import os

import pytest
from pyspark.sql import functions as F

from selvedge.functions.fixed import PATTERN_WORDS, PATTERNS
from selvedge.functions.text import field_value, first_value
from selvedge.operators import checks, tables
from selvedge.plans import papers, registry
from selvedge.sources import rendered

registry.load()
DATA = "/root/testdata/sf0.001"
LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate date, l_returnflag string, l_linestatus string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines with null and negative documents, nulls in columns, and repeated lines."""
    keys = [None, -7, -6, 0, 1, 2, 3, 4, 5, 8, 12]
    rows = [(k, n, 10 + n, None if n == 3 else n, 7.25 * n, 1.5 + n, None, None if n == 2 else "A", "O") for k in keys for n in range(1, 6)]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows + rows[-2:], LINE).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def same(ours, theirs):
    assert ours.columns == theirs.columns
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.collect()))


def test_cells_are_those_of_the_sql(spark, odd):
    same(rendered.table_cells(spark, odd), rendered.frame(spark, odd, rendered.CELLS))
    same(papers.supplier_cells(spark, odd), rendered.frame(spark, odd, papers.SUPPLIER_CELLS))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize(("name", "most"), [("signature_score", 1), ("header_row", 1), ("column_roles", 1), ("doc_classify", 2), ("table_candidates", 2), ("supplier_rolls", 3)])
def test_rows_are_shuffled_once(spark, name, most):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most


def test_parts_are_as_many_as_the_rows_ask_for(spark, odd, monkeypatch):
    monkeypatch.setattr(rendered, "DEALT", 5)
    assert rendered.dealt(spark, odd, "lineitem", "l_orderkey").rdd.getNumPartitions() == 12


def test_headings_beyond_the_broadcast(spark, odd, monkeypatch):
    cells = rendered.table_cells(spark, odd)
    every = [sorted(map(repr, f(cells).collect())) for f in (tables.matched, tables.signatures, tables.candidates)]
    monkeypatch.setattr(tables, "BROADCAST_HEADINGS", 1)
    assert every == [sorted(map(repr, f(cells).collect())) for f in (tables.matched, tables.signatures, tables.candidates)]


def test_words_of_patterns_change_no_value(spark):
    texts = [
        "CLIENT PO: W12\nINVOICE NO: A.1\nNETT WEIGHT: 1,2", "s.o. no: 77-A\nSO NO: 78", "Dn No: 1234\nDELIVERY NO: 999", "pl no: X/12\nBATCH/LOT: B1", "D/A no: Q12", "document NO: D-77", "Packing\nList No: PL-9",
        "İnvoice Ref: R123 KGS", "nw (kg): 5\nNo. Of Rolls: 7", "YOUR ORDER: O123\nyour product: cotton", "Qty: 5\nlength: 6", "Sales Order No: S1\nDispatch order: D2", "", "no words", None,
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in PATTERNS.values():
        for p in patterns:
            for got, gated in frame.select(first_value(F.col("t"), (p,)), first_value(F.col("t"), (p,), F.lower("t"), PATTERN_WORDS)).collect():
                assert got == gated, p


def test_field_values(spark):
    frame = spark.createDataFrame([(x,) for x in ("a", " a ", "a,", "a, ,", "a ,,", "", " ,", " b\t", None, ",", "a,b")], "x string")
    assert [r[0] for r in frame.select(field_value(F.col("x"))).collect()] == ["a", "a", "a", "a,", "a", None, None, "b", None, None, "a,b"]


def test_rules_with_quotes_and_fields_that_are_not_there(spark):
    rules = (("c", "it's", "{v} = 'x'", "it's \\ \"wrong\""), ("c", "n", "{n} > 1", "large"), ("c", "gone", "NOT {has}", "gone"), ("c", "n", "{n} / 0 > 1", "null"))
    records = spark.createDataFrame([(1, {"it's": "x", "n": "1,200"}), (2, {"n": None, "gone": "1"}), (3, None)], "doc_id long, values map<string,string>")
    found = {r["doc_id"]: [(e["field"], e["message"]) for e in r["errors"]] for r in checks.validated(records, rules[:3]).collect()}
    assert found == {1: [("it's", "it's \\ \"wrong\""), ("n", "large"), ("gone", "gone")], 2: [], 3: []}
    assert checks.validated(records, ()).select(F.size("errors")).collect() == [(0,)] * 3
    plan = checks.validated(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 20  # 13 rules look at texts or numbers; a number is read once for a field


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_records_shuffle_each_table_once(spark):
    """The papers, the tables' rows and the rolls are dealt alike, and meet as they are."""
    plan = registry.QUERIES["full_record"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
