"""Roll tables over pages: hand-made papers."""

import os
import random
import re

import pytest

from selvedge.api import Shipments
from selvedge.operators import books
from selvedge.plans import books as plan
from selvedge.plans import registry
from selvedge.sources.rendered import frame

registry.load()
DATA = "/root/testdata/sf0.001"

CELL = "doc_id string, page int, tbl int, row int, col int, text string"
LINE = "doc_id string, page int, tbl int, seq int, line string"
HEADS = ["Lot No", "Shade", "Roll No", "Length(mts)", "Length(yds)", "Weight (Gross kgs)", "Weight (Nett kgs)"]


def cells_of(spark, tables):
    """tables: (doc_id, page, tbl, rows)"""
    return spark.createDataFrame([(d, p, t, i, c, x) for d, p, t, rows in tables for i, row in enumerate(rows) for c, x in enumerate(row) if x is not None], CELL)


def test_four_hundred_rolls_over_eleven_pages(spark):
    """Every roll comes out once, in order, though the heading is repeated on some pages only, once in the midst of a table, and a number occurs twice."""
    rng = random.Random(2)
    numbers = [str(559_000_000 + rng.randrange(10**6)) for _ in range(399)]
    numbers.insert(200, numbers[10])
    body = [["072168 / 002" if i % 50 == 0 else '"', "ABC"[i % 3], n, f"{60 + i % 7}.00-FULL", "", "30", "29"] for i, n in enumerate(numbers)]
    tables = []
    for page in range(11):
        own = body[page * 37 : (page + 1) * 37] if page < 10 else body[370:]
        rows = ([HEADS] if page % 3 == 0 else []) + own
        if page == 4:
            rows.insert(20, ["LOT NO", *HEADS[1:]])
        if page == 0:
            rows.insert(0, ["Artistic Milliners", "", "", "", "", "", ""])
        tables.append(("d", page + 1, 0, rows))
    tables.append(("d", 12, 0, [["Terms", "Bank"], ["net 30", "x"]]))
    found = books.rolls(cells_of(spark, tables)).orderBy("seq").collect()
    assert [r.piece_number for r in found] == numbers and [r.seq for r in found] == list(range(1, 401))
    assert {r.lot for r in found} == {"072168 / 002"} and {r.tbl for r in found} == {0} and found[37].page == 2
    assert [r.meters for r in found[:8]] == [60.0, 61.0, 62.0, 63.0, 64.0, 65.0, 66.0, 60.0]


def test_cells_read_twice_are_one_row(spark):
    tables = [("d", 1, 0, [HEADS, ["L1", "A", "R1", "10", "", "", "5"], ["", "B", "R1", "10", "", "", "5"]])]
    cells = cells_of(spark, tables)
    found = books.rolls(cells.unionByName(cells)).orderBy("seq").collect()
    assert [(r.seq, r.piece_number, r.color) for r in found] == [(1, "R1", "A"), (2, "R1", "B")]


AML = [
    ("d", 1, 0, [HEADS, ["072168 / 002", "B", "559988021", "130", "142.17", "58.00", "56.75"], ['"', "A", "559988023", "74", "80.93", "34.00", "32.75"], ["TOTAL", "", "2", "204", "", "92", "89.5"]]),
    ("d", 1, 1, [HEADS, ["L9", "C", "1", "50", "", "", "20"], ['"', "", "2", "51", "", "", "21"]]),
    ("d", 2, 0, [HEADS, ['"', "C", "3", "52", "", "", "22"], ["", "", "3", "153", "", "", "63"]]),
    ("d", 2, 1, [HEADS, ["L10", "C", "X1", "10", "", "", "4"], ["Grand Total", "", "", "367", "", "", ""]]),
]
SECTIONS = [("d", 1, 0, 3, "  PO # 140928  AMS-1317-I DARK COBRA CT (R11419999)"), ("d", 1, 0, 4, "55% COTTON, 30% T400"), ("d", 1, 1, 0, "PO # 142400 AMS"), ("d", 2, 1, 9, "PO # PD6FB25121101  X")]


def test_sections_and_totals(spark):
    rows = books.classified_rows(cells_of(spark, AML), spark.createDataFrame(SECTIONS, LINE), spark.createDataFrame([("d", "AML")], "doc_id string, code string"))
    found = books.rolls_of(rows).orderBy("seq").collect()
    assert [(r.piece_number, r.po_number, r.lot, r.color) for r in found] == [
        ("559988021", "140928", "072168 / 002", "B"), ("559988023", "140928", "072168 / 002", "A"), ("1", "142400", "L9", "C"), ("2", "142400", "L9", None), ("3", "142400", "L9", "C"), ("X1", "PD6FB25121101", "L10", "C"),
    ]
    out = {(r.page, r.page_tbl, r.page_row): r.reason for r in books.left_out(rows).collect()}
    assert out == {(1, 0, 3): "total by its label", (2, 0, 2): "number counts the rolls above", (2, 1, 2): "total by its label"}
    totals = {r.label: (r.pieces_block, int(r.meters_block), r.differs) for r in books.stated_totals(rows).collect()}
    assert totals == {"TOTAL": (2, 204, False), "3": (3, 153, False), "Grand Total": (1, 10, False)}
    sums = {(r.level, r.value): (r.pieces, float(r.meters)) for r in books.rollups(books.rolls_of(rows)).collect()}
    assert sums["document", None] == (6, 367.0) and sums["po", "142400"] == (3, 153.0) and sums["lot", "L10"] == (1, 10.0)


def test_numbers_in_sequence_are_rolls(spark):
    """1, 2, 3 and 0, 1, 2 are rolls; a last row that only counts them isn't, and a sum gives a counting row away even where it goes on the sequence."""
    for numbers, last, n in ((["1", "2", "3"], "3", 3), (["0", "1", "2"], None, 3), (["7", "9", "4"], "3", 3), (["0", "1", "2"], "3", 3)):
        body = [["L", "A", x, "10", "", "", ""] for x in numbers] + ([["", "", last, "30", "", "", ""]] if last else [])
        assert books.rolls(cells_of(spark, [("d", 1, 0, [HEADS, *body])])).count() == n


def test_cartons(spark):
    heads = ["Ctn No", "Pce No", "Design/Color", "QTY(MTR)", "Gross", "Nett"]
    tables = [
        ("p", 1, 0, [heads, ["1", "0019555201", "DARK BLACK 3242882", "50", "", ""], ["", "0019555202", "DARK BLACK 3242882", "40", "", ""], ["Total:", "2", "", "90", "31.5", "30"], ["2", "0019555203", "NAVY 3242883", "60", "", ""]]),
        ("p", 2, 0, [heads, ["", "0019555204", "NAVY 3242883", "61", "", ""], ["Total:", "2", "", "121", "41.5", "40"], ["3", "0019555205", "NAVY 3242883", "62", "", ""]]),
    ]
    rows = books.classified_rows(cells_of(spark, tables), spark.createDataFrame([("p", 1, 0, 0, "PO NO:019391")], LINE), spark.createDataFrame([("p", "PEN")], "doc_id string, code string"))
    found = [(r.piece_number[-1], r.lot, r.color, r.po_number, r.carton, r.carton_gross, r.carton_net, r.net_weight) for r in books.rolls_of(rows).orderBy("seq").collect()]
    assert found == [
        ("1", "3242882", "DARK BLACK", "019391", 0, 31.5, 30.0, None), ("2", "3242882", "DARK BLACK", "019391", 0, 31.5, 30.0, None),
        ("3", "3242883", "NAVY", "019391", 1, 41.5, 40.0, None), ("4", "3242883", "NAVY", "019391", 1, 41.5, 40.0, None), ("5", "3242883", "NAVY", "019391", 2, None, None, None),
    ]


def test_empty_and_bare_tables(spark):
    assert books.rolls(spark.createDataFrame([], CELL)).count() == 0
    bare = cells_of(spark, [("d", 1, 0, [["a", None, "b"], [None, None, None]]), ("d", 2, 0, [["c", "d", "e"]])])
    assert books.rolls(bare).count() == 0 and {(r.tbl, r.heading) for r in books.stitched(bare).collect()} == {(0, None)}


@pytest.mark.parametrize("with_pages", [True, False])
def test_shipments_find_their_rolls(spark, with_pages):
    """A record is finished from its tables' or its text's rolls without anybody handing them in."""
    text = "PACKING LIST\nInvoice No: INV-1\nPO # 140928  AMS-1317\nPO # 142400 AMS\n"
    running = "Lot No   Roll No   Shade   Length (M)   Net Weight\nL1   R1   A   10 m   5.00\n\"   R2   A   12 m   6.00\nTotal   2   rolls\n"
    pages = spark.createDataFrame([("d", 1, text, "Artistic Milliners"), ("d", 2, "PO # PD6FB25121101 X and more text here", "Artistic Milliners"), ("t", 1, running, "unknown")], "doc_id string, page_number int, raw_text string, supplier_name string")
    cells = cells_of(spark, AML)
    if not with_pages:
        cells = cells.where("page = 1").drop("page")
    paper = Shipments(pages, cells=cells)
    found = {(r.doc_id, r.piece_number): (r.po_number, r.lot) for r in paper.rolls().collect()}
    assert found["d", "559988021"] == ("140928", "072168 / 002") and found["d", "2"] == ("142400", "L9") and found["t", "R2"] == (None, "L1")
    record = {r.doc_id: r for r in paper.result().collect()}
    assert record["t"].pieces == 2 and record["t"].meters == 22.0
    assert record["d"].lot == "072168 / 002" and record["d"].po_number == "140928"
    context = paper.context(spark.createDataFrame([("d", "packing")], "doc_id string, doc_type string")).where("doc_id = 'd'").first().context
    assert "Extracted Structured Tables" in context and "559988021" in context
    assert paper.rows_left_out().count() == (3 if with_pages else 1) and paper.total_differences().count() == 0


def test_scanned_pages_and_supplier_headers(spark):
    """A page of scraps gives no evidence; a known supplier's values come from where it writes them, whatever the general patterns find."""
    text = "ARTISTIC MILLINERS (PVT) LTD\nINVOICE NO : AM2/EXP/35795/2026  DATED : 7-Jan-26\nTOTAL METERS: 5,000  TOTAL ROLLS: 48\nPO # 140928  AMS-1317\n55% COTTON, 30% T400\nTOTAL METERS: 11,120  TOTAL ROLLS: 116\nTOTAL GROSS WT: 5288.00 KGS  TOTAL NET WT: 5143.00 KGS"
    pages = spark.createDataFrame([("a", 1, "PO: X-1", "Artistic Milliners"), ("a", 2, text, "Artistic Milliners"), ("s", 1, "PO: X-1", None)], "doc_id string, page_number int, raw_text string, supplier_name string")
    paper = Shipments(pages)
    assert paper.evidence().where("doc_id = 's'").count() == 0
    shown = {r.name: r.value for r in paper.response().where("doc_id = 'a'").collect()}
    assert shown["invoice_number"] == "AM2/EXP/35795/2026" and shown["delivered_date"] == "2026-01-07" and shown["po_number"] == "140928" and shown["quality"] == "55% COTTON, 30% T400"
    record = paper.result().where("doc_id = 'a'").first()
    assert (record.net_weight, record.meters, record.pieces) == (5143.0, 11120.0, 116)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("sql, made", [(plan.PAGES, plan.page_cells), (plan.TEXT, plan.page_text), (plan.BARE, plan.bare_cells)])
def test_rendered_in_one_pass(spark, sql, made):
    """The inputs that the queries render are the SQL's rows, by one shuffle of the lines at most."""
    ours, theirs = made(spark, DATA), frame(spark, DATA, sql)
    assert sorted(ours.dtypes) == sorted(theirs.dtypes)
    assert ours.exceptAll(theirs.select(*ours.columns)).isEmpty() and ours.count() == theirs.count()
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(ours) == 1


def test_blocks_follow_one_another(spark):
    """Counts and sums are a block's own, also where the block before ends without a total or has no lengths."""
    table = [HEADS, ["L1", "x", "11", "5", "1"], ["L1", "x", "12", "6", "1"], ["", "", "2", "11", "2"], ["Total", "", "", "11", ""], ["L1", "x", "21", "", "1"], ["L1", "x", "1", "", "1"]]
    kinds = [r.kind for r in books.classified_rows(cells_of(spark, [("d", 1, 0, table)])).orderBy("page_row").collect()]
    assert kinds == ["roll", "roll", "count", "summary", "roll", "count"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pages_as_rows_and_as_cells(spark):
    """Pages that come as one stream of rows and lines give what their cells and lines give, read one by one."""
    codes = plan.book(spark, DATA).select("doc_id", "code").distinct()
    shown = ["doc_id", "page", "page_tbl", "page_row", "tbl", "texts", "code", "section", "section_no", "kind", "piece_number", "meters", "net_weight", "carton"]
    ours, theirs = (x.select(shown) for x in (plan.rows(spark, DATA), books.classified_rows(plan.page_cells(spark, DATA), plan.page_text(spark, DATA), codes)))
    assert ours.exceptAll(theirs).isEmpty() and ours.count() == theirs.count()


def largest_method(spark, frame):
    """Bytes of the largest method that Spark generates for a frame; the JVM compiles none beyond 8,000."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(frame()._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", text))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["book_rolls", "rows_left_out"])
def test_books_shuffle_lines_once_and_compile(spark, name):
    query = registry.QUERIES[name]
    assert query(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert 0 < largest_method(spark, lambda: query(spark, DATA)) <= 8000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_cartons_are_sought_where_they_are_weighed(spark):
    """Suppliers that don't weigh cartons are left out before the lines are shuffled, and nothing else changes."""
    ours = registry.QUERIES["carton_totals"](spark, DATA)
    above, below = ours._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert "% 4) = 3" in below and ours.exceptAll(books.rolls_of(plan.rows(spark, DATA).where("code = 'PEN'")).select(ours.columns)).isEmpty()
    assert largest_method(spark, lambda: registry.QUERIES["carton_totals"](spark, DATA)) <= 8000
