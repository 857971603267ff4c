"""Operators on small hand-made inputs: golden values, ties, blanks, nulls."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from selvedge.api import Shipments
from selvedge.functions import text as T
from selvedge.functions.fixed import ALIASES
from selvedge.operators import checks, evidence, extraction, feedback, fields, pages, rates, records, responses, rolls, tables
from selvedge.sources import readers
from selvedge.streaming import ingest


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_dates(spark):
    raw = ["28-NOV-25", "01/January/24", "09/10/2025", "15.01.2024", "2024-01-02", "24-TEST-001", "31-Foo-24", "7-Jan-26", "12/3456/78", None]
    assert column(spark, raw, T.normal_date) == ["2025-11-28", "2024-01-01", "2025-10-09", "2024-01-15", "2024-01-02", "001-00-24", "2024-00-31", "7-Jan-26", "12/3456/78", None]
    spoken = ["7-Jan-26", "31-DEC-25", "15/03/2024", "March 15 24", "nonsense", None]
    assert column(spark, spoken, T.converted_date) == ["2026-01-07", "2025-12-31", "2024-03-15", "2024-03-15", None, None]
    assert column(spark, ["2024-02-31", "2024-13-01", "x", None], checks.date_error) == [None, "month or day", "not ISO", None]


def test_numbers(spark):
    assert column(spark, ["85,0", "1.796,3", "12.9", "1_000", "5d", "", None], T.coerced) == [850.0, 1.7963, 12.9, None, None, None, None]
    assert column(spark, ["12.9", "-3.9"], lambda x: T.coerced(x, whole=True)) == [12, -3]
    assert column(spark, ["1,245.50 m", "5,000", "60.00-FULL", "59.06-CUTTABLE", "1.245,50", "n/a"], T.clean_number) == [1245.5, 5000.0, 60.0, 59.06, 1245.5, None]
    assert column(spark, [130.0, 1000.0], lambda x: T.yards(x, 1.09361), "double") == ["142.17", "1093.61"]
    assert column(spark, ["\t a, \n", " ,", None], T.field_value) == ["a", None, None]


def test_patterns_first_page_and_supplier(spark):
    texts = [
        ("a", 1, "nothing here", "x"),
        ("a", 2, "PO: AB-1,\nLot A7\nClient PO: ZZ9\nDated 28-NOV-25", "x"),
        ("a", 3, "PO: LATER", "x"),
        ("b", 1, "Client PO: Q_1\nStyle: Twill", "Guston"),
    ]
    found = spark.createDataFrame(texts, "doc_id string, page_number int, raw_text string, supplier_name string")
    out = {r.doc_id: r for r in fields.by_document(found, "supplier_name").collect()}
    assert (out["a"].po_number, out["a"].lot, out["a"].delivered_date) == ("AB-1", "A7", "2025-11-28")
    assert (out["b"].po_number, out["b"].quality) == ("Q_1", "Twill")


def test_lot_pieces_meters(spark):
    text = ["Lot No A1 Lot B2 Batch No. C3 Roll No. 7 Piece 12 Total Metres: 1,200.5", "Lot number", None]
    assert column(spark, text, fields.lot_values) == [["B2", "B2"], [], []]
    assert column(spark, text, fields.most_pieces) == [12, None, None]
    assert column(spark, text, fields.meter_values)[0][0] == "1200.5"


def test_page_kinds(spark):
    rows = [("Grand total of all of the rolls", False), ("packing list and some more words", False), ("roll no and more words here", True), ("x" * 900, False), ("short but long enough text", False), ("tiny", True)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, h boolean")
    got = [r.k for r in frame.select("i", pages.kind(F.col("t"), F.col("h")).alias("k")).orderBy("i").collect()]
    assert got == ["summary", "header", "item_table", "item_table", "header", "scanned"]


def test_chunks_rejoin(spark):
    text = "head\n" + "".join(f"row {i} " + "x" * 90 + "\n" + ("\n" if i % 20 == 0 else "") for i in range(120))
    parts = pages.chunks(spark.createDataFrame([("a", text), ("b", "short"), ("c", "")], "doc_id string, full_text string")).orderBy("doc_id", "chunk").collect()
    mine = [r.content for r in parts if r.doc_id == "a"]
    assert len(mine) > 2 and all(len(p) < 6000 for p in mine)
    assert mine[0] + "".join(p.split("--- [CONTINUED ROWS] ---\n", 1)[1] for p in mine[1:]) == text
    assert [r.content for r in parts if r.doc_id == "b"] == ["short"]


CELLS = [("d", 0, 0, c, h) for c, h in enumerate(["Roll No", "PO Number", "Purchase Order", "Length (yds)", "Pce No"])]
CELLS += [("d", 0, 1, c, h) for c, h in enumerate(["17", "12", "PO-55", "30", "x"])] + [("d", 0, 2, c, h) for c, h in enumerate(["Shade", "1234", "", None, "y"])]


def test_headings_and_candidates(spark):
    cells = spark.createDataFrame(CELLS, "doc_id string, tbl int, row int, col int, text string")
    matched = {(r.row, r.col): r.field for r in tables.matched(cells).collect()}
    assert [matched.get((0, c)) for c in range(5)] == ["pieces", "invoice_number", "order_number", "meters", None]
    assert tables.header_rows(tables.matched(cells)).first().header_row == 0
    found = sorted((r.field, r.value) for r in tables.candidates(cells).collect())
    assert found == [("invoice_number", "1234"), ("meters", "30"), ("order_number", "PO-55"), ("pieces", "17")]


@pytest.mark.parametrize(
    "heading, field",
    [("Shade", "color"), ("Qty (MTR)", "meters"), ("N Wt.(KGS)", "net_weight"), ("Construction", "quality"), ("Length(mts)", "meters"), ("Quantity (M)", "pieces"), ("Material Style", "quality"), ("Your Order", "order_number"), ("Invoice Date", "invoice_number"), ("Lot #", "lot"), ("Dye Lot", "lot"), ("PO #", "po_number"), ("Contract No", "po_number"), ("Customer PO", "po_number"), ("Width", None), ("QTY(MTR)", None), ("Gross Wt", None), ("Delivery Date", None)],
)
def test_golden_headings(spark, heading, field):
    cells = spark.createDataFrame([("d", 0, 0, 0, heading)], "doc_id string, tbl int, row int, col int, text string")
    assert [r.field for r in tables.matched(cells).collect()] == ([field] if field else [])


def test_resolution_ties(spark):
    rows = [("d", "lot", "R", 0.9, "regex", 1, 1), ("d", "lot", "A", 0.9, "ai", 1, 2), ("d", "po_number", "R", 0.9, "regex", 1, 3), ("d", "po_number", "A", 0.9, "ai", 1, 4), ("d", "color", "first", 0.88, "table_col", 1, 5), ("d", "color", "second", 0.88, "table_col", 1, 6), ("d", "quality", None, 0.99, "template", 1, 7)]
    found = spark.createDataFrame(rows, "doc_id string, field string, value string, confidence double, source string, page_number int, ord long")
    won = {r.field: (r.value, r.source) for r in evidence.resolve_all(found, found).collect()}
    assert won["lot"] == ("A", "ai") and won["po_number"] == ("R", "regex") and won["color"] == ("first", "table_col") and won["quality"] == (None, "none") and len(won) == 10


def test_fill_and_identity(spark):
    rows = [("d", i, lot, piece) for i, (lot, piece) in enumerate([("A", "1"), ('"', ""), ("", "3"), ("B", "Total 9"), ('"', None)])]
    frame = spark.createDataFrame(rows, "doc_id string, seq int, lot string, piece_number string")
    assert [r.lot for r in rolls.filled(frame, "lot").orderBy("seq").collect()] == ["A", "A", "A", "B", "B"]
    kept = rolls.identified(rolls.without_summaries(frame)).orderBy("seq").collect()
    assert [(r.seq, r.piece_number) for r in kept] == [(0, "1"), (1, "2"), (2, "3"), (4, "4")]


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id string, seq int, lot string, po_number string, piece_number string, meters double, net_weight double, color string, quality string")
    assert rolls.summary(nothing).count() == 0 and rolls.filled(nothing, "lot").count() == 0
    cells = spark.createDataFrame([], "doc_id string, tbl int, row int, col int, text string")
    assert tables.candidates(cells).count() == 0 and tables.markdown(cells).count() == 0


def test_json_repair(spark):
    whole = '{"packing_list_no":"X","rolls":[{"roll_no":"1","length_mts":100.0},{"roll_no":"2","length_mts":5}]}'
    texts = [whole, f"```json\n{whole}\n```", f"[{whole}]", '{"packing_list_no":"X","rolls":[{"roll_no":"1","length_mts":100.0},{"roll_no":"2","le', "no json", None]
    answers = column(spark, texts, responses.parsed)
    assert [a and len(a.rolls) for a in answers] == [2, 2, 2, 1, None, None] and answers[3].packing_list_no == "X"


def test_actions_and_templates(spark):
    acts = spark.createDataFrame([("j", 1, "s", "lot", "confirm", "A"), ("j", 2, "s", "lot", "reassign", "B"), ("j", 3, "s", "color", "not_present", "x"), ("j", 4, "unknown", "lot", "confirm", "C"), ("j", 5, "s", "bad", "confirm", "x")], "job_id string, seq int, supplier_name string, field string, action string, value string")
    values = spark.createDataFrame([("j", "lot", "old"), ("j", "color", "old"), ("j", "quality", "old")], "job_id string, field string, value string")
    assert {r.field: r.value for r in feedback.applied(values, acts.where("supplier_name = 's'")).collect()} == {"lot": "B", "color": None, "quality": "old"}
    learnt = feedback.corrections(acts.where("field <> 'bad'")).collect()
    assert [(r.supplier_name, r.fields, r.correction_count) for r in learnt] == [("s", {"lot": "B"}, 2)]


def test_admission_batch_is_stream_order(spark):
    times = [("k", t * 1_000_000) for t in (0, 1, 2, 61, 62, 130)]
    frame = spark.createDataFrame([(1, t, i) for i, (_, t) in enumerate(times)], "key long, ts long, event_id long")
    got = [r.admitted for r in rates.admission(frame, per_minute=2, per_day=4).orderBy("event_id").collect()]
    assert got == [True, True, False, True, True, False]


def test_stream_equals_batch(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"packing list page\nPO: AB-{i}00\n\fLot C{i} and some more text")
    ingest.ingest(spark, str(source), str(sink), str(tmp_path / "cp")).awaitTermination()
    streamed = sorted((r.po_number, r.lot) for r in spark.read.parquet(str(sink)).collect())
    batch = sorted((r.po_number, r.lot) for r in ingest.extracted(readers.text_pages(spark, str(source))).collect())
    assert streamed == batch == [(f"AB-{i}00", f"C{i}") for i in range(3)]


def test_uploads_and_parser(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"\xff")
    files = readers.uploads(spark, str(tmp_path))
    got = readers.parsed_pages(files, lambda content: content.decode().split("\f")).orderBy("page_number").collect()
    assert [(r.page_number, r.raw_text) for r in got] == [(1, "one"), (2, "two")]


def test_whole_pipeline_and_workbook(spark):
    frame = spark.createDataFrame([("d", 1, "packing list\nPO: AB-100\nLot A7 and so on", " ")], "doc_id string, page_number int, raw_text string, supplier_name string")
    cells = spark.createDataFrame([("d", 0, 0, 0, "Shade"), ("d", 0, 1, 0, "Navy")], "doc_id string, tbl int, row int, col int, text string")
    record = Shipments(frame, cells).result().first()
    assert (record.po_number, record.lot, record.color) == ("AB-100", "A7", "Navy") and "po_number" not in record.flagged_fields and "meters" in record.flagged_fields
    lines = spark.createDataFrame([("d", 1, "L", "P", "1", 10.0, 2.5, "c"), ("d", 2, "L", None, "2", 0.0, 0.0, None)], "doc_id string, seq int, lot string, po_number string, piece_number string, meters double, net_weight double, color string")
    records = spark.createDataFrame([("d", "L", "Q", "red", 2, 10.0, 2.5)], "doc_id string, lot string, po_number string, color string, pieces int, meters double, net_weight double")
    rows = rolls.sheet_rows(lines, records).orderBy("row").collect()
    assert [(r.row, r.lot_no, r.po, r.shade, r.length_mts, r.length_yds) for r in rows] == [(9, "L", "P", "c", "10.00", "10.94"), (10, '"', "Q", "red", "", "")]
    book = Shipments.workbooks(lines, records).first().content
    assert "LOT No" in zipfile.ZipFile(io.BytesIO(bytes(book))).read("xl/worksheets/sheet1.xml").decode()


def test_workbook_has_all_cells(spark):
    lines = spark.createDataFrame([("d", 1, "L1", None, "77", "red", 10.0, 10.5, 3.0, 2.0, 5.0, 4.0), ("e", 1, "x", "P", "1", "c", 1.0, None, None, None, None, 1.0)], "doc_id string, seq int, lot string, po_number string, piece_number string, color string, meters double, length_yds double, points_per_roll double, points_per_100m2 double, weight_gross_kgs double, net_weight double")
    records = spark.createDataFrame([("d", "acme", "I-1", "2024-01-02", "Twill", "L", "Q", "blue", 1, 10.0, 4.0)], "doc_id string, supplier_name string, invoice_number string, delivered_date string, quality string, lot string, po_number string, color string, pieces int, meters double, net_weight double")
    books = {r.doc_id: bytes(r.content) for r in Shipments.workbooks(lines, records).collect()}
    assert sorted(books) == ["d", "e"]  # e has lines but no record
    sheet = zipfile.ZipFile(io.BytesIO(books["d"])).read("xl/worksheets/sheet1.xml").decode()
    cells = dict(re.findall(r'<c r="([A-Z]+[0-9]+)"[^>]*><is><t[^>]*>([^<]*)</t>', sheet))
    heads = ["LOT No", "PO #", "Shade", "Roll No", "Length (mts)", "Length (yds)", "Total Points /Roll", "Points / 100m2", "Weight (Gross kgs)", "Weight (Nett kgs)"]
    expected = {"C1": "Exporter / Manufacturer:", "D1": "ACME", "A3": "Packing list No:", "B3": "I-1", "C3": "Date:", "D3": "2024-01-02", "E3": "Net Weight:", "F3": "4.00", "G3": "Total Length:", "H3": "10.00", "A4": "Product:", "B4": "Twill"}
    expected |= {f"{c}8": h for c, h in zip("ABCDEFGHIJ", heads)}
    expected |= {f"{c}9": v for c, v in zip("ABCDEFGHIJ", ["L1", "Q", "red", "77", "10.00", "10.50", "3.00", "2.00", "5.00", "4.00"])}
    assert cells == expected
    assert [re.search(r"\d+", r)[0] for r in re.findall(r'<row r="\d+"', sheet)] == ["1", "3", "4", "8", "9"]


def test_finished_record(spark):
    """Values from running text, totals and several lots from rolls, weights of tables against the stated one."""
    frame = spark.createDataFrame([("d", 1, "packing list of some goods\nNet Weight: 1,000.0\nBatch X77 and Roll 12 of them\n", "acme"), ("e", 1, "nothing much to be read on this page", None), ("f", 1, "Net Weight: 100\nLot A1 is what there is", "acme")], "doc_id string, page_number int, raw_text string, supplier_name string")
    cells = spark.createDataFrame([("d", 0, 0, 0, "Net Weight"), ("d", 0, 1, 0, "600"), ("d", 0, 2, 0, "1,380.5"), ("d", 0, 3, 0, "n/a"), ("f", 0, 0, 0, "Net Wt (KG)"), ("f", 0, 1, 0, "101.9")], "doc_id string, tbl int, row int, col int, text string")
    lines = spark.createDataFrame([("e", 1, "L1", "red", "q", 10.25), ("e", 2, "L2", "red", "", 10.5), ("f", 1, "A1", None, None, 0.0)], "doc_id string, seq int, lot string, color string, quality string, meters double")
    templates = spark.createDataFrame([("acme", {"order_number": "O-9"}, "2")], "supplier_name string, fields map<string,string>, schema_version string")
    got = {r.doc_id: r for r in Shipments(frame, cells, templates, lines=lines).result().collect()}
    d, e, f = got["d"], got["e"], got["f"]
    assert (d.lot, d.pieces, d.net_weight, d.weight_mismatch, d.order_number, d.mapping_source) == ("X77", 12, 1000.0, True, "O-9", "template")
    assert d.sources["pieces"] == "text_pattern" and "net_weight" in d.flagged_fields.split(",")
    assert (e.lot, e.color, e.quality, e.pieces, e.meters, e.mapping_source) == ("MIXED (L1, L2)", "red", "q", 2, 20.75, "regex")
    assert (e.sources["lot"], e.sources["color"], e.sources["meters"]) == ("aggregated", "fallback_from_lines", "aggregated") and not e.weight_mismatch
    assert (f.lot, f.pieces, f.weight_mismatch) == ("A1", 1, False) and "net_weight" not in f.flagged_fields.split(",") and f.errors == ""


def test_places_of_large_tables_keep_their_order(spark):
    cells = [("d", 0, 0, 0, "Shade"), ("d", 1, 0, 0, "Shade"), ("d", 0, 1500, 0, "Late"), ("d", 1, 1, 0, "Early")]
    frame = spark.createDataFrame([("d", 1, "a page without any of the fields", "x")], "doc_id string, page_number int, raw_text string, supplier_name string")
    got = Shipments(frame, spark.createDataFrame(cells, "doc_id string, tbl int, row int, col int, text string")).result().first()
    assert got.color == "Late"


def test_context_of_key_pages(spark):
    rows = [("d", n, "item_table" if n % 2 else "header", "roll_level", f"text {n}" if n != 4 else "") for n in range(1, 20)]
    frame = spark.createDataFrame(rows, "doc_id string, page_number int, page_type string, doc_type string, raw_text string")
    found = spark.createDataFrame([("d", 2, 1, "y"), ("d", 2, 0, "x"), ("d", 3, 0, "z")], "doc_id string, page_number int, tbl int, markdown string")
    text = pages.context(frame, found).first().context
    first = "--- Page 1 (item_table) ---\ntext 1\n"
    second = "--- Page 2 (header) ---\ntext 2\n\n--- Extracted Structured Tables ---\n\nTable 1:\nx\n\nTable 2:\ny\n"
    assert text.startswith(first + "\n\n" + second + "\n\n--- Page 6 (header)") and text.endswith("--- Page 19 (item_table) ---\ntext 19\n")
    assert pages.context(frame, most=10).first().context == first[:10] and pages.context(frame.limit(0)).count() == 0


def test_ingest_to_records(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Invoice No: INV-77, packing list\fLot B22 follows on the second page")
    own = Shipments.ingest(spark, str(tmp_path), lambda content: content.decode().split("\f"))
    got = own.result().first()
    assert (got.invoice_number, got.lot) == ("INV-77", "B22")
    assert [(r.seq, r.msg) for r in Shipments.log(spark.createDataFrame([("j", 1, "read")], "job_id string, ord long, msg string")).orderBy("seq").collect()] == [(1, "read"), (2, "DONE")]


def test_ocr_coalesce(spark):
    own = spark.createDataFrame([("d", 1, "scanned", ""), ("d", 2, "header", "enough text to be a page")], "doc_id string, page_number int, page_type string, raw_text string")
    ocr = spark.createDataFrame([("d", 1, "tiny", "text of the image"), ("d", 2, "direct text that is long enough", "x")], "doc_id string, page_number int, direct_text string, image_text string")
    got = pages.ocr_filled(own, ocr).orderBy("page_number").collect()
    assert [(r.page_type, r.raw_text) for r in got] == [("item_table", "text of the image"), ("header", "enough text to be a page")]


def test_two_sections_of_rolls(spark):
    text = """SHIPMENT OF DENIM
PO # 140928
LOT NO   Roll No   Shade   Length(mts)   Weight (Nett kgs)
072168 / 002   559988021   A   60.00-FULL   30.60
"   559988022   A   1,059.06   29.9
Total   2   rolls
PO # 140929
Lot No | Roll No | Shade | Length (m) | Net Wt
072168 / 003 |  | B | 85 m | 40
" | 17 | " | 1.245,50 | 41
GRAND TOTAL | 4"""
    frame = spark.createDataFrame([("d", text), ("e", "no table at all"), ("f", None)], "doc_id string, full_text string")
    got = extraction.extracted(extraction.lines_of(frame)).orderBy("doc_id", "seq").collect()
    assert [(r.lot, r.po_number, r.piece_number, r.color, r.meters, r.net_weight) for r in got] == [
        ("072168 / 002", "140928", "559988021", "A", 60.0, 30.6),
        ("072168 / 002", "140928", "559988022", "A", 1059.06, 29.9),
        ("072168 / 003", "140929", "3", "B", 85.0, 40.0),
        ("072168 / 003", "140929", "17", "B", 1245.5, 41.0),
    ]


def test_rolls_are_read_in_two_windows(spark):
    lines = spark.createDataFrame([("d", 0, "x")], "doc_id string, seq int, line string")
    plan = extraction.extracted(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2
    assert plan.count("lambdafunction(") <= 3  # headings alone are looked at cell by cell
    assert "keys: [" not in plan  # sets of names, no map that is walked through


def test_odd_lines_of_rolls(spark):
    text = "\r\n".join(["  Lot No|Roll No |  Shade\t\tLength (M) | PO Number ", "|7||17 m|", "L1 | | \" | 1.2.3 | P-1", "\xa0L2\xa0  8  Red  -3,5  ''", " PO: 77 ", "〃  9  |12,|", "only one cell", " sub-total | 3 | x", "SHADE  Lot", "L3   10", "Roll No  Colour  Net Wt.(KGS)", "11  Blue  1.245,50"])
    frame = spark.createDataFrame([("d", text), ("e", "Lot No  Roll No  Shade\rA  1  R\n\nB  2  \""), ("f", "")], "doc_id string, full_text string")
    got = extraction.extracted(extraction.lines_of(frame)).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.seq, r.lot, r.po_number, r.piece_number, r.color, r.meters, r.net_weight) for r in got] == [
        ("d", 1, None, None, "7", None, 17.0, None),
        ("d", 2, "L1", "P-1", "2", None, None, None),
        ("d", 3, "L2", "P-1", "8", "Red", -35.0, None),
        ("d", 5, "L2", "P-1", "9", "12,", None, None),
        ("d", 8, "SHADE", "P-1", "Lot", "12,", None, None),
        ("d", 9, "L3", "P-1", "10", "12,", None, None),
        ("d", 11, "L3", "P-1", "11", "Blue", None, 1245.5),
        ("e", 1, "A", None, "1", "R", None, None),
        ("e", 3, "B", None, "2", "R", None, None),
    ]


def test_upsert_keeps_other_fields(spark):
    old = spark.createDataFrame([("s", {"lot": "A", "color": "red"}, "2", 3), ("t", {"lot": "Z"}, "2", 0)], "supplier_name string, fields map<string,string>, schema_version string, correction_count long")
    new = spark.createDataFrame([("s", {"lot": "B"}, 2), ("u", {"lot": "N"}, 1)], "supplier_name string, fields map<string,string>, correction_count long")
    got = {r.supplier_name: (r.fields, r.correction_count) for r in feedback.upserted(old, new).collect()}
    assert got == {"s": ({"lot": "B", "color": "red"}, 5), "t": ({"lot": "Z"}, 0), "u": ({"lot": "N"}, 1)}


def test_stripped_of_any_white_space(spark):
    """White space of any kind goes at both ends and stays within; dates and values are read once."""
    rows = spark.createDataFrame([(1, "　\t a b  "), (2, "ab"), (3, " "), (4, None), (5, "é "), (6, " x ,, \n")], "k int, x string")
    got = {r.k: (r.s, r.v) for r in rows.select("k", T.stripped(F.col("x")).alias("s"), T.field_value(F.col("x")).alias("v")).collect()}
    assert got == {1: ("a b", "a b"), 2: ("ab", "ab"), 3: ("", None), 4: (None, None), 5: ("é", "é"), 6: ("x ,,", "x")}
    plan = rows.select(T.normal_date(F.regexp_extract("x", "(q+)", 1)).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(q+)") == 1


def test_first_values_of_tables(spark):
    """What a document's tables say first of each field, and their weight, is what all candidates and weights() say, by one pass over the rows."""
    rng = random.Random(5)
    heads = ["Roll No", "Dye Lot", "Total Meters", "NW", "Net Weight", "Shade", "Width", "Customer PO", "Pce No", "", None, "Invoice No", " lot ", "Qty(MTR)"]
    cells = ["", " ", None, "12", "1234", "L12", "Shade", "roll no", " 7,5 ", "-3", "PO-1", "Navy", "0.5"]
    rows = [(d, t, r, [rng.choice(heads if r < 3 and rng.random() < 0.6 else cells) for _ in range(rng.randrange(1, 6))]) for d in range(60) for t in range(rng.randrange(1, 4)) for r in range(rng.randrange(1, 9)) if rng.random() < 0.9]
    frame = spark.createDataFrame(rows, "doc_id long, tbl int, row int, texts array<string>")
    long = frame.select("doc_id", "tbl", "row", F.posexplode("texts").alias("col", "text"))
    expected, names = {}, list(ALIASES)
    for r in sorted(tables.candidates(long).collect(), key=lambda r: (r.tbl, r.row, r.col)):
        expected.setdefault((r.doc_id, r.field), r.value)
    got, weights = {}, {}
    for r in tables.first_values(frame).collect():
        for x in r.firsts:
            got.setdefault((r.doc_id, names[x.k]), x.value)
        weights |= {r.doc_id: r.weight} if r.weight is not None else {}
    assert got == expected and len(got) > 100
    assert weights == {r.doc_id: r.weight for r in tables.weights(long).collect()} and weights


def test_meaning_of_headings(spark):
    """A heading's meaning within a row is that of the join with all aliases."""
    rng = random.Random(6)
    names = [n.lower() for every in ALIASES.values() for n in every]
    pieces = [*names, " ", "x", "po", "lot", "mtr", ".", "pcs", "s", "/", "total", "l12"]
    texts = sorted({*names, *(f.replace("_", " ") for f in ALIASES), *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))) for _ in range(800)), *(f"{a}{b}{c}" for a in ("po", "lot", "q") for b in (" ", ".", "") for c in ("po", "mtr", "z", "")), "l12", "é po", "po\n"})
    frame = spark.createDataFrame([(t,) for t in texts], "heading string")
    order = list(ALIASES)
    ours = {r.heading: order[r.k] for r in frame.select("heading", tables.meaning(F.col("heading")).alias("k")).collect() if r.k is not None}
    assert ours == {r.heading: r.field for r in tables.meanings(frame, tables.alias_table(spark)).collect()} and len(ours) > 300


def test_records_at_once_are_those_of_all_evidence(spark):
    """Without templates and a model the winners are found without all evidence; they and the records are the same."""
    pages = [
        ("a", 1, "ARTISTIC MILLINERS (PVT) LTD\nINVOICE NO : AM2/1  DATED : 7-Jan-26\nTOTAL METERS: 11,120  TOTAL ROLLS: 116\nPO # 140928 X", "Artistic Milliners"), ("a", 2, "Net Weight: 12,5\nLot A77 and Batch B9 of the order", None),
        ("b", 1, "Lot Z9 and more running text\nRoll No 7 Roll 9\n55.5 Metres in all", "techs"), ("b", 2, "short", "techs"), ("c", 1, "", None), ("c", 2, None, ""), ("d", 2, "Client PO: W12\nStyle: Twill soft\nColour: Navy blue\nTotal Rolls: 3", "Guston"), ("d", 1, "Quality: Drill of the first page", "Guston"),
    ]
    own = spark.createDataFrame(pages, "doc_id string, page_number int, raw_text string, supplier_name string")
    cells = [("a", 0, 0, ["Lot No", "Shade", "Net Weight"]), ("a", 0, 1, ["L1", "Red", "5"]), ("a", 0, 2, ["L2", "Red", "9"]), ("d", 0, 0, ["Shipment"]), ("d", 0, 1, ["Roll No", "Metres", "NW"]), ("d", 0, 2, ["1", "20", "3"]), ("c", 0, 0, ["Width"]), ("c", 1, 0, ["Batch", "Pcs"]), ("c", 1, 1, ["", "4"]), ("c", 1, 2, ["B7", "5"])]
    rows = spark.createDataFrame(cells, "doc_id string, tbl int, row int, texts array<string>")
    long = rows.select("doc_id", "tbl", "row", F.posexplode("texts").alias("col", "text"))
    lines = spark.createDataFrame([("a", "L1", "Red", "x", 5.0), ("a", "L2", "Red", "x", 6.0), ("d", "", "Red", None, 7.25)], "doc_id string, lot string, color string, quality string, meters double")
    for given in (rows, long, None):
        paper = Shipments(own, given, lines=lines)
        weights = None if given is None else tables.weights(paper.cells)
        theirs = records.finished(paper.resolved(), paper.rolls(), weights)
        assert sorted(map(repr, paper.result().collect())) == sorted(map(repr, theirs.collect()))
