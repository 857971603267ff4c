"""Queries on pages, text fields and tables: papers rendered from orders, and the documents table for what needs no shipment words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Shipments
from ..functions import text as T
from ..functions.fixed import ALIASES, FIELDS, HEADER_PRIORITY, HEADER_WORDS, ITEM_WORDS, LOT_NOT, LOT_PATTERNS, LOT_SIGNATURE, LOT_WORDS, METER_PATTERNS, PATTERNS, PIECE_PATTERNS, ROLL_SIGNATURE, ROLL_WORDS, SHORT_ALIASES, SHOWN_PATTERNS, SUMMARY_WORDS, SUPPLIER_PATTERNS, TABLE_FIELDS, TABLE_PRIORITY, WEIGHT_HEADINGS
from ..operators import fields, pages, tables
from ..sources.rendered import CELLS, PAPERS, ROLLS, dealt, duck, frame, rolls_dealt, table_cells, table_lines
from .registry import query

SPACE = r"'^\s+|\s+$'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def _score(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, {q(w)})::INT" for w in words) + ")"


def papers(spark, sf_dir):
    """Papers dealt by document, as pages would be: a table in one file would leave all patterns to one task, and what groups by document needs no other shuffle."""
    return spark.sql(PAPERS, orders=dealt(spark, sf_dir, "orders", "o_orderkey"))


def cells(spark, sf_dir):
    return table_cells(spark, sf_dir)


WITH_PAPERS = f"WITH papers AS ({duck(PAPERS)})"
WITH_CELLS = f"WITH cells AS ({duck(CELLS)})"


def _kind_sql(t: str, has_tables: str) -> str:
    low, n = f"lower({t})", f"length({t})"
    return f"""CASE WHEN length(regexp_replace({t}, {SPACE}, '', 'g')) < 20 THEN 'scanned' WHEN {_any(low, SUMMARY_WORDS)} AND contains({low}, 'total') AND (NOT {has_tables} OR {n} < 800) THEN 'summary'
        WHEN {_any(low, HEADER_WORDS)} AND {n} < 1500 THEN 'header' WHEN {_any(low, ITEM_WORDS)} AND {has_tables} THEN 'item_table' WHEN {has_tables} THEN 'item_table' WHEN {n} < 800 THEN 'header' ELSE 'item_table' END"""


@query("page_classify", f"{WITH_PAPERS} SELECT doc_id, {_kind_sql('raw_text', '(doc_id % 2 = 0)')} AS page_type FROM papers UNION ALL SELECT -1 - doc_id, {_kind_sql('text', '(doc_id % 3 = 0)')} FROM documents")
def page_classify(spark, sf_dir):
    own = papers(spark, sf_dir).select("doc_id", pages.kind(F.col("raw_text"), F.col("doc_id") % 2 == 0).alias("page_type"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return own.unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), pages.kind(F.col("text"), F.col("doc_id") % 3 == 0).alias("page_type")))


@query("scan_needs_ocr", f"SELECT doc_id, length(regexp_replace(text, {SPACE}, '', 'g')) < 20 AS needs_ocr FROM documents")
def scan_needs_ocr(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", pages.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("keyword_classify", f"{WITH_PAPERS} SELECT doc_id, CASE WHEN {_score('lower(raw_text)', ROLL_WORDS)} > {_score('lower(raw_text)', LOT_WORDS)} THEN 'roll_level' WHEN {_score('lower(raw_text)', LOT_WORDS)} > {_score('lower(raw_text)', ROLL_WORDS)} THEN 'lot_level' ELSE 'unknown' END AS doc_type FROM papers")
def keyword_classify(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", pages.word_kind(F.col("raw_text")).alias("doc_type"))


#: Events as pages: a user is a document, the event's minute the page.
PAGES = "SELECT user_id AS doc_id, event_id AS page_number, CASE event_type WHEN 'view' THEN 'item_table' WHEN 'signup' THEN 'header' WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'summary' ELSE 'item_table' END ELSE 'item_table' END AS page_type, CASE WHEN user_id % 7 = 0 THEN 'hybrid' ELSE 'roll_level' END AS doc_type, concat('page ', CAST(event_id AS STRING), ' of ', event_type, CASE WHEN event_id % 5 = 0 THEN '' ELSE ' with enough text' END) AS raw_text FROM {events}"


@query("key_pages", f"""WITH p AS ({duck(PAGES)}), w AS (SELECT *, count(*) OVER d AS n, max(page_number) OVER d AS last, min(page_number) OVER k AS lo, max(page_number) OVER k AS hi, count(*) FILTER (WHERE page_type = 'summary') OVER d AS sums FROM p WINDOW d AS (PARTITION BY doc_id), k AS (PARTITION BY doc_id, page_type))
    SELECT doc_id, page_number, page_type FROM w WHERE n <= 15 OR doc_type = 'hybrid' OR page_type = 'header' OR (page_type = 'item_table' AND page_number = lo) OR (page_type = 'summary' AND page_number = hi) OR (sums = 0 AND page_number = last)""")
def key_pages(spark, sf_dir):
    return pages.key_pages(frame(spark, sf_dir, PAGES))


@query("full_text", f"WITH p AS ({duck(PAGES)}) SELECT doc_id, coalesce(string_agg(raw_text, chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE length(trim(raw_text)) >= 20), '') AS full_text FROM p GROUP BY doc_id")
def full_text(spark, sf_dir):
    return pages.full_text(frame(spark, sf_dir, PAGES))


#: The key pages of PAGES.
KEY = f"""WITH p AS ({duck(PAGES)}), w AS (SELECT *, count(*) OVER d AS n, max(page_number) OVER d AS last, min(page_number) OVER k AS lo, max(page_number) OVER k AS hi, count(*) FILTER (WHERE page_type = 'summary') OVER d AS sums FROM p WINDOW d AS (PARTITION BY doc_id), k AS (PARTITION BY doc_id, page_type)),
    keys AS (SELECT * FROM w WHERE n <= 15 OR doc_type = 'hybrid' OR page_type = 'header' OR (page_type = 'item_table' AND page_number = lo) OR (page_type = 'summary' AND page_number = hi) OR (sums = 0 AND page_number = last))"""
#: Every fourth page has a table, every eighth two.
PAGE_TABLES = "SELECT user_id AS doc_id, event_id AS page_number, k AS tbl, concat('a | b', chr(10), '---', chr(10), CAST(event_id AS STRING), ' | ', CAST(k AS STRING)) AS markdown FROM {events} CROSS JOIN (VALUES (0), (1)) AS t(k) WHERE event_id % 4 = 0 AND (k = 0 OR event_id % 8 = 0)"


@query("context_text", KEY + f""", t AS (SELECT doc_id, page_number, string_agg(concat(chr(10), 'Table ', tbl + 1, ':', chr(10), markdown, chr(10)), '' ORDER BY tbl) AS shown FROM ({duck(PAGE_TABLES)}) GROUP BY ALL)
    SELECT doc_id, substr(string_agg(concat('--- Page ', page_number, ' (', page_type, ') ---', chr(10), raw_text, chr(10), chr(10) || '--- Extracted Structured Tables ---' || chr(10) || shown), chr(10) || chr(10) ORDER BY page_number), 1, {pages.MOST_CONTEXT}) AS context FROM keys LEFT JOIN t USING (doc_id, page_number) GROUP BY doc_id""")
def context_text(spark, sf_dir):
    return pages.context(frame(spark, sf_dir, PAGES), frame(spark, sf_dir, PAGE_TABLES))


@query("chunk_text", rf"""WITH RECURSIVE ends AS (SELECT '\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}' AS e),
    docs AS (SELECT doc_id, text, CASE WHEN length(text) > {pages.CHUNK} THEN regexp_extract_all(text, concat('[^', e, ']*(?:\r\n|[', e, '])|[^', e, ']+$')) END AS lines FROM documents, ends WHERE text IS NOT NULL),
    fold(doc_id, i, done, now) AS (
        SELECT doc_id, 1, CAST([] AS VARCHAR[]), '' FROM docs WHERE lines IS NOT NULL
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN cut THEN list_append(done, now) ELSE done END, CASE WHEN cut THEN line ELSE now || line END
        FROM (SELECT f.*, lines[i] AS line, length(now) + length(lines[i]) > {pages.CHUNK} AND now <> '' AND (length(now) + length(lines[i]) > {pages.FORCED} OR regexp_matches(lines[i], '^\s*(PO #|Page )') OR regexp_matches(lines[i], '^\s*$')) AS cut FROM fold f JOIN docs USING (doc_id) WHERE i <= len(lines))),
    parts AS (SELECT doc_id, text, [text] AS parts FROM docs WHERE lines IS NULL UNION ALL SELECT doc_id, text, CASE WHEN now = '' THEN done ELSE list_append(done, now) END FROM fold JOIN docs USING (doc_id) WHERE i = len(lines) + 1),
    numbered AS (SELECT doc_id, text, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS chunk FROM parts)
    SELECT doc_id, chunk::INTEGER AS chunk, CASE WHEN chunk > 0 THEN concat('--- [DOCUMENT HEADER FOR CONTEXT] ---', chr(10), substr(text, 1, {pages.CONTEXT}), chr(10), '--- [CONTINUED ROWS] ---', chr(10), content) ELSE content END AS content FROM numbered""")
def chunk_text(spark, sf_dir):
    return pages.chunks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL"), "text")


def _capture(text: str, pattern: str) -> str:
    return f"nullif(rtrim(regexp_replace(rtrim(regexp_replace(regexp_extract({text}, {q('(?im)' + pattern)}, 1), {SPACE}, '', 'g'), ','), {SPACE}, '', 'g'), ','), '')"


def _first(text: str, patterns) -> str:
    return "coalesce(" + ", ".join(_capture(text, p) for p in patterns) + ")" if len(patterns) > 1 else _capture(text, patterns[0])


def _date_sql(x: str) -> str:
    month = f"lpad(CAST(coalesce(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(regexp_extract({x}, '[A-Za-z]+'), 1, 3))), 0) AS VARCHAR), 2, '0')"
    named = r"'^(\d{2})[-/]([A-Za-z]{3,})[-/](\d{2,4})$'"
    year = f"regexp_extract({x}, {named}, 3)"
    return rf"""CASE WHEN regexp_matches({x}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN {x} WHEN regexp_matches({x}, '^\d{{2}}[/.]\d{{2}}[/.]\d{{4}}$') THEN concat(substr({x}, 7, 4), '-', substr({x}, 4, 2), '-', substr({x}, 1, 2))
        WHEN regexp_matches({x}, {named}) THEN concat(CASE WHEN length({year}) = 2 THEN '20' ELSE '' END, {year}, '-', {month}, '-', substr({x}, 1, 2)) ELSE {x} END"""


#: The papers as pages: in every second document the first page ends before its weight and the rest comes on the second, in the others both are whole; the second one names another lot.
TWO_PAGES = "SELECT doc_id, page_number, CASE WHEN page_number = 1 AND doc_id % 2 = 0 THEN substr(raw_text, 1, instr(raw_text, 'Net Weight') - 1) WHEN page_number = 2 THEN concat('Lot Z9', chr(10), raw_text) ELSE raw_text END AS raw_text FROM {papers} CROSS JOIN (VALUES (1), (2)) AS n(page_number)"


def _fields_sql(general: bool) -> str:
    out = []
    for field, patterns in PATTERNS.items():
        x = _first("raw_text", patterns)
        if not general:
            for name, own in SUPPLIER_PATTERNS.items():
                if field in own:
                    x = f"CASE WHEN lower(supplier_name) = '{name}' THEN coalesce({_first('raw_text', own[field])}, {x}) ELSE {x} END"
        out.append(f"{x} AS {field}")
    columns = [f"{_date_sql(f)} AS {f}" if f == "delivered_date" else f for f in PATTERNS]
    if general:
        first = ", ".join(f"arg_min({f}, page_number) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in PATTERNS)
        return f"{WITH_PAPERS}, pages AS ({TWO_PAGES.replace('{papers}', 'papers')}), found AS (SELECT doc_id, page_number, {', '.join(out)} FROM pages), dated AS (SELECT doc_id, page_number, {', '.join(columns)} FROM found) SELECT doc_id, {first} FROM dated GROUP BY doc_id"
    return f"{WITH_PAPERS}, found AS (SELECT doc_id, {', '.join(out)} FROM papers) SELECT doc_id, {', '.join(columns)} FROM found"


@query("regex_fields", _fields_sql(True))
def regex_fields(spark, sf_dir):
    return fields.by_document(spark.sql(TWO_PAGES, papers=papers(spark, sf_dir)))


@query("regex_supplier", _fields_sql(False))
def regex_supplier(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", fields.by_page(F.col("raw_text"), F.col("supplier_name")).alias("found")).select("doc_id", "found.*")


def _all(pattern: str) -> str:
    return f"regexp_extract_all(raw_text, {q('(?i)' + pattern)}, 1)"


@query("lot_text_pattern", f"{WITH_PAPERS}, found AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS n, list_filter({_all(p)}, lambda x: x <> '' AND lower(x) NOT IN {LOT_NOT})[1] AS value FROM papers" for k, p in enumerate(LOT_PATTERNS)) + ") SELECT doc_id, string_agg(value, '|' ORDER BY n) AS lots FROM found WHERE value IS NOT NULL GROUP BY doc_id")
def lot_text_pattern(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", F.array_join(fields.lot_values(F.col("raw_text")), "|").alias("lots")).where("lots <> ''")


@query("pieces_text_pattern", f"{WITH_PAPERS} SELECT doc_id, list_max(list_transform(list_concat({_all(PIECE_PATTERNS[0])}, {_all(PIECE_PATTERNS[1])}), lambda x: CAST(x AS BIGINT))) AS pieces FROM papers")
def pieces_text_pattern(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", fields.most_pieces(F.col("raw_text")).alias("pieces"))


@query("meters_text_pattern", f"{WITH_PAPERS}, found AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS n, list_filter(list_transform({_all(p)}, lambda x: replace(x, ',', '')), lambda x: try_cast(x AS DOUBLE) > 0)[1] AS value FROM papers" for k, p in enumerate(METER_PATTERNS)) + ") SELECT doc_id, string_agg(value, '|' ORDER BY n) AS meters FROM found WHERE value IS NOT NULL GROUP BY doc_id")
def meters_text_pattern(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", F.array_join(fields.meter_values(F.col("raw_text")), "|").alias("meters")).where("meters <> ''")


def _shown_sql(field: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(raw_text, {q('(?i)' + p)}, 1), '')" for p in SHOWN_PATTERNS[field]) + ", CASE WHEN contains(raw_text, 'Navy') THEN 'Navy' END)"


@query("highlight", f"{WITH_PAPERS} SELECT doc_id, " + ", ".join(f"{_shown_sql(f)} AS {f}" for f in ("lot", "po_number", "quality", "color")) + " FROM papers")
def highlight(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", *[fields.shown(F.col("raw_text"), f, F.lit("Navy")).alias(f) for f in ("lot", "po_number", "quality", "color")])


def _alias_rows(aliases) -> str:
    return ", ".join(f"({q(f)}, {k}, {q(a)})" for k, (f, names) in enumerate(aliases.items()) for a in dict.fromkeys(n.lower() for n in names))


SHORT_SQL = ", ".join(q(s) for s in SHORT_ALIASES)
MATCHED = f"""{WITH_CELLS}, aliases(field, k, alias) AS (VALUES {_alias_rows(ALIASES)}), heads AS (SELECT *, lower(trim(text)) AS h FROM cells WHERE row < 3 AND trim(coalesce(text, '')) <> ''),
    meant AS (SELECT h, arg_min(field, k) AS field FROM (SELECT DISTINCT h FROM heads) JOIN aliases ON h = replace(field, '_', ' ') OR h = alias OR (length(alias) > 3 AND contains(h, alias)) OR (alias IN ({SHORT_SQL}) AND (starts_with(h, alias || ' ') OR ends_with(h, ' ' || alias) OR starts_with(h, alias || '.'))) GROUP BY h),
    matched AS (SELECT doc_id, tbl, row, col, field FROM heads JOIN meant USING (h)),
    best AS (SELECT doc_id, tbl, arg_max(row, (n, -row)) AS header_row, max(n) AS n_columns FROM (SELECT doc_id, tbl, row, count(*) AS n FROM matched GROUP BY ALL) GROUP BY doc_id, tbl)"""
ECHOES = ", ".join(q(e) for e in tables.echoes())


@query("header_match", MATCHED + " SELECT doc_id, tbl, row, col, field FROM matched")
def header_match(spark, sf_dir):
    return tables.matched(cells(spark, sf_dir))


@query("header_row", MATCHED + " SELECT doc_id, tbl, header_row, n_columns FROM best")
def header_row(spark, sf_dir):
    return tables.header_rows(tables.matched(cells(spark, sf_dir)))


@query("table_candidates", MATCHED + f""", cols AS (SELECT m.doc_id, m.tbl, header_row, col, field FROM matched m JOIN best b ON m.doc_id = b.doc_id AND m.tbl = b.tbl AND m.row = b.header_row)
    SELECT c.doc_id, c.tbl, c.row, c.col, field, trim(text) AS value FROM cells c JOIN cols USING (doc_id, tbl, col) WHERE c.row > header_row AND trim(text) <> '' AND lower(trim(text)) NOT IN ({ECHOES}) AND NOT (field IN ('lot', 'order_number', 'invoice_number', 'po_number') AND regexp_matches(trim(text), '^[0-9]{{1,3}}$'))""")
def table_candidates(spark, sf_dir):
    return tables.candidates(cells(spark, sf_dir))


@query("header_echo_antijoin", f"{WITH_CELLS} SELECT doc_id, tbl, row, col, text FROM cells WHERE row > 0 AND lower(text) NOT IN ({ECHOES})")
def header_echo_antijoin(spark, sf_dir):
    return tables.without_echoes(cells(spark, sf_dir)).select("doc_id", "tbl", "row", "col", "text")


def _signature(name: str, signature) -> str:
    return f"""{name}_alias(field, k, alias) AS (VALUES {_alias_rows(signature)}), {name}_meant AS (SELECT h, arg_min(field, k) AS field FROM (SELECT DISTINCT h FROM heads) JOIN {name}_alias ON contains(h, alias) OR contains(alias, h) GROUP BY h),
        {name}_score AS (SELECT doc_id, tbl, count(DISTINCT field) AS {name}_score FROM heads JOIN {name}_meant USING (h) GROUP BY doc_id, tbl)"""


SIGNED = f"""{WITH_CELLS}, heads AS (SELECT *, replace(lower(trim(text)), '  ', ' ') AS h FROM cells WHERE row < 3 AND trim(coalesce(text, '')) <> ''), {_signature('roll', ROLL_SIGNATURE)}, {_signature('lot', LOT_SIGNATURE)},
    scored AS (SELECT doc_id, tbl, coalesce(roll_score, 0) AS roll_score, coalesce(lot_score, 0) AS lot_score FROM (SELECT doc_id, tbl FROM cells GROUP BY doc_id, tbl HAVING max(row) >= 1) LEFT JOIN roll_score USING (doc_id, tbl) LEFT JOIN lot_score USING (doc_id, tbl))"""


@query("signature_score", SIGNED + " SELECT doc_id, tbl, roll_score, lot_score FROM scored")
def signature_score(spark, sf_dir):
    return tables.signatures(cells(spark, sf_dir))


@query("signature_match", SIGNED + " SELECT h AS heading, r.field AS roll_field, l.field AS lot_field FROM (SELECT DISTINCT h FROM heads) LEFT JOIN roll_meant r USING (h) LEFT JOIN lot_meant l USING (h)")
def signature_match(spark, sf_dir):
    own = tables.signed_headings(cells(spark, sf_dir))
    out = own.select("heading").distinct()
    for name, signature in (("roll_field", ROLL_SIGNATURE), ("lot_field", LOT_SIGNATURE)):
        out = out.join(tables.signature_meanings(own, signature).withColumnRenamed("field", name), "heading", "left")
    return out


@query("doc_classify", SIGNED + f", docs AS (SELECT doc_id, sum(roll_score) AS r, sum(lot_score) AS l FROM scored GROUP BY doc_id), papers AS ({duck(PAPERS)}) SELECT doc_id, CASE WHEN r >= 3 AND l >= 2 THEN 'hybrid' WHEN r >= l AND r >= 3 THEN 'roll_level' WHEN l > r AND l >= 3 THEN 'lot_level' WHEN {_score('lower(raw_text)', ROLL_WORDS)} > {_score('lower(raw_text)', LOT_WORDS)} THEN 'roll_level' WHEN {_score('lower(raw_text)', LOT_WORDS)} > {_score('lower(raw_text)', ROLL_WORDS)} THEN 'lot_level' ELSE 'unknown' END AS doc_type FROM docs JOIN papers USING (doc_id)")
def doc_classify(spark, sf_dir):
    scores = tables.signatures(cells(spark, sf_dir)).groupBy("doc_id").agg(F.sum("roll_score").alias("roll"), F.sum("lot_score").alias("lot"))
    return scores.join(papers(spark, sf_dir), "doc_id").select("doc_id", pages.layout(F.col("roll"), F.col("lot"), F.col("raw_text")).alias("doc_type"))


@query("largest_table", f"{WITH_CELLS}, t AS (SELECT doc_id, row % 2 AS tbl, row, col FROM cells), n AS (SELECT doc_id, tbl, count(DISTINCT row) AS n FROM t GROUP BY ALL) SELECT doc_id, arg_max(tbl, (n, -tbl)) AS tbl, max(n) AS n_rows FROM n GROUP BY doc_id")
def largest_table(spark, sf_dir):
    return tables.largest(cells(spark, sf_dir).withColumn("tbl", F.col("row") % 2))


@query("table_markdown", f"""{WITH_CELLS}, wide AS (SELECT doc_id, tbl, max(col) AS w FROM cells GROUP BY ALL), grid AS (SELECT doc_id, tbl, row, w, unnest(range(0, w + 1)) AS col FROM (SELECT DISTINCT doc_id, tbl, row FROM cells) JOIN wide USING (doc_id, tbl)),
    lines AS (SELECT g.doc_id, g.tbl, g.row, string_agg(coalesce(text, ''), ' | ' ORDER BY g.col) || CASE WHEN g.row = 0 THEN chr(10) || '---' ELSE '' END AS line FROM grid g LEFT JOIN cells c ON c.doc_id = g.doc_id AND c.tbl = g.tbl AND c.row = g.row AND c.col = g.col GROUP BY g.doc_id, g.tbl, g.row)
    SELECT doc_id, tbl, string_agg(line, chr(10) ORDER BY row) AS markdown FROM lines GROUP BY doc_id, tbl""")
def table_markdown(spark, sf_dir):
    return tables.markdown(cells(spark, sf_dir))


#: The cells with two columns more: yards beside the meters, gross beside the net weight.
ROLE_CELLS = f"SELECT doc_id, tbl, row, col, text FROM ({CELLS}) WHERE row > 1 UNION ALL SELECT doc_id, tbl, row, 5, CAST(CAST(try_cast(text AS DECIMAL(18,2)) * 1.0936 AS DECIMAL(18,2)) AS STRING) FROM ({CELLS}) WHERE row > 1 AND col = 2 UNION ALL SELECT doc_id, tbl, row, 6, CAST(try_cast(text AS BIGINT) + 100 AS STRING) FROM ({CELLS}) WHERE row > 1 AND col = 3"


@query("column_roles", f"""WITH cells AS ({duck(ROLE_CELLS)}), s AS (SELECT doc_id, tbl, col, count(*) AS n, count(try_cast(text AS DOUBLE)) AS nn, min(try_cast(text AS DOUBLE)) AS lo, max(try_cast(text AS DOUBLE)) AS hi, avg(try_cast(text AS DOUBLE)) AS mean, count(DISTINCT text) AS nd, min(length(text)) AS sh FROM cells WHERE text <> '' GROUP BY ALL),
    r AS (SELECT doc_id, tbl, col, mean, CASE WHEN nn = n AND (sh >= 6 OR (hi - lo + 1 = n AND nd = n AND lo <= 1)) THEN 'roll_no' WHEN nn = n AND lo BETWEEN 10 AND 500 AND hi BETWEEN 10 AND 550 THEN 'length' WHEN nn = n AND hi > 500 THEN 'weight' WHEN nn <> n AND nd * 2 <= n THEN 'lot' ELSE 'other' END AS role FROM s),
    w AS (SELECT *, min(mean) OVER same AS low, count(*) OVER same AS k FROM r WINDOW same AS (PARTITION BY doc_id, tbl, role))
    SELECT doc_id, tbl, col, CASE WHEN role = 'length' AND EXISTS (SELECT 1 FROM r o WHERE o.doc_id = w.doc_id AND o.tbl = w.tbl AND o.role = 'length' AND w.mean / o.mean BETWEEN 1.08 AND 1.11) THEN 'length_yds' WHEN role = 'weight' AND k > 1 AND mean = low THEN 'net_weight' WHEN role = 'weight' AND k > 1 THEN 'weight_gross' ELSE role END AS role FROM w""")
def column_roles(spark, sf_dir):
    """The rows of ROLE_CELLS: the cells below the headings, each with the column that is made of it."""
    text, col = F.col("text"), F.col("col")
    more = F.when(col == 2, (text.try_cast("decimal(18,2)") * F.lit("1.0936").cast("decimal(5,4)")).cast("decimal(18,2)").cast("string")).when(col == 3, (text.try_cast("bigint") + 100).cast("string"))
    both = F.array(F.struct("col", "text"), F.when(col.isin(2, 3), F.struct((col + 3).alias("col"), more.alias("text"))))
    own = cells(spark, sf_dir).where("row > 1").select("doc_id", "tbl", "row", F.explode(both).alias("cell")).where("cell IS NOT NULL")
    return tables.column_roles(own.select("doc_id", "tbl", "row", "cell.col", "cell.text"))


#: Tables of three known suppliers, by doc_id modulo 3, with a total below the rolls.
SUPPLIER_HEADS = ("LOT NO|Shade|Roll No|Length(mts)|Weight (Nett kgs)", "Pce No|Design/Color|QTY(MTR)|Nett|Ctn No", "Roll No|Cont. No|Shade|Grade|Qty (MTR)")
SUPPLIER_CELLS = f"""
    WITH rolls AS ({ROLLS}), heads(k, col, text) AS (VALUES {", ".join(f"({k}, {c}, '{h}')" for k, line in enumerate(SUPPLIER_HEADS) for c, h in enumerate(line.split("|")))})
    SELECT doc_id, 0 AS tbl, 0 AS row, col, text FROM (SELECT DISTINCT doc_id FROM rolls) AS d JOIN heads ON doc_id % 3 = k
    UNION ALL SELECT doc_id, 0, CAST(seq AS INT), col,
        CASE doc_id % 3 WHEN 0 THEN CASE col WHEN 0 THEN CASE WHEN seq % 2 = 0 THEN '"' ELSE lot END WHEN 1 THEN color WHEN 2 THEN piece_number WHEN 3 THEN concat(CAST(CAST(meters AS INT) AS STRING), '.50-FULL') ELSE CAST(CAST(net_weight AS INT) AS STRING) END
        WHEN 1 THEN CASE col WHEN 0 THEN piece_number WHEN 1 THEN concat('DARK ', color, ' ', CAST(3000000 + seq AS STRING)) WHEN 2 THEN CAST(CAST(meters AS INT) AS STRING) WHEN 3 THEN '' ELSE CAST(seq % 3 AS STRING) END
        ELSE CASE col WHEN 0 THEN piece_number WHEN 1 THEN lot WHEN 2 THEN concat('R18-', color) WHEN 3 THEN CASE WHEN seq % 2 = 0 THEN '' ELSE 'B' END ELSE CAST(CAST(meters AS INT) AS STRING) END END
    FROM rolls CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS c(col)
    UNION ALL SELECT doc_id, 0, 1000, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END, 'Sub Total' FROM rolls WHERE seq = 1
    UNION ALL SELECT doc_id, 0, 1000, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 4 END, '999' FROM rolls WHERE seq = 1
"""
CODES = ("AML", "PEN", "SFM")


def supplier_cells(spark, sf_dir):
    """The rows of SUPPLIER_CELLS, in one pass over the rolls: a document's first roll brings its headings and its total along."""
    c = F.col
    kind, seq, first = c("doc_id") % 3, c("seq"), c("seq") == 1
    whole = lambda x: c(x).cast("int").cast("string")
    cell = lambda col, text: F.struct(F.lit(col).alias("col"), text.cast("string").alias("text"))
    line = lambda row, *cells_: F.struct(row.cast("int").alias("row"), F.array(*cells_).alias("cells"))
    headings = [line(F.lit(0), *[cell(k, F.lit(h)) for k, h in enumerate(heads.split("|"))]) for heads in SUPPLIER_HEADS]
    aml = [F.when(seq % 2 == 0, F.lit('"')).otherwise(c("lot")), c("color"), c("piece_number"), F.concat(whole("meters"), F.lit(".50-FULL")), whole("net_weight")]
    pen = [c("piece_number"), F.concat(F.lit("DARK "), "color", F.lit(" "), (seq + 3000000).cast("string")), whole("meters"), F.lit(""), (seq % 3).cast("string")]
    sfm = [c("piece_number"), c("lot"), F.concat(F.lit("R18-"), "color"), F.when(seq % 2 == 0, F.lit("")).otherwise(F.lit("B")), whole("meters")]
    body = [line(seq, *[cell(k, x) for k, x in enumerate(texts)]) for texts in (aml, pen, sfm)]
    total = lambda k, n: line(F.lit(1000), cell(k, F.lit("Sub Total")), cell(n, F.lit("999")))
    heads = F.when(first, F.when(kind == 0, headings[0]).when(kind == 1, headings[1]).when(kind == 2, headings[2]))
    totals = F.when(first, F.when(kind == 0, total(2, 3)).when(kind == 1, total(0, 3)).otherwise(total(0, 4)))
    lines = F.array(heads, F.when(kind == 0, body[0]).when(kind == 1, body[1]).otherwise(body[2]), totals)
    rows = rolls_dealt(spark, sf_dir).select("doc_id", F.explode(lines).alias("line")).where("line IS NOT NULL")
    rows = rows.select("doc_id", F.col("line.row").alias("row"), F.explode("line.cells").alias("cell"))
    return rows.select("doc_id", F.lit(0).alias("tbl"), "row", "cell.col", "cell.text")


@query("supplier_rolls", f"""WITH rolls AS ({duck(ROLLS)}) SELECT doc_id, seq::INTEGER AS seq, CASE doc_id % 3 WHEN 0 THEN CASE WHEN seq % 2 = 0 THEN lag(lot) OVER (PARTITION BY doc_id ORDER BY seq) ELSE lot END WHEN 1 THEN CAST(3000000 + seq AS VARCHAR) ELSE lot END AS lot,
    CASE doc_id % 3 WHEN 0 THEN color WHEN 1 THEN concat('DARK ', color) ELSE CASE WHEN seq % 2 = 0 THEN concat('R18-', color) ELSE 'B' END END AS color, piece_number, CAST(CAST(trunc(meters) AS INTEGER) + CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS meters, CASE WHEN doc_id % 3 = 0 THEN CAST(trunc(net_weight) AS DOUBLE) END AS net_weight FROM rolls""")
def supplier_rolls(spark, sf_dir):
    own = supplier_cells(spark, sf_dir)
    codes = dealt(spark, sf_dir, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("code", F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("doc_id") % 3).cast("int")))
    return tables.supplier_lines(own, codes).select("doc_id", "seq", "lot", "color", "piece_number", "meters", "net_weight")


#: Strings made of dates and numbers, as suppliers write them.
DATES = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-', substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3), '-', substr(CAST(year(o_orderdate) AS STRING), 3, 2)) WHEN 1 THEN concat(' ', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING)) WHEN 2 THEN concat(CAST(year(o_orderdate) AS STRING), '-02-31') WHEN 3 THEN '24-TEST-001' WHEN 4 THEN concat('31-Foo-', substr(CAST(year(o_orderdate) AS STRING), 3, 2)) ELSE concat(CAST(day(o_orderdate) AS STRING), '-jan-26') END AS raw FROM {orders}"


@query("date_normalise", f"WITH d AS ({duck(DATES)}), s AS (SELECT o_orderkey, raw, trim(raw) AS x FROM d) SELECT o_orderkey, raw, {_date_sql('x')} AS iso FROM s")
def date_normalise(spark, sf_dir):
    return frame(spark, sf_dir, DATES).select("o_orderkey", "raw", T.normal_date(F.col("raw")).alias("iso"))


@query("validate_date", f"WITH d AS ({duck(DATES)}), s AS (SELECT o_orderkey, trim(raw) AS x FROM d), i AS (SELECT o_orderkey, {_date_sql('x')} AS iso FROM s) SELECT o_orderkey, CASE WHEN NOT regexp_matches(iso, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'not ISO' WHEN NOT (CAST(substr(iso, 6, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(iso, 9, 2) AS INT) BETWEEN 1 AND 31) THEN 'month or day' END AS error FROM i")
def validate_date(spark, sf_dir):
    from ..operators.checks import date_error

    return frame(spark, sf_dir, DATES).select("o_orderkey", date_error(T.normal_date(F.col("raw"))).alias("error"))


@query("date_convert", f"WITH d AS ({duck(DATES)}) SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('20', strftime(o_orderdate, '%y-%m-%d')) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN raw WHEN 5 THEN concat('2026-01-', lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0')) END AS iso FROM d JOIN orders USING (o_orderkey)")
def date_convert(spark, sf_dir):
    return frame(spark, sf_dir, DATES).select("o_orderkey", T.converted_date(F.col("raw")).alias("iso"))


NUMBERS = "SELECT o_orderkey, CAST(o_custkey AS STRING) AS c, CASE o_orderkey % 7 WHEN 0 THEN concat(CAST(o_custkey AS STRING), ',', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.5') WHEN 1 THEN concat(CAST(o_custkey % 999 + 1 AS STRING), '.', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ',25') WHEN 2 THEN concat(' ', CAST(o_custkey AS STRING), '.75-FULL') WHEN 3 THEN concat(CAST(o_custkey AS STRING), ' m') WHEN 4 THEN CAST(o_custkey AS STRING) WHEN 5 THEN concat(CAST(o_custkey AS STRING), ' ', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')) ELSE 'n/a' END AS raw FROM {orders}"


@query("number_clean", f"WITH n AS ({duck(NUMBERS)}) SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 0 THEN replace(raw, ',', '') WHEN 1 THEN replace(replace(raw, '.', ''), ',', '.') WHEN 2 THEN c || '.75' WHEN 3 THEN c WHEN 4 THEN c WHEN 5 THEN c END AS DOUBLE) AS value FROM n")
def number_clean(spark, sf_dir):
    return frame(spark, sf_dir, NUMBERS).select("o_orderkey", T.clean_number(F.col("raw")).alias("value"))


@query("coerce_numbers", rf"WITH n AS ({duck(NUMBERS)}), s AS (SELECT *, regexp_replace(raw, '[,\s]', '', 'g') AS x FROM n), v AS (SELECT *, CASE WHEN regexp_matches(x, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') THEN try_cast(x AS DOUBLE) END AS d FROM s) SELECT o_orderkey, raw, CAST(CAST(trunc(d) AS INTEGER) AS VARCHAR) AS pieces, d AS meters FROM v")
def coerce_numbers(spark, sf_dir):
    return frame(spark, sf_dir, NUMBERS).select("o_orderkey", "raw", T.coerced(F.col("raw"), whole=True).cast("string").alias("pieces"), T.coerced(F.col("raw")).alias("meters"))


@query("clean_strings", "SELECT o_orderkey, o_orderpriority AS value FROM orders")
def clean_strings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.field_value(F.concat(F.lit("\t \n "), "o_orderpriority", F.lit("\r ,,\x0b"))).alias("value"))


#: Papers of which every third ends before its rolls and totals, so that these come from its lines and tables.
SHORT_PAPERS = f"SELECT doc_id, 1 AS page_number, supplier_name, CASE WHEN doc_id % 3 = 0 THEN substr(raw_text, 1, instr(raw_text, 'Batch No') + instr(raw_text, 'Lot A') - 1) ELSE raw_text END AS raw_text FROM ({PAPERS})"


MEANS_WEIGHT = " OR ".join(f"contains(lower(trim(text)), {q(w)})" for w in WEIGHT_HEADINGS)
TABLE_WEIGHTS = f"""wcol AS (SELECT doc_id, tbl, min(col) AS col FROM cells WHERE row = 0 AND ({MEANS_WEIGHT}) GROUP BY ALL),
    weights AS (SELECT doc_id, sum(value) AS weight FROM (SELECT doc_id, CAST(try_cast(replace(trim(text), ',', '') AS DOUBLE) AS DECIMAL(20,4)) AS value FROM cells JOIN wcol USING (doc_id, tbl, col) WHERE row > 0) WHERE value > 0 GROUP BY doc_id)"""


@query("table_weights", f"{WITH_CELLS}, {TABLE_WEIGHTS} SELECT doc_id, CAST(weight AS DOUBLE) AS weight FROM weights")
def table_weights(spark, sf_dir):
    return tables.weights(cells(spark, sf_dir)).select("doc_id", F.col("weight").cast("double").alias("weight"))


def _full_record_sql() -> str:
    texts = " UNION ALL ".join(f"SELECT doc_id, 'lot' AS field, list_filter({_all(p)}, lambda x: x <> '' AND lower(x) NOT IN {LOT_NOT})[1] AS value, CAST(0.85 AS DOUBLE) AS confidence, {k} AS n FROM papers" for k, p in enumerate(LOT_PATTERNS))
    texts += "".join(f" UNION ALL SELECT doc_id, 'meters', list_filter(list_transform({_all(p)}, lambda x: replace(x, ',', '')), lambda x: try_cast(x AS DOUBLE) > 0)[1], 0.82, {k} FROM papers" for k, p in enumerate(METER_PATTERNS))
    texts += f" UNION ALL SELECT doc_id, 'pieces', CAST(list_max(list_transform(list_concat({_all(PIECE_PATTERNS[0])}, {_all(PIECE_PATTERNS[1])}), lambda x: CAST(x AS BIGINT))) AS VARCHAR), 0.80, 0 FROM papers WHERE doc_id NOT IN (SELECT doc_id FROM cands WHERE field = 'pieces')"
    regex = _fields_sql(False).removeprefix(WITH_PAPERS + ", ")
    named = f"CASE source WHEN 'regex' THEN 0.90 WHEN 'table_col' THEN 0.88 ELSE 0.0 END"
    number = r"CASE WHEN regexp_matches(regexp_replace({0}, '[,\s]', '', 'g'), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') THEN try_cast(regexp_replace({0}, '[,\s]', '', 'g') AS DOUBLE) END"
    prio = f"CASE WHEN field IN {TABLE_FIELDS} THEN {{0}} ELSE {{1}} END".format(*("CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in p.items()) + " ELSE 0 END" for p in (TABLE_PRIORITY, HEADER_PRIORITY)))
    wide = ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}, coalesce(max(source) FILTER (WHERE field = '{f}'), 'none') AS {f}_source" for f in FIELDS)
    late = {}
    for f in FIELDS:
        if f == "meters":
            use = f"coalesce({number.format('meters')}, 0) BETWEEN 0 AND 0.0099999 AND s_meters > 0"
            late[f] = (f"CASE WHEN {use} THEN s_meters ELSE {number.format('meters')} END", f"CASE WHEN {use} THEN 'aggregated' ELSE meters_source END")
        elif f == "pieces":
            use = f"trunc(coalesce({number.format('pieces')}, 0)) = 0 AND s_n > 0"
            late[f] = (f"CAST(CASE WHEN {use} THEN s_n ELSE trunc({number.format('pieces')}) END AS BIGINT)", f"CASE WHEN {use} THEN 'aggregated' ELSE pieces_source END")
        elif f in ("lot", "color", "quality"):
            several, blank = f"coalesce(len(s_{f}), 0) > 1 AND NOT coalesce(list_contains(s_{f}, {f}), false)", f"len(s_{f}) = 1 AND coalesce({f}, '') = ''"
            late[f] = (f"CASE WHEN {several} THEN concat('MIXED (', array_to_string(s_{f}, ', '), ')') WHEN {blank} THEN s_{f}[1] ELSE {f} END", f"CASE WHEN {several} THEN 'aggregated' WHEN {blank} THEN 'fallback_from_lines' ELSE {f}_source END")
        else:
            late[f] = (number.format(f) if f == "net_weight" else f, f"{f}_source")
    sets = ", ".join(f"list_sort(list(DISTINCT {c}) FILTER (WHERE {c} <> '')) AS s_{c}" for c in ("lot", "color", "quality"))
    return (
        MATCHED
        + f""", papers AS ({duck(SHORT_PAPERS)}), rolls AS ({duck(ROLLS)}), lines AS (SELECT * FROM rolls WHERE doc_id % 5 <> 0),
    cols AS (SELECT m.doc_id, m.tbl, header_row, col, field FROM matched m JOIN best b ON m.doc_id = b.doc_id AND m.tbl = b.tbl AND m.row = b.header_row),
    cands AS (SELECT c.doc_id, c.tbl, c.row, c.col, field, trim(text) AS value FROM cells c JOIN cols USING (doc_id, tbl, col) WHERE c.row > header_row AND trim(text) <> '' AND lower(trim(text)) NOT IN ({ECHOES}) AND NOT (field IN ('lot', 'order_number', 'invoice_number', 'po_number') AND regexp_matches(trim(text), '^[0-9]{{1,3}}$'))),
    regexed AS (WITH {regex}),
    ev AS (SELECT doc_id, field, value, CAST(0.90 AS DOUBLE) AS confidence, 'regex' AS source, CAST(1 AS HUGEINT) << 60 AS ord FROM (UNPIVOT regexed ON {", ".join(PATTERNS)} INTO NAME field VALUE value)
        UNION ALL SELECT doc_id, field, value, 0.88, 'table_col', (CAST(3 AS HUGEINT) << 60) + (CAST(tbl AS HUGEINT) << 40) + (CAST(row AS HUGEINT) << 16) + col FROM cands
        UNION ALL SELECT doc_id, field, value, confidence, 'text_pattern', (CAST(4 AS HUGEINT) << 60) + n FROM ({texts}) WHERE value IS NOT NULL),
    won AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, {prio} DESC, ord) AS n FROM ev),
    wide AS (SELECT p.doc_id, {wide} FROM papers p LEFT JOIN (SELECT * FROM won WHERE n = 1) w ON w.doc_id = p.doc_id GROUP BY p.doc_id),
    sums AS (SELECT doc_id, CAST(sum(CAST(meters AS DECIMAL(18,2))) AS DOUBLE) AS s_meters, count(*) AS s_n, {sets} FROM lines GROUP BY doc_id),
    {TABLE_WEIGHTS},
    checked AS (SELECT wide.*, s_meters, s_n, s_lot, s_color, s_quality, coalesce({number.format("net_weight")} > 0 AND abs(weight - CAST({number.format("net_weight")} AS DECIMAL(20,4))) * 50 > CAST({number.format("net_weight")} AS DECIMAL(20,4)), false) AS weight_mismatch FROM wide LEFT JOIN sums USING (doc_id) LEFT JOIN weights USING (doc_id)),
    named AS (SELECT doc_id, weight_mismatch, {", ".join(f"{v} AS {f}, {s} AS {f}_source" for f, (v, s) in late.items())} FROM checked)
    SELECT doc_id, {", ".join(FIELDS)}, concat_ws(',', {", ".join(f"{f}_source" for f in FIELDS)}) AS sources, concat_ws(',', {", ".join(f"CASE WHEN {named.replace('CASE source', f'CASE {f}_source')} < 0.85{' OR weight_mismatch' if f == 'net_weight' else ''} THEN '{f}' END" for f in sorted(FIELDS))}) AS flagged_fields, weight_mismatch, 'regex' AS mapping_source FROM named"""
    )


@query("full_record", _full_record_sql())
def full_record(spark, sf_dir):
    """Papers to finished records: patterns, tables and running text as evidence, rolls and table weights set against it. One document in five has no rolls."""
    own = spark.sql(SHORT_PAPERS, orders=dealt(spark, sf_dir, "orders", "o_orderkey", beside="lineitem"))
    found = Shipments(own, table_lines(spark, sf_dir), lines=rolls_dealt(spark, sf_dir).where("doc_id % 5 <> 0")).result()
    sources = F.array_join(F.map_values("sources"), ",")  # in the order of FIELDS
    return found.select("doc_id", *FIELDS, sources.alias("sources"), "flagged_fields", "weight_mismatch", "mapping_source")


#: Texts of three known suppliers, by order modulo 3: header values where each writes them, totals twice.
HEADED = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'AML' WHEN 1 THEN 'PEN' ELSE 'SFM' END AS code,
    CASE o_orderkey % 3 WHEN 0 THEN concat('ARTISTIC MILLINERS (PVT) LTD', chr(10), 'INVOICE NO : AM2/', CAST(o_orderkey AS STRING), '  DATED : 7-Jan-26', chr(10), 'TOTAL METERS: 1  TOTAL ROLLS: 2', chr(10), 'PO # ', CAST(o_custkey AS STRING), '  AMS DARK', chr(10), '55% COTTON, 45% NYLON ', chr(10), 'TOTAL METERS: 11,', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '  TOTAL ROLLS: ', CAST(o_orderkey % 50 + 1 AS STRING), chr(10), 'TOTAL GROSS WT: 5288.00 KGS  TOTAL NET WT: ', CAST(o_custkey AS STRING), '.50 KGS')
    WHEN 1 THEN concat('PENFABRIC SDN. BERHAD  REF No: P', CAST(o_orderkey AS STRING), chr(10), 'PACKING LIST DATE: 15/03/2024', chr(10), 'Commodity (Description) WOVEN FABRIC 78% POLYESTER', chr(10), 'Marking PO NO:0', CAST(o_custkey AS STRING), chr(10), 'Sub Total: 5.00 6 7', chr(10), 'Sub Total: ', CAST(o_orderkey % 1000 AS STRING), '.25  40.00  ', CAST(o_custkey AS STRING), '.75', chr(10), 'page 2')
    ELSE concat('SAPPHIRE FINISHING MILLS LTD', chr(10), 'Packing List No. SFML-', CAST(o_orderkey AS STRING), '  Date 16-JAN-26', chr(10), 'DESCRIPTION OF GOODS: DYED WOVEN FABRICS', chr(10), 'PO# ', CAST(o_custkey AS STRING), chr(10), CAST(o_orderkey % 50 + 1 AS STRING), '  Total: 33', chr(10), 'Total Quantity: ', CAST(o_orderkey % 1000 AS STRING), '.5  Net Weight: ', CAST(o_custkey AS STRING), '.25 Kgs.') END AS full_text FROM {orders}"""
_HEADER_FIELDS = {
    "invoice_number": "CASE k WHEN 0 THEN concat('AM2/', o) WHEN 1 THEN concat('P', o) ELSE concat('SFML-', o) END", "delivered_date": "CASE k WHEN 0 THEN '2026-01-07' WHEN 1 THEN '2024-03-15' ELSE '2026-01-16' END",
    "net_weight": "concat(c, CASE k WHEN 0 THEN '.50' WHEN 1 THEN '.75' ELSE '.25' END)", "meters": "CASE k WHEN 0 THEN concat(11000 + o % 1000, '.00') WHEN 1 THEN concat(o % 1000, '.25') ELSE concat(o % 1000, '.50') END",
    "pieces": "CASE WHEN k <> 1 THEN CAST(o % 50 + 1 AS VARCHAR) END", "quality": "CASE k WHEN 0 THEN '55% COTTON, 45% NYLON' WHEN 1 THEN 'WOVEN FABRIC 78% POLYESTER' ELSE 'DYED WOVEN FABRICS' END", "po_number": "CASE WHEN k = 1 THEN concat('0', c) ELSE CAST(c AS VARCHAR) END",
}


@query("supplier_headers", f"WITH r AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 3 AS k FROM orders), v AS ({' UNION ALL '.join(f'SELECT o AS doc_id, {chr(39)}{f}{chr(39)} AS field, {v} AS value FROM r' for f, v in _HEADER_FIELDS.items())}) SELECT * FROM v WHERE value IS NOT NULL")
def supplier_headers(spark, sf_dir):
    """Header values of known suppliers, from the places where they write them."""
    return fields.supplier_headers(frame(spark, sf_dir, HEADED)).select("doc_id", "field", "value")
