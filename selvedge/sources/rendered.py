"""Shipment papers rendered from the star schema: the inputs of the queries, since the tables hold no papers of their own.

The SQL is common to Spark and DuckDB. Each order becomes a document: a header, a table of its lines, totals.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order lines as rolls. The order within a document is total.
ROLLS = """
    SELECT l_orderkey AS doc_id,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag, l_linestatus) AS BIGINT) AS seq,
           concat('L', CAST(l_suppkey AS STRING)) AS lot, concat('PO-', CAST(l_suppkey % 3 AS STRING)) AS po_number, CAST(l_partkey AS STRING) AS piece_number,
           l_quantity AS meters, l_extendedprice AS net_weight, l_returnflag AS color, l_linestatus AS quality
    FROM {lineitem}
"""

#: One text for each order: labelled header values in several layouts.
PAPERS = """
    SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'techs' WHEN o_orderkey % 5 = 1 THEN 'Guston' ELSE 'unknown' END AS supplier_name,
           concat(
               CASE WHEN o_orderkey % 3 = 0 THEN 'PACKING LIST' ELSE 'Delivery Note' END, chr(10),
               CASE WHEN o_orderkey % 4 = 0 THEN 'Client PO: ' WHEN o_orderkey % 4 = 1 THEN 'Contract No : ' ELSE 'Your ref ' END, 'W', CAST(o_orderkey AS STRING), '-', CAST(o_custkey AS STRING), chr(10),
               CASE WHEN o_orderkey % 2 = 0 THEN 'Invoice No: ' ELSE 'Inv. No ' END, 'INV/', CAST(o_custkey AS STRING), ',', chr(10),
               CASE WHEN o_orderkey % 6 = 0 THEN 'Dated ' ELSE 'Date: ' END,
               lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), CASE WHEN o_orderkey % 3 = 1 THEN '/' ELSE '-' END,
               CASE WHEN o_orderkey % 3 = 1 THEN lpad(CAST(month(o_orderdate) AS STRING), 2, '0') ELSE substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3) END,
               CASE WHEN o_orderkey % 3 = 1 THEN '/' ELSE '-' END, CAST(year(o_orderdate) AS STRING), chr(10),
               CASE WHEN o_orderkey % 2 = 0 THEN 'Net Weight: ' ELSE 'N Wt. (KGS) : ' END, CAST(o_custkey % 9 + 1 AS STRING), ',', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.50', chr(10),
               CASE WHEN o_orderkey % 7 = 0 THEN 'Style: Twill ' ELSE 'Article: Drill ' END, o_orderpriority, chr(10),
               CASE WHEN o_orderkey % 3 = 2 THEN 'Shade: ' ELSE 'Colour: ' END, 'Navy ', o_orderstatus, chr(10),
               CASE WHEN o_orderkey % 4 = 3 THEN 'Lot A' ELSE 'Batch No. B' END, CAST(o_orderkey % 97 AS STRING), chr(10),
               'Roll No ', CAST(o_orderkey % 11 + 1 AS STRING), '  Roll ', CAST(o_orderkey % 13 + 1 AS STRING), chr(10),
               CASE WHEN o_orderkey % 2 = 1 THEN 'Total Meters: ' ELSE 'Grand Total | ' END, CAST(o_orderkey % 500 AS STRING), '.5 Metres', chr(10),
               CASE WHEN o_orderkey % 8 = 0 THEN 'Total Rolls: ' ELSE 'No. of Pieces: ' END, CAST(o_orderkey % 40 + 1 AS STRING), chr(10)) AS raw_text
    FROM {orders}
"""

#: Column headings of a document's table, by doc_id modulo 6; columns are parted by |.
HEADINGS = (
    "Roll No|Shade|Qty (MTR)|N Wt.(KGS)|Lot No",
    "Piece No|Colour|Length (M)|Net Weight|Batch",
    "Lot / Batch|Pieces/Rolls|Metres|Gross Wt|Article",
    "PO Number|Dye Lot|Total Meters|Nett Wt|Construction",
    "Customer PO|Lot #|Quantity (M)|NW|Material Style",
    "Width|Your Order|QTY(MTR)|Invoice Date|Pce No",
)
#: Cells of the tables: a heading row (after a title row in every fourth document), then one row for each roll.
CELLS = f"""
    WITH rolls AS ({ROLLS}), heads(k, col, text) AS (VALUES {", ".join(f"({k}, {c}, '{h}')" for k, line in enumerate(HEADINGS) for c, h in enumerate(line.split("|")))}),
    docs AS (SELECT DISTINCT doc_id FROM rolls)
    SELECT doc_id, 0 AS tbl, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS row, col, text FROM docs JOIN heads ON doc_id % 6 = k
    UNION ALL SELECT doc_id, 0, 0, 0, 'Shipment' FROM docs WHERE doc_id % 4 = 0
    UNION ALL
    SELECT doc_id, 0, CAST(seq + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS INT), col,
           CASE col WHEN 0 THEN piece_number WHEN 1 THEN CASE WHEN seq % 3 = 0 THEN 'Shade' ELSE color END WHEN 2 THEN CAST(CAST(floor(meters) AS INT) AS STRING) WHEN 3 THEN CAST(CAST(floor(net_weight) AS INT) AS STRING) ELSE CASE WHEN seq % 4 = 2 THEN '' ELSE lot END END
    FROM rolls CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS c(col)
"""


#: Rows of a table, about, that one task holds when the table is dealt by document.
DEALT = 250_000


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, beside: str | None = None) -> DataFrame:
    """A table dealt by document into parts of about DEALT rows, so that no task grows with the table, and whatever goes by document needs no other shuffle; into as many parts as the table `beside`, where that asks for more, so that both can be joined as they are."""
    tables = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in (name, beside) if n]
    return tables[0].repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), *[-(-t.count() // DEALT) for t in tables]), key)


def rolls_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROLLS, dealt by document."""
    return spark.sql(ROLLS, lineitem=dealt(spark, sf_dir, "lineitem", "l_orderkey"))


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tables of CELLS (doc_id, tbl, row, texts), in one pass over the rolls: a document's first roll brings its headings along."""
    c = F.col
    below, first = F.when(c("doc_id") % 4 == 0, 1).otherwise(0), c("seq") == 1
    heads = F.get(F.array(*[F.array(*[F.lit(h) for h in line.split("|")]) for line in HEADINGS]), (c("doc_id") % len(HEADINGS)).cast("int"))
    whole = lambda x: F.floor(x).cast("int").cast("string")
    roll = F.array("piece_number", F.when(c("seq") % 3 == 0, "Shade").otherwise(c("color")), whole("meters"), whole("net_weight"), F.when(c("seq") % 4 == 2, "").otherwise(c("lot")))
    lines = rolls_dealt(spark, sf_dir).select("doc_id", "seq", below.alias("below"), F.array(F.when(first & (c("doc_id") % 4 == 0), F.array(F.lit("Shipment"))), F.when(first, heads), roll).alias("lines"))
    lines = lines.select("doc_id", "seq", "below", F.posexplode("lines").alias("part", "texts")).where("texts IS NOT NULL")
    row = F.when(c("part") == 0, 0).when(c("part") == 1, c("below")).otherwise((c("seq") + c("below")).cast("int"))
    return lines.select("doc_id", F.lit(0).alias("tbl"), row.alias("row"), "texts")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of CELLS."""
    return table_lines(spark, sf_dir).select("doc_id", "tbl", "row", F.posexplode("texts").alias("col", "text"))


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over tables in braces."""
    names = [n for n in ("lineitem", "orders", "events", "documents", "supplier", "customer") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def quoted(sql: str) -> str:
    """A DuckDB statement with the column names that are words of its own in quotes."""
    return re.sub(r"\b(at|end)\b", r'"\1"', sql)


def duck(sql: str) -> str:
    """The same statement for DuckDB."""
    for name in ("lineitem", "orders", "events", "documents", "supplier", "customer"):
        sql = sql.replace("{" + name + "}", name)
    return sql
