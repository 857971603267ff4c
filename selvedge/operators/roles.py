"""What the columns of a table without known headings hold, from its rows: each role goes to one column, so that the sum of what speaks for the roles is greatest.

What speaks for a role is counted over rows: numbers that follow one another (from any start), codes that stand in runs, lengths within bounds, and pairs of columns whose ratio is the same in each row (yards to meters, gross to net weight). So an order of columns or a few odd cells don't matter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_number, nonempty, stripped
from .rolls import explicit

ROLES = ("piece_number", "meters", "length_yds", "net_weight", "weight_gross_kgs", "lot", "color")
#: Bounds of a roll's length; of yards to a meter; of gross to net weight. Least score of a role.
LENGTHS, YARDS, GROSS, LEAST = (10, 500), (1.085, 1.103), (1.0, 1.25), 0.3
#: Figures of a roll's number that is no count.
LONG = 6


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(F.lit(0.0))


def column_facts(cells: DataFrame) -> DataFrame:
    """For each column with some text: n, and shares of its cells: numeric, inside (a roll's length), follows (one more than the number above), long (figures only, LONG or more), same (as the cell above, ditto marks too); distinct values, runs of equal ones."""
    above = Window.partitionBy("doc_id", "tbl", "col").orderBy("row")
    rows = cells.select("doc_id", "tbl", "row", "col", nonempty(stripped(F.col("text"))).alias("text")).where("text IS NOT NULL")
    rows = rows.withColumn("code", F.last(explicit(F.col("text")), ignorenulls=True).over(above.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("value", F.when(F.col("text").rlike(r"^[+-]?[0-9]"), clean_number(F.col("text"))))
    rows = rows.withColumns({"before": F.lag("value").over(above), "code_before": F.lag("code").over(above)})
    n, links = F.count("*"), F.count("*") - 1
    return rows.groupBy("doc_id", "tbl", "col").agg(
        n.alias("n"),
        _share(F.count("value"), n).alias("numeric"),
        _share(F.count_if(F.col("value").between(*LENGTHS)), n).alias("inside"),
        _share(F.count_if(F.col("value") == F.col("before") + 1), links).alias("follows"),
        _share(F.count_if(F.col("text").rlike(f"^[0-9]{{{LONG},}}$")), n).alias("long"),
        _share(F.count_if(F.col("code") == F.col("code_before")), links).alias("same"),
        F.count_distinct("code").alias("distinct"),
        (F.count_if(F.col("code") != F.col("code_before")) + 1).alias("runs"),
    )


def ratios(cells: DataFrame) -> DataFrame:
    """For each pair of a table's columns (col, other) that have numbers in one row: the share of these rows in which the other is as many yards, and in which it could be the gross weight. Pairs are made within a row, once for both ways, so there are as many as half a row's columns squared."""
    value = F.when(stripped(F.col("text")).rlike(r"^[+-]?[0-9]"), clean_number(F.col("text")))
    rows = cells.select("doc_id", "tbl", "row", "col", value.alias("value")).where("value > 0").groupBy("doc_id", "tbl", "row").agg(F.collect_list(F.struct("col", "value")).alias("cells"))
    ratio = lambda a, b: F.struct(a["col"].alias("col"), b["col"].alias("other"), (b["value"] / a["value"]).alias("ratio"), (a["value"] / b["value"]).alias("inverse"))
    pairs = F.flatten(F.transform("cells", lambda a: F.transform(F.filter("cells", lambda b: b["col"] > a["col"]), lambda b: ratio(a, b))))
    found = rows.select("doc_id", "tbl", F.explode(pairs).alias("p")).select("doc_id", "tbl", "p.*")
    n = F.count("*")
    yards = lambda r: _share(F.count_if(F.col(r).between(*YARDS)), n)
    gross = lambda r: _share(F.count_if(F.col(r).between(*GROSS)), n) * (F.avg(r) > GROSS[0]).cast("double")
    sums = found.groupBy("doc_id", "tbl", "col", "other").agg(yards("ratio").alias("yards"), gross("ratio").alias("gross"), yards("inverse").alias("back_yards"), gross("inverse").alias("back_gross"))
    ways = F.array(F.struct("col", "other", "yards", "gross"), F.struct(F.col("other").alias("col"), F.col("col").alias("other"), F.col("back_yards").alias("yards"), F.col("back_gross").alias("gross")))
    return sums.select("doc_id", "tbl", F.inline(ways))


def scores(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, col and a score from 0 to 1 for each role."""
    sides = F.array(*[F.struct(F.col(key).alias("col"), *[(F.col(x) if prefix == own else F.lit(None).cast("double")).alias(f"{prefix}_{x}") for prefix in ("to", "from") for x in ("yards", "gross")]) for own, key in (("to", "col"), ("from", "other"))])
    best = ratios(cells).select("doc_id", "tbl", F.inline(sides)).groupBy("doc_id", "tbl", "col").agg(*[F.max(x).alias(x) for x in ("to_yards", "to_gross", "from_yards", "from_gross")])
    rows = column_facts(cells).join(best, ["doc_id", "tbl", "col"], "left").fillna(0.0)
    c = F.col
    unique, counted = c("distinct") / c("n"), c("follows") > 0.8
    contiguous = c("distinct") / c("runs")
    repeats = c("same") > 0
    said = {
        "piece_number": F.greatest(c("follows"), F.when(unique > 0.95, 0.95 * c("long")).otherwise(F.lit(0.0)), F.when(unique == 1.0, F.lit(0.35)).otherwise(F.lit(0.0))),
        "meters": F.when(counted, F.lit(0.1)).otherwise(c("inside") * (0.6 + 0.4 * c("to_yards"))),
        "length_yds": c("from_yards"),
        "net_weight": 0.9 * c("to_gross") * (1 - c("to_yards")) * F.when(counted, 0.2).otherwise(1.0),
        "weight_gross_kgs": 0.9 * c("from_gross") * (1 - c("from_yards")) * F.when(counted, 0.2).otherwise(1.0),
        "lot": F.when(repeats & (contiguous > 0.5), contiguous * (0.7 + 0.3 * c("same")) * F.when(c("numeric") > 0.9, 0.8).otherwise(1.0)).otherwise(F.lit(0.0)),
        "color": F.when((c("numeric") < 0.1) & (unique < 0.5), 0.5 + 0.2 * (1 - contiguous)).otherwise(F.lit(0.0)),
    }
    return rows.select("doc_id", "tbl", "col", *[said[r].cast("double").alias(r) for r in ROLES])


def best_assignment(table: list[tuple[int, list[float]]]) -> dict[int, int]:
    """Column to role with the greatest sum of scores, one role for a column and one column for a role; scores below LEAST don't count. Over columns, by the set of roles that are taken."""
    reached: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for col, own in sorted(table):
        after = dict(reached)
        for taken, (total, chosen) in reached.items():
            for role, score in enumerate(own):
                if score >= LEAST and not taken >> role & 1:
                    key, value = taken | 1 << role, (total + score, (*chosen, (col, role)))
                    if key not in after or value[0] > after[key][0] + 1e-12:
                        after[key] = value
        reached = after
    return dict(max(reached.values(), key=lambda v: v[0])[1])


def assigned(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, col, role and score of the columns of each table (cells: doc_id, tbl, row, col, text, without headings) that have one of ROLES. A table is one small list of columns when its roles are dealt."""

    @F.pandas_udf("array<struct<col:int,role:string,score:double>>")
    def dealt(tables: pd.Series) -> pd.Series:
        out = []
        for columns in tables:
            own = {int(x["col"]): [float(s) for s in x["scores"]] for x in columns}
            out.append([{"col": col, "role": ROLES[role], "score": own[col][role]} for col, role in sorted(best_assignment(list(own.items())).items())])
        return pd.Series(out)

    table = scores(cells).groupBy("doc_id", "tbl").agg(F.collect_list(F.struct("col", F.array(*ROLES).alias("scores"))).alias("columns"))
    return table.select("doc_id", "tbl", F.explode(dealt("columns")).alias("x")).select("doc_id", "tbl", "x.*")
