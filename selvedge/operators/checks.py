"""Checks of records; each gives an error text or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.fixed import FIELDS

PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]*)?$|^-?\.[0-9]+$"


def date_error(x: Column) -> Column:
    """A date must be YYYY-MM-DD with a month from 1 to 12 and a day from 1 to 31 (of any month)."""
    iso = x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    inside = F.substring(x, 6, 2).try_cast("int").between(1, 12) & F.substring(x, 9, 2).try_cast("int").between(1, 31)
    return F.when(x.isNotNull() & ~iso, F.lit("not ISO")).when(iso & ~inside, F.lit("month or day"))


def lenient_number(x: Column) -> Column:
    """A number from text with commas; null if it is none."""
    bare = F.trim(F.replace(x, F.lit(","), F.lit("")))
    return F.when(bare.rlike(PLAIN_NUMBER), bare.try_cast("double"))


def rule_errors(meters: Column, pieces: Column, net_weight: Column) -> Column:
    """An array of errors: meters and pieces must be positive, the weight not negative; what is no number isn't judged here. Takes text."""
    whole = F.when(F.trim(F.replace(pieces, F.lit(","), F.lit(""))).rlike("^[0-9]+$"), lenient_number(pieces))
    errors = F.array(
        F.when(lenient_number(meters) <= 0, F.lit("meters must be > 0")),
        F.when(whole <= 0, F.lit("pieces must be > 0")),
        F.when(lenient_number(net_weight) < 0, F.lit("net_weight cannot be negative")),
    )
    return F.filter(errors, lambda e: e.isNotNull())


def quarantined(records: DataFrame, raw: dict[str, str]) -> DataFrame:
    """Records with a reason for each field whose text (raw: field to text column) gave no value: one bad field doesn't cost the record."""
    reasons = F.array(*[F.when(F.col(text).isNotNull() & F.col(field).isNull(), F.lit(field)) for field, text in raw.items()])
    return records.withColumn("quarantine", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ","))


def all_errors(delivered_date: Column, meters: Column, pieces: Column, net_weight: Column) -> Column:
    """An array of a record's errors: of its date, then of its rules. Takes text."""
    return F.concat(F.filter(F.array(date_error(delivered_date)), lambda e: e.isNotNull()), rule_errors(meters, pieces, net_weight))


def missing_columns(records: DataFrame) -> list[str]:
    """Fields of the record that a frame has no column for, in order."""
    return [f for f in FIELDS if f not in records.columns]


#: The rules of a record in the order in which they are checked: check, field, condition of an error, message. In a condition {has} says whether the record has the field, {v} is its text, {n} its number (null where it is none).
RULES = (
    *(("schema", f, "{v} IS NOT NULL AND {n} IS NULL" + (" OR {n} <> floor({n})" if kind == "int" else ""), f"{f} is no {'whole ' if kind == 'int' else ''}number") for f, kind in FIELDS.items() if kind != "string"),
    ("date", "delivered_date", "NOT {v} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'", "not ISO"),
    ("date", "delivered_date", "{v} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' AND NOT (try_cast(substr({v}, 6, 2) AS int) BETWEEN 1 AND 12 AND try_cast(substr({v}, 9, 2) AS int) BETWEEN 1 AND 31)", "month or day"),
    ("rules", "meters", "{n} <= 0", "meters must be > 0"),
    ("rules", "pieces", "{n} <= 0 AND {n} = floor({n})", "pieces must be > 0"),
    ("rules", "net_weight", "{n} < 0", "net_weight cannot be negative"),
    *(("completeness", f, "NOT {has}", f"{f} is missing from the record") for f in FIELDS),
)
#: Rules that are compiled into one expression, at most.
MOST_RULES = 500


def rule_table(rules: DataFrame) -> tuple:
    """Rules kept as a table (ord, check, field, condition, message), in their order; MOST_RULES at most."""
    rows = rules.orderBy("ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple((r["check"], r["field"], r["condition"], r["message"]) for r in rows)


def broken(condition: str, field: str, has: str, v: str, n: str) -> str:
    """Whether a record breaks a rule, as SQL, of what is known of the rule's field: has, v and n; what can't be told is no error."""
    return f"coalesce({condition.format(v=v, n=n, has=has)}, false)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def errors_of(values: str, rules: tuple) -> Column:
    """An array of a record's errors (values: a map of texts by field). Each field is looked up and read as a number once, and the rules are inside a lambda: in generated code they are a method too long for the JVM to compile, at seven times the price."""
    fields = list(dict.fromkeys(field for _, field, _, _ in rules))
    facts = [f"transform(array(try_element_at(r, {_quoted(f)})), v -> struct(map_contains_key(r, {_quoted(f)}) AS has, v AS v, CASE WHEN trim(replace(v, ',', '')) RLIKE {_quoted(PLAIN_NUMBER)} THEN try_cast(trim(replace(v, ',', '')) AS double) END AS n))[0]" for f in fields]
    at = {f: f"f[{k}]" for k, f in enumerate(fields)}
    found = [f"CASE WHEN {broken(condition, field, *(f'{at[field]}.{x}' for x in ('has', 'v', 'n')))} THEN struct({_quoted(check)} AS check, {_quoted(field)} AS field, {_quoted(message)} AS message) END" for check, field, condition, message in rules]
    if not found:
        return F.expr("cast(array() AS array<struct<check: string, field: string, message: string>>)")
    return F.expr(f"get(transform(array({values}), r -> get(transform(array(array({', '.join(facts)})), f -> array_compact(array({', '.join(found)}))), 0)), 0)")


def validated(records: DataFrame, rules: tuple = RULES, counts: Observation | None = None) -> DataFrame:
    """Records (doc_id, values: a map of texts by field) with errors: check, field and message of each rule that they break, in the rules' order. All rules are one expression over the record's row. With `counts`, the number of records that break each rule ("check: message") is counted in the same pass, and can be read from it when the rows have been."""
    out = records.withColumn("errors", errors_of("values", rules))
    if counts is not None:
        has = lambda check, message: F.exists("errors", lambda e: (e["check"] == check) & (e["message"] == message))
        out = out.observe(counts, F.count("*").alias("records"), *[F.count_if(has(check, message)).alias(f"{check}: {message}") for check, _, _, message in rules])
    return out


def violations(checked: DataFrame) -> DataFrame:
    """check, message and how many records of validated() have the error."""
    return checked.select(F.explode("errors").alias("e")).groupBy("e.check", "e.message").agg(F.count("*").alias("n"))
