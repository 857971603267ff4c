"""Strings, numbers and dates of shipment papers as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import MONTHS

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


#: White space of any kind.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once however often `then` uses it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def visible_ends(x: Column) -> Column:
    """Whether a text begins and ends with a visible ASCII character, so that there is nothing to strip."""
    return x.between("!", "~") & F.substring(x, -1, 1).between("!", "~")


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end. Most texts begin and end with a visible ASCII character and are only looked at, since trimming by a set of characters is slow."""
    return F.when(visible_ends(x), x).otherwise(F.trim(x, F.lit(SPACES)))


def nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def field_value(x: Column) -> Column:
    """A captured value: stripped, without commas at its end; null if nothing is left."""
    trimmed = lambda v: F.nullif(F.rtrim(F.rtrim(F.trim(v, F.lit(SPACES)), F.lit(",")), F.lit(SPACES)), F.lit(""))
    return once(x, lambda v: F.when(v == "", F.lit(None)).when(visible_ends(v) & ~F.endswith(v, F.lit(",")), v).otherwise(trimmed(v)))


def number(x: Column) -> Column:
    """A double, or null where the text isn't a decimal number."""
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def coerced(x: Column, whole: bool = False) -> Column:
    """A number without its commas and blanks; truncated toward zero if it must be whole. Text that is none is null here: keep the raw column beside it."""
    value = number(F.regexp_replace(x, r"[,\s]", ""))
    return value.try_cast("int") if whole else value


def leading_number(x: Column) -> Column:
    """The digits, commas and points that a text begins with; empty where it begins otherwise."""
    return F.regexp_extract(stripped(x), r"^([+-]?[0-9][0-9.,]*)", 1)


def leading_value(bare: Column) -> Column:
    """What a leading_number() comes to; takes commas or points for thousands, 1.245,50 too."""
    european = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    is_european = F.contains(bare, F.lit(",")) & F.contains(bare, F.lit(".")) & bare.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$")
    return F.when(is_european, european.try_cast("double")).otherwise(F.replace(bare, F.lit(","), F.lit("")).try_cast("double"))


def clean_number(x: Column) -> Column:
    """Numbers as suppliers write them: units and grades after them, commas or points for thousands, 1.245,50 too."""
    return once(leading_number(x), leading_value)


def _month(name: Column) -> Column:
    short = F.substring(F.lower(name), 1, 3)
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), short)
    return F.when(short.isNotNull(), F.lpad(place.cast("string"), 2, "0"))


def normal_date(x: Column) -> Column:
    """ISO text from day-first dates; an unknown month is 00; anything else stays as it is."""
    return once(F.trim(x, F.lit(SPACES)), _normal_date)


def _normal_date(raw: Column) -> Column:
    named = r"^([0-9]{2})[-/]([A-Za-z]{3,})[-/]([0-9]{2,4})$"
    year = F.regexp_extract(raw, named, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return (
        F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw)
        .when(raw.rlike(r"^[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}$"), F.regexp_replace(raw, r"^([0-9]{2})[/.]([0-9]{2})[/.]([0-9]{4})$", "$3-$2-$1"))
        .when(raw.rlike(named), F.concat_ws("-", year, _month(F.regexp_extract(raw, named, 2)), F.regexp_extract(raw, named, 1)))
        .otherwise(raw)
    )


def converted_date(x: Column) -> Column:
    """ISO text from 7-Jan-26, 15/03/2024 or "March 15 24"; null where it is no such date."""
    return once(F.trim(x, F.lit(SPACES)), _converted_date)


def _converted_date(raw: Column) -> Column:
    named, words = r"^([0-9]{1,2})[-/ ]([A-Za-z]{3,})[-/ ]([0-9]{2}|[0-9]{4})$", r"^([A-Za-z]{3,}) ([0-9]{1,2}),? ([0-9]{2}|[0-9]{4})$"
    plain = r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})$"

    def iso(day: Column, month: Column, year: Column) -> Column:
        return F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(raw, pattern, i)

    found = (
        F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw)
        .when(raw.rlike(plain), iso(part(plain, 1), part(plain, 2), part(plain, 3)))
        .when(raw.rlike(named), iso(part(named, 1), _month(part(named, 2)), part(named, 3)))
        .when(raw.rlike(words), iso(part(words, 2), _month(part(words, 1)), part(words, 3)))
    )
    return F.when(F.substring(found, 6, 2) != "00", found)


def yards(meters: Column, factor: float) -> Column:
    """Yards as text with two decimals, half to even."""
    return F.call_function("format_number", meters * F.lit(factor), F.lit("0.00"))


def captured(text: Column, pattern: str) -> Column:
    """The first group of a pattern's first match, any case, ^ and $ at lines; null without a match."""
    return nonempty(F.regexp_extract(text, f"(?im){pattern}", 1))


def first_value(text: Column, patterns: tuple[str, ...], low: Column | None = None, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The value of the first pattern that gives one. With `low`, the text in lower case, a pattern in `words` is tried only on texts that have any of its words: looking for words is much cheaper than a pattern that fails at each place."""
    out = []
    for p in patterns:
        value = field_value(F.regexp_extract(text, f"(?im){p}", 1))
        needed = (words or {}).get(p) if low is not None else None
        out.append(F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in needed]), value) if needed else value)
    return F.coalesce(*out)


def mixed(values: Column) -> Column:
    """One distinct value as it is, several as "MIXED (a, b)" in order, none as null. Takes an array."""
    distinct = F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).when(F.size(distinct) > 1, F.concat(F.lit("MIXED ("), F.array_join(distinct, ", "), F.lit(")")))
