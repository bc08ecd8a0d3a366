"""Text to typed values: numbers with units, dates and booleans. Every function gives null for text that does not denote
exactly one value of the type; none of them can fail on any input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from estateloom.functions.keys import strip

# Factors to the canonical unit of each kind of quantity.
GB_FACTORS = {"": 1.0, "b": 1 / 1024**3, "kb": 1 / 1024**2, "mb": 1 / 1024, "gb": 1.0, "tb": 1024.0, "pb": 1024.0**2}
HOUR_FACTORS = {"": 1.0, "s": 1 / 3600, "m": 1 / 60, "h": 1.0, "d": 24.0, "w": 168.0}

_NUMBER = r"[+-]?[0-9](?:[0-9.,]*[0-9])?"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it; keeps the generated code small."""
    return F.transform(F.array(value), body).getItem(0)


def _plain(number: Column) -> Column:
    """A comma before exactly three digits groups thousands, any other is a decimal mark."""
    grouped = F.regexp_replace(F.regexp_replace(number, r",(?=[0-9]{3}(?![0-9]))", ""), ",", ".")
    return let(grouped, lambda n: F.when(n.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), n))


def quantity(text: Column, units: str) -> Column:
    """Struct (n double, unit in lower case) of text that is one number and at most one of ``units`` (a pattern), else null."""
    whole = rf"^({_NUMBER})\s*({units})?$"
    groups = lambda t: F.when(
        t.rlike(whole), F.struct(_plain(F.regexp_extract(t, whole, 1)).try_cast("double").alias("n"), F.regexp_extract(t, whole, 2).alias("unit"))
    )
    return let(F.lower(strip(text)), groups)


def _factor(unit: Column, factors: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in factors.items() for x in pair)), unit)


def whole_number(text: Column, units: str) -> Column:
    return let(quantity(text, units)["n"], lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 9e18), n.try_cast("bigint")))


def gigabytes(text: Column) -> Column:
    """Of a number with a unit of bytes (GiB equals GB, steps of 1024); a bare number is in GB."""
    factors = GB_FACTORS | {k[0]: f for k, f in GB_FACTORS.items() if len(k) == 2}
    return let(quantity(text, "[kmgtp]?i?b|[kmgtp]"), lambda q: F.round(q["n"] * _factor(F.regexp_replace(q["unit"], "i", ""), factors), 3))


def percent(text: Column) -> Column:
    return F.round(quantity(text, "%|percent|pct|per cent")["n"], 3)


def hours(text: Column) -> Column:
    """Of a number with a unit of time; a bare number is in hours."""
    return let(
        quantity(text, "s|secs?|seconds?|m|mins?|minutes?|h|hrs?|hours?|d|days?|w|weeks?"), lambda q: F.round(q["n"] * _factor(F.substring(q["unit"], 1, 1), HOUR_FACTORS), 3)
    )


def boolean(text: Column) -> Column:
    return let(F.lower(strip(text)), lambda t: F.when(t.isin("yes", "y", "true", "1"), F.lit(True)).when(t.isin("no", "n", "false", "0"), F.lit(False)))


def date(text: Column) -> Column:
    """ISO, slashed year-first, dotted day-first and English month-name dates; a time of day is ignored."""
    iso = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[t ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:z|[+-]\d{2}:?\d{2})?)?$"
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    day_first = rf"^(\d{{1,2}})\.? {_MONTH},? (\d{{4}})$"
    month_first = rf"^{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$"
    x = F.regexp_extract

    def month(name: Column) -> Column:
        return ((F.instr(F.lit(_MONTHS), name) + 2) / 3).cast("int").cast("string")

    def ymd(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    def read(t: Column) -> Column:
        return (
            F.when(t.rlike(iso), ymd(x(t, iso, 1), x(t, iso, 2), x(t, iso, 3)))
            .when(t.rlike(dotted), ymd(x(t, dotted, 3), x(t, dotted, 2), x(t, dotted, 1)))
            .when(t.rlike(day_first), ymd(x(t, day_first, 3), month(x(t, day_first, 2)), x(t, day_first, 1)))
            .when(t.rlike(month_first), ymd(x(t, month_first, 3), month(x(t, month_first, 1)), x(t, month_first, 2)))
            .try_cast("date")
        )

    return let(F.lower(strip(text)), read)


def plain_number(c: Column) -> Column:
    """A number in plain digits, at most three decimals, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.round(c, 3).cast("decimal(38,3)").cast("string"), "0+$", ""), r"\.$", "")
