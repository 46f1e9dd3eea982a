"""Typed readings of free-entered values (integer, decimal, boolean, date) as Column expressions.

Every function gives null where the text does not state a value of its type, so that it can serve as a try cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partmill.functions.text import strip

# Qualifiers and currency signs that may stand before a number.
QUALIFIER = r"(?:approx(?:imately)?|about|around|ca|circa|max(?:imum)?|min(?:imum)?|up to|from|only|at least|at most|nominal|nom|usd|eur|gbp|us)"
SIGNS = r"[~≈±<>≤≥=$€£¥]"
NUMBER = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|[.,]\d+)"
#: A number with nothing but qualifiers before it and words without digits behind it.
STATED = rf"^(?i:{QUALIFIER}\.?\s*|{SIGNS}\s*)*([-+−]?{NUMBER})[^\p{{N}}]*$"


def number_text(col: Column) -> Column:
    """The only number of a value with ``.`` as decimal point and no thousands separators; null if none or several.

    A comma before exactly three digits separates thousands, any other comma is a decimal comma.
    """
    raw = F.regexp_replace(F.regexp_extract(strip(col), STATED, 1), "−", "-")
    plain = F.regexp_replace(raw, r",(?=\d{3}(?!\d))", "")
    return F.when(raw != "", F.regexp_replace(plain, ",", "."))


def as_integer(col: Column) -> Column:
    """A whole number (``12``, ``012``, ``3,600``, ``12.0``, ``12 pc.``) as BIGINT."""
    value = number_text(col).try_cast("decimal(38,9)")
    return F.when(value == F.floor(value), value.try_cast("bigint"))


def as_decimal(col: Column) -> Column:
    """A number as DECIMAL(28,3), rounded half up."""
    return F.round(number_text(col).try_cast("decimal(38,9)"), 3).try_cast("decimal(28,3)")


def as_boolean(col: Column) -> Column:
    """Yes/no words or letters, 1/0, a tick or x for true."""
    word = F.lower(strip(col))
    return F.when(word.isin("yes", "y", "true", "t", "1", "x", "✓", "✔", "☑", "✅"), True).when(
        word.isin("no", "n", "false", "f", "0"), False
    )


def as_date(col: Column) -> Column:
    """Year-month-day with ``-``, ``/``, ``.`` or nothing between, day-month name-year, month name-day-year; a time may follow."""
    text = F.lower(strip(col))
    day_first = r"^(\d{1,2})[\s\-./]*([a-z]{3})[a-z]*[\s\-./,]*(\d{4})$"
    name_first = r"^([a-z]{3})[a-z]*\.?\s*(\d{1,2})(?:st|nd|rd|th)?\s*,?\s*(\d{4})$"
    numeric = r"^(\d{4})(?:([-/.])(\d{1,2})\2(\d{1,2})|(\d{2})(\d{2}))(?:[t ]\d{2}:\d{2}.*)?$"
    months = "jan feb mar apr may jun jul aug sep oct nov dec"
    ordered = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, numeric, "$1-$3$5-$4$6"), day_first, "$3-$2-$1"), name_first, "$3-$1-$2")
    parts = F.split(ordered, "-")
    month = F.get(parts, F.lit(1))
    number = F.when(month.rlike("^[a-z]{3}$"), F.array_position(F.array(*[F.lit(m) for m in months.split()]), month).cast("int")).otherwise(month.try_cast("int"))
    return F.when(ordered.rlike(r"^\d{4}-(?:\d{1,2}|[a-z]{3})-\d{1,2}$"), F.concat_ws("-", F.get(parts, F.lit(0)), number.try_cast("int").cast("string"), F.get(parts, F.lit(2)))).try_cast("date")
