"""Numbers, dates and cell values.

Dates are read in ISO form, month-name form (``Jan 15, 2024``, ``15 January 2024``) and
month-first numeric form with day-first fallback.  Partial dates, which would depend on today's
date, are not dates here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formweave.functions.text import normalize_string

_NUMBER = r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|inf|infinity|nan)$"
_DATES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*$", ("yyyy-MM-dd",)),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ("MMM d yyyy",)),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", ("MMMM d yyyy",)),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ("d MMM yyyy",)),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", ("d MMMM yyyy",)),
)


def number_of_text(s: Column) -> Column:
    """Commas removed, surrounding space ignored, null if it is no number."""
    t = F.lower(F.replace(normalize_string(s, True), F.lit(","), F.lit("")))
    return F.when(t.rlike(_NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def plain_number(s: Column) -> Column:
    """As ``number_of_text``, but a comma makes it no number.  Plain digits, the usual case, are read at once."""
    return F.when(s.rlike("^[0-9]{1,15}$"), s.try_cast("double")).when(~F.contains(s, F.lit(",")), number_of_text(s))


def date_of_text(s: Column) -> Column:
    t = normalize_string(s, True)
    found = F.lit(None).cast("date")
    for pattern, formats in _DATES:
        # names of months are read with a capital first letter; a time of day is cut off
        u = F.initcap(F.replace(t, F.lit(","), F.lit(""))) if "A-Za-z" in pattern else F.substring(t, 1, 10)
        found = F.coalesce(found, F.when(t.rlike(pattern), F.coalesce(*[F.try_to_date(u, f) for f in formats])))
    return found


def text_value(s: Column) -> Column:
    """A cell value that holds text."""
    s = s.cast("string")
    return F.struct(F.when(s.isNotNull(), F.lit("s")).alias("kind"), s.alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("boolean").alias("b"))


def number_value(n: Column, text: Column) -> Column:
    return F.struct(F.when(n.isNotNull(), F.lit("n")).alias("kind"), text.alias("s"), n.cast("double").alias("n"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("boolean").alias("b"))


def date_value(d: Column) -> Column:
    return F.struct(F.when(d.isNotNull(), F.lit("d")).alias("kind"), d.cast("string").alias("s"), F.lit(None).cast("double").alias("n"), d.cast("date").alias("d"), F.lit(None).cast("boolean").alias("b"))


def coerce_numeric(v: Column) -> Column:
    return F.when(v["kind"] == "b", v["b"].cast("double")).when(v["kind"] == "n", v["n"]).when(v["kind"] == "s", number_of_text(v["s"]))


def coerce_date(v: Column) -> Column:
    return F.when(v["kind"] == "d", v["d"]).when(v["kind"] == "s", date_of_text(v["s"]))


def numbers_equal(a: Column, b: Column, tol: float = 1e-9) -> Column:
    return F.coalesce(F.abs(a - b) <= tol, F.lit(False))


def dates_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def value_blank(v: Column) -> Column:
    return normalize_string(v["s"], True) == ""


def cells_equal(a: Column, b: Column, ascii_only: bool = False) -> Column:
    """Both blank; or equal as dates if one is a date; or as numbers if one is a number; or as text in any case."""
    date = ((a["kind"] == "d") | (b["kind"] == "d")) & dates_equal(coerce_date(a), coerce_date(b))
    number = ((a["kind"] == "n") | (b["kind"] == "n")) & numbers_equal(coerce_numeric(a), coerce_numeric(b))
    text = normalize_string(a["s"], ascii_only) == normalize_string(b["s"], ascii_only)
    no = F.lit(False)
    return (value_blank(a) & value_blank(b)) | F.coalesce(date, no) | F.coalesce(number, no) | text
