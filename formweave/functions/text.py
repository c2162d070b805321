"""Text normalisation.  NFC and case folding have no built-in and run as Arrow functions, ASCII bypasses them."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: White space as Python's str.strip takes it: Unicode's, and the four separators that Java leaves out.
_SPACE = r"[\s\x1c-\x1f]"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


@arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    # Arrow's own normaliser leaves decomposed letters decomposed, so Python's is used
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


@arrow_udf(StringType())
def _fold(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.casefold() for x in s.to_pylist()], pa.string())


@arrow_udf(StringType())
def _nfc_fold(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x).strip().casefold() for x in s.to_pylist()], pa.string())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfc(c: Column | str) -> Column:
    return _nfc(_col(c))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalize_string(c: Column | str, ascii_only: bool = False) -> Column:
    """Null is empty; NFC; stripped.  ``ascii_only`` skips NFC for columns known to be ASCII, which keeps the plan in the JVM."""
    c = F.coalesce(_col(c).cast("string"), F.lit(""))
    return strip(c if ascii_only else nfc(c))


def normalize_case_insensitive(c: Column | str, ascii_only: bool = False) -> Column:
    c = _col(c)
    return F.lower(normalize_string(c, True)) if ascii_only else _nfc_fold(F.coalesce(c.cast("string"), F.lit("")))


def is_blank(c: Column | str, ascii_only: bool = True) -> Column:
    """NFC never makes text blank or not blank, so the JVM form is exact for all text."""
    return normalize_string(c, True) == ""


def strings_equal(a: Column, b: Column, case_insensitive: bool = False, ascii_only: bool = False) -> Column:
    f = normalize_case_insensitive if case_insensitive else normalize_string
    return f(a, ascii_only) == f(b, ascii_only)


def nfc_or_empty(c: Column | str, ascii_only: bool = False) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    return c if ascii_only else nfc(c)


def canonicalize_header(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^A-Za-z0-9]", ""))


def canonical_quotes(c: Column | str) -> Column:
    """Single quotes become double ones everywhere, runs of white space one space, ends stripped; null stays."""
    return strip(F.regexp_replace(F.translate(_col(c), "'", '"'), f"(?U){_SPACE}+", " "))


def text_sha(c: Column | str) -> Column:
    return F.sha2(F.coalesce(_col(c), F.lit("")), 256)


def bbox_key(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """Coordinates in buckets of two points, halves to even."""
    return [F.rint(v.cast("double") / 2.0).cast("int") for v in (x0, y0, x1, y1)]


def split_options(c: Column | str) -> Column:
    """The set of ``|``-separated options, sorted."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), r"[|]"), strip)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def a1(row: Column, col: Column) -> Column:
    """Spreadsheet coordinate for up to three letters."""
    c = col.cast("int")

    def letter(n: Column) -> Column:
        return F.char(F.lit(65) + n)

    one, two = c - 1, c - 27
    three = c - 703
    name = F.when(c <= 26, letter(F.pmod(one, F.lit(26)))).when(c <= 702, F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26)))))
    name = name.otherwise(F.concat(letter(F.floor(three / 676)), letter(F.pmod(F.floor(three / 26), F.lit(26))), letter(F.pmod(three, F.lit(26)))))
    return F.concat(name, row.cast("string"))


def latency_s(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), end - start)


def pair_key(candidate: Column, reference: Column) -> Column:
    """sha256 of both texts with a zero byte between."""
    return F.sha2(F.concat(F.encode(candidate, "UTF-8"), F.lit(b"\x00"), F.encode(reference, "UTF-8")), 256)


def combine_confidences(values: Column) -> Column:
    """Probabilistic OR of an array, within the contract's bounds."""
    miss = F.aggregate(values, F.lit(1.0), lambda acc, c: acc * (1 - c))
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), 1 - miss))


def block_id(page: Column, x0: Column, y0: Column, x1: Column, y1: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", page, *bbox_key(x0, y0, x1, y1), text_sha(text)), 256)


def clean_extracted(c: Column | str) -> Column:
    """NFC with Latin ligatures written out."""
    c = nfc(c)
    for ligature, letters in _LIGATURES.items():
        c = F.replace(c, F.lit(ligature), F.lit(letters))
    return c


def template_version(version: Column, content: Column) -> Column:
    return F.concat(version, F.lit("+sha:"), F.substring(F.sha2(content, 256), 1, 12))


def redact_for_debug(c: Column | str) -> Column:
    return F.substring(_col(c), 1, 40)


def redact_for_error(c: Column | str) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    return F.format_string("len=%d sha256=%s", F.char_length(c), F.sha2(c, 256))
