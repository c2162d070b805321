"""The branching expression language: ``[Display if] Q<n> (=|!=|in) value [AND ...]``.

Values are quoted texts or parenthesised lists of values.  Conjuncts are split at
AND wherever it stands, inside quotes too.  The canonical form has double quotes,
sorted conjuncts and sorted list items (duplicates kept).
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

_PREFIX = re.compile(r"\s*display\s+if\s+", re.I)
_AND = re.compile(r"\s+AND\s+", re.I)
_HEAD = re.compile(r"\s*(Q\d+)\s*(!=|=|(?i:in)\b)")
_PIECE = re.compile(r"""\s*(?:(?P<text>"(?:\\.|""|[^"\\])*+"|'(?:\\.|''|[^'\\])*+')|(?P<mark>[(),]))""", re.S)
#: Loose syntax: the prefix and a question reference, whatever follows on the line.
LOOSE = r"(?iU)^(?:Display if|If)\s+Q\d+\b[^\n]*$"


class BranchingError(ValueError):
    """An expression that does not parse."""


def _quoted(raw: str) -> str:
    quote = raw[0]
    plain = re.sub(r"\\(.)|" + quote * 2, lambda m: m[1] or quote, raw[1:-1], flags=re.S)
    return '"' + plain.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _value(text: str, at: int) -> tuple[str, int, bool]:
    """Canonical text of the value at ``at``, where it ends, and whether it is a list."""
    open_lists: list[list[str]] = []
    need = True  # a value has to come, not a comma or end
    while True:
        m = _PIECE.match(text, at)
        if not m:
            raise BranchingError("value expected")
        at, done = m.end(), None
        if m["text"]:
            if not need:
                raise BranchingError("',' or ')' expected")
            done = _quoted(m["text"])
        elif m["mark"] == "(":
            if not need:
                raise BranchingError("',' or ')' expected")
            open_lists.append([])
        elif m["mark"] == ",":
            if need or not open_lists:
                raise BranchingError("value expected")
            need = True
        else:
            if not open_lists or (need and open_lists[-1]):
                raise BranchingError("value expected")
            done = "(" + ", ".join(sorted(open_lists.pop())) + ")"
        if done is not None:
            if not open_lists:
                return done, at, done[0] == "("
            open_lists[-1].append(done)
            need = False


def canonicalize(text: str | None) -> str:
    """The canonical form; raises BranchingError."""
    s = unicodedata.normalize("NFC", text).strip() if text is not None else ""
    if not s:
        raise BranchingError("empty expression")
    m = _PREFIX.match(s)
    terms = []
    for part in _AND.split(s[m.end() :] if m else s):
        part = part.strip()
        head = _HEAD.match(part)
        if not head:
            raise BranchingError("question reference and operator expected")
        value, end, is_list = _value(part, head.end())
        if part[end:].strip():
            raise BranchingError("trailing input")
        op = head[2].lower()
        terms.append(f"{head[1]} {op} {value if is_list or op != 'in' else f'({value})'}")
    return "Display if " + " AND ".join(sorted(terms))


def try_canonicalize(text: str | None) -> str | None:
    try:
        return canonicalize(text)
    except BranchingError:
        return None


def equivalent_texts(a: str | None, b: str | None) -> bool:
    x = try_canonicalize(a)
    return x is not None and x == try_canonicalize(b)


@arrow_udf(StringType())
def _canonical(s: pa.Array) -> pa.Array:
    return pa.array([try_canonicalize(x) for x in s.to_pylist()], pa.string())


def canonical(c: Column | str) -> Column:
    """Canonical form, null if it does not parse."""
    return _canonical(F.col(c) if isinstance(c, str) else c)


def equivalent(a: Column, b: Column) -> Column:
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def loosely_valid(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(LOOSE), F.lit(False))
