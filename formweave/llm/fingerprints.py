"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document is cut into units (paragraphs at line ends and sentence ends, long
ones in pieces of ``PIECE`` code points); a unit's digest hashes its text and
how often it occurred before, so equal units count by multiplicity.  A sketch
has three tables of cells; each digest is added to one cell of each table: a
count, the XOR of digests and the XOR of their check hashes.  Subtracting two
sketches leaves the differing digests; peeling takes out cells that hold just
one, until nothing is left.  The stored fingerprints are subtracted first; if
cells remain, both documents' sketches are made again, twice as large and with
other hashes, subtracted and peeled again.  With d digests differing between
sets of a and b, the Jaccard likeness is (a+b-d) / (a+b+d).
``read`` and ``compare`` take fingerprints that were stored earlier.

The next document comes from parts of the order: cuts at quantiles of the ids
(about the square root of the rows, so that neither the parts nor their number
grow with the table), found for a row by binary search; rows of an id, or
without one, that fill several parts are cut by the hash of their text.

Edge cases: a null text is the empty text; it has an empty sketch; two empty
documents are alike (1.0), an empty and another are not (0.0).  Rows with the
same id are ordered by a hash of their text, equal rows are interchangeable;
null ids come first.  A table of one row is its own next document, an empty one
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from formweave.llm.common import small_batches

PIECE = 160
TABLES = 3
#: Cells of each of the three tables in the stored fingerprint; comparisons start there and double.
CELLS = 10
_UNIT = re.compile(r"\n+|(?<=[.!?])\s+")
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def units(text: str) -> list[str]:
    out = []
    for part in _UNIT.split(text):
        if len(part) <= PIECE:
            if part:
                out.append(part)
        else:
            out += [part[i : i + PIECE] for i in range(0, len(part), PIECE)]
    return out


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of (unit, occurrence), ascending."""
    seen: dict[str, int] = {}
    out = []
    hashed = xxhash.xxh3_64_intdigest
    for u in units(text):
        k = seen.get(u, 0)
        seen[u] = k + 1
        out.append(hashed(f"{k} {u}" if k else u))
    return np.unique(np.array(out, np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(int(_M[0]) * (salt + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, cells: np.ndarray | int, salt: int) -> list[np.ndarray]:
    """The cell of each key in each table."""
    return [(_mix(keys, salt * TABLES + t) % np.uint64(1 << 32) * np.asarray(cells, np.uint64) >> np.uint64(32)).astype(np.int64) for t in range(TABLES)]


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 97) & np.uint64(0xFFFFFFFF)


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # counts, XOR of keys, XOR of check hashes


def _sketch(keys: np.ndarray, owner: np.ndarray, cells: np.ndarray, salt: int) -> Cells:
    """Sketches of sets one behind the other: set i has TABLES * cells[i] cells, table t of it the t-th ``cells[i]``."""
    base = np.concatenate([[0], np.cumsum(cells * TABLES)])
    out = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.uint64)
    _change(out, keys, owner, np.ones(len(keys), np.int64), cells, base, salt)
    return out


def _change(sketch: Cells, keys: np.ndarray, owner: np.ndarray, by: np.ndarray, cells: np.ndarray, base: np.ndarray, salt: int) -> np.ndarray:
    """Add each key (``by`` times) to its cells; the places of these."""
    where = np.concatenate([p + base[owner] + t * cells[owner] for t, p in enumerate(_places(keys, cells[owner], salt))])
    np.add.at(sketch[0], where, np.tile(by, TABLES))
    np.bitwise_xor.at(sketch[1], where, np.tile(keys, TABLES))
    np.bitwise_xor.at(sketch[2], where, np.tile(_check(keys), TABLES))
    return where


def subtract(a: Cells, b: Cells) -> Cells:
    return a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]


def _peel(sketch: Cells, cells: np.ndarray, salt: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys that peeling takes out of each of the subtracted sketches, and whether cells are left in it."""
    count, xor, check = sketch
    base = np.concatenate([[0], np.cumsum(cells * TABLES)])
    look = np.flatnonzero(count)
    got_keys, got_owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while len(look):
        pure = look[(np.abs(count[look]) == 1) & (check[look] == _check(xor[look]))]
        if not len(pure):
            break
        own = np.searchsorted(base, pure, side="right") - 1
        found = np.stack([xor[pure], own.astype(np.uint64)])
        _, first = np.unique(found, axis=1, return_index=True)  # a key may be alone in several cells
        pure, own = pure[first], own[first]
        k, by = xor[pure].copy(), -count[pure]
        look = np.unique(_change(sketch, k, own, by, cells, base, salt))
        got_keys.append(k)
        got_owner.append(own)
    dirty = np.zeros(len(cells), bool)
    rest = np.flatnonzero((count != 0) | (xor != 0) | (check != 0))
    dirty[np.searchsorted(base, rest, side="right") - 1] = True
    k, o = np.concatenate(got_keys), np.concatenate(got_owner)
    order = np.argsort(o, kind="stable")
    return np.split(k[order], np.searchsorted(o[order], np.arange(1, len(cells)))), dirty


def sketches(keys: list[np.ndarray], cells: np.ndarray | int = CELLS, salt: int = 0) -> Cells:
    """The sketches of several sets, one behind the other."""
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return _sketch(np.concatenate([*keys, np.zeros(0, np.uint64)]), owner, np.broadcast_to(np.asarray(cells, np.int64), len(keys)), salt)


_CELL = np.dtype([("n", "<u4"), ("key", "<u8"), ("check", "<u4")])


def stored(keys: list[np.ndarray]) -> list[str]:
    """The fingerprints' text form: number of digests, then cells (count, key, 32-bit check) in base64."""
    rows = np.zeros((len(keys), TABLES * CELLS), _CELL)
    for name, values in zip(("n", "key", "check"), sketches(keys), strict=True):
        rows[name] = values.reshape(rows.shape)
    return [f"{len(k)}:{base64.b64encode(row.tobytes()).decode()}" for k, row in zip(keys, rows, strict=True)]


def read(fingerprints: list[str]) -> tuple[np.ndarray, Cells]:
    """Numbers of digests, and the sketches, of stored fingerprints."""
    parts = [f.split(":", 1) for f in fingerprints]
    row = np.frombuffer(b"".join(base64.b64decode(cells) for _, cells in parts), _CELL)
    return np.array([int(n) for n, _ in parts], np.int64), (row["n"].astype(np.int64), row["key"].astype(np.uint64), row["check"].astype(np.uint64))


def compare(a: list[str], b: list[str]) -> list[np.ndarray | None]:
    """The digests in which stored fingerprints differ, pair by pair; None where there are too many to peel."""
    keys, dirty = _peel(subtract(read(a)[1], read(b)[1]), np.full(len(a), CELLS), 0)
    return [None if bad else k for k, bad in zip(keys, dirty, strict=True)]


def differing(pairs: list[tuple[np.ndarray, np.ndarray]], prints: tuple[list[str], list[str]] | None = None) -> list[np.ndarray]:
    """The digests in which each pair of digest arrays differs, recovered by peeling.

    The pairs' stored fingerprints (made here if not given) are subtracted first.
    Pairs that fail go on to the next, larger size; all of them share arrays of
    cells, so every round of peeling is a few array operations.
    """
    prints = prints or (stored([a for a, _ in pairs]), stored([b for _, b in pairs]))
    found = compare(*prints)
    result = [np.zeros(0, np.uint64) if k is None else k for k in found]
    left = np.flatnonzero([k is None for k in found])
    factor = 2
    while len(left):
        # from the first retry on the documents' sizes bound the need
        most = np.array([len(pairs[i][0]) + len(pairs[i][1]) for i in left], np.int64)
        cells = np.maximum(CELLS * factor, most * factor // 8)
        both = [sketches([pairs[i][side] for i in left], cells, factor) for side in (0, 1)]
        keys, dirty = _peel(subtract(*both), cells, factor)
        for i, k, bad in zip(left, keys, dirty, strict=True):
            if not bad:
                result[i] = k
        left, factor = left[dirty], factor * 2
    return result


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]], prints: tuple[list[str], list[str]] | None = None) -> list[float]:
    """Jaccard likeness of each pair, from the number of digests recovered by peeling."""
    out = []
    for (a, b), d in zip(pairs, differing(pairs, prints), strict=True):
        both = len(a) + len(b)
        out.append((both - len(d)) / (both + len(d)) if both else 1.0)
    return out


def _at_most(cuts: Column, n: int, value: Column) -> Column:
    """How many of the ascending cuts are at most the value (0 for null), by binary search."""

    def halved(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        right = F.coalesce(F.get(cuts, middle) <= value, F.lit(False))
        return F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"), F.when(right, at["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halved)["low"]


def in_parts(rows: DataFrame, rows_a_part: int) -> DataFrame:
    """Rows (__o, __t, __h: order, text, its hash) with __p, their part of the order by (__o, __h), nulls first."""
    n, known, low = rows.agg(F.count("*"), F.count("__o"), F.min("__o")).first()
    size = max(rows_a_part, math.isqrt(n))
    found: list = []
    if low is not None and known > size:
        parts = known // size + 1
        found = rows.agg(F.percentile_approx("__o", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    kind = rows.schema["__o"].dataType
    times = Counter(found)
    cuts = sorted(times)
    # part 0: null ids, in slices; part k: ids from cut k - 1 on, first the cut itself in slices, then the others
    slices = [max(1, (n - known) // size), *([1] * (low is not None)), *[times[c] for c in cuts]]
    first = [0, *itertools.accumulate(k + 1 for k in slices)]

    def numbers(values: list[int]) -> Column:
        return F.from_json(F.lit(json.dumps(values)), "array<bigint>")

    at = F.from_json(F.lit(json.dumps(cuts, default=str)), ArrayType(kind))
    place = F.when(F.col("__o").isNull(), 0).otherwise(_at_most(at, len(cuts), F.col("__o")) + 1)
    rows = rows.withColumn("__c", place)
    hashed = F.floor((F.shiftright("__h", 32) + (1 << 31)) * F.get(numbers(slices), F.col("__c")) / (1 << 32))
    in_slices = F.col("__o").isNull() | (F.col("__o") == F.get(at, F.col("__c") - 2))
    part = F.get(numbers(first), F.col("__c")) + F.when(in_slices, hashed).otherwise(F.get(numbers(slices), F.col("__c")))
    return rows.withColumn("__p", part.cast("bigint")).drop("__c")


def with_next(docs: DataFrame, order: str = "doc_id", text: str = "text", rows_a_part: int = 1000) -> DataFrame:
    """Columns ``order``, ``text`` and ``next_text``: the text that follows in ascending order, for the last the first.

    Parts have ``rows_a_part`` rows or so, or the square root of all if that is more.  Each part gets the first row of
    the part behind it as a sentinel, so that a window within parts suffices and no task sees more than a part.
    """
    rows = docs.select(F.col(order).alias("__o"), F.coalesce(F.col(text), F.lit("")).alias("__t")).withColumn("__h", F.xxhash64("__t"))
    kind = rows.schema["__o"].dataType
    rows = in_parts(rows, rows_a_part)
    rank = F.struct(F.col("__o").isNotNull().alias("a"), F.col("__o").alias("o"), F.col("__h").alias("h"))
    heads = rows.groupBy("__p").agg(F.min_by("__t", rank).alias("__t"))
    # of each part the one before it that has rows; their number is about the square root of the rows
    every = heads.select("__p").withColumn("__b", F.coalesce(F.lag("__p").over(Window.orderBy("__p")), F.max("__p").over(Window.partitionBy(F.lit(0)))))
    heads = heads.join(every, "__p").select(F.lit(None).cast(kind).alias("__o"), "__t", F.lit(None).cast("bigint").alias("__h"), F.col("__b").alias("__p"), F.lit(1).alias("__k"))
    both = rows.withColumn("__k", F.lit(0)).unionByName(heads)
    near = Window.partitionBy("__p").orderBy("__k", F.col("__o").asc_nulls_first(), "__h")
    both = both.withColumn("__n", F.lead("__t").over(near)).where(F.col("__k") == 0)
    return both.select(F.col("__o").alias(order), F.col("__t").alias("text"), F.col("__n").alias("next_text"))


def fingerprints(pairs: DataFrame, order: str = "doc_id") -> DataFrame:
    """From ``with_next`` rows: fingerprints of text and edited text, and likenesses."""
    import hashlib

    small_batches(pairs.sparkSession)
    kind = pairs.schema[order].dataType.simpleString()
    schema = f"`{order}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, nexts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cols: dict[str, list] = {k: [] for k in ("n", "sha")}
            ne: list = []
            nn: list = []
            known: dict[str, np.ndarray] = {}
            for i, (text, after) in enumerate(zip(texts, nexts, strict=True)):
                edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
                own = known.pop(text, None)
                own = digests(text) if own is None else own
                known = {after: digests(after)}
                theirs = digests(edited)
                cols["n"].append(len(text))
                cols["sha"].append(hashlib.sha256(edited.encode()).hexdigest())
                ne.append((own, theirs))
                nn.append((own, known[after]))
            mine, edits, after = stored([a for a, _ in ne]), stored([b for _, b in ne]), stored([b for _, b in nn])
            both = likeness(ne + nn, (mine + mine, edits + after))
            out = [ids, pa.array(cols["n"], pa.int64()), pa.array(cols["sha"]), pa.array(mine), pa.array(edits), pa.array(both[: len(ne)], pa.float64()), pa.array(both[len(ne) :], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[order, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return pairs.select(order, "text", "next_text").mapInArrow(run, schema)
