"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words.  Sources in code-point order (null last) weigh 3, 1, 2, 3, ...
and share ``SHARE`` of all words; no source gets over ``REPEATS`` times its
words, what that frees is shared again by weight until none is above.  Each
source is then taken whole as often as fits into its target.  For the budget
that remains, documents are counted by exact length: an equal part of every
length is taken first, and a bounded-knapsack programme over the lengths'
remaining counts fills the rest exactly, or as nearly below as lengths allow.
At last the documents of each length are chosen in the order of a seeded hash.

Only counts by (source, length) reach the programme, never documents; choosing
ranks within (source, length, slice of the hash), so that thousands of copies
of one length are not ordered in one task.  Reruns agree, as ranks depend on
the ids, the seed and the counts alone.

Edge cases: a null text has size 0; documents of size 0 are taken 0 times; a
source without words has target 0; rows with equal ids and lengths are
interchangeable, each is a row of the result; an empty table gives an empty
result; extra columns are ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.llm.common import stash

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, 41
#: Slices of the hash in which documents of one length are ranked.
SLICES = 64
#: The programme's budget at most, in words: the proportional part leaves about this much to fill; and
#: bytes of the sets of sums at most, where it is given more.
EXACT, MOST_BYTES = 1 << 15, 1 << 28


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row a source.

    A share at level t is min(REPEATS * size, t * weight).  Sources in the order
    of size / weight reach their limit first; with running sums the level
    follows in one pass over the (few) sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.row_number().over(names) - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    by = by.withColumn("weight", weight).withColumn("most", F.lit(REPEATS) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    by = by.withColumn("budget", SHARE * F.sum("source_size").over(every))
    # if all before are full and this one is not, the level is (budget - their limits) / weights from here on
    before = F.sum("most").over(order) - F.col("most")
    rest = F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight")
    by = by.withColumn("level", (F.col("budget") - before) / rest)
    full = F.col("most") <= F.col("level") * F.col("weight")
    by = by.withColumn("full", full)
    # sources are full up to the first that is not; its level holds for all behind
    first = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("level"))).otherwise(None)).over(every)
    by = by.withColumn("final", first["level"])
    target = F.when(F.col("final").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("final") * F.col("weight")))
    return by.select("source", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take: their words sum to the budget or to the most reachable below it.

    All is divided by the lengths' greatest common divisor first.  Where the programme ends below the budget, it
    takes over more of the proportional part, four times as much each time, until it has the whole budget or its
    sets of sums would take ``MOST_BYTES``; only beyond that bound the sum may be below the most reachable."""
    step = int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)], initial=0))
    if step > 1:
        return fit(np.where(counts > 0, lengths, 0) // step, counts, budget // step)
    exact, log = EXACT, int(sum(int(c).bit_length() for c in counts))
    while True:
        taken = _fit(lengths, counts, budget, exact)
        short = budget - int((lengths * taken).sum())
        if budget <= exact or short < max(1, step) or (lengths * (counts - taken)).sum() == 0 or exact // 2 * log > MOST_BYTES:
            return taken
        exact *= 4


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int) -> np.ndarray:
    taken = np.zeros(len(lengths), np.int64)
    use = (lengths > 0) & (counts > 0)
    if not use.any() or budget <= 0:
        return taken
    total = int((lengths * counts)[use].sum())
    if total <= budget:
        return np.where(use, counts, 0)
    # the proportional part leaves exact words or so to the programme
    part = max(0.0, (budget - exact) / total)
    taken[use] = np.floor(counts[use] * part).astype(np.int64)
    rest = budget - int((lengths * taken).sum())
    if rest > exact:  # rounding down left more: longest first, what fits whole
        for i in np.argsort(-lengths, kind="stable"):
            if use[i] and rest > exact:
                more = min(int(counts[i] - taken[i]), (rest - exact) // int(lengths[i]))
                taken[i] += more
                rest -= more * int(lengths[i])
    # bounded knapsack over the remaining counts: reach[s] is the least place of a length that completes sum s.
    # Sums are a bit set; counts are split into binary bundles, so that a length costs log(count) shifts.
    bundles = []
    for i in np.flatnonzero(use & (lengths <= rest)):
        left, k = min(int(counts[i] - taken[i]), rest // int(lengths[i])), 1
        while left > 0:
            bundles.append((i, min(k, left)))
            left -= k
            k *= 2
    reach, mask, steps = 1, (1 << rest + 1) - 1, []
    for i, k in bundles:
        grown = (reach | reach << k * int(lengths[i])) & mask
        if grown != reach:
            steps.append((i, k, reach))
            reach = grown
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= k * int(lengths[i])
    return taken


def _plan(histogram: DataFrame) -> DataFrame:
    """source, size, passes, extra: whole passes over a source, and documents of each length taken once more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("size")
        sizes, counts = table["size"].to_numpy(), table["n"].to_numpy()
        total, target = int((sizes * counts).sum()), table["target"][0].as_py()
        goal = round(target)
        passes = min(REPEATS, goal // total) if total else 0
        extra = fit(sizes, counts, goal - passes * total) if passes < REPEATS else np.zeros(len(sizes), np.int64)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays([table["source"].combine_chunks(), table["size"].combine_chunks(), pa.array([passes] * n, pa.int64()), pa.array(extra, pa.int64())], names=["source", "size", "passes", "extra"])

    return histogram.groupBy("source").applyInArrow(lambda t: pa.Table.from_batches(run(t.to_batches())), "source string, size bigint, passes bigint, extra bigint")


def mix(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the ``keep`` columns in a struct ``kept``: one row each of ``docs``."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    place = F.pmod(F.shiftright(h, 40), F.lit(SLICES)).cast("int").alias("slice")
    full = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), h.alias("h"), place, *([F.struct(*keep).alias("kept")] if keep else []))
    rows = stash(full.drop("kept"), "mix-sizes")  # sizes and ids are read several times, texts are not
    goals = targets(rows)
    sliced = rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    histogram = sliced.groupBy("source", "size").agg(F.sum("n").alias("n"))
    histogram = histogram.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = _plan(histogram.select("source", "size", "n", "target"))
    # documents of one length in lower slices come first
    below = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sliced.select("source", "size", "slice", F.coalesce(below, F.lit(0)).alias("below"))
    plan = plan.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    null = F.lit("\x00null")  # joins by equality, which a null would not meet

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("source", F.coalesce("source", null))

    starts = keyed(starts).join(keyed(plan), ["source", "size"])
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("h", "doc_id"))
    ranked = keyed(full if keep else rows).withColumn("rank", rank)
    taken = F.col("size") * (F.col("passes") + (F.col("below") + F.col("rank") <= F.col("extra")).cast("bigint"))
    return ranked.join(starts, ["source", "size", "slice"]).select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["kept"] if keep else []))
