"""Semantic equivalence (evaluation D): expressions by canonical form, texts by exact match, then by a judge.

Pairs are rows (fixture_id, row_index, candidate, reference[, is_checkbox]).  The judge sees only
the distinct pairs that exact comparison leaves open; definite verdicts can be kept in a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.branching import equivalent
from formweave.functions.text import nfc_or_empty, pair_key, split_options
from formweave.operators.ratios import ratio


def zip_strict(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """Join by (fixture_id, row_index); a row that only one side has fails the query when it is run."""
    unmatched = F.assert_true(F.col("_c").isNotNull() & F.col("_r").isNotNull(), F.lit("candidate and reference differ in length"))
    both = candidate.withColumn("_c", F.lit(1)).join(reference.withColumn("_r", F.lit(1)), ["fixture_id", "row_index"], "full")
    return both.where(unmatched.isNull()).drop("_c", "_r")


def _open(pairs: DataFrame, ascii_only: bool) -> DataFrame:
    """Both sides in NFC; pairs empty on both sides are left out."""
    p = pairs.withColumn("candidate", nfc_or_empty("candidate", ascii_only)).withColumn("reference", nfc_or_empty("reference", ascii_only))
    return p.where((F.col("candidate") != "") | (F.col("reference") != ""))


def branching_equivalence(pairs: DataFrame, ascii_only: bool = False) -> DataFrame:
    p = _open(pairs, ascii_only).withColumn("equivalent", equivalent(F.col("candidate"), F.col("reference")))
    return score(p.withColumn("method", F.lit("ast")))


def judge_table(pairs: DataFrame, judge: Callable[[str, str], str], known: DataFrame | None = None) -> DataFrame:
    """(key, verdict) for the distinct pairs, one judge call each; ``known`` verdicts are not asked again."""
    asked = pairs.select(pair_key(F.col("candidate"), F.col("reference")).alias("key"), "candidate", "reference").dropDuplicates(["key"])
    if known is not None:
        asked = asked.join(known.select("key"), "key", "left_anti")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [judge(c, r) for c, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "verdict"])

    fresh = asked.mapInArrow(run, "key string, verdict string")
    return fresh if known is None else known.select("key", "verdict").unionByName(fresh)


def definite(verdicts: DataFrame) -> DataFrame:
    """The verdicts worth keeping: yes and no."""
    return verdicts.where(F.col("verdict").isin("yes", "no"))


def _judged(p: DataFrame, exact: Column, verdicts: DataFrame | None) -> DataFrame:
    """equivalent and method: exact, then a verdict by (candidate, reference), unknown without one."""
    p = p.withColumn("_exact", exact)
    if verdicts is None:
        p = p.withColumn("verdict", F.lit("unknown"))
    else:
        v = verdicts.select(F.col("key").alias("_key"), "verdict")
        p = p.withColumn("_key", F.when(~F.col("_exact"), pair_key(F.col("candidate"), F.col("reference")))).join(v, "_key", "left").drop("_key").withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))
    method = F.when(F.col("_exact"), "exact").when(F.col("verdict") == "unknown", "judge-unknown").otherwise("judge")
    return p.withColumn("method", method).withColumn("equivalent", F.col("_exact") | (F.col("verdict") == "yes")).drop("_exact", "verdict")


def residual(pairs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Pairs that exact comparison leaves to the judge."""
    p = _open(pairs, ascii_only)
    return p.where(~_answer_exact(p))


def _answer_exact(p: DataFrame) -> Column:
    exact = F.col("candidate") == F.col("reference")
    if "is_checkbox" in p.columns:
        boxes = split_options("candidate") == split_options("reference")
        return F.when(F.coalesce("is_checkbox", F.lit(False)), boxes).otherwise(exact)
    return exact


def text_equivalence(pairs: DataFrame, verdicts: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """Question texts: exact, else judged."""
    p = _open(pairs.drop("is_checkbox"), ascii_only)
    return score(_judged(p, _answer_exact(p), verdicts))


def answer_equivalence(pairs: DataFrame, verdicts: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """Answers: checkbox rows as sets of options, others exact; what differs is judged, checkbox rows are not."""
    p = _open(pairs, ascii_only)
    judged = _judged(p, _answer_exact(p), verdicts)
    box = F.coalesce("is_checkbox", F.lit(False))
    sets = split_options("candidate") == split_options("reference")
    judged = judged.withColumn("equivalent", F.when(box, sets | F.col("equivalent")).otherwise(F.col("equivalent")))
    return score(judged)


def score(cells: DataFrame) -> DataFrame:
    """numerator, denominator, score (1.0 without pairs) and unresolved of each fixture."""
    yes = F.sum(F.col("equivalent").cast("bigint"))
    return cells.groupBy("fixture_id").agg(yes.alias("numerator"), F.count("*").alias("denominator"), ratio(yes, F.count("*"), 1.0).alias("score"), F.sum((F.col("method") == "judge-unknown").cast("bigint")).alias("unresolved"))


def uplift(scores: DataFrame, baseline: DataFrame, key: str = "metric") -> DataFrame:
    """Score minus the baseline's; a metric that the baseline lacks counts 0 there."""
    b = baseline.select(key, F.col("score").alias("base"))
    return scores.select(key, "score").join(b, key, "left").select(key, (F.col("score") - F.coalesce("base", F.lit(0.0))).alias("uplift"))
