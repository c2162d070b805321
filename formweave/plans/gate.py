"""Confidence gate, refinement override and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.operators import graph
from formweave.operators.ratios import ratio

GATE_CONFIDENCE, LEAST_CONFIDENCE, SCORE_GAP = 0.75, 0.05, 0.05


def routed(threshold: float = GATE_CONFIDENCE, confidence: Column | str = "confidence") -> Column:
    """Whether a block is deferred: confidence (missing: 0) under the threshold."""
    return F.coalesce(confidence, F.lit(0.0)) < threshold


def gate(blocks: DataFrame, threshold: float = GATE_CONFIDENCE) -> DataFrame:
    """Adds ``routed``; the two sides are filters on it."""
    return blocks.withColumn("routed", routed(threshold))


def gate_reasons(blocks: DataFrame, threshold: float = 0.70, by_type: dict[str, float] | None = None) -> DataFrame:
    """fixture_id, block_id, reasons (sorted), threshold_used; every reason that holds is listed."""
    limit = F.lit(threshold)
    for name, value in (by_type or {}).items():
        limit = F.when(F.col("block_type") == name, value).otherwise(limit)
    b = blocks.withColumn("threshold_used", limit)
    low = F.when(F.coalesce("confidence", F.lit(0.0)) < F.col("threshold_used"), F.lit("low_confidence"))
    near = F.when(F.col("runner_up").isNotNull() & (F.col("confidence") - F.col("runner_up") <= SCORE_GAP), F.lit("ambiguous")) if "runner_up" in blocks.columns else F.lit(None).cast("string")
    b = b.join(graph.anomalies(blocks), ["fixture_id", "block_id"], "left")
    reasons = F.array_sort(F.concat(F.array_compact(F.array(low, near)), F.coalesce("anomalies", F.array().cast("array<string>"))))
    return b.select("fixture_id", "block_id", reasons.alias("reasons"), "threshold_used", (F.size(reasons) > 0).alias("routed"))


def reason_histogram(reasons: DataFrame) -> DataFrame:
    """fixture_id, reason, blocks: how many blocks of a document each reason of ``gate_reasons`` routed."""
    return reasons.select("fixture_id", F.explode("reasons").alias("reason")).groupBy("fixture_id", "reason").agg(F.count("*").alias("blocks"))


def run_summary(reasons: DataFrame, rows: DataFrame) -> DataFrame:
    """fixture_id, blocks, routed, route_rate, rows: one record a document from its gate reasons and mapped rows."""
    routed = F.count(F.when(F.col("routed"), 1))
    out = reasons.groupBy("fixture_id").agg(F.count("*").alias("blocks"), routed.alias("routed"), ratio(routed, F.count("*"), 0.0).alias("route_rate"))
    made = rows.groupBy("fixture_id").agg(F.count("*").alias("rows"))
    return out.join(made, "fixture_id", "left").fillna(0, ["rows"])


def refine(blocks: DataFrame, refinements: DataFrame | None) -> DataFrame:
    """Routed blocks take what a refinement has for them; provenance tells which."""
    if refinements is None:
        return blocks
    fields = [c for c in ("block_type", "confidence", "branching_logic") if c in refinements.columns]
    r = refinements.select("fixture_id", "block_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields])
    b = blocks.join(r, ["fixture_id", "block_id"], "left")
    hit = F.col("routed") & F.coalesce("_hit", F.lit(False))
    b = b.withColumns({c: F.when(hit, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in fields})
    return b.withColumn("provenance", F.when(hit, "llm").otherwise("rule")).drop("_hit", *[f"_{c}" for c in fields])


def merge(accepted: DataFrame, enriched: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Accepted blocks, then enriched ones, without those of too little confidence (missing: kept); ``branch`` and ``pos`` order them."""
    both = accepted.withColumn("branch", F.lit(0)).unionByName(enriched.withColumn("branch", F.lit(1)), allowMissingColumns=True)
    return both.where(F.coalesce("confidence", F.lit(1.0)) >= least)
