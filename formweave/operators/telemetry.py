"""Cost and latency from log records (evaluation E): one pass of conditional sums, exact to merge in streams."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.operators.ratios import count_true, ratio


def measures(cost: str = "cost_usd") -> list[Column]:
    """cost_usd, blocks, routed, llm_calls, cache_hits as mergeable sums."""
    call = F.coalesce("llm_call", F.lit(False))
    return [
        F.coalesce(F.sum(cost), F.lit(0)).cast("double").alias("cost_usd"),
        F.coalesce(count_true(F.col("block")), F.lit(0)).alias("blocks"),
        F.coalesce(count_true(F.col("routed")), F.lit(0)).alias("routed"),
        F.coalesce(count_true(F.col("llm_call")), F.lit(0)).alias("llm_calls"),
        F.coalesce(count_true(call & F.coalesce("cache_hit", F.lit(False))), F.lit(0)).alias("cache_hits"),
    ]


def with_ratios(sums: DataFrame) -> DataFrame:
    return sums.withColumns({"cost_per_block_usd": ratio(F.col("cost_usd"), F.col("blocks"), 0.0), "route_rate": ratio(F.col("routed"), F.col("blocks"), 0.0), "cache_hit_rate": ratio(F.col("cache_hits"), F.col("llm_calls"), 0.0)})


def cost_latency(records: DataFrame, *by: str) -> DataFrame:
    """Sums and ratios over all records, or by columns.  No records give one row of zeros."""
    return with_ratios(records.groupBy(*by).agg(*measures()) if by else records.agg(*measures()))


def budget_lock(runs: DataFrame, column: str) -> DataFrame:
    """90th percentile plus a quarter, over the first ten runs by ``run``."""
    first = runs.orderBy("run").limit(10)
    return first.agg((F.percentile(column, 0.9) * 1.25).alias("budget"))


#: Alert limits.
ALERTS = {"cost_usd": 0.25, "route_rate": 0.30, "llm_invalid_rate": 0.05, "latency_s": 120.0}


def alerts(summary: DataFrame) -> DataFrame:
    """The summary with the names of limits it exceeds; limits whose column is missing are skipped."""
    checks = [F.when(F.col(c) > limit, F.lit(c)) for c, limit in ALERTS.items() if c in summary.columns]
    return summary.withColumn("alerts", F.array_compact(F.array(*checks)))


class CostTracker:
    """Wall clock around a run plus the records it produced."""

    def __init__(self) -> None:
        self.records: DataFrame | None = None
        self.start = self.end = 0.0

    def __enter__(self) -> CostTracker:
        self.start = time.monotonic()
        return self

    def __exit__(self, *exc) -> None:
        self.end = time.monotonic()

    def ingest(self, records: DataFrame) -> None:
        self.records = records if self.records is None else self.records.unionByName(records, allowMissingColumns=True)

    def result(self) -> DataFrame:
        if self.records is None:
            raise ValueError("no records were ingested")
        return cost_latency(self.records).withColumn("latency_s", F.lit(max(0.0, self.end - self.start)))
