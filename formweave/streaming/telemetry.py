"""Evaluation E over a stream of log records: the batch measures per event-time window, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from formweave import schema
from formweave.operators.telemetry import measures, with_ratios


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log records with an event time ``ts``."""
    return spark.readStream.schema(schema.record(**{f.name: f.dataType for f in schema.LOG}, ts=TimestampType())).json(path)


def windowed(records: DataFrame, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Measures of each window; the same function serves batch frames, where the watermark has no effect."""
    r = records.withColumn("ts", F.col("ts").cast("timestamp"))
    r = r.withWatermark("ts", late) if r.isStreaming else r
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    sums = r.groupBy(w.alias("w")).agg(*measures())
    return with_ratios(sums.select(F.col("w.start").alias("window_start"), *[c for c in sums.columns if c != "w"]))


def error_rate(records: DataFrame, window: str = "1 hour", slide: str = "5 minutes", limit: float = 0.01) -> DataFrame:
    """Share of failed calls (status 500 and above) in a sliding window, and whether it is over the limit."""
    r = records.withColumn("ts", F.col("ts").cast("timestamp"))
    r = r.withWatermark("ts", window) if r.isStreaming else r
    out = r.groupBy(F.window("ts", window, slide).alias("w")).agg(F.avg((F.col("status") >= 500).cast("double")).alias("rate"))
    return out.select(F.col("w.start").alias("window_start"), "rate", (F.col("rate") > limit).alias("alert"))
