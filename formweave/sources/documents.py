"""Enriched documents (JSON), log records (JSON lines), and writers of metrics and traces."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave import schema


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file; fixture_id is the name of its folder."""
    d = spark.read.schema(schema.DOCUMENT).option("multiLine", True).json(path)
    return d.withColumn("fixture_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.LOG).json(path)


def write_trace(blocks: DataFrame, path: str) -> None:
    """Per-block trace as JSON lines, without texts: length and digest only."""
    text = F.coalesce("text", F.lit(""))
    blocks.select(*[c for c in blocks.columns if c != "text"], F.char_length(text).alias("text_chars"), F.sha2(text, 256).alias("text_sha256")).write.mode("overwrite").json(path)


def export_schema(path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(schema.json_schema(), indent=2, sort_keys=True) + "\n")
    return path


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        bound = {k: v for k, v in getattr(record, "bound", {}).items() if isinstance(v, (str, int, float, bool, type(None)))}
        when = datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds")
        return json.dumps(bound | {"timestamp": when, "level": record.levelname.lower(), "stage": record.name.rpartition(".")[2], "event": record.getMessage()})


def configure_logging(level: str = "INFO", renderer: str = "console") -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(_Json() if renderer == "json" else logging.Formatter("%(levelname)s %(name)s %(message)s"))
    root = logging.getLogger("formweave")
    root.handlers[:] = [handler]
    root.setLevel(level)


class _Bound(logging.LoggerAdapter):
    """Adds its fields to each record."""

    def process(self, msg, kwargs):
        return msg, kwargs | {"extra": {"bound": dict(self.extra)} | kwargs.get("extra", {})}


def get_logger(stage: str, **fields: object) -> logging.Logger | logging.LoggerAdapter:
    """The stage's logger; ``fields`` are written with each of its records."""
    logger = logging.getLogger(f"formweave.{stage}")
    return _Bound(logger, fields) if fields else logger
