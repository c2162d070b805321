"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from formweave.shared import drop_stash, shared_dir, stash

__all__ = ["drop_stash", "map_batches", "shared_dir", "small_batches", "stash", "text_frame"]
#: Rows per Arrow batch: texts may be long, and a batch has to fit a small Python worker.
BATCH_ROWS = 400
#: Code points handled at once by vectorised code.
SLICE_CHARS = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default Arrow batch (10,000 rows) where the session still has it.

    It stays lowered: a lazy frame reads the setting when it runs, long after it was made."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) >= 10_000:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from columns to columns, one small batch at a time."""
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_frame(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, str, Callable[[dict], list]]:
    """The columns to hand to Python (a text that is kept is sent once), the DDL of the kept
    ones, and a function that takes the texts out of a batch's columns."""
    frame = docs.select(*keep, *([] if text in keep else [docs[text].alias("__text")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "__text")
    return frame, fields, lambda cols: list(cols[text]) if text in keep else cols.pop("__text")
