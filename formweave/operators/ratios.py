"""Ratios with a value of their own for no rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_true(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """One division of two whole numbers."""
    return F.when(F.coalesce(whole, F.lit(0)) <= 0, F.lit(empty)).otherwise(part.cast("double") / whole.cast("double"))


def ratio_true(c: Column, empty: float = 1.0) -> Column:
    """Share of true among the rows in which ``c`` is not null."""
    return ratio(F.coalesce(F.sum(c.cast("bigint")), F.lit(0)), F.count(c), empty)
