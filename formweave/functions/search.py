"""Places of values among ascending cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_at_most(cuts: Column, value: Column, steps: int = 31) -> Column:
    """How many of the ascending cuts are at most the value, by binary search (0 for null or no cuts)."""

    def halved(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        right = F.coalesce(F.get(cuts, middle) <= value, F.lit(False))
        return F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"), F.when(right, at["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.coalesce(F.size(cuts), F.lit(0)).alias("high")), halved)["low"]


def part_of(cuts: Column, value: Column) -> Column:
    """The value's part: odd for a cut itself, even between cuts; 0 without cuts."""
    k = count_at_most(F.coalesce(cuts, F.array().cast("array<double>")), value)
    return (2 * k - F.coalesce((F.get(cuts, k - 1) == value).cast("int"), F.lit(0))).cast("int")
