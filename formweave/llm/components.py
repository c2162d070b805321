"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a min-aggregate and a join; between rounds the edges are written
to the shared folder.  Stops when a round changes nothing: then each node points
at the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.common import drop_stash, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b bigint): component is its smallest reachable node."""
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = stash(edges.where("a <> b").select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state = None
    while True:
        count = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(count) == state or not count[0]:
            break
        state = tuple(count)
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = both.join(low, "x").where("y > x and y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        before, now = now, stash(small, "edges")
        drop_stash(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
