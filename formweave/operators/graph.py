"""Checks on the parent links of blocks: dangling parents, orphan inputs, cycles, distant options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.shared import drop_stash, stash

INPUTS = ("text_input", "text_area", "date_input", "checkbox_option", "radio_option")
LABELS = ("question_label", "section_header", "subsection_header")
OPTION_REACH = 5


def edges(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("parent_link").isNotNull()).select("fixture_id", F.col("block_id").alias("child"), F.col("parent_link.parent_block_id").alias("parent"))


def dangling_parents(blocks: DataFrame) -> DataFrame:
    """fixture_id, block_id of blocks whose parent does not exist."""
    e = edges(blocks)
    known = blocks.select("fixture_id", F.col("block_id").alias("parent"))
    return e.join(known, ["fixture_id", "parent"], "left_anti").select("fixture_id", F.col("child").alias("block_id"))


def orphan_inputs(blocks: DataFrame) -> DataFrame:
    """Input blocks without a link to or from another block."""
    e = edges(blocks)
    linked = e.select("fixture_id", F.col("child").alias("block_id")).union(e.select("fixture_id", "parent"))
    return blocks.where(F.col("block_type").isin(*INPUTS)).select("fixture_id", "block_id").join(linked, ["fixture_id", "block_id"], "left_anti")


def cycle_members(blocks: DataFrame) -> DataFrame:
    """Blocks on a cycle of parent links, of any length (the least parent counts where a block has several).

    Pointer doubling: after k rounds each block is paired with the one 2^k links above it, and blocks whose chain
    ends are gone.  What is reached shrinks from round to round; once it does not, following the links permutes it,
    so all of it lies on cycles, and each cycle is in it, as it comes around.  Each round is written to the shared
    folder."""
    e = edges(blocks).groupBy("fixture_id", F.col("child").alias("a")).agg(F.min("parent").alias("b"))
    known = blocks.select("fixture_id", F.col("block_id").alias("b"))
    reach, before = stash(e.join(known, ["fixture_id", "b"], "left_semi").select("fixture_id", "a", "b"), "links"), -1
    while True:
        reached = reach.select("fixture_id", F.col("b").alias("block_id")).distinct()
        now = reached.count()
        if now in (0, before):
            return reached
        above = reach.select("fixture_id", F.col("a").alias("b"), F.col("b").alias("c"))
        last, reach, before = reach, stash(reach.join(above, ["fixture_id", "b"]).select("fixture_id", "a", F.col("c").alias("b")), "links"), now
        drop_stash(last)


def distant_options(blocks: DataFrame) -> DataFrame:
    """Options whose nearest preceding label or header is over five positions before, or missing."""
    before = Window.partitionBy("fixture_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    label = F.last(F.when(F.col("block_type").isin(*LABELS), F.col("pos")), True).over(before)
    o = blocks.withColumn("label_pos", label).where(F.col("block_type").isin("checkbox_option", "radio_option"))
    return o.where(F.coalesce(F.col("pos") - F.col("label_pos") > OPTION_REACH, F.lit(True))).select("fixture_id", "block_id")


def anomalies(blocks: DataFrame) -> DataFrame:
    """fixture_id, block_id, sorted anomaly names."""
    found = dangling_parents(blocks).withColumn("name", F.lit("dangling_parent"))
    for name, rows in (("orphan_input", orphan_inputs(blocks)), ("cycle", cycle_members(blocks)), ("distant_option", distant_options(blocks))):
        found = found.union(rows.withColumn("name", F.lit(name)))
    return found.groupBy("fixture_id", "block_id").agg(F.array_sort(F.collect_set("name")).alias("anomalies"))


def neighbours(blocks: DataFrame, reach: int = 3) -> DataFrame:
    """Each block with the ids of the blocks up to ``reach`` positions before and after."""
    w = Window.partitionBy("fixture_id").orderBy("pos")
    return blocks.withColumn("before", F.collect_list("block_id").over(w.rowsBetween(-reach, -1))).withColumn("after", F.collect_list("block_id").over(w.rowsBetween(1, reach)))


def page_neighbours(blocks: DataFrame, distance: float) -> DataFrame:
    """Pairs of blocks of a page whose boxes' corners lie within ``distance`` vertically, found by bands of that height."""
    b = blocks.select("fixture_id", "page", "block_id", F.col("bbox.y0").alias("y"))
    b = b.withColumn("band", F.floor(F.col("y") / distance))
    near = b.select("fixture_id", "page", F.col("block_id").alias("other"), F.col("y").alias("oy"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    return b.join(near, ["fixture_id", "page", "band"]).where((F.col("block_id") != F.col("other")) & (F.abs(F.col("y") - F.col("oy")) <= distance)).select("fixture_id", "page", "block_id", "other")
