"""Block-level comparison of enriched documents (evaluation A).

Blocks are rows with a fixture (the document they belong to) and a position.
A block's identity is its page, its box in buckets of two points and its text's
digest.  Matching keeps the last candidate block of each identity; each golden
block is looked up there.  All joins are equi-joins on fixture and identity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.functions.text import bbox_key, canonical_quotes, text_sha
from formweave.functions.search import part_of
from formweave.operators.ratios import ratio, ratio_true
from formweave.shared import stash

KEY = ["fixture_id", "page", "k0", "k1", "k2", "k3", "sha"]
_KEPT = ["block_id", "block_type", "confidence", "reading_order", "sequence", "branching_logic"]


def explode_documents(documents: DataFrame, fixture: str = "fixture_id") -> DataFrame:
    """One row per block with its position; documents without blocks give none."""
    return documents.select(F.col(fixture).alias("fixture_id"), F.posexplode("blocks").alias("pos", "b")).select("fixture_id", "pos", "b.*")


def with_identity(blocks: DataFrame) -> DataFrame:
    box = bbox_key(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1"), F.col("bbox.y1"))
    return blocks.select("fixture_id", "pos", "page", *[k.alias(f"k{i}") for i, k in enumerate(box)], text_sha("text").alias("sha"), *[c for c in _KEPT if c in blocks.columns])


def match_blocks(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """Golden blocks with the candidate block of the same identity, as ``c`` (null if there is none)."""
    g, c = with_identity(golden), with_identity(candidate)
    kept = [x for x in _KEPT if x in candidate.columns]
    last = c.groupBy(*KEY).agg(F.max_by(F.struct(*kept), "pos").alias("c"))
    return g.join(last, KEY, "left")


def match_counts(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """golden_blocks, matched, candidate_keys, block_coverage and type_accuracy of each fixture."""
    m = match_blocks(golden, candidate)
    same = F.when(F.col("c").isNotNull(), F.col("c.block_type") == F.col("block_type"))
    out = m.groupBy("fixture_id").agg(F.count("*").alias("golden_blocks"), F.count("c").alias("matched"), ratio(F.count("c"), F.count("*"), 1.0).alias("block_coverage"), ratio_true(same).alias("type_accuracy"))
    keys = with_identity(candidate).select(*KEY).distinct().groupBy("fixture_id").agg(F.count("*").alias("candidate_keys"))
    both = out.join(keys, "fixture_id", "full")
    zero = F.lit(0).cast("bigint")
    return both.select("fixture_id", *[F.coalesce(x, zero).alias(x) for x in ("golden_blocks", "matched", "candidate_keys")], *[F.coalesce(x, F.lit(1.0)).alias(x) for x in ("block_coverage", "type_accuracy")])


def type_accuracy_per_type(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """By fixture and golden type: matched blocks, right ones, accuracy."""
    m = match_blocks(golden, candidate).where(F.col("c").isNotNull())
    same = F.col("c.block_type") == F.col("block_type")
    return m.groupBy("fixture_id", "block_type").agg(F.count("*").alias("matched"), F.sum(same.cast("bigint")).alias("correct"), ratio_true(same).alias("accuracy"))


def link_triples(blocks: DataFrame) -> DataFrame:
    """Distinct (child, parent, relation) by raw block ids."""
    return blocks.where(F.col("parent_link").isNotNull()).select("fixture_id", F.col("block_id").alias("child"), "parent_link.parent_block_id", "parent_link.relation").distinct()


def parent_link_f1(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """tp, fp, fn, f1, precision, recall of each fixture; all 1 where neither side has links."""
    keys = ["fixture_id", "child", "parent_block_id", "relation"]
    both = link_triples(golden).withColumn("g", F.lit(1)).join(link_triples(candidate).withColumn("c", F.lit(1)), keys, "full")
    fixtures = golden.select("fixture_id").union(candidate.select("fixture_id")).distinct()
    hit = F.col("g").isNotNull() & F.col("c").isNotNull()
    counts = both.groupBy("fixture_id").agg(F.sum(hit.cast("bigint")).alias("tp"), F.sum(F.col("g").isNull().cast("bigint")).alias("fp"), F.sum(F.col("c").isNull().cast("bigint")).alias("fn"))
    counts = fixtures.join(counts, "fixture_id", "left").fillna(0, ["tp", "fp", "fn"])
    none = (F.col("tp") + F.col("fp") + F.col("fn")) == 0

    def share(whole):
        return F.when(none, 1.0).otherwise(ratio(F.col("tp"), whole, 0.0))

    return counts.select("*", share(F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp") + F.col("fn")).alias("recall"), F.when(none, 1.0).otherwise(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0)).alias("f1"))


def branching_exact_match(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """Matched blocks whose golden expression is set: share equal after normalising quotes and space."""
    m = match_blocks(golden, candidate)
    same = F.coalesce(canonical_quotes("branching_logic") == canonical_quotes(F.col("c.branching_logic")), F.lit(False))
    asked = F.when(F.col("c").isNotNull() & F.col("branching_logic").isNotNull(), same)
    return m.groupBy("fixture_id").agg(F.count(asked).alias("asked"), F.coalesce(F.sum(asked.cast("bigint")), F.lit(0)).alias("equal"), ratio_true(asked).alias("branching_exact_match"))


def concordance(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Concordant and discordant pairs, ties in either left out, in O(n log^2 n)."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]

    def ties(*cols: np.ndarray) -> int:
        _, k = np.unique(np.stack(cols), axis=1, return_counts=True)
        return int((k * (k - 1) // 2).sum())

    inversions, width, part = 0, 1, y.copy()
    while width < n:
        for a in range(0, n - width, 2 * width):
            left, right = part[a : a + width], part[a + width : a + 2 * width]
            inversions += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            part[a : a + 2 * width] = np.sort(part[a : a + 2 * width], kind="stable")
        width *= 2
    total = n * (n - 1) // 2
    return total - ties(x) - ties(y) + ties(x, y) - inversions, inversions


#: Rows of a fixture up to which its pairs are counted in one task; larger ones are cut.
TAU_ROWS = 1 << 16


def _inversions_of_cells(table: pa.Table) -> pa.Table:
    """Pairs of rows in cells (ix, iy) of which one is before in ix and behind in iy, from the cells' counts."""
    ix, iy = (np.unique(table[c].to_numpy(), return_inverse=True)[1] for c in ("ix", "iy"))
    cells = np.zeros((ix.max() + 1, iy.max() + 1), np.int64)
    cells[ix, iy] = table["n"].to_numpy()
    found, later = 0, np.zeros(cells.shape[1], np.int64)
    for row in cells[::-1]:
        found += int(row[1:] @ np.cumsum(later)[:-1])
        later += row
    return pa.table({"fixture_id": table["fixture_id"][:1], "discordant": [found]}, _DISCORDANT)


_DISCORDANT = pa.schema([("fixture_id", pa.string()), ("discordant", pa.int64())])


def discordant_pairs(rows: DataFrame) -> DataFrame:
    """(fixture_id, discordant) from (fixture_id, x, y): pairs in order in one of x and y and out of order in the other.

    Fixtures of more than ``TAU_ROWS`` rows are cut at quantiles of x and of y; a cut value is a part of its own, so
    equal values fill no task.  Pairs of one part of x are counted in a task, so are pairs of one part of y from
    different parts of x, and all others follow from the numbers of rows by (part of x, part of y)."""

    def counted(x: str, y: str):
        def count(table: pa.Table) -> pa.Table:
            _, d = concordance(table[x].to_numpy(), table[y].to_numpy())
            return pa.table({"fixture_id": table["fixture_id"][:1], "discordant": [d]}, _DISCORDANT)

        return count

    schema = "fixture_id string, discordant bigint"
    most = rows.groupBy("fixture_id").count().agg(F.max("count")).first()[0] or 0
    if most <= TAU_ROWS:
        return rows.groupBy("fixture_id").applyInArrow(counted("x", "y"), schema)
    part = max(TAU_ROWS, 64 * math.isqrt(most)) if TAU_ROWS >= 1 << 16 else TAU_ROWS
    parts = -(-most // part)
    at = [i / parts for i in range(1, parts)] or [0.5]
    cuts = rows.groupBy("fixture_id").agg(F.count("*").alias("n"), *[F.array_sort(F.array_distinct(F.percentile_approx(c, at, 10 * parts))).alias(f"cuts_{c}") for c in ("x", "y")])
    # at most one cut for 4,096 rows of the table, since parts grow with the largest fixture
    cut = rows.join(F.broadcast(cuts.where(F.col("n") > TAU_ROWS).drop("n")), "fixture_id", "left")
    cut = cut.select("fixture_id", "x", "y", part_of(F.col("cuts_x"), F.col("x")).alias("ix"), part_of(F.col("cuts_y"), F.col("y")).alias("iy"))
    cut = stash(cut, "tau")
    found = cut.where("ix % 2 = 0").groupBy("fixture_id", "ix").applyInArrow(counted("x", "y"), schema)
    found = found.unionByName(cut.where("iy % 2 = 0").groupBy("fixture_id", "iy").applyInArrow(counted("ix", "y"), schema))
    cells = cut.groupBy("fixture_id", "ix", "iy").agg(F.count("*").alias("n"))
    found = found.unionByName(cells.groupBy("fixture_id").applyInArrow(_inversions_of_cells, schema))
    return found.groupBy("fixture_id").agg(F.sum("discordant").alias("discordant"))


def kendall_tau(pairs: DataFrame) -> DataFrame:
    """From (fixture_id, x, y): concordant, discordant and tau of each fixture, 1.0 without comparable pairs.

    Pairs of blocks are counted, not made; ties in x or y are neither."""
    rows = pairs.select(F.col("fixture_id").cast("string").alias("fixture_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def ties(*cols: str) -> DataFrame:
        k = rows.groupBy("fixture_id", *cols).agg(F.count("*").alias("k"))
        return k.groupBy("fixture_id").agg(F.sum(F.expr("k * (k - 1) div 2")).alias("_".join(("ties", *cols))))

    out = discordant_pairs(rows).join(ties(), "fixture_id").join(ties("x"), "fixture_id").join(ties("y"), "fixture_id").join(ties("x", "y"), "fixture_id")
    out = out.select("fixture_id", (F.col("ties") - F.col("ties_x") - F.col("ties_y") + F.col("ties_x_y") - F.col("discordant")).alias("concordant"), "discordant")
    return out.withColumn("tau", ratio(F.col("concordant") - F.col("discordant"), F.col("concordant") + F.col("discordant"), 1.0))


def reading_order_tau(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    m = match_blocks(golden, candidate).where(F.col("c").isNotNull())
    return kendall_tau(m.select("fixture_id", F.col("reading_order").alias("x"), F.col("c.reading_order").alias("y")))


def sequence_correctness(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    m = match_blocks(golden, candidate).where(F.col("sequence").isNotNull() & F.col("c.sequence").isNotNull())
    return kendall_tau(m.select("fixture_id", F.col("sequence").alias("x"), F.col("c.sequence").alias("y")))


#: Lower bounds of the calibration bins; the last bin takes 1 too.
BINS = (0.0, 0.2, 0.4, 0.6, 0.8)


def confidence_calibration(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """By fixture and bin of the candidate's confidence: blocks, and share of right types; empty bins are left out."""
    m = match_blocks(golden, candidate).where(F.col("c").isNotNull())
    c = F.col("c.confidence")
    name = F.when(F.lit(False), F.lit(""))
    for low in BINS:
        high = round(low + 0.2, 1)
        name = name.when((c >= low) & (c < (high if high < 1 else 1 + 1e-9)), F.lit(f"{low:.1f}-{high:.1f}"))
    same = F.col("c.block_type") == F.col("block_type")
    return m.withColumn("bin", name).where(F.col("bin").isNotNull()).groupBy("fixture_id", "bin").agg(F.count("*").alias("blocks"), ratio_true(same).alias("accuracy"))


def evaluate(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """All measures, one row a fixture; maps hold accuracy by type and by confidence bin."""
    by_type = type_accuracy_per_type(golden, candidate).groupBy("fixture_id").agg(F.map_from_entries(F.collect_list(F.struct("block_type", "accuracy"))).alias("type_accuracy_per_type"))
    bins = confidence_calibration(golden, candidate).groupBy("fixture_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "accuracy"))).alias("confidence_calibration"))
    out = match_counts(golden, candidate).join(by_type, "fixture_id", "left").join(bins, "fixture_id", "left")
    out = out.join(parent_link_f1(golden, candidate).select("fixture_id", F.col("f1").alias("parent_link_f1"), F.col("precision").alias("parent_link_precision"), F.col("recall").alias("parent_link_recall")), "fixture_id", "left")
    out = out.join(branching_exact_match(golden, candidate).select("fixture_id", "branching_exact_match"), "fixture_id", "left")
    out = out.join(reading_order_tau(golden, candidate).select("fixture_id", F.col("tau").alias("reading_order_tau")), "fixture_id", "left")
    out = out.join(sequence_correctness(golden, candidate).select("fixture_id", F.col("tau").alias("sequence_correctness")), "fixture_id", "left")
    return out.fillna(1.0, ["branching_exact_match", "reading_order_tau", "sequence_correctness"]).withColumn("status", F.lit("OK"))


def evaluate_documents(golden: DataFrame, candidate: DataFrame, fixture: str = "fixture_id") -> DataFrame:
    """``evaluate`` on documents; a placeholder golden gives status SKIPPED_PLACEHOLDER and null measures."""
    real = golden.where(~F.coalesce(F.col("_placeholder"), F.lit(False)))
    skipped = golden.where(F.coalesce(F.col("_placeholder"), F.lit(False))).select(F.col(fixture).alias("fixture_id"), F.lit("SKIPPED_PLACEHOLDER").alias("status"))
    wanted = candidate.join(real.select(fixture), fixture, "left_semi")
    return evaluate(explode_documents(real, fixture), explode_documents(wanted, fixture)).unionByName(skipped, allowMissingColumns=True)
