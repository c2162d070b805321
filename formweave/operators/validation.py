"""Checks of the enriched contract: one row per violation, and a step that fails on any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave import schema
from formweave.functions.branching import canonical
from formweave.functions.text import normalize_case_insensitive


def violations(blocks: DataFrame, vocab: DataFrame | None = None, parse: bool = True) -> DataFrame:
    """fixture_id, block_id, rule.  ``vocab`` has (fixture_id, key); ``parse`` runs the expression parser."""
    c = F.col
    rules = {
        "page": c("page").isNull() | (c("page") < 1),
        "confidence": c("confidence").isNull() | ~c("confidence").between(schema.LEAST_CONFIDENCE, schema.MOST_CONFIDENCE),
        "block_type": ~F.coalesce(c("block_type").isin(*schema.BLOCK_TYPES), F.lit(False)),
        "relation": c("parent_link").isNotNull() & ~F.coalesce(c("parent_link.relation").isin(*schema.RELATIONS), F.lit(False)),
        "provenance": ~F.coalesce(c("provenance").isin(*schema.SOURCES), F.lit(False)),
    }
    if parse:
        rules["branching_syntax"] = c("branching_logic").isNotNull() & canonical("branching_logic").isNull()
    named = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    found = blocks.select("fixture_id", "block_id", F.explode(named).alias("rule"))
    links = blocks.where(c("parent_link").isNotNull()).select("fixture_id", "block_id", c("parent_link.parent_block_id").alias("parent"), "branching_logic")
    parents = blocks.select("fixture_id", c("block_id").alias("parent"), c("sequence").alias("parent_sequence"))
    missing = links.join(parents, ["fixture_id", "parent"], "left_anti").select("fixture_id", "block_id", F.lit("parent_missing").alias("rule"))
    unordered = links.where(c("branching_logic").isNotNull()).join(parents, ["fixture_id", "parent"]).where(c("parent_sequence").isNull()).select("fixture_id", "block_id", F.lit("parent_without_sequence").alias("rule"))
    found = found.unionByName(missing).unionByName(unordered)
    if vocab is not None:
        typed = blocks.where(c("question_type").isNotNull()).select("fixture_id", "block_id", normalize_case_insensitive("question_type").alias("key"))
        found = found.unionByName(typed.join(vocab.select("fixture_id", "key"), ["fixture_id", "key"], "left_anti").select("fixture_id", "block_id", F.lit("question_type").alias("rule")))
    return found


def sequence_gaps(blocks: DataFrame) -> DataFrame:
    """Documents whose sequence numbers are not just 1..n."""
    s = blocks.where(F.col("sequence").isNotNull()).groupBy("fixture_id").agg(F.count("*").alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count_distinct("sequence").alias("kinds"))
    return s.where(~((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("kinds") == F.col("n")))).select("fixture_id", F.lit("sequence").alias("rule"))


def unknown_keys(json_text: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows of JSON objects with keys that the contract does not know."""
    extra = F.array_except(F.json_object_keys(column), F.array(*map(F.lit, allowed)))
    return json_text.withColumn("unknown_keys", extra).where(F.size("unknown_keys") > 0)


def enforce(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks; the query fails if any document has a violation."""
    bad = found.groupBy("fixture_id").agg(F.count("*").alias("bad"))
    ok = F.assert_true(F.coalesce("bad", F.lit(0)) == 0, F.concat(F.lit("contract violations in "), F.col("fixture_id")))
    return blocks.join(bad, "fixture_id", "left").where(ok.isNull()).drop("bad")
