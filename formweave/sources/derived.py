"""Form-like inputs derived from the test tables by whole-number arithmetic on their keys.

No test table is shaped like a form; these views are, and SQL can state them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.functions.coerce import number_value, text_value
from formweave.schema import BLOCK_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _type(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BLOCK_TYPES)), (F.pmod(index, F.lit(15)) + 1).cast("int"))


def _box(d: Column, shift: Column) -> Column:
    x, y = (d % 37 * 7).cast("double") + shift, (d % 53 * 5).cast("double")
    return F.struct(x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 12).alias("y1"), F.lit("top_left").alias("coord_origin"))


def _link(d: Column, wrong: Column) -> Column:
    relation = F.when(d % 4 == 1, "option_of").when(d % 4 == 2, "input_of").otherwise("row_of")
    return F.when(d % 4 != 0, F.struct(F.concat(F.lit("b"), (d - d % 4 + F.when(wrong, 4).otherwise(0)).cast("string")).alias("parent_block_id"), relation.alias("relation")))


def _blocks(docs: DataFrame, candidate: bool) -> DataFrame:
    d = F.col("doc_id")
    no = F.lit(False)
    quote = F.when(d % 5 == 0, "'").otherwise('"') if candidate else F.lit('"')
    gap = F.when(d % 7 == 0, "  ").otherwise(" ") if candidate else F.lit(" ")
    answer = F.when(d % 11 == 0, "no").otherwise("yes") if candidate else F.lit("yes")
    logic = F.when(d % 3 != 0, F.concat(F.lit("Display if Q"), (d % 9 + 1).cast("string"), gap, F.lit("= "), quote, answer, quote))
    return docs.select(
        F.coalesce("source", F.lit("")).alias("fixture_id"),
        d.alias("pos"),
        F.concat(F.lit("b"), d.cast("string")).alias("block_id"),
        (d % 11 + 1).cast("int").alias("page"),
        d.alias("reading_order"),
        _box(d, F.when(d % 3 == 0, 0.4).otherwise(0.0) if candidate else F.lit(0.0)).alias("bbox"),
        F.col("text"),
        _type(d + F.when(d % 9 == 0, 1).otherwise(0) if candidate else d).alias("block_type"),
        ((5 + d * 37 % 95) / 100.0).alias("confidence"),
        _link(d, d % 8 == 1 if candidate else no).alias("parent_link"),
        logic.alias("branching_logic"),
        F.when(d % 6 != 0, d * 37 % 1009 if candidate else d).alias("sequence"),
        F.lit("rule").alias("provenance"),
    )


def golden_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(table(spark, sf_dir, "documents"), False)


def candidate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th block is missing, boxes and types are off now and then, every 7th block comes again with another type."""
    b = _blocks(table(spark, sf_dir, "documents").where("doc_id % 50 <> 0"), True)
    again = b.where("pos % 7 = 0").withColumn("block_type", _type(F.col("pos") + 2)).withColumn("pos", F.col("pos") + 1_000_000_000)
    return b.unionByName(again)


#: The sheet made from ``part``: its header row, and headers of both sides.
HEADER_ROW = 3
REFERENCE_HEADERS = ("Section", "Sequence", "QuestionType", "Question Text", "Branching Logic", "Alert\n(Yes / No)", "IT Notes ", "Answer Text")
CANDIDATE_HEADERS = ("Section", "Sequence", "QuestionType", "Question Text", "Branching Logic", "Alert (Yes/No)", "IT Notes", "section")


def sheet_cells(spark: SparkSession, sf_dir: str, candidate: bool) -> DataFrame:
    """Cells of three sheets: part k is row k // 3 of sheet k % 3."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    k, i = F.col("k"), F.floor(F.col("k") / 3)
    fixture = F.concat(F.lit("part"), (k % 3).cast("string"))
    p = p.withColumn("i", i)
    if candidate:  # sheet 1 lacks its last row
        last = p.groupBy().agg(F.max(F.when(k % 3 == 1, F.col("i"))).alias("last"))
        p = p.join(F.broadcast(last)).where(~((k % 3 == 1) & (F.col("i") == F.col("last"))))
    c = candidate
    seq = (F.col("i") + 1).cast("string")
    logic = F.when(k % 2 == 0, F.concat(F.lit("Display if Q"), (k % 9 + 1).cast("string"), F.lit(' = "yes"')))
    values = [
        text_value(F.when(k % 10 == 0, F.concat("p_type", F.lit(" x"))).otherwise(F.col("p_type")) if c else F.col("p_type")),
        F.when(k % 4 == 0, text_value(F.concat(seq, F.lit(".0")))).otherwise(number_value(F.col("i") + 1, seq)) if c else number_value(F.col("i") + 1, seq),
        text_value(F.when(k % 5 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")) if c else F.col("p_brand")),
        text_value(F.when(k % 6 == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit("\t"))).otherwise(F.col("p_name")) if c else F.col("p_name")),
        text_value(F.when(k % 8 == 0, "bad").otherwise(logic) if c else logic),
        text_value(F.when(k % 11 == 0, "maybe").when(k % 2 == 0, "Yes").otherwise("No") if c else F.when(k % 2 == 0, "Yes").otherwise("No")),
        text_value(F.when(k % 13 == 0, "note") if c else F.lit(None).cast("string")),
        text_value(F.when(k % 12 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")) if c else F.col("p_type")),
    ]
    cells = p.select(fixture.alias("fixture_id"), (F.col("i") + HEADER_ROW + 1).cast("int").alias("row"), F.posexplode(F.array(*values)).alias("j", "value"))
    return cells.where(F.col("value.kind").isNotNull()).select("fixture_id", "row", (F.col("j") + 1).cast("int").alias("col"), "value")


def sheets(spark: SparkSession, sf_dir: str, candidate: bool) -> DataFrame:
    k = F.col("p_partkey")
    ends = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("part"), (k % 3).cast("string")).alias("fixture_id")).agg((F.max(F.floor(k / 3)) + HEADER_ROW + 1).cast("int").alias("data_end_row"))
    if candidate:
        ends = ends.withColumn("data_end_row", F.col("data_end_row") - F.when(F.col("fixture_id") == "part1", 1).otherwise(0))
    headers = F.array(*map(F.lit, CANDIDATE_HEADERS if candidate else REFERENCE_HEADERS))
    merged = F.array(F.lit("A1:B1"), F.lit("C1:D1")) if not candidate else F.when(F.col("fixture_id") == "part2", F.array(F.lit("A1:B1"))).otherwise(F.array(F.lit("C1:D1"), F.lit("A1:B1")))
    names = F.array(F.lit("Values"), F.lit("Assessment"))
    return ends.select("fixture_id", F.lit(HEADER_ROW).alias("header_row"), headers.alias("headers"), F.lit(HEADER_ROW + 1).alias("data_start_row"), "data_end_row", merged.alias("merged_ranges"), F.lit("A4").alias("frozen_panes"), F.array(F.lit("C4:C99")).alias("data_validations"), F.array(F.lit("Types")).alias("named_ranges"), names.alias("sheet_names"))


def vocabulary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column C of the value sheets: a header, brands in two spellings, a blank; brand 5x is missing."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    brands = p.where("p_brand not like '%5'").select(F.concat(F.lit("part"), (k % 3).cast("string")).alias("fixture_id"), (k + 1).cast("int").alias("row"), F.when(k % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("value"))
    heads = brands.select("fixture_id").distinct().select("fixture_id", F.lit(1).alias("row"), F.lit("QuestionType").alias("value"))
    return brands.unionByName(heads)


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records from ``events``: views and clicks are blocks, clicks routed, purchases model calls with a cost."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    key = F.get_json_object("props", "$.k").try_cast("bigint")
    call = kind == "purchase"
    return e.select("event_id", "ts", "user_id", F.when(call, F.col("value").cast("decimal(12,2)")).alias("cost_usd"), (call & (key % 2 == 0)).alias("cache_hit"), call.alias("llm_call"), (kind == "click").alias("routed"), kind.isin("view", "click").alias("block"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn and the next of a conversation, whole; made pairs (equal, empty, option lists) are rows added to them."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    r = c.join(nxt, ["conv_id", "turn"]).select(F.concat(F.lit("f"), (F.col("conv_id") % 7).cast("string")).alias("fixture_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("text").alias("a"), F.col("after").alias("b"))
    k = F.col("k")

    def pair(candidate: Column, reference: Column, box: bool) -> Column:
        return F.struct(candidate.alias("candidate"), reference.alias("reference"), F.lit(box).alias("is_checkbox"))

    options = pair(F.concat(F.lit("red | blue|"), (k % 4).cast("string")), F.concat((k % 2).cast("string"), F.lit("|red|blue|")), True)
    rows = F.array(pair(F.col("a"), F.col("b"), False), F.when(k % 4 == 0, pair(F.col("a"), F.col("a"), False)), F.when(k % 5 == 0, pair(F.lit(""), F.lit(""), False)), F.when(k % 3 == 0, options))
    r = r.select("fixture_id", "k", F.posexplode(rows).alias("made", "pair")).where("pair is not null")
    return r.select("fixture_id", (k * 4 + F.col("made")).alias("row_index"), "pair.*")
