"""From enriched blocks to rows of the 28-column question sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.functions.branching import canonical

# The sheet's headers in column order (spelling and spaces as in the template), with the row's field and default.
COLUMNS = (
    ("Section", "section", None),
    ("Alert\n(Yes / No)", "alert", "No"),
    ("Alternate Text \n(Yes / No)", "alternate_text", "No"),
    ("Auto Populated\n(Yes / No)", "auto_populated", "No"),
    ("History\n(Yes / No)", "history", "No"),
    ("Pre Populate\n(Yes / No)  ", "pre_populate", "No"),
    ("Required\n(Yes / No)  ", "required", "Yes"),
    ("Speech to Text\n(Yes / No)", "speech_to_text", "No"),
    ("Submission History\n(Yes / No)", "submission_history", "No"),
    ("Concept Code\n(for Migration use only)", "concept_code", None),
    ("Sequence", "sequence", None),
    ("Question Rule", "question_rule", None),
    ("QuestionType", "question_type", None),
    ("Question Text", "question_text", None),
    ("Branching Logic", "branching_logic", None),
    ("Answer Text", "answer_text", None),
    ("Answer Validation", "answer_validation", None),
    ("Answer Score Value", "answer_score_value", None),
    ("Talking Points", "talking_points", None),
    ("Auto Populate with:", "auto_populate_with", None),
    ("Auto Populate Field:", "auto_populate_field", None),
    ("Auto Poulate Rule:", "auto_populate_rule", None),
    ("Alternate Question Text", "alternate_question_text", None),
    ("Alternate Answer Text", "alternate_answer_text", None),
    ("Alert Type", "alert_type", None),
    ("Alert Text", "alert_text", None),
    ("Token ID\n(PDF Generation)", "token_id", None),
    ("IT Notes ", "it_notes", None),
)
NO_ROW = ("section_header", "page_header", "page_footer", "unknown")
TEXT_RULE, DATE_RULE, SIGNATURE_RULE = "default characters = 100", "Format is mm/dd/yyyy", "signature"
AUTO_POPULATED = r"(?i)\b(name|ssn|dob|date of birth|social security)\b"


def sequenced(blocks: DataFrame) -> DataFrame:
    """Row-producing blocks with section (the nearest header before) and sequence 1, 2, 3, ... per document."""
    order = Window.partitionBy("fixture_id").orderBy("page", "reading_order", "block_id")
    section = F.last(F.when(F.col("block_type") == "section_header", F.col("text")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("section", section).where(~F.col("block_type").isin(*NO_ROW))
    return rows.withColumn("sequence", F.row_number().over(order))


def children(blocks: DataFrame) -> DataFrame:
    """Per parent: counts of children by type, and option texts joined by ``|`` in reading order."""
    c = blocks.where(F.col("parent_link").isNotNull()).withColumn("parent", F.col("parent_link.parent_block_id"))

    def kind(name: str):
        return F.sum((F.col("block_type") == name).cast("bigint")).alias(f"n_{name}")

    option = F.when(F.col("block_type").isin("checkbox_option", "radio_option"), F.struct("page", "reading_order", F.coalesce("text", F.lit("")).alias("text")))
    options = F.array_join(F.transform(F.sort_array(F.collect_list(option)), lambda o: o["text"]), "|")
    return c.groupBy("fixture_id", "parent").agg(*[kind(k) for k in ("checkbox_option", "radio_option", "text_input", "text_area", "date_input")], options.alias("options"))


def map_rows(blocks: DataFrame, substitute: bool = True) -> DataFrame:
    """fixture_id, block_id and the 28 fields, one row a row-producing block."""
    s = sequenced(blocks)
    k = children(blocks).withColumnRenamed("parent", "block_id")
    r = s.join(k, ["fixture_id", "block_id"], "left").fillna(0, [f"n_{n}" for n in ("checkbox_option", "radio_option", "text_input", "text_area", "date_input")])
    label = F.col("block_type") == "question_label"
    question = (
        F.when(label & (F.col("n_checkbox_option") >= 2), "Checkbox Group").when(label & (F.col("n_checkbox_option") == 1), "Checkbox").when(label & (F.col("n_radio_option") >= 2), "Radio Button")
        .when(label & (F.col("n_date_input") > 0), "Date").when(label & (F.col("n_text_area") > 0), "Text Area").when(label & (F.col("n_text_input") > 0), "Text Box")
        .when(F.col("block_type").isin("signature_field", "text_input"), "Text Box").when(F.col("block_type") == "text_area", "Text Area").when(F.col("block_type") == "date_input", "Date").otherwise("Display")
    )
    r = r.withColumn("question_type", question)
    rule = F.when(F.col("block_type") == "signature_field", SIGNATURE_RULE).when(F.col("question_type") == "Date", DATE_RULE).when(F.col("question_type") == "Text Box", TEXT_RULE)
    auto = F.when(F.coalesce(F.col("text").rlike(AUTO_POPULATED), F.lit(False)), "Yes").otherwise("No")
    options = F.when(F.col("question_type").isin("Checkbox Group", "Radio Button", "Checkbox"), F.col("options"))
    if substitute:
        r = substitute_references(r, s)
    made = {"section": F.col("section"), "auto_populated": auto, "sequence": F.col("sequence"), "question_type": F.col("question_type"), "question_text": F.coalesce("text", F.lit("")), "answer_text": options, "answer_validation": rule}
    made["branching_logic"] = F.col("branching_logic") if "branching_logic" in r.columns else F.lit(None).cast("string")
    fields = [made.get(name, F.lit(default).cast("string")).alias(name) for _, name, default in COLUMNS]
    return r.select("fixture_id", "block_id", *fields)


def substitute_references(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Replace the parent's block id in an expression by ``Q<sequence>``; an expression that then does not parse becomes null."""
    if "parent_link" not in rows.columns or "branching_logic" not in rows.columns:
        return rows
    p = sequences.select("fixture_id", F.col("block_id").alias("_parent"), F.col("sequence").alias("_seq"))
    r = rows.withColumn("_parent", F.col("parent_link.parent_block_id")).join(p, ["fixture_id", "_parent"], "left")
    new = F.when(F.col("_seq").isNull(), F.col("branching_logic")).otherwise(F.replace(F.col("branching_logic"), F.col("_parent"), F.concat(F.lit("Q"), F.col("_seq").cast("string"))))
    r = r.withColumn("branching_logic", new)
    return r.withColumn("branching_logic", F.when(canonical("branching_logic").isNotNull(), F.col("branching_logic"))).drop("_parent", "_seq")


def header_meta(blocks: DataFrame, program: str | None = None) -> DataFrame:
    """Title (the first heading) and program of each document."""
    heading = F.when(F.col("block_type").isin("section_header", "subsection_header", "page_header"), F.struct("page", "reading_order", "text"))
    return blocks.groupBy("fixture_id").agg(F.min(heading)["text"].alias("assessment_title")).withColumn("program", F.lit(program).cast("string"))


def checked(rows: DataFrame, limit: int = 32767) -> DataFrame:
    """The rows; the query fails on a text longer than a spreadsheet cell may be."""
    long = F.greatest(*[F.coalesce(F.char_length(F.col(n).cast("string")), F.lit(0)) for _, n, _ in COLUMNS])
    return rows.where(F.assert_true(long <= limit, F.lit("a cell is longer than 32767 characters")).isNull())
