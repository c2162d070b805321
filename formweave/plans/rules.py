"""Rule-based classification: each rule is a predicate with a confidence; the best one names the block.

Input: fixture_id, pos, page, text, raw_kind, font_size, bold, y0, y1 (missing columns are
taken as null).  A rule_id is always set; ``none`` with confidence 0 is routed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.functions.text import combine_confidences

#: Smallest confidence that the combination may give, and the longest text of an option, the shortest of a paragraph.
OPTION_CHARS, PARAGRAPH_CHARS, REPEATED_PAGES, STACKED = 80, 160, 3, 3
#: Underscore runs are alike if the shorter has this share of the longer; a run inside an option has at most INLINE_RUN.
ALIKE, INLINE_RUN = 0.75, 40
#: A subsection's font has at least this share of the document's median.
BAND = 0.75
#: Multipliers on a type's combined score where something speaks against it: a header that opens a long body block,
#: and a bold header whose font is no larger than the body's.
OPENS_BODY, BODY_SIZED = 0.9, 0.8
#: Band of a page's height that is its foot, as (y from, page height).
FOOT, PAGE_HEIGHT = 720.0, 792.0
_OPTIONAL = {"raw_kind": "string", "font_size": "double", "bold": "boolean", "y0": "double", "y1": "double"}


def with_context(blocks: DataFrame) -> DataFrame:
    """Neighbour, page and document features that the rules read."""
    for name, kind in _OPTIONAL.items():
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    b = blocks.withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    order = Window.partitionBy("fixture_id").orderBy("page", "pos")
    runs = F.col("t").rlike("_{2,}$")
    line = F.regexp_extract("t", "(_+)$", 1)
    b = b.withColumns({"is_input": runs | F.coalesce(F.col("raw_kind") == "form_field", F.lit(False)), "run": F.char_length(line), "only_run": F.col("t").rlike("^_{3,}$")})
    b = b.withColumns({"next_input": F.lead("is_input").over(order), "next_text": F.lead("t").over(order), "before_kind": F.lag("raw_kind").over(order), "next_run": F.lead("run").over(order), "last_run": F.lag(F.when(F.col("only_run"), F.col("run"))).over(order)})
    # a block beside another on its page is not isolated
    beside = F.lit(False)
    for near in (F.lag, F.lead):
        page, y0, y1 = (near(c).over(order) for c in ("page", "y0", "y1"))
        beside = beside | F.coalesce((page == F.col("page")) & (y0 < F.col("y1")) & (y1 > F.col("y0")), F.lit(False))
    # stacked underscore runs: islands of consecutive run-only blocks of similar length
    alike = F.col("last_run").isNotNull() & (F.least("run", "last_run") >= ALIKE * F.greatest("run", "last_run"))
    starts = (~(F.col("only_run") & F.coalesce(alike, F.lit(False)))).cast("int")
    b = b.withColumns({"isolated": ~beside, "island": F.sum(starts).over(order)})
    b = b.withColumn("stacked", F.when(F.col("only_run"), F.count("*").over(Window.partitionBy("fixture_id", "island"))).otherwise(0)).drop("island")
    median = blocks.groupBy("fixture_id").agg(F.percentile("font_size", 0.5).alias("median_size"))
    pages = b.where("t <> ''").groupBy("fixture_id", "t").agg(F.count_distinct("page").alias("pages"))
    return b.join(median, "fixture_id", "left").join(pages, ["fixture_id", "t"], "left").fillna(0, ["pages"])


def _rules() -> list[tuple[str, str, float, Column]]:
    t, size = F.col("t"), F.col("font_size")
    colon, short = t.rlike(":$"), F.char_length("t") <= OPTION_CHARS
    large = F.coalesce(F.col("bold"), F.lit(False)) | F.coalesce(size > F.col("median_size"), F.lit(False))
    kind = F.coalesce("raw_kind", F.lit(""))
    next_input, next_text = F.coalesce("next_input", F.lit(False)), F.col("next_text")
    return [
        ("section_header", "section_header", 0.80, large & colon & F.col("isolated") & next_text.isNotNull() & ~next_input),
        ("subsection_header", "subsection_header", 0.65, colon & ~large & t.rlike(r"\(.*\)") & ~next_input & F.coalesce(size >= BAND * F.col("median_size"), F.lit(True))),
        ("question_label", "question_label", 0.80, colon & next_input),
        ("checkbox_glyph", "checkbox_option", 0.90, t.rlike("^[☐◻]") & short),
        ("checkbox_neighbour", "checkbox_option", 0.70, F.coalesce(F.col("before_kind") == "checkbox", F.lit(False)) & short),
        ("radio_glyph", "radio_option", 0.90, t.rlike("^[○◯]") & short),
        ("text_input", "text_input", 0.75, t.rlike("_+$") & ~t.rlike("(?i)signature") | (kind == "form_field")),
        ("text_area", "text_area", 0.85, F.col("stacked") >= STACKED),
        ("date_input", "date_input", 0.85, t.rlike(r"(?i)\b(date|dob|mm/dd/yyyy)\b") & (F.col("is_input") | next_input)),
        ("display", "display", 0.70, (F.char_length("t") > PARAGRAPH_CHARS) & ~next_input),
        ("signature_field", "signature_field", 0.85, t.rlike(r"(?i)\bsignature\b") & (F.col("is_input") | next_input) | (kind == "signature_cell")),
        ("table_header", "table_header", 0.90, kind == "table_header"),
        ("table_cell", "table_cell", 0.90, kind == "table_cell"),
        ("page_header", "page_header", 0.90, (kind == "page_header") | (F.col("pages") >= REPEATED_PAGES)),
        ("page_footer", "page_footer", 0.85, (kind == "page_footer") | F.coalesce((F.col("y0") >= FOOT) & short, F.lit(False))),
    ]


def classify(blocks: DataFrame) -> DataFrame:
    """Adds block_type, confidence, rule_id, notes and runner_up (the best other type's confidence).

    rule_id names the rules that hit and each multiplier that lowered their score, as ``rule+rule*reason=0.80``."""
    b = with_context(blocks)
    # what speaks against a header, and its multiplier
    opens = F.coalesce(F.char_length("next_text") > PARAGRAPH_CHARS, F.lit(False))
    plain = F.coalesce(F.col("bold") & (F.col("font_size") <= F.col("median_size")), F.lit(False))
    against = {"opens_body": F.when(opens, OPENS_BODY).otherwise(1.0), "body_sized": F.when(plain, BODY_SIZED).otherwise(1.0)}
    held = {"section_header": ("opens_body", "body_sized"), "subsection_header": ("opens_body",)}
    hits = []
    for place, (rule, block_type, confidence, predicate) in enumerate(_rules()):
        hits.append(F.when(F.coalesce(predicate, F.lit(False)), F.struct(F.lit(block_type).alias("type"), F.lit(confidence).alias("c"), F.lit(rule).alias("rule"), F.lit(-place).alias("priority"))))
    b = b.withColumn("hits", F.array_compact(F.array(*hits)))
    # rules of one type support each other; types compete, the earlier rule wins a tie
    types = F.array_distinct(F.transform("hits", lambda h: h["type"]))

    def of_type(name: Column) -> Column:
        own = F.filter("hits", lambda h: h["type"] == name)
        factor, marks = F.lit(1.0), F.lit("")
        for header, reasons in held.items():
            for reason in reasons:
                f = F.when(name == header, against[reason]).otherwise(1.0)
                factor, marks = factor * f, F.concat(marks, F.when(f < 1, F.concat(F.lit(f"*{reason}="), F.format_number(f, 2))).otherwise(""))
        score = combine_confidences(F.transform(own, lambda h: h["c"])) * factor
        rule = F.concat(F.array_join(F.transform(own, lambda h: h["rule"]), "+"), marks)
        return F.struct(score.alias("c"), F.array_max(F.transform(own, lambda h: h["priority"])).alias("priority"), name.alias("type"), rule.alias("rule"))

    b = b.withColumn("ranked", F.sort_array(F.transform(types, of_type), asc=False))
    best, second = F.try_element_at("ranked", F.lit(1)), F.try_element_at("ranked", F.lit(2))
    out = b.withColumns({"block_type": F.coalesce(best["type"], F.lit("unknown")), "confidence": F.coalesce(best["c"], F.lit(0.0)), "rule_id": F.coalesce(best["rule"], F.lit("none")), "runner_up": second["c"], "notes": F.transform("ranked", lambda r: F.concat(r["type"], F.lit("="), F.format_number(r["c"], 2)))})
    return out.select(*blocks.columns, "block_type", "confidence", "rule_id", "runner_up", "notes")


def link_parents(blocks: DataFrame) -> DataFrame:
    """Post-pass over whole documents: options and inputs link to the nearest preceding label, labels to the section before them.

    An underscore run beside the option right before it, on the same line, is that option's input."""
    for name in ("y0", "y1"):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast("double"))
    order = Window.partitionBy("fixture_id").orderBy("page", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    label = F.last(F.when(F.col("block_type") == "question_label", F.col("block_id")), True).over(before)
    section = F.last(F.when(F.col("block_type") == "section_header", F.col("block_id")), True).over(before)
    last = F.lag(F.struct("block_id", "block_type", "page", "y0", "y1")).over(order)
    option = F.col("block_type").isin(*OPTIONS)
    entry = F.col("block_type").isin("text_input", "text_area", "date_input", "signature_field")
    beside = (last["page"] == F.col("page")) & (last["y0"] < F.col("y1")) & (last["y1"] > F.col("y0"))
    inline = (F.col("block_type") == "text_input") & F.trim("text").rlike(f"^_{{2,{INLINE_RUN}}}$") & last["block_type"].isin(*OPTIONS) & beside

    def link(parent: Column, relation: str) -> Column:
        return F.struct(parent.alias("parent_block_id"), F.lit(relation).alias("relation"))

    found = F.when(inline, link(last["block_id"], "input_of")).when(option & label.isNotNull(), link(label, "option_of"))
    found = found.when(entry & label.isNotNull(), link(label, "input_of"))
    return blocks.withColumn("parent_link", found.when((F.col("block_type") == "question_label") & section.isNotNull(), link(section, "child_of_section")))


OPTIONS = ("checkbox_option", "radio_option")


def with_inline_inputs(blocks: DataFrame) -> DataFrame:
    """Classified and linked blocks, and a text_input after each option whose text ends in a short underscore run.

    The input has the option's place, the run as text and ``<option>-input`` as id, and links to the option as its
    ``input_of``.  The option keeps its text; a number in front of it stays part of the label."""
    run = F.regexp_extract(F.trim("text"), f"[^_](_{{2,{INLINE_RUN}}})$", 1)
    made = blocks.where(F.col("block_type").isin(*OPTIONS)).withColumn("made", run).where("made <> ''")
    link = F.struct(F.col("block_id").alias("parent_block_id"), F.lit("input_of").alias("relation"))
    made = made.withColumns({"parent_link": link, "text": F.col("made"), "block_id": F.concat("block_id", F.lit("-input")), "block_type": F.lit("text_input"), "confidence": F.lit(0.75), "rule_id": F.lit("inline_input"), "runner_up": F.lit(None).cast("double"), "notes": F.array(F.lit("text_input=0.75"))})
    return blocks.unionByName(made.drop("made"))
