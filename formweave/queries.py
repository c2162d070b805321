"""Queries of the library over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.functions import branching, coerce, headers, text
from formweave.operators import blocks, graph, semantic, telemetry, validation, workbooks
from formweave.oracles import SQL
from formweave.plans import gate, mapping, rules
from formweave.sources import derived, xlsx
from formweave.sources.derived import table
from formweave.streaming import telemetry as windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return derived.golden_blocks(spark, sf), derived.candidate_blocks(spark, sf)


def _sheets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reference cells and sheets, candidate cells and sheets."""
    return derived.sheet_cells(spark, sf, False), derived.sheets(spark, sf, False), derived.sheet_cells(spark, sf, True), derived.sheets(spark, sf, True)


@query
def block_match_quality(spark, sf):
    return blocks.match_counts(*_both(spark, sf))


@query
def type_accuracy_per_type(spark, sf):
    return blocks.type_accuracy_per_type(*_both(spark, sf))


@query
def parent_link_f1(spark, sf):
    return blocks.parent_link_f1(*_both(spark, sf))


@query
def branching_exact_match(spark, sf):
    return blocks.branching_exact_match(*_both(spark, sf))


@query
def sequence_tau(spark, sf):
    return blocks.sequence_correctness(*_both(spark, sf))


@query
def confidence_calibration(spark, sf):
    return blocks.confidence_calibration(*_both(spark, sf))


@query
def block_evaluation(spark, sf):
    """All measures; accuracies by type and by bin in millionths, as text."""
    out = blocks.evaluate(*_both(spark, sf))

    def listed(c: str) -> Column:
        parts = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 1e6).cast("string")))
        return F.coalesce(F.array_join(parts, ","), F.lit(""))

    return out.withColumns({c: listed(c) for c in ("type_accuracy_per_type", "confidence_calibration")})


@query
def per_column_accuracy(spark, sf):
    return workbooks.per_column_accuracy(*_sheets(spark, sf), ascii_only=True)


@query
def row_count_delta(spark, sf):
    return workbooks.row_count_delta(derived.sheets(spark, sf, False), derived.sheets(spark, sf, True))


@query
def header_meta(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    at = [F.concat(F.lit("nation"), F.col("n_regionkey").cast("string")).alias("fixture_id"), (k % 2 + 1).cast("int").alias("row"), (F.floor(k / 2) + 1).cast("int").alias("col")]
    ref = n.where(k % 5 != 0).select(*at, coerce.text_value(F.col("n_name")).alias("value"))
    cand = n.where(k % 7 != 0).select(*at, coerce.text_value(F.when(k % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name"))).alias("value"))
    tops = n.select(F.concat(F.lit("nation"), F.col("n_regionkey").cast("string")).alias("fixture_id"), F.lit(3).alias("header_row"), F.array_repeat(F.lit("h"), 10).alias("headers")).distinct()
    return workbooks.header_meta_accuracy(ref, cand, tops, ascii_only=True).drop("cells")


@query
def controlled_vocabulary(spark, sf):
    return workbooks.vocabulary(derived.vocabulary_values(spark, sf), ascii_only=True)


@query
def vocab_validity(spark, sf):
    rc, rs, cc, cs = _sheets(spark, sf)
    return workbooks.vocab_validity(cc, cs, rc, rs, controlled_vocabulary(spark, sf), ascii_only=True)


@query
def yes_no_validity(spark, sf):
    return workbooks.yes_no_validity(derived.sheet_cells(spark, sf, True), derived.sheets(spark, sf, True), ascii_only=True)


@query
def branching_validity(spark, sf):
    return workbooks.branching_validity(derived.sheet_cells(spark, sf, True), derived.sheets(spark, sf, True), ascii_only=True)


@query
def sequence_contiguity(spark, sf):
    return workbooks.contiguous(table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("s")), "l_orderkey")


@query
def sheet_sequence_contiguity(spark, sf):
    return workbooks.sequence_contiguity(derived.sheet_cells(spark, sf, True), derived.sheets(spark, sf, True))


@query
def formatting_checks(spark, sf):
    p = table(spark, sf, "part")

    def side(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("p_brand").alias("fixture_id")).agg(F.collect_list("p_type").alias("merged_ranges"), F.collect_list("p_size").alias("data_validations"), F.lit("A4").alias("frozen_panes"), F.array(F.lit("Values")).alias("named_ranges"), F.array(F.lit("Assessment")).alias("sheet_names"))

    return workbooks.formatting_preservation(side(p), side(p.where("p_partkey % 50 <> 0 or p_brand like '%1'")))


def _distance(spark, sf):
    rc, rs, cc, cs = _sheets(spark, sf)
    cols = workbooks.per_column_accuracy(rc, rs, cc, cs, ascii_only=True)
    checks = vocab_validity(spark, sf).select("fixture_id", "out_of_vocab")
    checks = checks.join(workbooks.sequence_contiguity(cc, cs).select("fixture_id", F.col("contiguous").alias("sequence_contiguity")), "fixture_id")
    checks = checks.join(workbooks.formatting_preservation(rs, cs).select("fixture_id", "formatting_preservation"), "fixture_id")
    return workbooks.distance(cols, checks)


@query
def workbook_distance(spark, sf):
    d = _distance(spark, sf)
    return d.select("fixture_id", *[F.round(c, 9).alias(c) for c in ("base", "penalties", "distance")], "passed")


@query
def e2e_pass_rate(spark, sf):
    return workbooks.e2e_pass_rate(_distance(spark, sf))


@query
def workbook_distance_delta(spark, sf):
    """Against the reference itself, whose distance has only its own out-of-vocabulary penalty."""
    rc, rs, _, _ = _sheets(spark, sf)
    cols = workbooks.per_column_accuracy(rc, rs, rc, rs, ascii_only=True)
    own = workbooks.distance(cols, rs.select("fixture_id", F.lit(0).alias("out_of_vocab"), F.lit(True).alias("sequence_contiguity"), F.lit(True).alias("formatting_preservation")))
    d = workbooks.distance_delta(own, _distance(spark, sf))
    return d.select("fixture_id", *[F.round(c, 9).alias(c) for c in ("before", "after", "workbook_distance_delta")])


@query
def contributions(spark, sf):
    c = workbooks.contributions(workbooks.per_column_accuracy(*_sheets(spark, sf), ascii_only=True))
    return c.withColumn("contribution", F.round("contribution", 9))


@query
def workbook_evaluation(spark, sf):
    rc, rs, cc, cs = _sheets(spark, sf)
    return workbooks.evaluate(rc, rs, cc, cs, controlled_vocabulary(spark, sf), ascii_only=True).drop("per_column")


@query
def header_priorities(spark, sf):
    """Priority, threshold and weight of the headers that brands stand in for."""
    names = [h for group in headers.CLASSES.values() for h in group] + ["other"]
    p = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")).alias("name"))
    raw = F.concat(F.upper("name"), F.lit(" \n(?)"))
    canon = text.canonicalize_header(raw)
    pr = headers.column_priority(canon)
    return p.select("p_partkey", canon.alias("canon"), pr.alias("priority"), headers.priority_threshold(pr).alias("threshold"), headers.priority_weight(pr).alias("weight"))


@query
def cell_values(spark, sf):
    """Numbers and dates read from text, and equality of cells, over order attributes in several spellings."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    number = F.when(k % 4 == 0, F.concat(F.lit(" 1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5"))).when(k % 4 == 1, F.lit("1_000")).when(k % 4 == 2, F.lit("7d")).otherwise(F.lit("1e3"))
    date = F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "MMM d, yyyy")).otherwise(F.date_format(day, "M/d/yyyy"))
    n, d = coerce.number_of_text(number), coerce.date_of_text(date)
    same = coerce.cells_equal(coerce.date_value(day), coerce.text_value(F.when(k % 7 == 0, "2001-02-30").otherwise(date)), True)
    numeric = coerce.cells_equal(coerce.number_value(F.lit(1000.0), F.lit("1000")), coerce.text_value(number), True)
    return o.select("o_orderkey", n.alias("number"), d.cast("string").alias("day"), same.alias("same_day"), numeric.alias("is_thousand"))


@query
def normalized_text(spark, sf):
    """Normalised conversation texts padded with several kinds of space, decomposed accents composed again."""
    c = table(spark, sf, "conversations")
    raw = F.concat(F.lit(" \t"), F.replace(F.coalesce("text", F.lit("")), F.lit("é"), F.lit("é")), F.lit(" \x1f\n"))
    return c.select("conv_id", "turn", F.sha2(text.normalize_string(raw), 256).alias("digest"), text.is_blank(raw).alias("blank"), text.pair_key(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("key"))


def _expressions(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    a, b = (k % 9 + 1).cast("string"), (k % 5 + 1).cast("string")
    one = F.concat(F.lit("Q"), a, F.lit(" = 'yes'"))
    two = F.concat(F.lit("Q"), b, F.lit(' !=  "no"'))
    three = F.concat(F.lit("Q"), b, F.lit(" IN ('b', \"a\", 'b')"))
    made = F.when(k % 4 == 0, F.concat(F.lit("Display if "), one, F.lit(" AND "), two)).when(k % 4 == 1, F.concat(F.lit("display  IF "), two, F.lit(" and "), one)).when(k % 4 == 2, three).otherwise(F.concat(F.lit("Q"), a, F.lit(" = yes")))
    other = F.concat(F.lit("Display if "), two, F.lit(" AND "), F.lit("Q"), a, F.lit(' = "yes"'))
    return o.select("o_orderkey", F.concat(F.lit("f"), (k % 6).cast("string")).alias("fixture_id"), made.alias("candidate"), F.when(k % 8 == 5, F.lit("")).otherwise(other).alias("reference"))


@query
def dsl_canonical(spark, sf):
    return _expressions(spark, sf).select("o_orderkey", branching.canonical("candidate").alias("canonical"), branching.loosely_valid("candidate").alias("loosely_valid"))


@query
def branching_equivalence(spark, sf):
    return semantic.branching_equivalence(_expressions(spark, sf).withColumnRenamed("o_orderkey", "row_index"), ascii_only=True)


def _verdicts(spark, sf) -> DataFrame:
    """Verdicts for what is left open: by the pair's lengths, so that SQL can state them."""
    open_pairs = semantic.residual(derived.text_pairs(spark, sf)).select("candidate", "reference").distinct()
    n = F.char_length("candidate") + F.char_length("reference")
    ascii_of = F.ascii("candidate") + F.ascii("reference") + n
    return open_pairs.select(text.pair_key(F.col("candidate"), F.col("reference")).alias("key"), F.when(ascii_of % 3 == 0, "yes").when(ascii_of % 3 == 1, "no").otherwise("unknown").alias("verdict"))


@query
def text_equivalence(spark, sf):
    return semantic.text_equivalence(derived.text_pairs(spark, sf), _verdicts(spark, sf))


@query
def answer_sets(spark, sf):
    return semantic.answer_equivalence(derived.text_pairs(spark, sf))


@query
def judge_calls(spark, sf):
    """A live judge on executors: asked once per distinct open pair."""
    found = semantic.judge_table(semantic.residual(derived.text_pairs(spark, sf)), lambda a, b: "yes" if a[:1] == b[:1] else "no")
    return found.groupBy("verdict").agg(F.count("*").alias("pairs"))


@query
def uplift(spark, sf):
    pairs = derived.text_pairs(spark, sf)
    exact, judged = semantic.text_equivalence(pairs), semantic.text_equivalence(pairs, _verdicts(spark, sf))
    return semantic.uplift(judged, exact.where("fixture_id <> 'f0'"), "fixture_id").withColumn("uplift", F.round("uplift", 9))


@query
def cost_latency(spark, sf):
    return telemetry.cost_latency(derived.log_records(spark, sf))


@query
def cost_by_user(spark, sf):
    return telemetry.cost_latency(derived.log_records(spark, sf), "user_id")


@query
def cost_tumbling(spark, sf):
    return windows.windowed(derived.log_records(spark, sf), "1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def budget_lock(spark, sf):
    runs = telemetry.cost_latency(derived.log_records(spark, sf), "user_id").withColumnRenamed("user_id", "run")
    return telemetry.budget_lock(runs, "cost_usd").withColumn("budget", F.round("budget", 6))


@query
def run_alerts(spark, sf):
    return telemetry.alerts(telemetry.cost_latency(derived.log_records(spark, sf), "user_id")).select("user_id", F.array_join("alerts", ",").alias("alerts"))


def _staged(spark, sf) -> DataFrame:
    """Blocks of which every 13th has no confidence."""
    return derived.golden_blocks(spark, sf).withColumn("confidence", F.when(F.col("pos") % 13 != 0, F.col("confidence")))


@query
def gate_split(spark, sf):
    g = gate.gate(_staged(spark, sf))
    return g.groupBy("fixture_id", "routed").agg(F.count("*").alias("blocks"), F.min("block_id").alias("first_id"))


@query
def merge_filter(spark, sf):
    g = gate.gate(_staged(spark, sf))
    return gate.merge(g.where("not routed"), g.where("routed"), 0.3).select("fixture_id", "block_id", "branch", "pos", "confidence")


def _linked(spark, sf) -> DataFrame:
    """Blocks with every 40th parent missing, two-cycles among every 100th, and distances as they come."""
    d = F.col("pos")
    parent = F.when(d % 40 == 3, F.lit(-1)).when(d % 100 == 20, d + 1).when(d % 100 == 21, d - 1).when(d % 4 != 0, d - d % 4)
    b = derived.golden_blocks(spark, sf).withColumn("fixture_id", F.lit("all")).withColumn("parent_link", F.when(parent.isNotNull(), F.struct(F.concat(F.lit("b"), parent.cast("string")).alias("parent_block_id"), F.lit("option_of").alias("relation"))))
    # one document per 50 blocks
    return b.withColumn("fixture_id", F.concat(F.lit("d"), F.floor(d / 50).cast("string")))


def _reasons(spark, sf) -> DataFrame:
    return gate.gate_reasons(_linked(spark, sf).withColumn("runner_up", F.when(F.col("pos") % 6 == 0, F.col("confidence") - 0.04)))


@query
def reason_histogram(spark, sf):
    return gate.reason_histogram(_reasons(spark, sf))


@query
def run_summary(spark, sf):
    return gate.run_summary(_reasons(spark, sf), mapping.map_rows(_linked(spark, sf), substitute=False))


@query
def gate_reasons(spark, sf):
    r = _reasons(spark, sf)
    return r.select("fixture_id", "block_id", F.array_join("reasons", ",").alias("reasons"), "routed")


@query
def neighbours(spark, sf):
    n = graph.neighbours(_linked(spark, sf))
    return n.select("fixture_id", "block_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query
def page_neighbours(spark, sf):
    return graph.page_neighbours(_linked(spark, sf), 60.0)


@query
def merge_override(spark, sf):
    g = gate.gate(_staged(spark, sf))
    d = F.col("pos")
    r = g.where(d % 2 == 0).select("fixture_id", "block_id", F.when(d % 4 == 0, "display").alias("block_type"), F.lit(0.9).alias("confidence"))
    out = gate.refine(g, r)
    return out.select("fixture_id", "block_id", "block_type", "confidence", "provenance", "routed")


@query
def map_rows(spark, sf):
    b = _linked(spark, sf)
    return mapping.map_rows(b, substitute=False).select("fixture_id", "block_id", "section", "sequence", "question_type", "question_text", "answer_text", "answer_validation", "required", "auto_populated")


@query
def substituted_branching(spark, sf):
    """Parents' ids in expressions become sequence numbers."""
    b = _linked(spark, sf)
    b = b.withColumn("branching_logic", F.concat(F.lit("Display if "), F.col("parent_link.parent_block_id"), F.lit(' = "yes"')))
    return mapping.map_rows(b).select("fixture_id", "block_id", "sequence", "branching_logic").where("branching_logic is not null")


@query
def document_titles(spark, sf):
    return mapping.header_meta(_linked(spark, sf), "program")


@query
def repeated_headers(spark, sf):
    b = derived.golden_blocks(spark, sf)
    return b.groupBy(text.text_sha("text").alias("sha")).agg(F.count_distinct("page").alias("pages"), F.count("*").alias("blocks")).where("pages >= 3")


@query
def rule_combine(spark, sf):
    b = derived.golden_blocks(spark, sf)
    d = F.col("pos")
    scores = [F.struct(F.lit(name).alias("type"), ((d * f % 90 + 5) / 100.0).alias("c"), F.lit(p).alias("priority")) for p, (name, f) in enumerate((("display", 7), ("question_label", 11), ("text_input", 13)))]
    r = b.select("block_id", F.explode(F.array(*scores)).alias("s")).select("block_id", "s.*")
    order = Window.partitionBy("block_id").orderBy(F.desc("c"), "priority")
    r = r.withColumns({"rank": F.row_number().over(order), "next": F.lead("c").over(order), "all": F.collect_list("c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return r.where("rank = 1").select("block_id", "type", F.round(text.combine_confidences(F.col("all")), 9).alias("combined"), F.round(F.col("c") - F.col("next"), 9).alias("gap"))


@query
def contract_violations(spark, sf):
    d = F.col("pos")
    b = _linked(spark, sf).withColumns({
        "page": F.when(d % 17 == 0, 0).otherwise(F.col("page")),
        "confidence": F.when(d % 19 == 0, 1.0).otherwise(F.col("confidence")),
        "block_type": F.when(d % 23 == 0, "heading").otherwise(F.col("block_type")),
        "provenance": F.when(d % 29 == 0, "human").otherwise(F.col("provenance")),
        "branching_logic": F.when(d % 31 == 0, "Q1 = yes").otherwise(F.col("branching_logic")),
    })
    return validation.violations(b)


@query
def sequence_gaps(spark, sf):
    d = F.col("pos")
    return validation.sequence_gaps(_linked(spark, sf).withColumn("sequence", d - F.floor(d / 50) * 50 + F.when(d % 350 == 49, 2).otherwise(1)))


def _page_blocks(spark, sf) -> DataFrame:
    """Headings, paragraphs, list items and labels of the pages as raw blocks, with the text inside their inline tags."""
    p = table(spark, sf, "pages")
    inline = r"</?(?:a|abbr|b|br|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|time|u)\b[^>]*>"
    parts = F.regexp_extract_all("html", F.lit(rf"(?i)<(?:p|h[1-6]|li|label)\b[^>]*>([^<]*+(?:{inline}[^<]*+)*+)"), F.lit(1))
    r = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("fixture_id"), F.posexplode(parts).alias("pos", "text"))
    return r.select("fixture_id", "pos", F.concat("fixture_id", F.lit("-"), F.col("pos").cast("string")).alias("block_id"), F.lit(1).alias("page"), F.col("pos").alias("reading_order"), text.strip(F.regexp_replace("text", "<[^>]*>", "")).alias("text"))


@query
def html_blocks(spark, sf):
    return _page_blocks(spark, sf).select("fixture_id", "pos", "block_id", F.char_length("text").alias("chars"))


@query
def classified_blocks(spark, sf):
    """The rule library over the whole page blocks, and over documents made from them with labels, glyphs, input lines and fonts."""
    b, n = _page_blocks(spark, sf), F.col("pos")
    k = n % 12
    run = F.when(n % 24 < 12, "________").otherwise("__________")
    raw = F.when(k.isin(0, 1), F.concat("text", F.lit(":"))).when(k == 11, F.concat("text", F.lit(" (part):"))).when(k == 2, run)
    raw = raw.when(k == 3, F.concat(F.lit("☐ 1. "), F.col("text"), F.when(n % 24 == 3, " ____").otherwise(""))).when(k == 5, "Signature ____").when(k == 6, "DOB mm/dd/yyyy ____")
    raw = raw.when(k == 7, "○ other").when(k.between(8, 10), F.when(n % 36 == 9, "___").otherwise(run)).otherwise(F.col("text"))
    # some options have their input beside them, some headers a subsection, and every third header is of the body's size
    top = F.when((n % 24).isin(8, 13), n - 1).otherwise(n) * 10.0
    made = b.withColumns({"text": raw, "font_size": F.when((k == 0) & (n % 36 != 0), 14.0).otherwise(10.0), "bold": k == 0, "y0": top, "y1": top + 8.0, "raw_kind": F.when(n % 40 == 39, "table_cell")})
    made = made.withColumns({c: F.concat(F.lit("made-"), F.col(c)) for c in ("fixture_id", "block_id")})
    c = rules.with_inline_inputs(rules.link_parents(rules.classify(b.unionByName(made, allowMissingColumns=True))))
    return c.select("fixture_id", "block_id", "block_type", "rule_id", F.round("confidence", 9).alias("confidence"), F.col("parent_link.parent_block_id").alias("parent"), F.col("parent_link.relation").alias("relation"))


@query
def workbook_round_trip(spark, sf):
    """A workbook for each region, written and read back: its dimension, vocabulary, cells, panes and merged ranges."""
    n = table(spark, sf, "nation")
    book = F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("workbook")
    at = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    full = F.col("n_nationkey") % 5 != 0
    accent = F.when(F.col("n_nationkey") % 2 == 0, "é\t").otherwise("É")

    def rows(of: DataFrame, sheet: str, row: Column, *values: Column) -> DataFrame:
        return of.select(book, F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), F.array(*[v.cast("string") for v in values]).alias("values"))

    none = F.lit(None)
    tops = n.select("n_regionkey").distinct()
    every = rows(tops, "Assessment", F.lit(1), F.lit("Title & \"more\""), F.lit("")).unionByName(rows(tops, "Assessment", F.lit(3), F.lit("Section"), none, F.lit("Question <Text>"), F.lit(" ")))
    every = every.unionByName(rows(n, "Assessment", at + 3, F.when(full, F.col("n_name")), F.lit(""), F.when(full, F.concat("n_name", F.lit(" ü"))), F.lit("beyond")))
    every = every.unionByName(rows(tops, "Values", F.lit(1), none, none, F.lit("Question Type")))
    every = every.unionByName(rows(n, "Values", at + 1, none, none, F.concat(F.lit("\n "), F.substring("n_name", 1, 1), accent)))
    files = xlsx.build_workbooks(every, {"Assessment": ["A1:B1"]}, {"Assessment": "A4"})
    cells = xlsx.cells_of(files)
    dims = xlsx.sheet_dimension(cells, xlsx.sheets_of(files), 3, "Assessment")
    words = xlsx.controlled_vocabulary(cells).groupBy("workbook").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda v: v["value"]), ",").alias("vocabulary"))
    texts = cells.where("sheet = 'Assessment' and row > 3 and col = 3").groupBy("workbook").agg(F.count("*").alias("texts"), F.sum(F.char_length("value.s")).alias("chars"))
    out = dims.join(words, "workbook", "left").join(texts, "workbook", "left")
    lists = [F.array_join(c, "|").alias(c) for c in ("headers", "merged_ranges", "sheet_names")]
    return out.select("workbook", *lists, "frozen_panes", "data_start_row", "data_end_row", "vocabulary", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("chars", F.lit(0)).alias("chars"))


@query
def few_shot_examples(spark, sf):
    """The three examples of a bank of benchmark texts that are closest to each turn by BM25."""
    from formweave.operators.retrieval import bm25_top

    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    c = table(spark, sf, "conversations").select(name.alias("query_id"), "text")
    return bm25_top(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), c, 3)
