"""Cell-level comparison of workbooks (evaluations B and C).

Cells are rows (workbook, row, col, value, formula); sheets are a dimension with
headers and the first and last data row.  Columns are aligned by canonical header
(the last one wins), rows by their ordinal below the header, down to the shorter
sheet.  A candidate and its reference share ``fixture_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.branching import loosely_valid
from formweave.functions.coerce import cells_equal, plain_number, value_blank
from formweave.functions.headers import YES_NO, column_priority, priority_threshold, priority_weight
from formweave.functions.text import canonicalize_header, normalize_case_insensitive, strip
from formweave.operators.ratios import ratio, ratio_true

DISTANCE_THRESHOLD, ROW_DELTA, VOCAB_THRESHOLD, BRANCHING_THRESHOLD = 0.05, 2, 1.0, 0.97


def row_count(sheet: str = "") -> Column:
    p = f"{sheet}." if sheet else ""
    return F.greatest(F.lit(0), F.col(f"{p}data_end_row") - F.col(f"{p}data_start_row") + 1)


def columns_of(sheets: DataFrame) -> DataFrame:
    """fixture_id, col (1-based), header, canon, data_start_row, rows."""
    return sheets.select("fixture_id", "data_start_row", row_count().alias("rows"), F.posexplode("headers").alias("i", "header")).select("fixture_id", "data_start_row", "rows", (F.col("i") + 1).alias("col"), "header", canonicalize_header("header").alias("canon"))


def data_cells(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Cells of the data area by ordinal: fixture_id, i (0-based), col, value."""
    s = sheets.select("fixture_id", "data_start_row", row_count().alias("rows"))
    joined = cells.join(s, "fixture_id").withColumn("i", F.col("row") - F.col("data_start_row"))
    return joined.where((F.col("i") >= 0) & (F.col("i") < F.col("rows"))).select("fixture_id", "i", "col", "value")


def aligned_columns(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Reference columns with a canonical header, the candidate's column of that header, and the rows compared."""
    r = columns_of(reference).where("canon <> ''").select("fixture_id", "col", "header", "canon", F.col("rows").alias("ref_rows"))
    c = columns_of(candidate)
    last = c.groupBy("fixture_id", "canon").agg(F.max("col").alias("cand_col"))
    size = candidate.select("fixture_id", row_count().alias("cand_rows"))
    out = r.join(last, ["fixture_id", "canon"], "left").join(size, "fixture_id", "left")
    return out.withColumn("n", F.least("ref_rows", F.coalesce("cand_rows", F.lit(0)))).withColumn("priority", column_priority(F.col("canon")))


def per_column_accuracy(ref_cells: DataFrame, ref_sheets: DataFrame, cand_cells: DataFrame, cand_sheets: DataFrame, ascii_only: bool = False) -> DataFrame:
    """fixture_id, col, header, priority, total, correct, accuracy, threshold, passed: one row a reference column.

    Only stored cells are joined; the rows where neither side has one are blank
    on both, which is equal, so they are counted and not built."""
    cols = aligned_columns(ref_sheets, cand_sheets)
    ref, cand = data_cells(ref_cells, ref_sheets), data_cells(cand_cells, cand_sheets)
    r = ref.join(cols.select("fixture_id", "col", "n", "cand_col"), ["fixture_id", "col"]).where(F.col("cand_col").isNotNull()).select("fixture_id", "col", "i", "n", F.col("value").alias("rv"))
    c = cand.withColumnRenamed("col", "cand_col").join(cols.select("fixture_id", "cand_col", "col", "n"), ["fixture_id", "cand_col"]).select("fixture_id", "col", "i", F.col("n").alias("cn"), F.col("value").alias("cv"))
    both = r.join(c, ["fixture_id", "col", "i"], "full").where(F.col("i") < F.coalesce("n", "cn"))
    equal, blank = cells_equal(F.col("rv"), F.col("cv"), ascii_only), value_blank(F.col("cv"))
    seen = both.groupBy("fixture_id", "col").agg(F.count("*").alias("seen"), F.sum(F.coalesce(equal, F.lit(False)).cast("bigint")).alias("seen_equal"), F.sum(blank.cast("bigint")).alias("seen_blank"))
    filled = ref.where(~value_blank(F.col("value"))).select("fixture_id", "col").distinct().withColumn("filled", F.lit(True))
    out = cols.join(seen, ["fixture_id", "col"], "left").join(filled, ["fixture_id", "col"], "left").fillna(0, ["seen", "seen_equal", "seen_blank"])
    preserved = (F.col("priority") == "low") & F.col("filled").isNull()
    unseen = F.col("n") - F.col("seen")
    total = F.when(F.col("cand_col").isNull() | preserved, F.col("ref_rows")).otherwise(F.col("n")).cast("bigint")
    # a blank column compares over the reference's rows: candidate cells beyond its sheet are blank
    right = F.when(F.col("cand_col").isNull(), 0).when(preserved, F.col("ref_rows") - F.col("n") + unseen + F.col("seen_blank")).otherwise(unseen + F.col("seen_equal")).cast("bigint")
    out = out.withColumn("total", total).withColumn("correct", right)
    accuracy = F.when(F.col("cand_col").isNull(), 0.0).otherwise(ratio(F.col("correct"), F.col("total"), 1.0))
    out = out.withColumn("accuracy", accuracy).withColumn("threshold", priority_threshold(F.col("priority")))
    return out.select("fixture_id", "col", "header", "priority", "total", "correct", "accuracy", "threshold", (F.col("accuracy") >= F.col("threshold")).alias("passed"))


def first_column(sheets: DataFrame, canon: tuple[str, ...]) -> DataFrame:
    """The first column whose canonical header is one of ``canon``: fixture_id, col."""
    return columns_of(sheets).where(F.col("canon").isin(*canon)).groupBy("fixture_id").agg(F.min("col").alias("col"))


def _fixtures_with(sheets: DataFrame, counted: DataFrame, **empty) -> DataFrame:
    return sheets.select("fixture_id").distinct().join(counted, "fixture_id", "left").fillna(empty)


def row_count_delta(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    c = candidate.select("fixture_id", row_count().alias("c"))
    return reference.select("fixture_id", row_count().alias("r")).join(c, "fixture_id").select("fixture_id", (F.col("c") - F.col("r")).cast("bigint").alias("row_count_delta"))


def vocabulary(values: DataFrame, ascii_only: bool = False) -> DataFrame:
    """From (fixture_id, row, value string): the distinct entries by folded text, first spelling kept, with its row."""
    s = values.where(strip("value") != "").where(~F.lower(strip("value")).isin("questiontype", "question type"))
    key = normalize_case_insensitive("value", ascii_only)
    return s.groupBy("fixture_id", key.alias("key")).agg(F.min_by("value", "row").alias("value"), F.min("row").alias("row"))


def lookup_vocabulary(values: DataFrame, vocab: DataFrame, ascii_only: bool = False) -> DataFrame:
    """``values`` (fixture_id, value) with ``entry``: the vocabulary's spelling of the value, null if it has none or
    the value is blank.  ``vocab`` is what ``vocabulary`` gives."""
    entries = vocab.select("fixture_id", F.col("key").alias("k"), F.col("value").alias("entry"))
    keyed = values.withColumn("k", normalize_case_insensitive("value", ascii_only))
    return keyed.join(entries.where(F.col("k") != ""), ["fixture_id", "k"], "left").drop("k")


def column_index(sheets: DataFrame, header: str) -> DataFrame:
    """fixture_id, col: the first column whose header is this one, white space around aside; null without one."""
    stripped = F.transform("headers", lambda h: strip(F.coalesce(h, F.lit(""))))
    found = F.array_position(stripped, strip(F.lit(header))).cast("int")
    return sheets.select("fixture_id", F.when(found > 0, found).alias("col"))


def vocab_validity(cand_cells: DataFrame, cand_sheets: DataFrame, ref_cells: DataFrame, ref_sheets: DataFrame, vocab: DataFrame, canon: tuple[str, ...] = ("questiontype",), ascii_only: bool = False) -> DataFrame:
    """total, valid, out_of_vocab, validity: a value is valid if the vocabulary has it, or if it equals the
    reference cell of its row."""
    c = data_cells(cand_cells, cand_sheets).join(first_column(cand_sheets, canon), ["fixture_id", "col"]).where(~value_blank(F.col("value")))
    r = data_cells(ref_cells, ref_sheets).join(first_column(ref_sheets, canon), ["fixture_id", "col"]).select("fixture_id", "i", F.col("value").alias("rv"))
    known = vocab.select("fixture_id", F.col("key").alias("k"), F.lit(True).alias("known"))
    c = c.withColumn("k", normalize_case_insensitive(F.col("value.s"), ascii_only)).join(known, ["fixture_id", "k"], "left").join(r, ["fixture_id", "i"], "left")
    ok = F.col("known").isNotNull() | (F.col("rv").isNotNull() & F.coalesce(cells_equal(F.col("value"), F.col("rv"), ascii_only), F.lit(False)))
    counted = c.groupBy("fixture_id").agg(F.count("*").alias("total"), F.sum(ok.cast("bigint")).alias("valid"))
    out = _fixtures_with(cand_sheets, counted, total=0, valid=0)
    return out.select("*", (F.col("total") - F.col("valid")).alias("out_of_vocab"), ratio(F.col("valid"), F.col("total"), 1.0).alias("validity"))


def yes_no_validity(cells: DataFrame, sheets: DataFrame, ascii_only: bool = False) -> DataFrame:
    cols = columns_of(sheets).where(F.col("canon").isin(*YES_NO)).select("fixture_id", "col")
    c = data_cells(cells, sheets).join(cols, ["fixture_id", "col"]).where(~value_blank(F.col("value")))
    ok = normalize_case_insensitive(F.col("value.s"), ascii_only).isin("yes", "no")
    counted = c.groupBy("fixture_id").agg(F.count("*").alias("total"), F.sum(ok.cast("bigint")).alias("valid"))
    out = _fixtures_with(sheets, counted, total=0, valid=0)
    return out.withColumn("validity", ratio(F.col("valid"), F.col("total"), 1.0))


def branching_validity(cells: DataFrame, sheets: DataFrame, ascii_only: bool = False) -> DataFrame:
    from formweave.functions.text import normalize_string

    c = data_cells(cells, sheets).join(first_column(sheets, ("branchinglogic",)), ["fixture_id", "col"]).where(~value_blank(F.col("value")))
    counted = c.groupBy("fixture_id").agg(F.count("*").alias("total"), F.sum(loosely_valid(normalize_string(F.col("value.s"), ascii_only)).cast("bigint")).alias("valid"))
    out = _fixtures_with(sheets, counted, total=0, valid=0)
    return out.withColumn("validity", ratio(F.col("valid"), F.col("total"), 1.0))


def contiguous(numbers: DataFrame, key: str = "fixture_id") -> DataFrame:
    """From (key, s text): whether the non-blank values, cut to whole numbers, are just 1..n.

    n values from 1 to n without repeats: no list is gathered or sorted."""
    n = plain_number(F.col("s"))
    whole = F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 9e18), F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("bigint"))
    rows = numbers.select(key, whole.alias("v"), (F.col("s").rlike("^[0-9]") | (strip("s") != "")).alias("filled")).where("filled")
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.count("v").alias("read"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_distinct("v").alias("kinds"))
    return counted.select(key, "n", F.coalesce((F.col("read") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("kinds") == F.col("n")), F.lit(False)).alias("contiguous"))


def sequence_contiguity(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    c = data_cells(cells, sheets).join(first_column(sheets, ("sequence",)), ["fixture_id", "col"])
    return _fixtures_with(sheets, contiguous(c.select("fixture_id", F.col("value.s").alias("s"))), n=0, contiguous=True)


def formatting_preservation(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Sheets, merged ranges, frozen panes and named ranges as in the reference, and at least as many validations."""
    names = ["sheet_names", "merged_ranges", "named_ranges"]
    c = candidate.select("fixture_id", *[F.sort_array(n).alias(f"c_{n}") for n in names], F.col("frozen_panes").alias("c_frozen"), F.size("data_validations").alias("c_validations"))
    both = reference.join(c, "fixture_id")
    checks = [F.sort_array(n).eqNullSafe(F.col(f"c_{n}")) for n in names] + [F.col("frozen_panes").eqNullSafe(F.col("c_frozen")), F.col("c_validations") >= F.size("data_validations")]
    every = checks[0]
    for x in checks[1:]:
        every = every & x
    return both.select("fixture_id", *[x.alias(n) for x, n in zip(checks, ("sheets_equal", "merges_equal", "names_equal", "panes_equal", "validations_kept"), strict=True)], every.alias("formatting_preservation"))


def header_meta_accuracy(ref_cells: DataFrame, cand_cells: DataFrame, ref_sheets: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Cells above the header, as far as it has columns, that are set on either side: total, correct, accuracy, and right or wrong by ``R<r>C<c>``."""
    top = ref_sheets.select("fixture_id", "header_row", F.size("headers").alias("width"))
    r = ref_cells.join(top, "fixture_id").where("row < header_row and col <= width").select("fixture_id", "row", "col", F.col("value").alias("rv"))
    c = cand_cells.join(top, "fixture_id").where("row < header_row and col <= width").select("fixture_id", "row", "col", F.col("value").alias("cv"))
    both = r.join(c, ["fixture_id", "row", "col"], "full").where(~(value_blank(F.col("rv")) & value_blank(F.col("cv"))))
    same = F.coalesce(cells_equal(F.col("rv"), F.col("cv"), ascii_only), F.lit(False))
    counted = both.groupBy("fixture_id").agg(F.count("*").alias("total"), F.sum(same.cast("bigint")).alias("correct"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.format_string("R%dC%d", "row", "col"), same)))).alias("cells"))
    out = ref_sheets.select("fixture_id").join(counted, "fixture_id", "left").fillna(0, ["total", "correct"])
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total"), 1.0))


def evaluate(ref_cells, ref_sheets, cand_cells, cand_sheets, vocab, ascii_only: bool = False) -> DataFrame:
    """All workbook measures and verdicts of evaluation B, one row a fixture."""
    cols = per_column_accuracy(ref_cells, ref_sheets, cand_cells, cand_sheets, ascii_only)
    classes = cols.groupBy("fixture_id").agg(F.bool_and(F.when(F.col("priority") != "unclassified", F.col("passed"))).alias("columns_passed"), F.collect_list(F.struct("col", "header", "priority", "accuracy", "passed")).alias("per_column"))
    out = ref_sheets.select("fixture_id").join(classes, "fixture_id", "left").join(row_count_delta(ref_sheets, cand_sheets), "fixture_id")
    out = out.join(vocab_validity(cand_cells, cand_sheets, ref_cells, ref_sheets, vocab, ascii_only=ascii_only).select("fixture_id", F.col("validity").alias("controlled_vocab_validity"), "out_of_vocab"), "fixture_id")
    out = out.join(yes_no_validity(cand_cells, cand_sheets, ascii_only).select("fixture_id", F.col("validity").alias("yes_no_validity")), "fixture_id")
    out = out.join(branching_validity(cand_cells, cand_sheets, ascii_only).select("fixture_id", F.col("validity").alias("branching_syntactic_validity")), "fixture_id")
    out = out.join(sequence_contiguity(cand_cells, cand_sheets).select("fixture_id", F.col("contiguous").alias("sequence_contiguity")), "fixture_id")
    out = out.join(formatting_preservation(ref_sheets, cand_sheets).select("fixture_id", "formatting_preservation"), "fixture_id")
    out = out.join(header_meta_accuracy(ref_cells, cand_cells, ref_sheets, ascii_only).select("fixture_id", F.col("accuracy").alias("header_meta_accuracy")), "fixture_id")
    passed = F.coalesce("columns_passed", F.lit(True)) & (F.abs("row_count_delta") <= ROW_DELTA) & (F.col("controlled_vocab_validity") >= VOCAB_THRESHOLD) & (F.col("branching_syntactic_validity") >= BRANCHING_THRESHOLD) & F.col("sequence_contiguity") & F.col("formatting_preservation")
    return out.withColumn("passed", passed).drop("columns_passed")


def distance(columns: DataFrame, checks: DataFrame) -> DataFrame:
    """Weighted distance of evaluation C from per-column accuracies and (out_of_vocab, sequence_contiguity,
    formatting_preservation).  Sums of right and total per weight stay whole numbers as long as they can."""
    w = columns.withColumn("w", priority_weight(F.col("priority")))
    base = w.groupBy("fixture_id").agg(F.sum(F.col("w") * (1 - F.col("accuracy"))).alias("num"), F.sum("w").alias("den"))
    out = checks.join(base, "fixture_id", "left")
    oov = F.least(F.lit(0.10) * F.col("out_of_vocab"), F.lit(0.30))
    penalties = oov + F.when(F.col("sequence_contiguity"), 0.0).otherwise(0.10) + F.when(F.col("formatting_preservation"), 0.0).otherwise(0.20)
    out = out.select("fixture_id", F.coalesce(F.when(F.col("den") > 0, F.col("num") / F.col("den")), F.lit(0.0)).alias("base"), penalties.alias("penalties"))
    return out.withColumn("distance", F.col("base") + F.col("penalties")).withColumn("passed", F.col("distance") <= DISTANCE_THRESHOLD)


def contributions(columns: DataFrame) -> DataFrame:
    """What each weighted column adds to the base distance, largest first."""
    from pyspark.sql.window import Window

    w = columns.withColumn("w", priority_weight(F.col("priority"))).where("w > 0")
    share = F.col("w") * (1 - F.col("accuracy")) / F.sum("w").over(Window.partitionBy("fixture_id"))
    return w.select("fixture_id", "col", "header", "priority", share.alias("contribution")).orderBy("fixture_id", F.desc("contribution"), "col")


def e2e_pass_rate(distances: DataFrame) -> DataFrame:
    return distances.agg(F.count("*").alias("fixtures"), F.sum(F.col("passed").cast("bigint")).alias("passed"), ratio_true(F.col("passed"), 0.0).alias("e2e_pass_rate"))


def distance_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("fixture_id", F.col("distance").alias("before")).join(after.select("fixture_id", F.col("distance").alias("after")), "fixture_id").withColumn("workbook_distance_delta", F.col("after") - F.col("before"))
