import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formweave import schema
from formweave.operators import blocks, graph, judges, retrieval, semantic, telemetry, validation, workbooks
from formweave.functions.coerce import text_value
from formweave.plans import gate


def block(i, **kw):
    b = {"block_id": f"b{i}", "page": 1, "reading_order": i, "bbox": {"x0": 0.0, "y0": 10.0 * i, "x1": 10.0, "y1": 10.0 * i + 10, "coord_origin": "top_left"}, "text": f"hello {i}", "block_type": "question_label", "confidence": 0.9, "parent_link": None, "branching_logic": None, "sequence": None, "question_type": None, "provenance": {"source": "rule"}}
    return b | kw


def frame(spark, rows, fixture="f"):
    d = spark.createDataFrame([{"schema_version": "1", "source": None, "blocks": rows, "_placeholder": None}], schema.DOCUMENT)
    return blocks.explode_documents(d.withColumn("fixture_id", F.lit(fixture)))


def test_self_compare_is_perfect(spark):
    rows = frame(spark, [block(i, sequence=i, parent_link={"parent_block_id": "b0", "relation": "option_of"} if i else None, branching_logic='Q1 = "a"') for i in range(6)])
    r = blocks.evaluate(rows, rows).first()
    assert (r.block_coverage, r.type_accuracy, r.parent_link_f1, r.branching_exact_match, r.reading_order_tau, r.sequence_correctness) == (1, 1, 1, 1, 1, 1)


def test_coverage_and_tolerance(spark):
    g = frame(spark, [block(1), block(2)])
    assert blocks.match_counts(g, frame(spark, [block(1)])).first().block_coverage == 0.5
    near = {"x0": 0.8, "y0": 10.3, "x1": 10.4, "y1": 20.7, "coord_origin": "top_left"}
    assert blocks.match_counts(frame(spark, [block(1)]), frame(spark, [block(1, bbox=near)])).first().matched == 1


def test_last_duplicate_wins_and_types(spark):
    g = frame(spark, [block(1), block(2, block_type="display")])
    c = frame(spark, [block(1, block_type="display"), block(1), block(2)])
    assert {r.block_type: r.accuracy for r in blocks.type_accuracy_per_type(g, c).collect()} == {"question_label": 1.0, "display": 0.0}


def test_parent_link_f1(spark):
    link = lambda p: {"parent_block_id": p, "relation": "option_of"}
    g = frame(spark, [block(1, parent_link=link("a")), block(2, parent_link=link("b"))])
    c = frame(spark, [block(1, parent_link=link("a")), block(2, parent_link=link("x"))])
    r = blocks.parent_link_f1(g, c).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    assert blocks.parent_link_f1(frame(spark, [block(1)]), frame(spark, [block(1)])).first().f1 == 1


def test_calibration_and_placeholder(spark):
    r = blocks.confidence_calibration(frame(spark, [block(1)]), frame(spark, [block(1, confidence=0.95, block_type="display")])).first()
    assert (r.bin, r.accuracy) == ("0.8-1.0", 0.0)
    d = spark.createDataFrame([{"schema_version": None, "source": None, "blocks": None, "_placeholder": True}], schema.DOCUMENT).withColumn("fixture_id", F.lit("p"))
    r = blocks.evaluate_documents(d, d).first()
    assert (r.status, r.block_coverage) == ("SKIPPED_PLACEHOLDER", None)


@pytest.mark.parametrize("seed", range(6))
def test_concordance_equals_pairs(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 2, 7, 40, 129])
    x, y = (np.array([rng.randrange(12) for _ in range(n)], float) for _ in range(2))
    signs = [np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i)]
    assert blocks.concordance(x, y) == (sum(s > 0 for s in signs), sum(s < 0 for s in signs)) if n else True


def test_tau(spark):
    for pairs, tau in (([(1, 3), (2, 2), (3, 1)], -1.0), ([(1, 1), (2, 2), (3, 3)], 1.0), ([(1, 1)], 1.0)):
        assert blocks.kendall_tau(spark.createDataFrame([("f", *p) for p in pairs], "fixture_id string, x int, y int")).first().tau == tau


def sheet(spark, headers, rows, fixture="f", name="Assessment"):
    cells = [(fixture, 2 + i, 1 + j, v) for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None]
    c = spark.createDataFrame(cells or [(fixture, 99, 99, None)], "fixture_id string, row int, col int, v string").select("fixture_id", "row", "col", text_value(F.col("v")).alias("value")).where("row < 99")
    s = spark.createDataFrame([(fixture, 1, headers, 2, 1 + len(rows), ["A1:B1"], "A2", [], [], [name])], "fixture_id string, header_row int, headers array<string>, data_start_row int, data_end_row int, merged_ranges array<string>, frozen_panes string, data_validations array<string>, named_ranges array<string>, sheet_names array<string>")
    return c, s


def test_columns(spark):
    ref = sheet(spark, ["QuestionType", "IT Notes "], [["a", None], ["b", None]])
    half = {r.header: (r.accuracy, r.passed) for r in workbooks.per_column_accuracy(*ref, *sheet(spark, ["QuestionType", "IT Notes"], [["a", None], ["x", "note"]])).collect()}
    assert half == {"QuestionType": (0.5, False), "IT Notes ": (0.5, False)}
    missing = workbooks.per_column_accuracy(*ref, *sheet(spark, ["Other"], [["a"]])).collect()
    assert [r.accuracy for r in missing] == [0.0, 0.0]
    empty = workbooks.per_column_accuracy(*ref, *sheet(spark, ["QuestionType", "IT Notes"], [])).collect()
    assert [r.accuracy for r in empty] == [1.0, 1.0]  # no rows in common


def test_workbook_self_compare(spark):
    rows = [["Intake", str(i + 1), "Text Box", 'Display if Q1 = "a"', "Yes"] for i in range(3)]
    s = sheet(spark, ["Section", "Sequence", "QuestionType", "Branching Logic", "Alert (Yes/No)"], rows)
    vocab = workbooks.vocabulary(spark.createDataFrame([("f", 1, "QuestionType"), ("f", 2, "Text Box"), ("f", 3, "text box"), ("f", 4, " ")], "fixture_id string, row int, value string"))
    assert [r.value for r in vocab.collect()] == ["Text Box"]
    r = workbooks.evaluate(*s, *s, vocab).first()
    assert r.passed and r.sequence_contiguity and r.yes_no_validity == 1 and r.header_meta_accuracy == 1
    d = workbooks.distance(workbooks.per_column_accuracy(*s, *s), workbooks.evaluate(*s, *s, vocab)).first()
    assert d.distance == 0 and d.passed


@pytest.mark.parametrize("values,ok", [(["1", "2", "3"], True), (["1", "3"], False), (["2", "1", " "], True), (["1", "1.9"], False), (["1", "x"], False), (["inf"], False), (["1.0", "2"], True)])
def test_contiguous(spark, values, ok):
    assert workbooks.contiguous(spark.createDataFrame([("f", v) for v in values], "fixture_id string, s string")).first().contiguous == ok


def pairs(spark, rows):
    return spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "fixture_id string, row_index int, candidate string, reference string, is_checkbox boolean")


def test_semantic(spark):
    p = pairs(spark, [("red|blue|green", "green| red |blue", True), ("A", "A", False), ("A", "B", False), (None, "", False)])
    r = semantic.answer_equivalence(p).first()
    assert (r.numerator, r.denominator, r.unresolved) == (2, 3, 1)
    assert semantic.residual(p).count() == 1
    table = semantic.judge_table(semantic.residual(p), judges.StubJudge({("A", "B"): "yes"}))
    assert semantic.answer_equivalence(p, table).first().score == 1
    assert semantic.judge_table(semantic.residual(p), judges.disabled_judge, table).count() == 1
    e = semantic.branching_equivalence(pairs(spark, [('Q1="a" AND Q2="b"', 'Q2="b" AND Q1="a"', None), ("x", "x", None)])).first()
    assert (e.numerator, e.denominator) == (1, 2)


def test_zip_strict(spark):
    a = spark.createDataFrame([("f", 0, "x"), ("f", 1, "y")], "fixture_id string, row_index int, candidate string")
    b = spark.createDataFrame([("f", 0, "x")], "fixture_id string, row_index int, reference string")
    assert semantic.zip_strict(a.where("row_index = 0"), b).count() == 1
    with pytest.raises(Exception, match="differ in length"):
        semantic.zip_strict(a, b).collect()


def test_judges(monkeypatch):
    inner = judges.StubJudge({("a", "b"): "yes"})
    j = judges.CachingJudge(inner)
    assert [j("a", "b") for _ in range(3)] == ["yes"] * 3 and len(inner.calls) == 1
    assert [j("x", "y") for _ in range(2)] == ["unknown"] * 2 and len(inner.calls) == 3
    assert judges.resolve_judge() is judges.disabled_judge
    monkeypatch.setenv("FORMWEAVE_ENABLE_JUDGE", "yes")
    assert judges.resolve_judge(model=lambda p: "Yes, they do")("a", "b") == "yes"
    assert judges.ModelJudge(lambda p: "perhaps")("a", "b") == "unknown"


def test_uplift(spark):
    s = lambda d: spark.createDataFrame(list(d.items()), "metric string, score double")
    r = {x.metric: round(x.uplift, 9) for x in semantic.uplift(s({"a": 1.0, "b": 0.95, "c": 0.9}), s({"a": 0.98, "b": 0.80})).collect()}
    assert r == {"a": 0.02, "b": 0.15, "c": 0.9}


def test_telemetry(spark):
    rows = [(None, None, None, False, True), (None, None, None, True, True), (0.015, True, True, True, True), (0.005, False, True, None, True), (None, True, None, None, None)]
    logs = spark.createDataFrame(rows, schema.LOG)
    r = telemetry.cost_latency(logs).first()
    assert (r.cost_per_block_usd, r.route_rate, r.cache_hit_rate) == (0.005, 0.5, 0.5)
    e = telemetry.cost_latency(logs.limit(0)).first()
    assert (e.cost_usd, e.route_rate, e.cache_hit_rate) == (0, 0, 0)
    with telemetry.CostTracker() as t:
        t.ingest(logs)
        t.ingest(logs)
    assert t.result().first().blocks == 8


def test_gate_and_merge(spark):
    b = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.75), (4, None)], "id int, confidence double")
    assert {r.id for r in gate.gate(b).where("not routed").collect()} == {1, 3}
    kept = gate.merge(spark.createDataFrame([(1, 0.9), (2, None)], "id int, confidence double"), spark.createDataFrame([(3, 0.04), (4, 0.5)], "id int, confidence double"))
    assert {r.id for r in kept.collect()} == {1, 2, 4}


def test_graph_and_validation(spark):
    link = lambda p: {"parent_block_id": p, "relation": "option_of"}
    b = frame(spark, [block(0, parent_link=link("b1")), block(1, parent_link=link("b0")), block(2, parent_link=link("none")), block(3, block_type="text_input"), block(4, parent_link=link("b5")), block(5)])
    found = {r.block_id: r.anomalies for r in graph.anomalies(b).collect()}
    assert found == {"b0": ["cycle"], "b1": ["cycle"], "b2": ["dangling_parent"], "b3": ["orphan_input"]}
    v = b.withColumn("provenance", F.col("provenance.source"))
    rules = {(r.block_id, r.rule) for r in validation.violations(v).collect()}
    assert rules == {("b2", "parent_missing")}
    with pytest.raises(Exception, match="contract violations"):
        validation.enforce(v, validation.violations(v)).collect()
    keys = spark.createDataFrame([('{"block_id": 1, "odd": 2}',)], "j string")
    assert validation.unknown_keys(keys, "j", ("block_id",)).first().unknown_keys == ["odd"]


def test_bm25(spark):
    d = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "red red wine")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "Red?")], "query_id int, text string")
    assert [r.doc_id for r in retrieval.bm25_top(d, q, 2).orderBy("rank").collect()] == [3, 1]


def test_stacks_headers_and_inline_inputs(spark):
    from formweave.plans import rules

    rows = [
        ("Part A:", 10.0, True, 0.0), ("text", 10.0, False, 20.0), ("Part B:", 14.0, False, 40.0), ("text", 10.0, False, 60.0),
        ("Part C:", 14.0, False, 80.0), ("beside", 10.0, False, 82.0), ("Which:", 10.0, False, 100.0), ("______", 10.0, False, 120.0),
        ("☐ 12. other: ____", 10.0, False, 140.0), ("☐ more", 10.0, False, 160.0), ("___", 10.0, False, 162.0),
        ("end", 10.0, False, 180.0), ("________", 10.0, False, 200.0), ("_______", 10.0, False, 220.0), ("________", 10.0, False, 240.0), ("___", 10.0, False, 260.0),
    ]
    b = spark.createDataFrame([("f", i, f"b{i}", 1, t, size, bold, y, y + 10) for i, (t, size, bold, y) in enumerate(rows)], "fixture_id string, pos int, block_id string, page int, text string, font_size double, bold boolean, y0 double, y1 double")
    got = {r.block_id: r for r in rules.with_inline_inputs(rules.link_parents(rules.classify(b))).collect()}
    assert (got["b0"].block_type, got["b0"].rule_id) == ("section_header", "section_header*body_sized=0.80")
    assert abs(got["b0"].confidence - 0.64) < 1e-9 and got["b2"].rule_id == "section_header"
    assert got["b4"].block_type != "section_header"  # another block beside it
    assert got["b8-input"].parent_link.parent_block_id == "b8" and got["b8-input"].text == "____"
    assert got["b8"].text == "☐ 12. other: ____" and got["b8"].parent_link.parent_block_id == "b6"
    assert got["b10"].parent_link.parent_block_id == "b9" and got["b10"].parent_link.relation == "input_of"
    assert [got[f"b{i}"].block_type for i in (12, 13, 14, 15)] == ["text_area"] * 3 + ["text_input"]
    assert len(got) == len(rows) + 1


def test_bm25_bank_rotates(spark):
    d = spark.createDataFrame([(i, f"common w{i}") for i in range(30)] + [(None, "w5")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "w5"), (2, "w29 common"), (3, None)], "query_id int, text string")
    got = retrieval.bm25_top(d, q, 3).collect()
    assert {r.query_id for r in got} == {2} and len(got) == 3 and min(r.doc_id for r in got) >= 10
    assert [r.doc_id for r in got if r["rank"] == 1] == [29]
    assert retrieval.bm25_top(d.limit(0), q, 3).count() == 0
