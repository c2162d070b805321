import json

import pytest
from pyspark.sql import functions as F

from formweave import cli, report, schema
from formweave.plans import mapping, pipeline
from formweave.sources import catalog, documents, xlsx


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "golden.xlsx"
    rows = [["Title", None], [None, None], ["Section", "Sequence", "QuestionType", None], ["Intake", 1, "Text Box"], ["Intake", 2, "radio button"], [" ", None]]
    values = [[None, None, "QuestionType"], [None, None, "Text Box"], [None, None, "Radio Button"], [None, None, "text box"], [None, None, None]]
    xlsx.write_workbook(path, {"Assessment": rows, "Values": values}, {"Assessment": ["A1:B1"]}, {"Assessment": "A4"})
    return path


def test_read(spark, book):
    cells, sheets = xlsx.read_cells(spark, str(book)), xlsx.read_sheets(spark, str(book))
    s = xlsx.sheet_dimension(cells, sheets, 3, "Assessment").first()
    assert (s.headers, s.data_start_row, s.data_end_row, s.frozen_panes, s.merged_ranges) == (["Section", "Sequence", "QuestionType"], 4, 6, "A4", ["A1:B1"])
    m = {(r.row, r.col): r for r in xlsx.expand_merges(cells, sheets).where("sheet = 'Assessment'").collect()}
    assert m[1, 2].value.s == "Title" and m[1, 2].merged_from.col == 1 and m[1, 1].is_merged_origin
    assert [r.value for r in xlsx.controlled_vocabulary(cells).orderBy("row").collect()] == ["Text Box", "Radio Button"]
    with pytest.raises(Exception, match="no sheet"):
        xlsx.sheet_dimension(cells, sheets, 3, "Nope").collect()
    spark.dataSource.register(xlsx.WorkbookSource)
    assert spark.read.format("workbook_cells").load(str(book)).count() == cells.count()


def test_template(spark, book, tmp_path):
    out = tmp_path / "o" / "out.xlsx"
    made = xlsx.write_from_template(book, out, "Assessment", 3, [("A & <b>", 1, "Text Box"), (None, 2.5, True)])
    assert made["rows_written"] == 2
    got = {(r.row, r.col): r.value.s for r in xlsx.read_cells(spark, str(out)).where("sheet = 'Assessment'").collect()}
    assert got[4, 1] == "A & <b>" and got[5, 2] == "2.5" and (6, 1) not in got and got[3, 1] == "Section"
    with pytest.raises(ValueError):
        xlsx.write_from_template(book, out, "Assessment", 3, [("x" * 40000,)])


def test_cli_self_compare(spark, book, tmp_path, capsys):
    (tmp_path / "evals").mkdir()
    y = tmp_path / "evals" / "fixtures.yaml"
    y.write_text("fixtures:\n  - {id: FX-1, pdf_path: a.pdf, golden_xlsx_path: golden.xlsx, reference_xlsx_path: golden.xlsx, question_sheet: Assessment, header_row: 3}\n")
    for which in "BC":
        assert cli.main(["run", "--eval", which, "--fixtures", str(y), "--out", str(tmp_path / "r")]) == 0
        assert f"[PASS] Eval {which} FX-1" in capsys.readouterr().out
    assert "workbook_distance | 0.0000" in (tmp_path / "r" / "FX-1.C.md").read_text()
    with pytest.raises(KeyError):
        catalog.find_fixture(catalog.load_fixtures(spark, y), "nope")


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert catalog.load_config().gate_confidence == 0.75
    monkeypatch.setenv("FORMWEAVE_THRESHOLDS__GATE_CONFIDENCE", "0.6")
    monkeypatch.setenv("FORMWEAVE_STAGES__LLM", "false")
    c = catalog.load_config()
    assert c.gate_confidence == 0.6 and not c.stages.llm
    (tmp_path / "config.yaml").write_text("thresholds: {gate_confidence: 0.9}\n")
    assert catalog.load_config().gate_confidence == 0.9  # the file wins
    (tmp_path / ".env").write_text("A_NEW=1\nexport B_NEW='x'\n")
    monkeypatch.setenv("A_NEW", "kept")
    monkeypatch.setenv("B_NEW", "y")
    assert catalog.load_env() == {"A_NEW": "1", "B_NEW": "x"}


def test_reports_and_schema(tmp_path):
    r = {"fixture_id": "f", "eval_name": "B", "passed": True, "notes": "n", "metrics": [report.metric("m", 0.5, True, {"a": "x|y"}), report.metric("k", 3)]}
    j, m = report.write_report(r, tmp_path)
    assert json.loads(j.read_text())["passed"] is True
    assert "| m | 0.5000 | True |" in m.read_text() and "x\\|y" in m.read_text()
    s = json.loads(documents.export_schema(tmp_path / "s.json").read_text())
    assert s["additionalProperties"] is False and s["properties"]["blocks"]["items"]["properties"]["page"]["minimum"] == 1


def test_documents(spark, tmp_path):
    (tmp_path / "FX").mkdir()
    (tmp_path / "FX" / "golden.json").write_text(json.dumps({"schema_version": "1", "blocks": [{"block_id": "b", "page": 1, "text": "t"}]}))
    d = documents.read_documents(spark, str(tmp_path / "*" / "golden.json")).first()
    assert d.fixture_id == "FX" and d.blocks[0].block_id == "b"
    documents.write_trace(spark.createDataFrame([("b", "secret text")], "block_id string, text string"), str(tmp_path / "t"))
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "t").glob("*.json"))
    assert catalog.is_placeholder({"_placeholder": True}) and not catalog.is_placeholder({})


def raw(spark, texts):
    rows = [("f", i, f"f-{i}", 1, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "fixture_id string, pos int, block_id string, page int, reading_order int, text string")


def test_pipeline(spark, tmp_path, book):
    b = raw(spark, ["Your name:", "______", "Pick some:", "☐ red", "☐ blue", "Signature ____", "word " * 60])
    m = {r.block_id: r for r in pipeline.merged(b).collect()}
    assert m["f-0"].block_type == "question_label" and m["f-3"].block_type == "checkbox_option" and m["f-5"].block_type == "signature_field" and m["f-6"].block_type == "display"
    # "Pick some:" stands before no input, so no rule makes it a label and the options go to the label before it
    assert "f-2" not in m and m["f-3"].parent_link.parent_block_id == m["f-4"].parent_link.parent_block_id == "f-0"
    rows = pipeline.run(b).orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(1, len(rows) + 1))
    assert len(mapping.COLUMNS) == 28 and rows[0].required == "Yes"
    off = pipeline.Config(stages=pipeline.Stages(mapping=False))
    assert pipeline.run(b, off).count() == 0
    refined = pipeline.merged(b, pipeline.Config(gate_confidence=1.0), lambda d: d.select("fixture_id", "block_id", F.lit("display").alias("block_type"), F.lit(0.9).alias("confidence")))
    assert {r.block_type for r in refined.collect()} == {"display"}
    report_ = xlsx.write_from_template(book, tmp_path / "m.xlsx", "Assessment", 3, (tuple(r)[2:] for r in mapping.checked(pipeline.run(b)).orderBy("sequence").toLocalIterator()))
    assert report_["rows_written"] == len(rows)


def test_streaming_equals_batch(spark, tmp_path):
    from formweave.streaming import telemetry as t

    logs = spark.createDataFrame([(0.5, True, True, False, False, "2024-01-01 10:00:00"), (None, None, None, True, True, "2024-01-01 11:00:00"), (0.25, False, True, False, False, "2024-01-03 11:00:00")], schema.record(**{f.name: f.dataType for f in schema.LOG}, ts=schema.S)).withColumn("ts", F.col("ts").cast("timestamp"))
    logs.write.json(str(tmp_path / "in"))
    q = t.windowed(t.read_logs(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = sorted(map(str, spark.table("live").collect()))
    assert live == sorted(map(str, t.windowed(logs).collect())) and len(live) == 2


def test_template_lint_and_version(tmp_path):
    lint_template, require_version, version_of, write_workbook = xlsx.lint_template, xlsx.require_version, xlsx.version_of, xlsx.write_workbook
    good, bad = tmp_path / "good.xlsx", tmp_path / "bad.xlsx"
    heads = [[] for _ in range(12)]
    write_workbook(good, {"Q": [*heads, [f"h{i}" for i in range(28)]]})
    write_workbook(bad, {"Q": [*heads, [f"h{i}" for i in range(26)] + [" ", "h27"]]})
    assert lint_template(good, "Q") == [] and lint_template(good, "Z") == ["no sheet Z"]
    assert lint_template(bad, "Q", names=["Types"]) == ["row 13 has 27 headers up to column 28, not 28", "no named range Types"]
    pinned = version_of(good, "1.0.0")
    require_version(good, pinned)
    with pytest.raises(ValueError, match="has version"):
        require_version(bad, pinned)


def test_bound_fields(capsys):
    documents.configure_logging("INFO", "json")
    documents.get_logger("gate", run="r1").info("done")
    got = json.loads(capsys.readouterr().err.splitlines()[-1])
    assert got.pop("timestamp").endswith("+00:00") and got == {"run": "r1", "level": "info", "stage": "gate", "event": "done"}
