"""Long cycles, tau in parts, cells and sheets as stored, command lines, model client."""

import json
import random
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from formweave import cli
from formweave.functions.coerce import text_value
from formweave.operators import blocks, graph, judges, model_client, workbooks
from formweave.plans import pipeline
from formweave.sources import catalog, xlsx

LINKED = "fixture_id string, block_id string, parent_link struct<parent_block_id:string,relation:string>"


def linked(spark, rows):
    return spark.createDataFrame([(f, a, (b, "x") if b else None) for f, a, b in rows], LINKED)


def test_cycles_of_any_length(spark):
    rows = [("chain", f"c{i}", f"c{i - 1}" if i else None) for i in range(1000)]
    rows += [("ring", f"r{i}", f"r{(i + 1) % 300}") for i in range(300)] + [("ring", f"t{i}", f"t{i + 1}" if i < 199 else "r7") for i in range(200)]
    rows += [("self", "s", "s"), ("two", "a", "b"), ("two", "b", "a"), ("gone", "a", "nowhere")]
    got = {tuple(r) for r in graph.cycle_members(linked(spark, rows)).collect()}
    assert got == {("ring", f"r{i}") for i in range(300)} | {("self", "s"), ("two", "a"), ("two", "b")}
    assert graph.cycle_members(linked(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [7, 1 << 16])
def test_tau_in_parts(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "TAU_ROWS", limit)
    rng = random.Random(limit)
    rows = [("many", rng.randrange(60), rng.randrange(40)) for _ in range(300)] + [("ties", 5, rng.randrange(30)) for _ in range(60)] + [("ties", rng.randrange(9), 3) for _ in range(40)]
    rows += [("small", 1, 2), ("small", 2, 1), ("one", 1, 1), ("sorted", 0, 0), *[("sorted", i, -i) for i in range(1, 50)]]
    got = {r.fixture_id: (r.concordant, r.discordant, r.tau) for r in blocks.kendall_tau(spark.createDataFrame(rows, "fixture_id string, x int, y int")).collect()}
    for f in {r[0] for r in rows}:
        mine = [(x, y) for g, x, y in rows if g == f]
        signs = [(a[0] - b[0]) * (a[1] - b[1]) for i, a in enumerate(mine) for b in mine[:i]]
        c, d = sum(s > 0 for s in signs), sum(s < 0 for s in signs)
        assert got[f] == (c, d, (c - d) / (c + d) if c + d else 1.0)


def test_contiguity_reads_numbers_as_written(spark):
    cases = {"plain": ["1", "2.0", "3.9"], "space": ["1", " 2\n", " ", "\n"], "suffix": ["1d", "2d"], "comma": ["1", "2,0"], "under": ["1", "2", "1_0"], "ten": [str(i) for i in range(1, 10)] + ["1_0"], "word": ["1", "x"], "nan": ["nan"]}
    d = spark.createDataFrame([(k, s) for k, v in cases.items() for s in v], "fixture_id string, s string")
    got = {r.fixture_id: r.contiguous for r in workbooks.contiguous(d).collect()}
    assert {k for k, v in got.items() if v} == {"plain", "space", "ten"}


def test_vocabulary_lookup_and_columns(spark):
    values = spark.createDataFrame([("f", i, v) for i, v in enumerate(["\tQuestionType\n", "Text Box", " ", "text box ", "STRASSE", "Radio"])], "fixture_id string, row int, value string")
    vocab = workbooks.vocabulary(values)
    assert sorted(r.value for r in vocab.collect()) == ["Radio", "STRASSE", "Text Box"]
    asked = spark.createDataFrame([("f", v) for v in (" TEXT box", "straße", "none", None, "")], "fixture_id string, value string")
    assert {r.value: r.entry for r in workbooks.lookup_vocabulary(asked, vocab).collect()} == {" TEXT box": "Text Box", "straße": "STRASSE", "none": None, None: None, "": None}
    s = spark.createDataFrame([("f", ["A", " B ", "B", None])], "fixture_id string, headers array<string>")
    assert [workbooks.column_index(s, h).first().col for h in ("B", " A", "C")] == [2, 1, None]


def test_header_meta_ends_with_the_headers(spark):
    cells = [("f", 1, 1, "title"), ("f", 1, 9, "far")]
    ref = spark.createDataFrame(cells, "fixture_id string, row int, col int, s string").select("fixture_id", "row", "col", text_value(F.col("s")).alias("value"))
    sheets = spark.createDataFrame([("f", 3, ["a", "b"])], "fixture_id string, header_row int, headers array<string>")
    r = workbooks.header_meta_accuracy(ref, ref.where("col = 1"), sheets).first()
    assert (r.total, r.correct, r.accuracy) == (1, 1, 1.0)


@pytest.fixture
def merged_book(tmp_path):
    path = tmp_path / "evals" / "golden.xlsx"
    path.parent.mkdir()
    rows = [["Title", None, None], ["Section", None, "Sequence"], ["Über", "x", 1], [None, None, None], [None, None, None]]
    xlsx.write_workbook(path, {"Assessment": rows, "Values": [[None, None, "QuestionType"], [None, None, " Text Box\n"]]}, {"Assessment": ["A2:B2", "A3:A5"]}, {"Assessment": "A3"})
    part, book = "xl/worksheets/sheet1.xml", "xl/workbook.xml"
    with zipfile.ZipFile(path) as z:
        files = {n: z.read(n).decode() for n in z.namelist()}
    files[part] = files[part].replace("</worksheet>", '<dataValidations count="1"><dataValidation sqref="C4:C9 D4:D9"/></dataValidations></worksheet>').replace(' state="frozen"', "")
    files[book] = files[book].replace("</workbook>", '<definedNames><definedName name="Types">x</definedName><definedName name="own" localSheetId="0">x</definedName><definedName name="_xlnm.Print_Area">x</definedName></definedNames></workbook>')
    with zipfile.ZipFile(path, "w") as z:
        for n, data in files.items():
            z.writestr(n, data)
    return path


def test_sheets_come_from_stored_cells(spark, merged_book):
    fixture = SimpleNamespace(id="f", header_row=2, question_sheet="Assessment")
    cells, sheet, vocab = cli._side(spark, str(merged_book), fixture)
    s = sheet.first()
    assert (s.headers, s.data_end_row, s.frozen_panes) == (["Section", "", "Sequence"], 3, "A3")
    assert s.data_validations == ["C4:C9", "D4:D9"] and s.named_ranges == ["Types"]
    assert [r.value for r in vocab.collect()] == ["Text Box"]
    assert {(r.row, r.col): r.value.s for r in cells.collect()}[5, 1] == "Über"  # covered by the merge


def catalogue(tmp_path, pdf="a.pdf"):
    y = tmp_path / "evals" / "fixtures.yaml"
    y.write_text(f"fixtures:\n  - {{id: FX-1, pdf_path: {pdf}, golden_xlsx_path: evals/golden.xlsx, reference_xlsx_path: evals/golden.xlsx, question_sheet: Assessment, header_row: 2}}\n")
    return y


def test_convert_command(spark, merged_book, tmp_path, capsys):
    y, out = catalogue(tmp_path), tmp_path / "o" / "made.xlsx"
    assert cli.main(["convert", "--fixture", "FX-1", "--out", str(out), "--fixtures", str(y), "--config", str(tmp_path / "none.yaml")]) == 0
    assert capsys.readouterr().out.strip() == str(out)
    made = xlsx.read_cells(spark, str(out)).where("sheet = 'Assessment'")
    assert {r.row for r in made.collect()} == {1, 2}  # no parser for the source: the template, blanked
    (tmp_path / "page.html").write_text("<h1>Intake</h1><p>Your name:</p><p>______</p>")
    y = catalogue(tmp_path, "page.html")
    assert cli.main(["convert", "--fixture", "FX-1", "--out", str(out), "--fixtures", str(y)]) == 0
    assert xlsx.read_cells(spark, str(out)).where("sheet = 'Assessment' and row > 2").count() > 0
    config = tmp_path / "off.yaml"
    for stage in ("extraction", "mapping", "output"):
        config.write_text(f"stages: {{{stage}: false}}\n")
        assert cli.main(["convert", "--fixture", "FX-1", "--out", str(out), "--fixtures", str(y), "--config", str(config)]) == 0
        assert xlsx.read_cells(spark, str(out)).where("sheet = 'Assessment' and row > 2").count() == 0


def test_evaluation_command(spark, merged_book, tmp_path, capsys):
    y = catalogue(tmp_path)
    assert cli.main(["run", "--eval", "c", "--all", "--fixtures", str(y), "--out", str(tmp_path / "r")]) == 0
    assert "[PASS] Eval C FX-1" in capsys.readouterr().out
    names = {m["name"]: m for m in json.loads((tmp_path / "r" / "FX-1.C.json").read_text())["metrics"]}
    assert set(names) == {"workbook_distance", "row_count_delta"} and names["row_count_delta"]["passed"] is True
    worse = tmp_path / "worse.xlsx"
    xlsx.write_workbook(worse, {"Assessment": [["Title"], ["Section", None, "Sequence"], ["Other", None, 2]], "Values": [[None]]})
    assert cli.main(["run", "--eval", "B", "--fixture", "FX-1", "--fixtures", str(y), "--candidate", str(worse), "--out", str(tmp_path / "r")]) == 1
    assert "[FAIL] Eval B FX-1" in capsys.readouterr().out
    names = {m["name"]: m for m in json.loads((tmp_path / "r" / "FX-1.B.json").read_text())["metrics"]}
    assert names["sequence_contiguity"]["passed"] is False and names["header_meta_accuracy"]["passed"] is None
    assert names["per_column_accuracy[Section]"]["details"]["total"] == 1 and names["row_count_delta"]["details"] == {"candidate": 1, "reference": 1}
    assert names["formatting_preservation"]["details"]["merges_equal"] is False


def test_model_client():
    asked = []

    def send(model, body):
        asked.append((model, json.loads(body)))
        return json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]})

    client = model_client.ModelClient(model_client.ModelSettings("m", "r", max_tokens=7), send)
    assert client.invoke("hello", system="be brief") == "ab" and client.invoke("x") == "ab"
    assert asked[0][0] == "m" and asked[0][1]["max_tokens"] == 7 and asked[0][1]["system"] == "be brief" and asked[0][1]["messages"] == [{"role": "user", "content": "hello"}]
    assert "system" not in asked[1][1]
    config, context = pipeline.Config(model={"model_id": "m", "region": "r", "other": 1}), pipeline.Context("o", "t", "s", 1)
    made = []
    assert pipeline.build(config, context, refiner=made.append).refiner is None and not made
    pipeline.build(config, context, with_llm=True, refiner=made.append)
    assert made[0].settings.model_id == "m"
    off = pipeline.Config(stages=pipeline.Stages(llm=False))
    assert pipeline.build(off, context, with_llm=True, refiner=made.append).refiner is None and len(made) == 1


def test_judge_and_config(tmp_path, monkeypatch):
    stub = judges.StubJudge(default="yes")
    judge = judges.resolve_judge(stub)
    assert [judge("a", "b"), judge("a", "b")] == ["yes"] * 2 and len(stub.calls) == 1
    monkeypatch.chdir(tmp_path)
    assert catalog.load_config(tmp_path / "missing.yaml") == catalog.load_config()
