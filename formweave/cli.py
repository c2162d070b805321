"""Command line: run the pipeline on a fixture, and evaluate workbooks of a fixture catalogue.

    python -m formweave.cli convert --fixture ID --out FILE [--config FILE] [--fixtures FILE] [--with-llm]
    python -m formweave.cli run --eval B|C [--fixture ID | --all] [--candidate FILE or FOLDER] [--out FOLDER]

``convert`` prints the path of the workbook that it wrote.  ``run`` prints a line ``[PASS]`` or ``[FAIL]`` for each
fixture; its exit code is 1 if any fails.  ``--candidate`` is a workbook, or a folder of <fixture id>.xlsx files;
without it the golden file is compared with itself.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave import report
from formweave.operators import workbooks
from formweave.plans import pipeline
from formweave.sources import catalog, xlsx


def _side(spark: SparkSession, path: str, fixture) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (merged ranges expanded), sheet dimension and vocabulary of one workbook, tagged with the fixture."""
    raw, dims = xlsx.read_cells(spark, path), xlsx.read_sheets(spark, path)
    tag = F.lit(fixture.id).alias("fixture_id")
    sheet = xlsx.sheet_dimension(raw, dims, fixture.header_row, fixture.question_sheet)
    vocab = xlsx.controlled_vocabulary(raw).select(tag, "row", "value")
    cells = xlsx.expand_merges(raw.where(F.col("sheet") == fixture.question_sheet), dims.where(F.col("sheet") == fixture.question_sheet))
    inside = cells.join(sheet.select("workbook", F.size("headers").alias("width")), "workbook").where("col <= width")
    return inside.select(tag, "row", "col", "value"), sheet.select(tag, "*"), workbooks.vocabulary(vocab)


def evaluate(spark: SparkSession, fixture, candidate: str, which: str) -> dict:
    """The result of evaluation B or C for one fixture."""
    rc, rs, vocab = _side(spark, fixture.reference_xlsx_path, fixture)
    cc, cs, _ = _side(spark, candidate, fixture)
    rc, rs, cc, cs, vocab = (x.cache() for x in (rc, rs, cc, cs, vocab))
    b = workbooks.evaluate(rc, rs, cc, cs, vocab)
    row = b.first().asDict(recursive=True)
    delta_ok = abs(row["row_count_delta"]) <= workbooks.ROW_DELTA
    if which == "C":
        cols = workbooks.per_column_accuracy(rc, rs, cc, cs)
        d = workbooks.distance(cols, b.select("fixture_id", "out_of_vocab", "sequence_contiguity", "formatting_preservation")).first()
        metrics = [report.metric("workbook_distance", d.distance, d.passed, {"base": d.base, "penalties": d.penalties}), report.metric("row_count_delta", row["row_count_delta"], delta_ok)]
        return {"fixture_id": fixture.id, "eval_name": "C", "metrics": metrics, "passed": d.passed, "notes": ""}
    sizes = [s.select(workbooks.row_count().alias("n")).first()[0] for s in (cs, rs)]
    checks = workbooks.formatting_preservation(rs, cs).drop("fixture_id", "formatting_preservation").first().asDict()
    listed = workbooks.branching_validity(cc, cs).first()["total"]
    meta = workbooks.header_meta_accuracy(rc, cc, rs).first()["total"]
    metrics = [
        report.metric("row_count_delta", row["row_count_delta"], delta_ok, {"candidate": sizes[0], "reference": sizes[1]}),
        report.metric("controlled_vocab_validity", row["controlled_vocab_validity"], row["controlled_vocab_validity"] >= workbooks.VOCAB_THRESHOLD, {"out_of_vocab": row["out_of_vocab"]}),
        report.metric("yes_no_validity", row["yes_no_validity"], row["yes_no_validity"] >= 1.0),
        report.metric("branching_syntactic_validity", row["branching_syntactic_validity"], row["branching_syntactic_validity"] >= workbooks.BRANCHING_THRESHOLD, {"total_with_branching": listed}),
        report.metric("sequence_contiguity", row["sequence_contiguity"], row["sequence_contiguity"]),
        report.metric("formatting_preservation", row["formatting_preservation"], row["formatting_preservation"], checks),
        report.metric("header_meta_accuracy", row["header_meta_accuracy"], None, {"sub_count": meta}),
    ]
    for c in workbooks.per_column_accuracy(rc, rs, cc, cs).orderBy("col").collect():  # one row a column
        details = {"priority": c.priority, "matched": c.correct, "total": c.total, "threshold": c.threshold}
        metrics.append(report.metric(f"per_column_accuracy[{c.header}]", c.accuracy, None if c.priority == "unclassified" else c.passed, details))
    return {"fixture_id": fixture.id, "eval_name": "B", "metrics": metrics, "passed": row["passed"], "notes": ""}


def convert(spark: SparkSession, args: argparse.Namespace) -> int:
    config = catalog.load_config(args.config)
    fixture = catalog.find_fixture(catalog.load_fixtures(spark, args.fixtures or config.fixtures_yaml), args.fixture)
    context = pipeline.Context(args.out, fixture.golden_xlsx_path, fixture.question_sheet, fixture.header_row)
    print(pipeline.build(config, context, args.with_llm)(spark, fixture.pdf_path))
    return 0


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    config = catalog.load_config(args.config)
    fixtures = catalog.load_fixtures(spark, args.fixtures or config.fixtures_yaml)
    every = args.all or args.fixture == "all"
    chosen = fixtures.collect() if every else [catalog.find_fixture(fixtures, args.fixture)]
    passed = True
    for fixture in chosen:  # a handful of catalogue rows; each evaluation is distributed
        candidate = fixture.golden_xlsx_path
        if args.candidate:
            candidate = str(Path(args.candidate) / f"{fixture.id}.xlsx") if Path(args.candidate).is_dir() else args.candidate
        result = evaluate(spark, fixture, candidate, args.eval)
        passed &= bool(result["passed"])
        for path in report.write_report(result, args.out):
            print(path)
        print(f"[{'PASS' if result['passed'] else 'FAIL'}] Eval {result['eval_name']} {result['fixture_id']}")
    return 0 if passed else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="formweave")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert")
    one.add_argument("--fixture", required=True)
    one.add_argument("--out", required=True)
    one.add_argument("--with-llm", action="store_true")
    many = commands.add_parser("run")
    many.add_argument("--eval", type=str.upper, choices=["B", "C"], default="B")
    some = many.add_mutually_exclusive_group()
    some.add_argument("--fixture", default="all")
    some.add_argument("--all", action="store_true")
    many.add_argument("--candidate")
    many.add_argument("--out", default="evals/reports")
    for command in (one, many):
        command.add_argument("--config")
        command.add_argument("--fixtures")
    args = parser.parse_args(argv)
    catalog.load_env()
    spark = SparkSession.builder.appName("formweave").getOrCreate()
    return convert(spark, args) if args.command == "convert" else run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
