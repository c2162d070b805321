"""The pipeline: one lazy chain of transforms, with a switch for each stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.functions import text
from formweave.operators.model_client import ModelClient, ModelSettings
from formweave.plans import gate, mapping, rules
from formweave.sources import xlsx


@dataclass(frozen=True)
class Stages:
    extraction: bool = True
    classification: bool = True
    gate: bool = True
    llm: bool = True
    merge: bool = True
    mapping: bool = True
    output: bool = True


@dataclass(frozen=True)
class Config:
    """Thresholds and switches; enter the plans as literals."""

    pipeline_version: str = "v1"
    gate_confidence: float = gate.GATE_CONFIDENCE
    min_block_confidence: float = gate.LEAST_CONFIDENCE
    stages: Stages = field(default_factory=Stages)
    model: dict = field(default_factory=lambda: {"model_id": "", "region": "", "max_tokens": 4096, "temperature": 0.0, "timeout_seconds": 60})
    fixtures_yaml: str = "evals/fixtures.yaml"
    default_template_xlsx: str | None = None
    log_level: str = "INFO"
    log_renderer: str = "console"


#: A refiner takes the deferred blocks and returns refinements by (fixture_id, block_id).
Refiner = Callable[[DataFrame], DataFrame]


def merged(blocks: DataFrame, config: Config | None = None, refiner: Refiner | None = None) -> DataFrame:
    """Blocks after classification, gate, refinement and merge.  A stage that is off passes its input on."""
    config = config or Config()
    on = config.stages
    b = rules.with_inline_inputs(rules.link_parents(rules.classify(blocks))) if on.classification else blocks
    b = gate.gate(b, config.gate_confidence) if on.gate else b.withColumn("routed", gate.routed(-1.0))
    accepted, deferred = b.where("not routed"), b.where("routed")
    enriched = gate.refine(deferred, refiner(deferred)) if on.llm and refiner else deferred
    if not on.merge:
        return gate.merge(accepted, enriched, float("-inf"))
    return gate.merge(accepted, enriched, config.min_block_confidence)


def run(blocks: DataFrame, config: Config | None = None, refiner: Refiner | None = None) -> DataFrame:
    """Mapped rows of all documents (none if mapping is off)."""
    config = config or Config()
    m = merged(blocks, config, refiner)
    rows = mapping.map_rows(m)
    return rows if config.stages.mapping else rows.limit(0)


def null_pipeline(golden: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A pipeline that returns the golden result, for checking the evaluations."""
    return lambda _: golden


@dataclass(frozen=True)
class Context:
    """Where a run writes, and the template whose sheet it fills."""

    out_path: str
    template_xlsx: str
    question_sheet: str
    header_row: int
    template_version: str | None = None  # pinned: a run with another template is refused


#: Raw blocks of a source document.
Extractor = Callable[[SparkSession, str], DataFrame]


def extract(spark: SparkSession, path: str) -> DataFrame:
    """Raw blocks of the headings and paragraphs of an HTML file; no blocks for other files, as no parser is at hand."""
    empty = "fixture_id string, pos int, block_id string, page int, reading_order int, text string"
    if not path.lower().endswith((".html", ".htm")):
        return spark.createDataFrame([], empty)
    page = spark.read.text(path, wholetext=True)
    tags = r"(?is)<(p|h[1-6]|li|label)\b[^>]*>(.*?)(?=</?(?:p|h[1-6]|li|label|ul|ol|div|body)\b)"
    parts = F.regexp_extract_all("value", F.lit(tags), F.lit(2))
    rows = page.select(F.lit(path).alias("fixture_id"), F.posexplode(parts).alias("pos", "text"))
    return rows.select("fixture_id", "pos", F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"), F.lit(1).alias("page"), F.col("pos").alias("reading_order"), text.strip(F.regexp_replace("text", r"<[^>]*>", "")).alias("text"))


@dataclass(frozen=True)
class WorkbookPipeline:
    """From a source document to a workbook: all stages, then the template with the mapped rows.  Returns the path."""

    config: Config
    context: Context
    refiner: Refiner | None = None
    extractor: Extractor = extract

    def __call__(self, spark: SparkSession, source: str) -> str:
        on, at = self.config.stages, self.context
        if at.template_version:
            xlsx.require_version(at.template_xlsx, at.template_version)
        blocks = self.extractor(spark, source) if on.extraction else extract(spark, "")
        rows: Iterator[tuple] = iter(())
        if on.mapping and blocks.columns and not blocks.isEmpty():
            mapped = run(blocks, self.config, self.refiner)
            names = [f for f in mapped.columns if f not in ("fixture_id", "block_id", "pos")]
            rows = (tuple(r) for r in mapped.orderBy("fixture_id", "sequence").select(*names).toLocalIterator())
        # with output off the template is cloned and blanked, as there is nothing to append
        xlsx.write_from_template(at.template_xlsx, at.out_path, at.question_sheet, at.header_row, rows if on.output else ())
        return at.out_path


def build(config: Config, context: Context, with_llm: bool = False, client: ModelClient | None = None, refiner: Callable[[ModelClient], Refiner] | None = None) -> WorkbookPipeline:
    """A pipeline with a model only if asked for and the stage is on; ``refiner`` makes one from the client."""
    if not (with_llm and config.stages.llm):
        return WorkbookPipeline(config, context)
    known = {f.name for f in fields(ModelSettings)}
    client = client or ModelClient(ModelSettings(**{k: v for k, v in config.model.items() if k in known}))
    return WorkbookPipeline(config, context, refiner(client) if refiner else None)
