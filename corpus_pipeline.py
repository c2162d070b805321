"""A training-data pipeline over ``documents``: each stage applies one corpus operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
the documents it keeps, with the columns of ``documents``; the last one returns
tokens.  Each result is written as Parquet and reread as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.llm import byte_bpe, jaccard_join, language_id, mixing, secrets
from formweave.llm.common import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no text, no letters) go; a missing label is filled."""
    found = language_id.identify(docs, language_id.fit_sample(docs), keep=COLUMNS)
    found = found.where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _told_apart(docs: DataFrame) -> DataFrame:
    """Adds ``one``: doc_id, but an id of its own, above all others, for each further text of a repeated doc_id."""
    docs = docs.withColumn("hash", F.xxhash64("text"))
    clash = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low <> high")
    clash = stash(clash.select("doc_id", "low"), "clash")
    if clash.isEmpty():
        return docs.withColumn("one", F.col("doc_id")).drop("hash")
    top = docs.agg(F.max("doc_id")).first()[0]
    more = docs.join(clash, "doc_id").where("hash <> low").select("doc_id", "hash").distinct()
    more = stash(more.withColumn("own", F.monotonically_increasing_id() + F.lit(top + 1)), "further")
    return docs.join(more, ["doc_id", "hash"], "left").withColumn("one", F.coalesce("own", "doc_id")).drop("hash", "own")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5 words, 0.8) the document of the smallest id stays; rows without an id all stay.

    Different texts that share an id are documents of their own, of which all but one come after all ids."""
    docs = docs.select(*COLUMNS)
    rows = _told_apart(docs)
    joined = jaccard_join.ngram_jaccard_join(rows.select(F.col("one").alias("doc_id"), "text"), n=5, percent=80).documents
    ids = joined.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("one")).distinct()
    kept = rows.join(ids, "one", "left_semi")
    once = Window.partitionBy("one").orderBy(F.xxhash64("text"))
    kept = kept.withColumn("copy", F.row_number().over(once)).where(F.col("copy") == 1).drop("copy")
    return kept.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull())).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found, encoded ones too, is replaced by a mark; n_chars follows the text."""
    found = secrets.scan_secrets(docs, keep=("doc_id", "lang", "source", "n_chars"), redact=True)
    size = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.char_length("redacted").cast(docs.schema["n_chars"].dataType))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    mixed = mixing.mix(docs, keep=COLUMNS)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select("kept.*").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids and digests."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: Language ID and the fitted mix are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
