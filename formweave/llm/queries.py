"""Queries of the corpus operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import chat, sharding



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formweave.llm import main_text

    return main_text.extract(_table(spark, sf_dir, "pages"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formweave.llm import secrets

    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formweave.llm import language_id

    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit_sample(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formweave.llm import fingerprints

    return fingerprints.fingerprints(fingerprints.with_next(_table(spark, sf_dir, "documents")))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formweave.llm import media

    return media.media_columns(_table(spark, sf_dir, "documents"), media=False, tensors=False)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formweave.llm import jaccard_join

    found = jaccard_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85, count_links=True)
    return found.documents.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from formweave.llm import byte_bpe

    return byte_bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(_table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formweave.llm import mixing

    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_secret_scans, op3_language_id, op4_document_fingerprints, op5_media_columns, op6_extendible_shards, op7_ngram_jaccard_join, op8_byte_bpe, op9_chat_formatting, op10_source_mixing)
}
SQL: dict[str, str] = {"op6_extendible_shards": sharding.SQL, "op9_chat_formatting": chat.SQL}
