"""BM25 over word counts: examples for a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.2, 0.75


def _words(df: DataFrame, key: str) -> DataFrame:
    w = F.explode(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    return df.select(key, w.alias("word"))


#: Fixed value: examples that the bank holds.
BANK = 20


def bank_of(docs: DataFrame, size: int = BANK) -> DataFrame:
    """The bank of examples: the ``size`` newest (largest doc_id), so that it rotates as examples are added."""
    return docs.where("doc_id is not null").orderBy(F.desc("doc_id"), F.desc("text")).limit(size)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, bank: int = BANK) -> DataFrame:
    """query_id, doc_id, rank, score of the ``k`` best documents of the bank for each query (doc_id decides ties).

    A word has one row with all its postings, ``bank`` at most, so a query's word meets one row however frequent
    the word is, and scores are summed by query before any shuffle.  Queries without a word of the bank give no row;
    those of one id are one query."""
    tf = _words(bank_of(docs, bank), "doc_id").groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    by_doc, by_word = Window.partitionBy("doc_id"), Window.partitionBy("word")
    tf = tf.withColumns({"len": F.sum("tf").over(by_doc), "df": F.count("*").over(by_word)})
    stats = tf.select("doc_id", "len").distinct().agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    postings = tf.join(F.broadcast(stats)).groupBy("word").agg(F.collect_list(F.struct("doc_id", weight.alias("w"))).alias("postings"))
    hits = _words(queries, "query_id").distinct().join(postings, "word").select("query_id", F.inline("postings"))
    hits = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)
