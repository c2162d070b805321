"""Sharding by extendible hashing: only oversized buckets split, each on one more bit of the hash.

Every row's key is hashed to 60 bits.  A bucket is a prefix of them; a bucket of
more than ``limit_bytes`` is replaced by the two that its next bit makes, until
every shard fits.  All splits are found from sums by prefix: rows are summed
once at a depth at which most buckets fit, only buckets still too large are
summed again some bits deeper, and the small tree of sums is then cut at the
first prefixes that fit.  Rows are never gathered by bucket, and only ids and
sizes are shuffled.

Defined results: a null size counts 0 and a null key hashes as an empty string;
rows of one key stay together, so a key (or one row) of more than the limit is
a shard of its own with ``fits`` false, at the first bit that parts it from all others; ties and repeated rows need
no order; an empty table has no shards; other columns do not matter.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.llm.common import stash

#: Bytes of text in a shard: the unit that a streaming reader fetches and shuffles whole.
LIMIT_BYTES = 1 << 20
HASH_BITS, STEP_BITS = 60, 12


def key_hash(key: Column) -> Column:
    """60 bits of the md5 of a key as text, as a bigint."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("h", HASH_BITS - depth)


def tree(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """(depth, prefix, bytes, low, high) of leaf buckets, with the least and greatest hash: all at one depth, or
    deeper where that was still too large and had keys to part."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total) / limit_bytes)) + 3))
    open_rows, found = rows, None
    while True:
        sums = open_rows.groupBy(_prefix(depth).alias("prefix")).agg(F.sum("size").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
        level = sums.withColumn("depth", F.lit(depth)).withColumn("more", (F.col("bytes") > limit_bytes) & (F.col("low") < F.col("high")))
        found = level if found is None else found.where(~F.col("more")).unionByName(level)
        if depth == HASH_BITS or level.where("more").isEmpty():
            return found.select("depth", "prefix", "bytes", "low", "high")
        large = level.where("more").select("prefix")
        open_rows = open_rows.withColumn("prefix", _prefix(depth)).join(large, "prefix", "left_semi").drop("prefix")
        depth = min(HASH_BITS, depth + STEP_BITS)


def directory(leaves: DataFrame, limit_bytes: int) -> DataFrame:
    """(leaf_depth, leaf_prefix, depth, prefix, shard_bytes): the shard of each leaf bucket."""
    up = leaves.select(F.col("depth").alias("leaf_depth"), F.col("prefix").alias("leaf_prefix"), "bytes", "low", "high", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("depth"))
    up = up.withColumn("prefix", F.expr("shiftrightunsigned(leaf_prefix, leaf_depth - depth)"))
    nodes = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), (F.min("low") == F.max("high")).alias("alone"))
    marked = up.drop("bytes", "low", "high").join(nodes, ["depth", "prefix"])
    # the shortest prefix that fits or has one key, else (equal hashes aside, there is none) the leaf itself
    good = F.when((F.col("shard_bytes") <= limit_bytes) | F.col("alone"), F.struct("depth", "prefix", "shard_bytes"))
    own = F.max(F.struct("depth", "prefix", "shard_bytes"))
    best = marked.groupBy("leaf_depth", "leaf_prefix").agg(F.coalesce(F.min(good), own).alias("s"))
    return best.select("leaf_depth", "leaf_prefix", "s.*")


def extendible_shards(df: DataFrame, key: str, size: Column, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """key, n_bytes, shard (its bits, "" for the root), depth, shard_bytes, fits: one row each of ``df``."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")).alias("size"), key_hash(F.col(key)).alias("h"))
    rows = stash(rows, "sizes")  # texts are read once
    shards = stash(directory(tree(rows, limit_bytes), limit_bytes), "shards")
    depths = [r[0] for r in shards.select("leaf_depth").distinct().orderBy("leaf_depth").collect()]  # at most 5
    # each row has one leaf: the deepest prefix that is one
    if len(depths) < 2:  # none: no rows
        joined = rows.withColumn("leaf_prefix", _prefix(depths[0] if depths else 1)).join(shards, "leaf_prefix")
    else:
        options = F.array(*[F.struct(F.lit(d).alias("leaf_depth"), _prefix(d).alias("leaf_prefix")) for d in depths])
        joined = rows.withColumn("o", F.explode(options)).select("key", "size", "h", "o.*").join(shards, ["leaf_depth", "leaf_prefix"])
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return joined.select(F.col("key").alias(key), F.col("size").alias("n_bytes"), bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") <= limit_bytes).alias("fits"))


SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), t AS (
  SELECT 0 AS depth, 0::BIGINT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(DISTINCT h) AS keys FROM r
  UNION ALL
  SELECT depth + 1, prefix * 2 + bit, (SELECT sum(n_bytes)::BIGINT FROM r WHERE h >> (59 - depth) = prefix * 2 + bit),
    (SELECT count(DISTINCT h) FROM r WHERE h >> (59 - depth) = prefix * 2 + bit)
  FROM t, (VALUES (0), (1)) b(bit) WHERE shard_bytes > {LIMIT_BYTES} AND keys > 1
)
SELECT doc_id, n_bytes,
  coalesce((SELECT string_agg((prefix >> i & 1)::VARCHAR, '' ORDER BY i DESC) FROM range(depth) x(i)), '') AS shard,
  depth, shard_bytes, shard_bytes <= {LIMIT_BYTES} AS fits
FROM r JOIN t ON h >> (60 - depth) = prefix AND (shard_bytes <= {LIMIT_BYTES} OR keys = 1)
"""
