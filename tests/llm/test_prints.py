"""Fingerprints and next documents against brute force over whole tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from formweave.llm import fingerprints, queries


def brute(rows):
    """(edited text, next text) of each row by (id, hash of the text), null ids first."""

    def key(r):
        h = xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
        return (r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h)

    order = sorted(rows, key=key)
    out = []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = r[1] or "", after[1] or ""
        out.append((r[0], t, t[: len(t) - len(t) // 2] + n[: len(t) // 2], n))
    return out


def jaccard(a, b):
    """Of multisets of units."""

    def marked(text):
        seen, out = {}, set()
        for u in fingerprints.units(text):
            seen[u] = seen.get(u, 0) + 1
            out.add((u, seen[u]))
        return out

    x, y = marked(a), marked(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def made(n, seed):
    rng = random.Random(seed)
    words = ["one", "two", "three. ", "four\n", "fünf", "🎉!"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(12)]
    return [(i * 3, rng.choice([None, "", *base, rng.choice(base) + f" more {i}."])) for i in range(n)]


@pytest.mark.parametrize("part", [1000, 7, 2])
def test_whole_table(spark, tmp_path, part):
    rows = made(150, part)
    hot = [(200_000, f"text {i}. And more.") for i in range(60)] + [(None, f"no id {i}") for i in range(40)] + [(90, f"also {i}") for i in range(30)]
    rows += hot + [(7, "x" * 300_000), (10**15, "the last"), (-5, "below")]
    d = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, fingerprint string, __p int").repartition(6)
    pairs = fingerprints.with_next(d.drop("__p"), rows_a_part=part)
    got = fingerprints.fingerprints(pairs).collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), r.edited_sha256, r.n_chars, round(r.near_edited, 12), round(r.near_next, 12)) for r in got) == sorted(
        (str(i), hashlib.sha256(e.encode()).hexdigest(), len(t), round(jaccard(t, e), 12), round(jaccard(t, n), 12)) for i, t, e, n in want
    )
    if part == 2:  # slices of the ids of many rows, and cuts
        parts = pairs.select("doc_id").rdd.glom().map(len).collect()
        assert sum(parts) == len(rows)
        d.write.parquet(f"{tmp_path}/documents.parquet")
        query = queries.op4_document_fingerprints(spark, str(tmp_path))
        assert {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"} <= set(query.columns)
        assert query.count() == len(rows)


def test_parts_are_small(spark):
    """No part of the order is much larger than asked for, whatever ids are frequent."""
    rows = [(i, f"t {i}") for i in range(600)] + [(700, f"u {i}") for i in range(300)] + [(None, f"v {i}") for i in range(300)]
    d = spark.createDataFrame(rows, "__o bigint, __t string").withColumn("__h", F.xxhash64("__t"))
    got = fingerprints.in_parts(d, 10).groupBy("__p").agg(F.count("*").alias("n"), F.min("__o").alias("low"), F.max("__o").alias("high")).orderBy("__p").collect()
    assert sum(r.n for r in got) == len(rows) and max(r.n for r in got) < 120 and len(got) > 25  # a part is about 35 rows
    ends = [(r.low, r.high) for r in got if r.low is not None]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_odd_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    assert fingerprints.fingerprints(fingerprints.with_next(d)).count() == 0
    for rows in ([(1, "One. Two.")], [(None, None)], [(None, "a b"), (None, "c d")], [(3, "same")] * 5):
        one = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = fingerprints.fingerprints(fingerprints.with_next(one, rows_a_part=1)).collect()
        assert sorted((r.edited_sha256, r.near_next) for r in got) == sorted((hashlib.sha256(e.encode()).hexdigest(), jaccard(t, n)) for _, t, e, n in brute(rows))


def test_stored_prints_are_read_back_and_subtracted():
    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 9, 40, 3000)]
    sizes, cells = fingerprints.read(fingerprints.stored(keys))
    assert sizes.tolist() == [len(k) for k in keys]
    assert all((x == y).all() for x, y in zip(cells, fingerprints.sketches(keys), strict=True))
    a = keys[4]
    b = np.concatenate([a[4:], np.array([5, 6, 7], np.uint64)])
    (found,) = fingerprints.compare(fingerprints.stored([a]), fingerprints.stored([b]))
    assert sorted(found.tolist()) == sorted(np.setxor1d(a, b).tolist())
    assert fingerprints.compare(fingerprints.stored([a]), fingerprints.stored([keys[3]])) == [None]  # too many: larger sketches are needed
    assert sorted(fingerprints.differing([(a, keys[3])])[0].tolist()) == sorted(np.setxor1d(a, keys[3]).tolist())
