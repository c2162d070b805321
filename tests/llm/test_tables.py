"""Operators across rows, against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import same_rows
from formweave.llm import chat, components, fingerprints, jaccard_join, mixing, queries, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def test_peeling_recovers_differences():
    rng = np.random.default_rng(1)
    pairs = []
    for n, m, d in ((0, 0, 0), (5, 5, 0), (0, 40, 0), (300, 300, 20), (2000, 1500, 1500), (50, 50, 50)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: max(0, n - d)], rng.integers(0, 1 << 63, max(0, m - max(0, n - d))).astype(np.uint64)])
        pairs.append((np.unique(a), np.unique(b)))
    for (a, b), got in zip(pairs, fingerprints.differing(pairs), strict=True):
        assert sorted(got.tolist()) == sorted(np.setxor1d(a, b).tolist())
    for (a, b), x in zip(pairs, fingerprints.likeness(pairs), strict=True):
        u = len(np.union1d(a, b))
        assert x == (len(np.intersect1d(a, b)) / u if u else 1.0)


@pytest.mark.parametrize("part", [1000, 3])
def test_fingerprints(spark, part):
    rows = [(5, "One. Two. Three.\nFour"), (1, None), (9, "One. Two. Three.\nFour"), (2, ""), (3, "x" * 999), (3, "same id"), (30, "é. " * 200), (12, "tail"), (40, "a\nb\nc")]
    d = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, fingerprint string").repartition(3)
    got = fingerprints.fingerprints(fingerprints.with_next(d, rows_a_part=part)).collect()
    ids = {i for i, _ in rows if i != 3}
    by = {r.doc_id: r for r in got if r.doc_id in ids}
    order = [1, 2, 5, 9, 12, 30, 40]
    text = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for i, j in zip([5, 9, 12, 30, 40], [9, 12, 30, 40, 1], strict=True):
        t, nx = text[i], text[j]
        edited = t[: len(t) - len(t) // 2] + nx[: len(t) // 2]
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by[i].n_chars == len(t)
    assert by[5].fingerprint == by[9].fingerprint and by[5].near_next == 1.0 and len(order) == 7
    assert fingerprints.fingerprints(fingerprints.with_next(d.limit(0))).count() == 0


def sets(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    own, parent = [sets(t, n) for _, t in rows], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= percent * len(own[i] | own[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return {r[0]: (len(s), find(r[0])) for r, s in zip(rows, own, strict=True)}


def near_copies():
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(40)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(60):
        if i % 10 == 0:
            base = [*base]
            base[rng.randrange(120)] = f"z{i}"
        b = [*base]
        b[rng.randrange(120)] = f"q{i}"
        rows.append((1000 + i, " ".join(b)))
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(2000 + i, common + " " + " ".join(rng.choice(words) + str(i) for _ in range(rng.randrange(3, 14)))) for i in range(40)]
    rows += [(3000 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 7)))) for i in range(40)]
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\tTWO"), (6, "é " * 300), (7, "x" * 9000), (8, "Ünï one two three")]


@pytest.mark.parametrize("n,percent,run", [(4, 85, 4), (5, 80, 2)])
def test_jaccard_join(spark, monkeypatch, n, percent, run):
    monkeypatch.setattr(jaccard_join, "RUN", run)
    monkeypatch.setattr(jaccard_join, "COUNT_TOKENS", 2000)
    rows = near_copies()
    d = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, size string").repartition(4)
    d = d.unionByName(d.where("doc_id = 1005")).unionByName(spark.createDataFrame([(None, "no id at all", "c")], d.schema))
    got = jaccard_join.ngram_jaccard_join(d, n, percent).documents.collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows, n, percent)
    assert next(r.component_id for r in got if r.doc_id is None) is None


def test_jaccard_all_links(spark):
    rows = near_copies()[:30]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.a, r.b): (r.overlap, r.either) for r in jaccard_join.ngram_jaccard_join(d, 4, 85, all_links=True).links.collect()}
    own = {i: sets(t, 4) for i, t in rows}
    want = {(a, b): (len(own[a] & own[b]), len(own[a] | own[b])) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])}
    assert got == want


def test_empty_join(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.ngram_jaccard_join(d).documents.count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(35)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("limit", [100_000, 20_000, 2_000])
def test_sharding_equals_sql(spark, sf, duck, limit):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("shard", F.lit("clash"))
    got = sharding.extendible_shards(d, "doc_id", F.octet_length("text"), limit).toPandas()
    same_rows(got, duck.execute(sharding.SQL.replace(str(sharding.LIMIT_BYTES), str(limit))).df())
    assert got.depth.max() >= 2
    sizes = got.groupby("shard").agg(total=("n_bytes", "sum"), said=("shard_bytes", "first"), rows=("n_bytes", "size"))
    assert (sizes.total == sizes.said).all()
    assert ((sizes.total <= limit) | (sizes.rows == 1)).all()
    for a in sizes.index:  # shards are disjoint prefixes
        assert not any(b != a and b.startswith(a) for b in sizes.index)


def test_sharding_hot_key(spark):
    d = spark.createDataFrame([(k, s) for k in (1, 1, 1, 2, None) for s in (10, None)], "k int, s int")
    got = sharding.extendible_shards(d, "k", F.col("s"), 15).toPandas()
    assert len(got) == 10 and not got[got.k == 1].fits.any() and got[got.k == 2].fits.all()
    assert sharding.extendible_shards(d.limit(0), "k", F.col("s")).count() == 0


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\o\\e[<]", "[SYS] x [/SYS]", "", None, " lead and trail ", "a\nb", "é🎉", "[OUT] </s>", "\\\\[", "[ROLE x] y [/ROLE]"]


def test_chat_round_trip(spark):
    rng, rows = random.Random(4), []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system", "tool ]x", "", None]), rng.choice(NASTY)))
    d = spark.createDataFrame([(*r, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, valid string")
    f = chat.format_conversations(d)
    back = {r.conv_id: r.t for r in f.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append(((turn is not None, turn or 0), (role is not None, role or ""), text or "", role))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[:3])
        assert [(t.role, t.text) for t in back[c]] == [(x[3], x[2]) for x in turns]
    for r in f.collect():
        assert "".join(s.text for s in r.segments) == r.formatted


def test_chat_machine(spark):
    ok = [["user"], ["user", "assistant"], ["system", "user", "assistant", "user"]]
    bad = [["assistant"], ["user", "user"], ["system"], ["user", "system"], ["tool"], [None], ["user", "assistant", "assistant"]]
    d = spark.createDataFrame([(i, t, r, "x") for i, roles in enumerate(ok + bad) for t, r in enumerate(roles)], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.valid for r in chat.format_conversations(d).collect()}
    assert [got[i] for i in range(len(ok + bad))] == [True] * len(ok) + [False] * len(bad)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).df())


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        lengths = np.array(rng.sample(range(30), rng.randrange(1, 8)))
        counts = np.array([rng.randrange(5) for _ in lengths])
        budget = rng.randrange(200)
        got = mixing.fit(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * j for s in sums for j in range(c + 1) if s + n * j <= budget}
        assert (got >= 0).all() and (got <= counts).all() and (lengths * got).sum() == max(sums)


def fair_targets(size):
    """Water filling by bisection."""
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, low, high = 1.5 * sum(size.values()), 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * size[s], mid * weight[s]) for s in names) < budget else (low, mid)
    return {s: min(2 * size[s], high * weight[s]) for s in names}


def test_mixing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "é", None, "Z", "hot", "hot", "hot", "hot"]), " ".join(["w"] * rng.choice([0, 1, 2, 3, 50, 7]))) for i in range(500)] + [(900, "a", None), (901, "empty", ""), (902, "one", "x" * 50), (902, "one", "x y")]
    d = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, source string, text string, taken string")
    got = mixing.mix(d).toPandas()
    assert len(got) == len(rows)
    size = Counter()
    for _, s, t in rows:
        size[s] += len(WORDS.findall(t or ""))
    want = fair_targets(size)
    source = {i: s for i, s, _ in rows}
    got["s"] = [source[i] for i in got.doc_id]
    for s, part in got.groupby("s", dropna=False):
        s = None if s != s or s is None else s
        assert part.source_size.iloc[0] == size[s] and abs(part.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(part.taken.sum() - want[s]) <= max(3, 0.01 * want[s])
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix(d.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    assert mixing.mix(d.limit(0)).count() == 0
