"""Numbers of links of the n-gram Jaccard join, against brute force."""

import pytest

from formweave.llm import jaccard_join, queries
from test_tables import near_copies, sets


def brute_links(texts, n, percent):
    """Of each text: the other distinct sets that link with its own."""
    own = [sets(t, n) for t in texts]
    return [sum(100 * len(s & o) >= percent * len(s | o) and bool(s & o) for o in set(own) - {s}) for s in own]


@pytest.mark.parametrize("n,percent,chunk,spread", [(4, 85, 7, 50), (5, 80, 64, 1 << 16)])
def test_link_counts(spark, monkeypatch, n, percent, chunk, spread):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "SPREAD", spread)
    rows = near_copies() + [(9000 + i, t) for i, t in near_copies()[:5]]  # exact copies
    d = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.n_links for r in jaccard_join.ngram_jaccard_join(d, n, percent, count_links=True).documents.collect()}
    want = brute_links([t for _, t in rows], n, percent)
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)} | {None: 0}
    assert max(want) > jaccard_join.RUN * 2


def test_query_gives_links(spark, tmp_path):
    rows = near_copies()
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_links for r in queries.op7_ngram_jaccard_join(spark, str(tmp_path)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_links([t for _, t in rows], 4, 85), strict=True))


def test_null_id_comes_first(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base, "more"])  # of another size, so of another group
    rows = [(None, " ".join(base)), (7, " ".join(base)), (None, near), (9, near)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.ngram_jaccard_join(d, 4, 85, count_links=True).documents.collect()}
    assert got == {None: (None, 0), 7: (7, 1), 9: (7, 1)}
