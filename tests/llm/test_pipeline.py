import hashlib
import re

import corpus_pipeline as p
from formweave.llm import secrets


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, None, "s", 0), (10_001, "", "en", None, 0), (10_002, "12 34", "en", "s", 5), (10_003, "Note token=abcdefghijkl and more words here", None, "s", 43)], docs.schema)
    docs = docs.unionByName(extra)
    columns = list(p.COLUMNS)
    kept = p.identify_language(spark, docs, sf)
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {10_000, 10_001, 10_002} and 10_003 in ids and len(ids) == docs.count() - 3
    assert kept.where("doc_id = 10003").first().lang is not None
    kept = kept.cache()
    single = p.drop_near_copies(spark, kept, sf)
    assert single.columns == columns
    left = single.toPandas()
    assert left.doc_id.is_unique
    words = {r.doc_id: " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())) for r in kept.toPandas().itertuples()}
    # no text is there twice
    assert len({words[i] for i in left.doc_id}) == len(left)
    clean = p.redact_secrets(spark, single, sf)
    assert clean.columns == columns
    for r in clean.collect():
        assert not [s for s in secrets.base_spans(r.text) if "[REDACTED]" not in r.text[s[0] : s[1]]]
    row = clean.where("doc_id = 10003").first()
    assert row.text == "Note [REDACTED] and more words here" and row.n_chars == len(row.text)
    mixed = p.mix_sources(spark, clean, sf)
    assert mixed.columns == columns
    assert set(mixed.toPandas().groupby("doc_id").size()) <= {1, 2}
    tokens = p.encode_tokens(spark, mixed, sf).toPandas()
    assert len(tokens) == mixed.count()
    text = {r.doc_id: r.text for r in clean.collect()}
    assert all(hashlib.sha256(text[r.doc_id].encode()).hexdigest() == r.decoded_sha256 for r in tokens.itertuples())


def test_run_and_repeated_rows(spark, sf, tmp_path):
    rows = [(1, "the cat sat on the mat and it was warm", "en", "a", 10), (1, "the cat sat on the mat and it was warm", "en", "a", 10), (None, "some other words that have no id", "en", "b", 9), (2, "the cat sat on the mat and it was warm", "en", "a", 10)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = p.drop_near_copies(spark, d, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (True, 0)]
    d.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() >= 1
