"""The registered queries: contract columns over a whole table, values against brute force, odd tables."""

import binascii
import hashlib
import random
import re
import struct
import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from formweave.llm import queries
from test_tables import fair_targets
from test_texts import brute_spans

CONTRACT = {
    "op1_html_extraction": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op2_secret_scans": ("documents", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}),
    "op3_language_id": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    "op4_document_fingerprints": ("documents", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
    "op5_media_columns": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}),
    "op6_extendible_shards": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "shard": "string", "depth": "int", "shard_bytes": "bigint", "fits": "boolean"}),
    "op7_ngram_jaccard_join": ("documents", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "class_id": "bigint", "n_links": "bigint"}),
    "op8_byte_bpe": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    "op10_source_mixing": ("documents", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
}
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, feature string, media string, ids string, size string, kept string"


def rows():
    rng = random.Random(12)
    words = {"en": ["the", "house", "and", "with"], "de": ["der", "Haus", "und", "mit"], None: ["12", "½", "!"]}
    made = []
    for i in range(120):
        lang = rng.choice(["en", "de", "en", None])
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.choice([0, 3, 40, 200])))
        if i % 9 == 0:
            text += ' token = "0123456789abcdef0123" AKIA' + "Q" * 16
        made.append((i, None if i % 17 == 0 else text, lang, rng.choice(["a", "b", None, "hot", "hot"]), len(text)))
    made += [made[3], (500, "the house " * 30_000, "en", "hot", 0), (501, "", None, None, None), (None, "no id", "en", "a", 5)]
    return [(*r, *["clash"] * 6) for r in made]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows(), DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    page = [(i, f"http://h{i % 2}.example/", f"<p>words {i}</p>", "clash", 1) for i in range(20)] + [(7, None, None, None, None)]
    spark.createDataFrame(page, "page_id bigint, url string, html string, text string, n_chars int").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns_and_every_row(spark, folder, sf, name):
    table, columns = CONTRACT[name]
    found = queries.QUERIES[name](spark, folder)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    assert found.count() == spark.read.parquet(f"{folder}/{table}.parquet").count()
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_empty_table(spark, folder, tmp_path, name):
    table, columns = CONTRACT[name]
    spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def by_text(spark, folder, name):
    docs = [(r.doc_id, r.text or "", r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.QUERIES[name](spark, folder).collect()
    at = {}
    for r in got:
        at.setdefault(r.doc_id, r)
    return [(t, at[i], r) for i, t, r in docs]


def test_secrets_query(spark, folder):
    for text, r, _ in by_text(spark, folder, "op2_secret_scans"):
        base = brute_spans(text)
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_language_query(spark, folder):
    right = total = 0
    for text, r, row in by_text(spark, folder, "op3_language_id"):
        assert r.held_out == (row.doc_id is not None and binascii.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and 0 <= r.score <= 1
        if row.lang and len(text) > 100 and "token" not in text:
            right, total = right + (r.lang_pred == row.lang), total + 1
    assert right == total > 20


def test_media_query(spark, folder):
    for text, r, _ in by_text(spark, folder, "op5_media_columns"):
        raw = text.encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_bytes > len(data) // 2 and len(r.media_sha256) == 64 and r.feature


def test_tokens_query(spark, folder):
    import tiktoken

    from formweave.llm import byte_bpe

    ranks = byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, r, _ in by_text(spark, folder, "op8_byte_bpe"):
        ids = ref.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_mixing_query(spark, folder):
    size: dict = {}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    for d in docs:
        size[d.source] = size.get(d.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    want, taken = fair_targets(size), {}
    source = {d.doc_id: d.source for d in docs}
    for r in queries.op10_source_mixing(spark, folder).collect():
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    # the long document is most of its source: the others' words bound how near its budget can come
    assert all(abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]) for s in size if s != "hot") and taken["hot"] <= want["hot"] + 1


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, folder, stage):
    """Nulls, an empty and a very long text, repeated rows, clashing names, and no rows at all."""
    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = run(spark, docs, folder)
    assert got.count() > 0 and (stage == 4 or got.columns == list(corpus_pipeline.COLUMNS))
    none = run(spark, docs.limit(0), folder)
    assert none.count() == 0 and none.columns == got.columns
    if stage in (2, 4):
        assert got.count() == docs.count()
    if stage == 1:
        assert got.where("doc_id is null").count() == 1 and got.where("doc_id = 500").count() == 1
