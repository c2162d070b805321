"""Operators that work row by row, against brute force, public libraries and round trips."""

import base64
import gzip
import hashlib
import random
import re
import struct
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formweave.llm import byte_bpe, language_id, main_text, media, secrets

ODD = [None, "", " ", "\n\n", "é" * 300, "\x00\x01", "a" * 5000, "日本語🎉", "'s I'M don't  x\n", "𝒳 ſ K", "x " * 9000]


def docs(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 0, "clash", "clash") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, ids string")
    return d if extra else d.drop("spans", "ids")


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcé \n'1ſß") for _ in range(400)) for _ in range(20)]
    for r in byte_bpe.encode(docs(spark, texts), path, public_tokenizers.PATTERN).collect():
        t = texts[r.doc_id] or ""
        want = ref.encode_ordinary(t)
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.encode(docs(spark, ODD).limit(0), path, public_tokenizers.PATTERN).count() == 0


def brute_spans(text):
    found = []
    for k, (pattern, least, group) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0)]):
        found += [(m.start(), m.end(), k) for m in re.finditer(pattern, text, re.I | re.A if k == 0 else 0) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], s[2]))


SECRET = 'token = "0123456789abcdef0123"'


def test_secrets_base(spark):
    rng = random.Random(3)
    parts = ["token", "secret", "API_KEY", "=", ":", " ", '"', "abcdef0123", "AKIA", "ABCDEFGH12", "%41", "\\u0041", "\n", "é", "ſecret", "Zm9vYmFyYmF6"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(300)]
    for r in secrets.scan_secrets(docs(spark, texts), redact=True).collect():
        base = brute_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(secrets.listed(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in base) for k in range(3)]
        assert set(filter(None, secrets.listed(base).split(","))) <= set(filter(None, r.spans.split(",")))
        assert (r.redacted is None) == (texts[r.doc_id] is None)


LAYERS = {
    "url": lambda s: urllib.parse.quote(s, safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_secrets_nested(outer, inner):
    coded = LAYERS[outer](LAYERS[inner](SECRET))
    text = f"before {coded} after"
    _, spans, _ = secrets.scan(text)
    kinds = {k for a, b, k in spans if 7 <= a and b <= 7 + len(coded)}
    assert {0, 2} <= kinds and all(0 <= a < b <= len(text) for a, b, _ in spans)


def test_secrets_spans_are_exact_and_cycles_end():
    text = "x tok%65n%3Dabcdefghijklmnop y"
    assert secrets.listed(secrets.scan(text)[1]) == f"assign:2:{text.index(' y')}"
    assert secrets.scan("%25" * 2000 + "41")[1] == []
    assert secrets.redacted("a token=abcdefghijkl b", [(2, 20, 0), (8, 20, 2)]) == "a [REDACTED] b"


def test_automaton_is_greedy_longest_match():
    rng = random.Random(2)
    for _ in range(60):
        s, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        n, i = 0, 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in s and t[i : i + k] in s:
                k += 1
            i, n = i + k, n + 1
        assert language_id.SuffixAutomaton(s).phrases(t) == n
        p = language_id.CrossParser({"x": s, "y": t + "d"})
        assert abs(p.costs([t])[0, 0] - n * p.cost[0] / len(t)) < 1e-9


def test_language_id(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    samples = language_id.fit_sample(d)
    assert sum(map(len, samples.values())) <= language_id.SAMPLE_CHARS
    got = language_id.identify(d.withColumn("score", d["doc_id"]), samples, keep=("doc_id", "lang")).withColumn("h", language_id.held_out()).where("h").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in language_id.identify(docs(spark, [None, "", "123 !!", "the"]), samples).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[0].score == 0 and odd[3].lang_pred in samples
    assert {r.lang_pred for r in language_id.identify(docs(spark, ["abc"]), {}).collect()} == {"und"}
    assert language_id.fit_sample(docs(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))) == {}


@pytest.mark.parametrize("n", [64, 384, 448, 64 * 70])
def test_jpeg_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (bytes(n), b"\xff" * n, rng.bytes(n), bytes([127, 128]) * (n // 2)):
        file = media.encode(data)
        image = media.decode(file)
        assert media.payload(image) == data
        fast = (media._uniform_ac, media._uniform_dc)
        media._uniform_ac = media._uniform_dc = lambda *a: False  # the symbol path reads the same
        try:
            slow = media.decode(file)
        finally:
            media._uniform_ac, media._uniform_dc = fast
        for k, c in image.comps.items():
            assert (c.coef == slow.comps[k].coef).all()
        assert media.rgb(image).shape == (image.height, image.width, 3)


def test_jpeg_transform_and_order():
    z = media.ZIGZAG.tolist()
    assert z[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(z) == list(range(64)) and z[-1] == 63
    image = media.decode(media.encode(bytes([200] * 384)))
    c = image.comps[2]
    natural = np.zeros(64)
    natural[media.ZIGZAG] = c.coef[0, 0]
    want = np.zeros((8, 8))
    for x in range(8):
        for y in range(8):
            for u in range(8):
                for v in range(8):
                    cu, cv = (np.sqrt(0.5) if k == 0 else 1 for k in (u, v))
                    want[y, x] += 0.25 * cu * cv * natural[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    assert np.abs(media._plane(image, c)[:8, :8] - want - 128).max() < 0.01
    for bad in (b"", b"x" * 9, b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            media.payload(media.decode(bad)) if bad[:2] == b"\xff\xd8" else media.decode(bad)


def test_media_columns(spark):
    for r in media.media_columns(docs(spark, ODD)).collect():
        raw = (ODD[r.doc_id] or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_bytes == len(r.media) and len(r.rgb) == r.height * r.width * 3


PAGE = '<html><head><title>t</title><script>"</p>"</script></head><body><nav><ul><li>m</li></ul></nav><div class="ad">buy</div>{site}<article><h1>Head &amp; tail</h1><p><b>one<br><p>two\n  three</p>{own}</article><footer>f</footer></body></html>'


def test_main_text_rules():
    assert main_text.main_text(PAGE.format(site="", own="")) == "Head & tail\none\ntwo three"
    assert main_text.main_text('<div id="cookieBanner">c</div><div class="header">h</div><p>a&nbsp;b<p>c<div class="comments"><article>no</article></div>') == "a b\nc"
    assert main_text.main_text("plain < 3 &amp text<br>x") == "plain < 3 & text x"
    assert main_text.main_text("<p>a</p><p title='x>y") == "a\ny" and main_text.main_text("<p " * 3000) == "" and main_text.main_text(None) == ""


def test_templates_are_counted_per_host(spark):
    site = "<div><p>Our shop is open every day</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{site}<div><p>text {i}</p></div></body>") for i in range(6)]
    rows += [(10, "http://b.example/1", f"<body>{site}<div><p>other</p></div></body>"), (11, None, None), (12, "odd", "<p>x"), (13, None, "<p>y")]
    rows += [(20 + i, f"http://c.example/{i}", f"<body>{site}<div><p>copied page</p></div></body>") for i in range(9)]  # exact copies are one page
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    for limit in (main_text.BROADCAST_TEMPLATES, -1):  # both joins
        old, main_text.BROADCAST_TEMPLATES = main_text.BROADCAST_TEMPLATES, limit
        try:
            got = {r.page_id: r.text for r in main_text.extract(d).collect()}
        finally:
            main_text.BROADCAST_TEMPLATES = old
        assert [got[i] for i in range(6)] == [f"text {i}" for i in range(6)]
        assert got[10] == "Our shop is open every day\nother" and got[20] == "Our shop is open every day\ncopied page"
        assert (got[11], got[12], got[13]) == ("", "x", "y") and len(got) == len(rows)
    assert main_text.extract(d.limit(0)).count() == 0
