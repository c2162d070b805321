"""Layers of secrets: compressed data under escapes, members in members, control characters, deep nesting."""

import base64
import bz2
import gzip
import lzma
import random
import re
import time
import urllib.parse
import zlib

import pytest
import zstandard

from formweave.llm import secrets

SECRET = "token=abcdefghijklmnopqrstuvw"
PACK = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}


def b64(data):
    return base64.b64encode(data).decode()


def spans_of(text, kind=0):
    return [(a, b) for a, b, k in secrets.scan(text)[1] if k == kind]


@pytest.mark.parametrize("pack", PACK.values(), ids=PACK)
def test_packed_under_escapes(pack):
    data = pack(b"some words " * 3 + SECRET.encode() + b" end")
    every = "".join(f"%{x:02X}" for x in data)
    quoted = urllib.parse.quote_from_bytes(data, safe="")
    slashes = "".join(f"\\x{x:02x}" for x in data)
    mixed = repr(data)[2:-1]
    for coded in (every, quoted, slashes, mixed):
        if coded is mixed and pack is zlib.compress:  # starts like any text
            continue
        assert spans_of(f"a {coded} z"), coded[:40]
        (a, b), *_ = spans_of(f"a {coded} z")
        # the printable characters behind backslash escapes may be data too
        assert a == 2 and -1 <= b - 2 - len(coded) <= (0 if coded in (every, quoted) else 2)
        assert spans_of(f"a {b64(coded.encode())} z")  # each nested once more


@pytest.mark.parametrize("inner", PACK.values(), ids=PACK)
@pytest.mark.parametrize("outer", PACK.values(), ids=PACK)
def test_members_in_members(monkeypatch, outer, inner):
    data = outer(outer(b"first ") + outer(inner(b"x" * 40 + b" ") + inner(SECRET.encode())))
    assert spans_of(b64(outer(inner(inner(b"x ") + inner(SECRET.encode())))))
    assert spans_of(b64(outer(b"first ") + outer(SECRET.encode())))
    assert isinstance(spans_of(b64(data)), list)
    monkeypatch.setattr(secrets, "MAX_EXPANDED", 1 << 12)
    monkeypatch.setattr(secrets, "WINDOW", 1 << 13)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    rng = random.Random(1)
    noise = " ".join(rng.choice(["so", "and", "then", "more"]) for _ in range(30_000)).encode()
    large = b64(outer(inner(noise + b" " + SECRET.encode() + b" " + noise)))
    _, spans, too_far = secrets.scan(f"a {large} b")
    assert (2, 2 + len(large), 0) in spans and too_far >= 1


def test_control_characters_and_wide_text():
    assert spans_of(b64(b"\x01\x02 some words " + SECRET.encode() + b" \x03 more"))
    assert spans_of(b64(gzip.compress(b"\x01 " + SECRET.encode() + b" \x00")))
    text = "x " + SECRET + " y"
    coded = b64(text.encode("utf-16-le"))
    assert spans_of(f"see {coded} end") and all(4 <= a < b <= 4 + len(coded) for a, b in spans_of(f"see {coded} end"))


def brute(text):
    """The spans of the last layer, percent and backslash escapes taken off level by level, with a span for each character."""
    layer = [(c, i, i + 1, True) for i, c in enumerate(text)]
    one = re.compile(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
    while True:
        t = "".join(x[0] for x in layer)
        out, at = [], 0
        for m in one.finditer(t):
            code = int(m[1] or m[2] or m[3], 16)
            if code < 0x80:
                out += layer[at : m.start()] + [(chr(code), layer[m.start()][1], layer[m.end() - 1][2], False)]
                at = m.end()
        out += layer[at:]
        if len(out) == len(layer):
            return {(layer[a][1], layer[b - 1][2], k) for a, b, k in secrets.base_spans(t)}
        layer = out


def test_nested_escapes_against_brute_force():
    rng = random.Random(8)

    def coded(c):
        for _ in range(rng.randrange(4)):
            c = "".join((f"%{ord(x):02x}", f"\\u{ord(x):04x}", f"\\x{ord(x):02X}")[rng.randrange(3)] if rng.random() < 0.5 else x for x in c)
        return c

    for _ in range(150):
        text = "".join(map(coded, "a " + rng.choice([SECRET, "AKIA" + "Q7" * 9, "0123456789abcdef01"]) + " z"))
        want = brute(text)
        assert want and want <= set(secrets.scan(text)[1]), text


def test_deep_nesting_and_long_runs_take_linear_time():
    start = time.perf_counter()
    for nest in ("%25" + "25" * 100_000 + "41", "%3" * 100_000 + "%35", "\\x5c" + "x5c" * 60_000 + "x41"):
        text = f"{SECRET} {nest} z"
        assert spans_of(text) == [(0, len(SECRET))]
    assert spans_of("/a_b-c" * 50_000 + " " + SECRET)
    assert spans_of(b64(("plain words and more " * 60_000 + SECRET).encode()))
    assert time.perf_counter() - start < 60


def test_cycles_end(monkeypatch):
    """Data that expand to themselves, or to each other in turns."""
    turns = {b"a" * 12: b"b" * 12, b"b" * 12: b"a" * 12}
    monkeypatch.setattr(secrets, "_expand", lambda data: turns.get(bytes(data)))
    assert secrets.scan(b64(b"a" * 12))[1] == []


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, spans string")
    assert secrets.scan_secrets(d, redact=True).count() == 0
