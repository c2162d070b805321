"""Base64 that is wrapped, glued to other characters or holds several or very large members."""

import base64
import bz2
import gzip
import lzma
import textwrap
import zlib

import pytest

from formweave.llm import secrets

SECRET = "token=abcdefghijklmnopqrstuvw"
PACK = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}


def b64(data):
    return base64.b64encode(data).decode()


def kinds(text):
    return {k for _, _, k in secrets.scan(text)[1]}


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_wrapped(newline):
    for offset in range(57):
        lines = textwrap.wrap(b64(("y" * offset + " " + SECRET + " " + "tail " * 30).encode()), 76)
        text = "see\n\n" + newline.join(lines) + "\n\nend"
        spans = [s for s in secrets.scan(text)[1] if s[2] == 0]
        assert spans and all(5 <= a < b <= len(text) - 5 for a, b, _ in spans), offset
    noise = "".join(chr(33 + i * 7919 % 90) for i in range(400))
    for pack in PACK.values():
        assert 0 in kinds(newline.join(textwrap.wrap(b64(pack((noise + " " + SECRET).encode())), 76)))


@pytest.mark.parametrize("before", ["https://host/x/", "cfg_", "cfg-", "a", "ab", "abc", "abcdefg", "/a_b-c/"])
def test_glued(before):
    assert 0 in kinds(f"x {before}{b64(SECRET.encode())} y")
    assert 0 in kinds(f"x {before}{b64(gzip.compress(SECRET.encode()))} y")


def test_prose_lines_do_not_hide_a_run():
    for text in (f"internationally\n{b64(SECRET.encode())}\nextraordinarily", f"x {b64(SECRET.encode())}\nand more"):
        assert 0 in kinds(text)


@pytest.mark.parametrize("pack", PACK.values(), ids=PACK)
def test_members(monkeypatch, pack):
    assert 0 in kinds(b64(pack(b"first ") + pack(SECRET.encode())))
    monkeypatch.setattr(secrets, "MAX_EXPANDED", 1 << 16)
    monkeypatch.setattr(secrets, "PIECE", 1 << 12)
    monkeypatch.setattr(secrets, "WINDOW", 1 << 15)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    large = b64(pack(b"so " * 50_000 + SECRET.encode() + b" so" * 50_000))
    _, spans, too_far = secrets.scan(f"a {large} b")
    assert spans == [(2, 2 + len(large), 0)] and too_far >= 1
    assert secrets.scan(f"a {b64(large.encode())} b")[2] >= 1  # in an inner layer
