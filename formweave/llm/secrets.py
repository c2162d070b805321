"""Secret scans over a text and every layer that decoding it uncovers.

Base kinds, each matched leftmost and non-overlapping over the whole text:

* ``assign``: a credential name, ``:`` or ``=``, and a value of 12 or more characters;
* ``access``: ``AKIA`` and upper-case letters or digits, 18 or more characters together;
* ``hex``: 16 or more lower-case hexadecimal digits.

A worklist then unwraps layers until nothing new appears: percent escapes,
backslash-u / backslash-x escapes, base64 runs, and compressed data (gzip, zlib,
bzip2, xz, zstandard) inside base64, percent escapes or backslash-x escapes.  A
layer is the text with all segments of one encoding replaced by what they decode
to, so a secret whose name is plain and whose value is encoded is found too.
Layers already seen are not queued again, which ends cycles; compressed data
inside compressed data are unwrapped with a set of what was seen as well.
Escapes of escapes are taken off one level, and then all levels at once (one
pass with a stack), so that deep nesting costs no square of its depth.
Matches of a layer that touch decoded characters are mapped through all layers
back to the span of the original text that encodes them; compressed bytes map to
their whole run.

Edge cases: null counts as the empty text (no spans); each span is listed once
per kind; offsets are code points, ends exclusive; rows are independent, so
repeated rows and extra columns change nothing, and an empty table gives an
empty result.  All members of concatenated compressed data count.  Data that
expand past ``MAX_EXPANDED`` bytes are not held: they (and compressed data in
them, to any depth) are read as a stream in windows of ``WINDOW`` bytes that
overlap by ``OVERLAP``, and their secrets span the whole run
(``expanded_too_far`` counts such data in every layer).  A base64 run goes on
over single line breaks; it counts as text in UTF-8 or, if every other byte is
zero, UTF-16.  One that is no text as a whole is tried at each alignment, where
clean stretches of ``LEAST_CLEAN`` characters and compressed data count.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
from pyspark.sql import DataFrame

from formweave.llm.common import map_batches, text_frame

KINDS = ("assign", "access", "hex")
MAX_EXPANDED = 64 << 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
#: Runs that may nest escapes, and where compressed data start under escapes (fixed values of the formats).
_NESTED = re.compile(r"[%\\0-9A-Fa-fxuU{}]{3,}")
_DEEPER = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}")
_PERCENT_DATA = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
_BACKSLASH_DATA = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[nrt0\\'\"]|[ -!#-&(-\[\]-~])+")
_STARTS = (b"\x1f\x8b\x08", *(b"BZh%d1AY" % level for level in range(1, 10)), b"\xfd7zXZ", b"\x28\xb5\x2f\xfd", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")


def _escaped_start(mark: str) -> re.Pattern[str]:
    """The starts, each byte under an escape or, if printable, as it is; at least one under an escape."""

    def one(b: int) -> str:
        coded = mark + "".join(c if c.isdigit() else f"[{c}{c.upper()}]" for c in f"{b:02x}")
        return f"(?:{coded}|{re.escape(chr(b))})" if 32 < b < 127 else coded

    return re.compile("|".join(f"(?=[!-~]{{0,12}}{mark}){''.join(map(one, start))}" for start in _STARTS))


_PERCENT_MEMBER, _BACKSLASH_MEMBER = _escaped_start("%"), _escaped_start(r"\\x")
_BACKSLASH_ONE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|(.))")
_BACKSLASH_BYTES = {"n": 10, "r": 13, "t": 9, "0": 0, "\\": 92, "'": 39, '"': 34}
_ESCAPE_ONE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|[uUx]([0-9A-Fa-f]+))")
#: Digits of a run at least, and characters of a clean stretch inside a run that does not decode as a whole.
LEAST_DIGITS, LEAST_CLEAN = 12, 12
#: Bytes expanded at a time, and the windows over members past MAX_EXPANDED.
PIECE, WINDOW, OVERLAP = 1 << 20, 8 << 20, 1 << 16
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_MEMBER = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_CLEAN = re.compile(  # UTF-8 without control characters
    rb"(?:[\x09-\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){%d,}" % LEAST_CLEAN
)

Span = tuple[int, int, int]  # start, end, place of the kind in KINDS


def base_spans(text: str) -> list[Span]:
    """All base matches of a text, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


class _Cut:
    """A segment [start, end) of a layer and the text it decodes to; ``left`` and ``right`` hold the part of the
    layer behind each character (ascending), or are None if every character stands for the whole segment."""

    __slots__ = ("start", "end", "text", "left", "right")

    def __init__(self, start: int, end: int, text: str, left=None, right=None):
        self.start, self.end, self.text = start, end, text
        self.left, self.right = (None if x is None else np.asarray(x, np.int64) for x in (left, right))


class _Piece:
    """A run of a layer's text from ``at`` on, and the original text behind it: the same characters from ``left`` on
    (plain), a span for each character (arrays), or one span for all of them."""

    __slots__ = ("at", "left", "right", "plain")

    def __init__(self, at: int, left, right, plain: bool):
        self.at, self.left, self.right, self.plain = at, left, right, plain

    def lefts(self, where: np.ndarray) -> np.ndarray:
        if self.plain:
            return where - self.at + self.left
        return self.left[where - self.at] if isinstance(self.left, np.ndarray) else np.full(len(where), self.left)

    def rights(self, where: np.ndarray) -> np.ndarray:
        """Of the last characters ``where``."""
        if self.plain:
            return where - self.at + self.left + 1
        return self.right[where - self.at] if isinstance(self.right, np.ndarray) else np.full(len(where), self.right)


class _Layer:
    """A text made from a parent by replacing segments, with the original spans behind it in pieces."""

    def __init__(self, text: str, pieces: list[_Piece]):
        self.text, self.pieces, self.starts = text, pieces, [p.at for p in pieces]

    def origin(self, start: int, end: int) -> tuple[int, int, bool]:
        """The original span behind [start, end), and whether any of it was decoded."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        left = self.pieces[i].lefts(np.array([start]))[0]
        right = self.pieces[j].rights(np.array([end - 1]))[0]
        return int(left), int(right), not all(p.plain for p in self.pieces[i : j + 1])

    def _behind(self, where: np.ndarray, of_last: bool) -> np.ndarray:
        """Original places behind ascending places of this layer."""
        piece = np.searchsorted(self.starts, where, side="right") - 1
        cut = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(where)), strict=True):
            p = self.pieces[piece[a]]
            out.append(p.rights(where[a:b]) if of_last else p.lefts(where[a:b]))
        return np.concatenate(out)

    def replace(self, cuts: list[_Cut]) -> "_Layer":
        out, pieces, size, at = [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            i = bisect_right(self.starts, a) - 1
            while a < b:
                stop = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else b)
                p = self.pieces[i]
                if p.plain:
                    pieces.append(_Piece(size, p.left + a - p.at, None, True))
                elif isinstance(p.left, np.ndarray):
                    pieces.append(_Piece(size, p.left[a - p.at : stop - p.at], p.right[a - p.at : stop - p.at], False))
                else:
                    pieces.append(_Piece(size, p.left, p.right, False))
                out.append(self.text[a:stop])
                size += stop - a
                a, i = stop, i + 1

        for c in cuts:
            keep(at, c.start)
            if c.text:
                if c.left is None:
                    left, right, _ = self.origin(c.start, c.end)
                    pieces.append(_Piece(size, left, right, False))
                else:
                    pieces.append(_Piece(size, self._behind(c.left, False), self._behind(c.right - 1, True), False))
                out.append(c.text)
                size += len(c.text)
            at = c.end
        keep(at, len(self.text))
        return _Layer("".join(out), pieces)


def _opened(head: bytes):
    """A decompressor for data that starts like this, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What the members of compressed data expand to, some PIECE bytes at a time; ends where they break."""
    data, d = b"", None
    try:
        for chunk in chunks:
            data += chunk
            while data:
                if d is None:
                    if len(data) < 6:
                        break
                    d = _opened(data)
                    if d is None:
                        return
                if hasattr(d, "unconsumed_tail") and hasattr(d, "copy"):  # zlib
                    out = d.decompress(data, PIECE)
                    data = d.unused_data if d.eof else d.unconsumed_tail
                elif hasattr(d, "needs_input"):  # bzip2, xz
                    out = d.decompress(data, PIECE)
                    while not d.eof and not d.needs_input:
                        if out:
                            yield out
                        out = d.decompress(b"", PIECE)
                    data = d.unused_data if d.eof else b""
                else:  # zstandard has no bound on what comes out, so little goes in
                    some, data = data[:256], data[256:]
                    out = d.decompress(some)
                    data = d.unused_data + data if d.eof else data
                if out:
                    yield out
                if d.eof:
                    d = None
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return
    except Exception as e:
        if not type(e).__module__.startswith("zstandard") and type(e).__name__ != "ZstdError":
            raise


def _slices(data: bytes) -> Iterator[bytes]:
    return (data[i : i + (1 << 16)] for i in range(0, len(data), 1 << 16))


def _expand(data: bytes) -> bytes | None:
    """One layer of compression off all members, or None.  Raises OverflowError past MAX_EXPANDED."""
    out, size = [], 0
    for piece in _members(_slices(data)):
        out.append(piece)
        size += len(piece)
        if size > MAX_EXPANDED:
            raise OverflowError
    return b"".join(out) or None


def _windows(data: bytes) -> Iterator[str]:
    """Overlapping windows over the text of members that are too large to hold, with all compression off."""
    pieces, seen = _members(_slices(data)), set()
    while (head := next(pieces, None)) is not None:
        pieces = _chained(head, pieces)
        key = hashlib.sha256(head).digest()
        if key in seen or next(_members([head]), None) is None:
            break
        seen.add(key)
        pieces = _members(pieces)
    held = b""
    for piece in pieces:
        held += piece
        while len(held) >= WINDOW:
            yield held[:WINDOW].decode(errors="replace")
            held = held[WINDOW - OVERLAP :]
    yield held.decode(errors="replace")


def _chained(head: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from rest


def _readable(data: bytes) -> str | None:
    """Decoded text if the bytes are UTF-8 without control characters other than white space."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def _wide(data: bytes) -> str | None:
    """Text in little-endian UTF-16, if every other byte is zero."""
    return _readable(data[::2]) if len(data) > 1 and not len(data) % 2 and not any(data[1::2]) else None


def _percent(text: str) -> list[_Cut]:
    cuts = []
    for m in _PERCENT.finditer(text):
        data = bytes.fromhex(m[0].replace("%", ""))
        parts, left, right, i = [], [], [], 0
        while i < len(data):  # one span per character
            n = 1 if data[i] < 0xC0 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            try:
                c = data[i : i + n].decode()
            except UnicodeDecodeError:
                n = 1
                c = m[0][3 * i : 3 * i + 3]
            parts.append(c)
            left += [m.start() + 3 * i] * len(c)
            right += [m.start() + 3 * min(i + n, len(data))] * len(c)
            i += n
        decoded = "".join(parts)
        if decoded != m[0]:
            cuts.append(_Cut(m.start(), m.end(), decoded, left, right))
    return cuts


def _escapes(text: str) -> list[_Cut]:
    cuts = []
    for m in _ESCAPE.finditer(text):
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        for x in _ESCAPE_ONE.finditer(text, m.start(), m.end()):
            code = int(x[1] or x[2], 16)
            if 0xDC00 <= code < 0xE000 and parts and len(parts[-1]) == 6 and parts[-1][2] in "dD" and parts[-1][3] in "89abAB":
                high, (a, _) = parts.pop(), spans.pop()  # a surrogate pair
                parts.append(chr(0x10000 + ((int(high[2:], 16) - 0xD800) << 10) + code - 0xDC00))
                spans.append((a, x.end()))
            else:
                parts.append(x[0] if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code))
                spans.append(x.span())
        decoded = "".join(parts)
        if decoded != m[0]:
            sizes = [len(c) for c in parts]
            cuts.append(_Cut(m.start(), m.end(), decoded, np.repeat([a for a, _ in spans], sizes), np.repeat([b for _, b in spans], sizes)))
    return cuts


def _fixpoint(text: str) -> list[_Cut]:
    """All levels of nested percent and backslash escapes at once: each character goes onto a stack, and whenever its
    top is an escape, what that stands for takes its place.  Bytes from 0x80 on are put together at the end."""
    cuts = []
    for m in _NESTED.finditer(text):
        if "%" not in m[0] and "\\" not in m[0]:
            continue
        chars: list[str] = []
        left: list[int] = []
        right: list[int] = []

        def reduced(n: int, code: int, byte: bool, chars=chars, left=left, right=right) -> None:
            del chars[-n:]
            del left[1 - n + len(left) :]
            end = right[-1]
            del right[-n:]
            right.append(end)
            chars.append(chr(0xDC00 + code) if byte and code >= 0x80 else chr(code))

        for i, c in enumerate(m[0], m.start()):
            chars.append(c)
            left.append(i)
            right.append(i + 1)
            while len(chars) > 2:
                top = "".join(chars[-10:])
                x = _TOP.search(top)
                if not x:
                    break
                code = int(next(g for g in x.groups() if g), 16)
                if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
                    break
                reduced(len(x[0]), code, top[x.start()] == "%" or x[0][1:2] == "x")
        decoded, begin, end, k = [], [], [], 0
        while k < len(chars):
            n = 1
            c = chars[k]
            if "\udc80" <= c <= "\udcff":
                run = bytes(ord(x) - 0xDC00 for x in chars[k : k + 4] if "\udc80" <= x <= "\udcff")
                c = "�"
                for size in (2, 3, 4):
                    try:
                        c, n = run[:size].decode(), size
                        break
                    except UnicodeDecodeError:
                        continue
            decoded.append(c)
            begin.append(left[k])
            end.append(right[k + n - 1])
            k += n
        if (found := "".join(decoded)) != m[0]:
            cuts.append(_Cut(m.start(), m.end(), found, begin, end))
    return cuts


_TOP = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\})\Z")


def _parts(data: bytes, at: np.ndarray, first: int, last: int, wide: bool = False) -> _Cut:
    """A cut with one span per character of clean data: byte i comes from digits 4i/3 .. 4(i+1)/3, which are at[...] in the text."""
    text = data[::2].decode() if wide else data.decode()
    raw = np.frombuffer(data[::2] if wide else data, np.uint8)
    begin = np.flatnonzero((raw & 0xC0) != 0x80) * (2 if wide else 1)
    end = np.append(begin[1:], len(data))
    left = at[(first + begin) * 4 // 3]
    right = at[np.minimum(len(at), -(-(first + end) * 4 // 3)) - 1] + 1
    right[-1] = max(int(right[-1]), last)
    return _Cut(int(left[0]), int(right[-1]), text, left, right)


def _bytes(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)].translate(_URLSAFE)
    return base64.b64decode(body + "=" * (-len(body) % 4))


class _Run:
    """What the runs of one encoding give: cuts, secrets in data too large to hold, and the number of those."""

    def __init__(self) -> None:
        self.cuts: list[_Cut] = []
        self.large: list[Span] = []
        self.too_far = 0

    def unpacked(self, data: bytes, start: int, end: int) -> bool:
        """Whether the data are compressed; a cut with what they expand to, as far as compression goes."""
        packed, seen = data, {hashlib.sha256(data).digest()}
        try:
            while (more := _expand(packed)) is not None:
                packed = more
                if (key := hashlib.sha256(more).digest()) in seen:
                    break
                seen.add(key)
        except OverflowError:
            self.too_far += 1
            kinds = {kind for w in _windows(packed) for _, _, kind in scan(w)[1]}
            self.large += [(start, end, kind) for kind in kinds]
            return True
        if packed is data:
            return False
        self.cuts.append(_Cut(start, end, packed.decode(errors="replace")))
        return True

    def whole(self, body: str, at: np.ndarray, end: int) -> bool:
        """The digits as one run."""
        if len(body) < LEAST_DIGITS or len(body) % 4 == 1:
            return False
        data = _bytes(body)
        if self.unpacked(data, int(at[0]), end):
            return True
        wide = _wide(data) is not None
        if not wide and _readable(data) is None:
            return False
        cut = _parts(data, at, 0, end, wide)
        cut.start, cut.end = int(at[0]), end
        self.cuts.append(cut)
        return True

    def glued(self, body: str, at: np.ndarray, end: int) -> None:
        """Digits that do not decode as one run: clean stretches and compressed data at each alignment, longest first."""
        found = []
        for shift in range(4):
            data = _bytes(body[shift:])
            for m in _MEMBER.finditer(data):
                digit = shift + m.start() * 4 // 3
                if m.start() % 3 == 0 and self.unpacked(data[m.start() :], int(at[digit]), end):
                    body, at = body[:digit], at[:digit]  # the rest of the run is the member
                    break
            found += [(m.end() - m.start(), shift, m.start(), m[0]) for m in _CLEAN.finditer(data)]
        taken: list[tuple[int, int]] = []
        for size, shift, first, piece in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            a, b = shift + first * 4 // 3, min(len(body), shift + -(-(first + size) * 4 // 3))
            k = bisect_right(taken, (a, len(body)))
            if b - a < size * 4 // 3 or k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < b:
                continue
            taken.insert(k, (a, b))
            self.cuts.append(_parts(piece, at[shift:], first, 0))

    def sorted_cuts(self) -> list[_Cut]:
        self.cuts.sort(key=lambda c: (c.start, c.end))
        apart, last = [], 0
        for cut in self.cuts:
            if cut.start >= last:
                apart.append(cut)
                last = cut.end
        return apart


def _base64(text: str) -> _Run:
    out = _Run()
    for m in _BASE64.finditer(text):
        # a run spans single line breaks; its lines are tried alone if it fails, then at other alignments
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        at = np.concatenate([np.arange(a, b) for a, b in lines])
        joined = "".join(text[a:b] for a, b in lines)
        if out.whole(joined, at, m.end()):
            continue
        before = len(out.cuts)
        if len(lines) > 1:
            out.glued(joined, at, m.end())
            if len(out.cuts) > before:
                continue
        for a, b in lines:
            end = m.end() if b == lines[-1][1] else b
            body, at = text[a:b], np.arange(a, b)
            if len(lines) > 1 and out.whole(body, at, end):
                continue
            if len(body) >= LEAST_DIGITS:
                out.glued(body, at, end)
    return out


def _packed(text: str) -> _Run:
    """Compressed data under percent or backslash-x escapes."""
    out, last = _Run(), 0
    found = [(m.start(), True) for m in _PERCENT_MEMBER.finditer(text)] if "%" in text else []
    found += [(m.start(), False) for m in _BACKSLASH_MEMBER.finditer(text)] if "\\x" in text else []
    for start, percent in sorted(found):
        if start < last:
            continue
        m = (_PERCENT_DATA if percent else _BACKSLASH_DATA).match(text, start)
        if m:
            data = unquote_to_bytes(m[0]) if percent else _BACKSLASH_ONE.sub(lambda x: chr(int(x[1], 16) if x[1] else _BACKSLASH_BYTES[x[2]]), m[0]).encode("latin-1")
            if out.unpacked(data, start, m.end()):
                last = m.end()
    return out


_URLSAFE = str.maketrans("-_", "+/")


def scan(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans (base and decoded), and how much data was too large to hold."""
    base = base_spans(text)
    found, too_far = set(base), 0
    work, seen = [_Layer(text, [_Piece(0, 0, None, True)])], {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    while work:
        layer = work.pop()
        if layer.text is not text:
            for a, b, kind in base_spans(layer.text):
                left, right, decoded = layer.origin(a, b)
                if decoded:
                    found.add((left, right, kind))
        makers, runs = [], [_base64(layer.text)]
        if "%" in layer.text or "\\" in layer.text:
            runs.append(_packed(layer.text))
            makers += [_percent(layer.text), _escapes(layer.text)]
            if layer.text is not text and _DEEPER.search(layer.text):
                makers = [_fixpoint(layer.text)]
        for run in runs:
            too_far += run.too_far
            for a, b, kind in run.large:
                left, right, _ = layer.origin(a, b)
                found.add((left, right, kind))
            makers.append(run.sorted_cuts())
        for cuts in makers:
            if cuts:
                child = layer.replace(cuts)
                key = hashlib.sha256(child.text.encode("utf-8", "surrogatepass")).digest()
                if child.text and key not in seen:
                    seen.add(key)
                    work.append(child)
    return base, sorted(found, key=lambda s: (s[0], s[2], s[1])), too_far


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", redact: bool = False) -> DataFrame:
    """``keep`` columns, counts of base matches, their digest, all spans, and with ``redact`` the cleaned text."""
    frame, fields, take = text_frame(docs, keep, text)

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = take(cols)
        found = [scan(t or "") for t in texts]
        for place, kind in enumerate(KINDS):
            cols[f"n_{kind}"] = [sum(s[2] == place for s in base) for base, _, _ in found]
        cols["base_sha256"] = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _, _ in found]
        cols["spans"] = [listed(spans) for _, spans, _ in found]
        cols["expanded_too_far"] = [n for _, _, n in found]
        if redact:
            cols["redacted"] = [None if t is None else redacted(t, spans) for t, (_, spans, _) in zip(texts, found, strict=True)]
        return cols

    made = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, expanded_too_far bigint"
    return map_batches(frame, run, f"{fields}, {made}{', redacted string' if redact else ''}")
