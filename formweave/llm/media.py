"""Media columns: progressive JPEG with any payload stored losslessly in its coefficients.

Writing.  A payload is cut into blocks of 64 bytes, one byte a coefficient;
six blocks (four of luma, one of each chroma plane at half resolution) make an
MCU of a 4:2:0 image.  Byte v of an AC position becomes the coefficient whose
eight magnitude bits are v (category 8: v < 128 is v - 255, else v), of the DC
position v itself.  Scans, all progressive: an interleaved DC scan at
successive-approximation level 8 (every difference is zero) and eight DC
refinements; then for each component an AC scan of positions 1-63 at level 1
and its refinement.
As every AC coefficient is of one category, each scan has symbols of one
length and is packed and unpacked by array operations.

Reading.  ``decode`` accumulates all scans of a progressive JPEG (any Huffman
tables, spectral selections, refinements, subsampling, restart intervals)
into coefficient arrays; scans of the uniform kind take the array path, others
the symbol path.  ``rgb`` dequantises, inverse-transforms with numpy,
upsamples chroma and returns the full-resolution tensor.

Edge cases: null is the empty text, whose payload is 64 zero bytes; the payload
length is in a comment segment.  A file that is no progressive JPEG raises
ValueError.  Rows are independent.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.common import map_batches, text_frame

#: Widest image written, in MCUs; taller ones follow from the payload's length.
MCUS_WIDE = 64
#: Zigzag place -> row-major place (a fixed value of the format): diagonals, alternately up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else -(p // 8))))
_MARK = b"formweave payload "
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)  # a scan ends at the first marker that is no restart


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's number of UTF-8 bytes, and these with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % 64 if data else 64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each row: padded with one bits, a zero byte after each 0xFF."""
    rest = -bits.shape[1] % 8
    data = np.packbits(bits, axis=1)
    if rest:
        data[:, -1] |= (1 << rest) - 1
    return [row.tobytes().replace(b"\xff", b"\xff\x00") for row in data]


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the payload's bytes."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    mcus = -(-len(payload) // 384)
    wide = min(mcus, MCUS_WIDE)
    high = -(-mcus // wide)
    if high > 4095:
        wide, high = 4095, -(-mcus // 4095)
    if high > 4095:
        raise ValueError("a payload of over 6.4 GB does not fit one image")
    cells = np.zeros((high * wide, 6, 64), np.uint8)
    cells.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    luma = cells[:, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    out = [b"\xff\xd8", _segment(0xFE, _MARK + str(len(payload)).encode())]
    out.append(_segment(0xDB, bytes([0]) + bytes([1]) * 64))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    one = bytes([1] + [0] * 15)  # a single code of one bit
    out.append(_segment(0xC4, bytes([0x00]) + one + bytes([0])))  # DC table 0: difference zero
    out.append(_segment(0xC4, bytes([0x10]) + one + bytes([7])))  # AC table 0: no zeros before, category 7
    out.append(_segment(0xC4, bytes([0x11]) + one + bytes([0])))  # AC table 1: end of band

    def scan(names: tuple[int, ...], table: int, start: int, end: int, high_bit: int, low_bit: int, coded: bytes) -> None:
        who = b"".join(bytes([name, table]) for name in names)
        out.append(_segment(0xDA, bytes([len(names)]) + who + bytes([start, end, high_bit << 4 | low_bit])))
        out.append(coded)

    dc = cells[:, :, 0].ravel()  # an interleaved scan visits blocks in just this order
    scan((1, 2, 3), 0x00, 0, 0, 0, 8, _stuffed(np.zeros((1, len(dc)), np.uint8))[0])
    for level, coded in zip(range(7, -1, -1), _stuffed(np.unpackbits(dc[:, None], axis=1).T), strict=True):
        scan((1, 2, 3), 0x00, 0, 0, level + 1, level, coded)
    for name, plane in ((1, luma), (2, cells[:, 4]), (3, cells[:, 5])):
        # a coefficient's code is one zero bit and the top seven bits of its byte: a byte below 0x80,
        # and for negative values the ones' complement that the format asks for
        ac = plane[:, 1:]
        scan((name,), 0x00, 1, 63, 0, 1, (ac >> 1).tobytes())
        # the refinement appends the lowest magnitude bit to each nonzero coefficient, after an end-of-band code
        # (a correction bit is of the magnitude, which for negative values is the byte's complement)
        fix = np.zeros((len(plane), 64), np.uint8)
        fix[:, 1:] = (ac & 1) ^ (ac < 128)
        scan((name,), 0x01, 1, 63, 1, 0, _stuffed(fix.reshape(1, -1))[0])
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Bits:
    """Bit reader over unstuffed entropy-coded bytes, for scans of varying code lengths."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.acc = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.have < n:
            self.acc = self.acc << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.have = self.at + 1, self.have + 8
        self.have -= n
        value = self.acc >> self.have
        self.acc &= (1 << self.have) - 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code, length = 0, 0
        while length < 16:
            code, length = code << 1 | self.take(1), length + 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("bad Huffman code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> size - 1 else v - (1 << size) + 1


def _table(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    codes, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(lengths[length - 1]):
            codes[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


class _Component:
    def __init__(self, h: int, v: int, quant: int):
        self.h, self.v, self.quant = h, v, quant
        self.coef = np.zeros((0, 0, 64), np.int32)  # rows, columns (padded to MCUs), zigzag place
        self.rows = self.cols = 0  # without the padding


class Image:
    """What a file holds after all its scans."""

    def __init__(self) -> None:
        self.width = self.height = 0
        self.comps: dict[int, _Component] = {}
        self.quants: dict[int, np.ndarray] = {}
        self.comment = b""


def decode(data: bytes) -> Image:
    """Accumulate every scan of a progressive JPEG into coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, restart, at = Image(), {}, 0, 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        if marker == 0xFF:
            at += 1
            continue
        (length,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                image.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            for i in range(n):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                image.comps[c] = _Component(hv >> 4, hv & 15, q)
            h, v = max(c.h for c in image.comps.values()), max(c.v for c in image.comps.values())
            across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
            for c in image.comps.values():
                c.coef = np.zeros((down * c.v, across * c.h, 64), np.int32)
                c.cols, c.rows = -(-image.width * c.h // (8 * h)), -(-image.height * c.v // (8 * v))
        elif marker == 0xDA:
            found = _NEXT_MARKER.search(data, at)
            if not found:
                raise ValueError("no end of image")
            end = found.start()
            _scan(image, tables, restart, body, data[at:end])
            at = end
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman JPEG is read")
    raise ValueError("no end of image")


def _scan(image: Image, tables: dict, restart: int, head: bytes, coded: bytes) -> None:
    n = head[0]
    parts = [(image.comps[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(n)]
    start, end, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if not restart and start == 0 and _uniform_dc(parts, tables, high, low, coded):
        return
    if n == 1 and not restart and start and _uniform_ac(parts[0][0], tables[0x10 | parts[0][1] & 15], start, end, high, low, coded):
        return
    pieces = _split_restarts(coded)
    state = {"bits": _Bits(pieces[0]), "eob": 0, "dc": {}}
    if n == 1:
        c = parts[0][0]
        order = [[(c, parts[0][1], y, x)] for y in range(c.rows) for x in range(c.cols)]
    else:
        down, across = parts[0][0].coef.shape[0] // parts[0][0].v, parts[0][0].coef.shape[1] // parts[0][0].h
        order = [[(c, t, my * c.v + y, mx * c.h + x) for c, t in parts for y in range(c.v) for x in range(c.h)] for my in range(down) for mx in range(across)]
    for i, mcu in enumerate(order):
        if restart and i and i % restart == 0:
            state = {"bits": _Bits(pieces[i // restart]), "eob": 0, "dc": {}}
        for c, t, y, x in mcu:
            block = c.coef[y, x]
            if start == 0:
                _dc(block, state, tables.get(t >> 4), id(c), high, low)
            elif high == 0:
                _ac_first(block, state, tables[0x10 | t & 15], start, end, low)
            else:
                _ac_refine(block, state, tables[0x10 | t & 15], start, end, low)


def _split_restarts(coded: bytes) -> list[bytes]:
    out, at, i = [], 0, 0
    while (i := coded.find(b"\xff", i)) >= 0 and i + 1 < len(coded):
        if coded[i + 1]:
            out.append(coded[at:i])
            at = i + 2
        i += 2
    out.append(coded[at:])
    return [p.replace(b"\xff\x00", b"\xff") for p in out]


def _dc(block: np.ndarray, state: dict, codes: dict | None, key: int, high: int, low: int) -> None:
    bits = state["bits"]
    if high:
        block[0] |= bits.take(1) << low
    else:
        state["dc"][key] = state["dc"].get(key, 0) + bits.signed(bits.symbol(codes))
        block[0] = state["dc"][key] << low


def _ac_first(block: np.ndarray, state: dict, codes: dict, start: int, end: int, low: int) -> None:
    if state["eob"]:
        state["eob"] -= 1
        return
    bits, k = state["bits"], start
    while k <= end:
        run, size = divmod(bits.symbol(codes), 16)
        if size:
            k += run
            value = bits.signed(size)
            block[k] = value << low if value >= 0 else -(-value << low)
        elif run == 15:
            k += 15
        else:
            state["eob"] = (1 << run) - 1 + (bits.take(run) if run else 0)
            return
        k += 1


def _ac_refine(block: np.ndarray, state: dict, codes: dict, start: int, end: int, low: int) -> None:
    bits, k, one = state["bits"], start, 1 << low

    def correct(k: int) -> None:
        if bits.take(1):
            block[k] += one if block[k] > 0 else -one

    if not state["eob"]:
        while k <= end:
            run, size = divmod(bits.symbol(codes), 16)
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif run < 15:
                state["eob"] = (1 << run) + (bits.take(run) if run else 0)
                break
            while k <= end:
                if block[k]:
                    correct(k)
                elif run:
                    run -= 1
                else:
                    if value:
                        block[k] = value
                    k += 1
                    break
                k += 1
    if state["eob"]:
        while k <= end:
            if block[k]:
                correct(k)
            k += 1
        state["eob"] -= 1


def _raw(coded: bytes) -> np.ndarray:
    return np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8)


def _uniform_dc(parts: list, tables: dict, high: int, low: int, coded: bytes) -> bool:
    """The array path for DC scans of one bit a block: refinements, and first scans of zero differences only."""
    if not high:
        return all(tables.get(t >> 4) == {(1, 0): 0} for _, t in parts)
    if len(parts) == 1:
        c = parts[0][0]
        bits = np.unpackbits(_raw(coded), count=c.rows * c.cols).reshape(c.rows, c.cols)
        c.coef[: c.rows, : c.cols, 0] |= bits.astype(np.int32) << low
        return True
    first = parts[0][0]
    down, across = first.coef.shape[0] // first.v, first.coef.shape[1] // first.h
    each = sum(c.h * c.v for c, _ in parts)
    bits = np.unpackbits(_raw(coded), count=down * across * each).reshape(down, across, each).astype(np.int32) << low
    at = 0
    for c, _ in parts:
        own = bits[:, :, at : at + c.h * c.v].reshape(down, across, c.v, c.h).transpose(0, 2, 1, 3)
        c.coef[:, :, 0] |= own.reshape(c.coef.shape[:2])
        at += c.h * c.v
    return True


def _uniform_ac(c: _Component, codes: dict, start: int, end: int, high: int, low: int, coded: bytes) -> bool:
    """The array path for AC scans whose every symbol has the same length; false if this is none of them."""
    if c.coef.shape[:2] != (c.rows, c.cols):
        return False
    blocks = c.coef.reshape(-1, 64)
    n, band = len(blocks), end - start + 1
    if not high and len(codes) == 1 and (1, 0) in codes and 0 < codes[1, 0] < 8:
        size = codes[1, 0]
        if size == 7:  # a byte each
            value = _raw(coded)[: n * band].astype(np.int32)
        else:
            each = np.unpackbits(_raw(coded), count=n * band * (size + 1)).reshape(-1, size + 1)
            value = np.packbits(each, axis=1).astype(np.int32)[:, 0] >> (7 - size)
        value = np.where(value >> (size - 1), value << low, (value + 1 - (1 << size)) * (1 << low))
        blocks[:, start : end + 1] = value.reshape(n, band)
        return True
    if high and codes == {(1, 0): 0} and blocks[:, start : end + 1].all():
        fix = np.unpackbits(_raw(coded), count=n * (band + 1)).reshape(n, band + 1)[:, 1:].astype(np.int32) << low
        part = blocks[:, start : end + 1]
        part += np.where(part > 0, fix, -fix)
        return True
    return False


def payload(image: Image) -> bytes:
    """The bytes that ``encode`` stored."""
    if not image.comment.startswith(_MARK):
        raise ValueError("no payload here")
    luma, cb, cr = (image.comps[i].coef for i in (1, 2, 3))
    high, wide = cb.shape[:2]
    cells = np.empty((high * wide, 6, 64), np.uint8)

    def back(coef: np.ndarray) -> np.ndarray:
        out = np.where(coef < 0, coef + 255, coef)
        return out.astype(np.uint8)

    cells[:, :4] = back(luma).reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    cells[:, 4], cells[:, 5] = back(cb).reshape(-1, 64), back(cr).reshape(-1, 64)
    return cells.tobytes()[: int(image.comment[len(_MARK) :])]


_K = np.arange(8)
_BASIS = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]).astype(np.float32)


def _plane(image: Image, c: _Component) -> np.ndarray:
    """Samples of one component after dequantising and the inverse transform."""
    rows, cols = c.coef.shape[:2]
    natural = np.empty((rows * cols, 64), np.float32)
    natural[:, ZIGZAG] = c.coef.reshape(-1, 64) * image.quants[c.quant]
    blocks = _BASIS.T @ natural.reshape(-1, 8, 8) @ _BASIS
    return blocks.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8) + 128


def rgb(image: Image) -> np.ndarray:
    """Height x width x 3, unsigned bytes, chroma repeated up to full resolution."""
    comps = list(image.comps.values())
    h, v = max(c.h for c in comps), max(c.v for c in comps)
    planes = []
    for c in comps:
        p = _plane(image, c)
        p = p.repeat(v // c.v, axis=0) if c.v < v else p
        p = p.repeat(h // c.h, axis=1) if c.h < h else p
        planes.append(p[: image.height, : image.width])
    if len(planes) == 1:
        planes = planes * 3
    else:
        y, cb, cr = planes
        cb, cr = cb - 128, cr - 128
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.stack([np.clip(np.rint(p), 0, 255).astype(np.uint8) for p in planes], axis=-1)


def feature(tensor: np.ndarray) -> str:
    """Size, mean of each channel in 1/16 steps, and the mean luma of a 4 x 4 grid."""
    means = tensor.mean(axis=(0, 1), dtype=np.float64)
    luma = tensor[..., 1]
    grid = luma.reshape(4, luma.shape[0] // 4, 4, luma.shape[1] // 4).mean(axis=(1, 3), dtype=np.float64)
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{','.join(str(int(m * 16)) for m in means)}:{bytes(grid.astype(np.uint8).ravel()).hex()}"


def media_columns(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", media: bool = True, tensors: bool = True) -> DataFrame:
    """``keep`` columns, payload digests read back from the stored form, a feature, and on demand
    the stored form (``media``) and its full-resolution RGB tensor (``rgb``, with height and width)."""
    frame, fields, take = text_frame(docs, keep, text)
    schema = f"{fields}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows: list[tuple] = []
        for t in take(cols):
            n, data = padded(t)
            file = encode(data)
            image = decode(file)
            back, tensor = payload(image), rgb(image)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(tensor)) + ((file,) if media else ()) + ((tensor.shape[0], tensor.shape[1], tensor.tobytes()) if tensors else ()))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] * media), *(["height", "width", "rgb"] * tensors)]
        return cols | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(frame, run, schema + ", media binary" * media + ", height int, width int, rgb binary" * tensors)
