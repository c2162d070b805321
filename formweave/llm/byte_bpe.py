"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

No tokenizer is trained.  The rank file gives every token's bytes and merge
rank; each byte is mapped to one code point (U+0100 + byte), each token becomes
a piece scored by its negative rank, the normaliser is the identity.  Merging
the adjacent pair with the best score is then merging the pair of lowest rank,
which is byte-pair encoding.  Texts are first cut by the public split pattern;
a match that is itself a token is taken whole, as the rank-file format asks.

Edge cases: a null text counts as the empty text (no tokens); rows are
independent, so repeated rows and extra columns change nothing; an empty table
gives an empty result.  A long match without any split point is handed to
sentencepiece whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from formweave.llm.common import map_batches, text_frame

#: Matches kept with their ids in each Python worker, and the longest one kept.
CACHE_ENTRIES, CACHE_CHARS = 1 << 16, 48
_FIRST_CHAR = 0x100
_MODELS: dict[str, "ByteBpe"] = {}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes | str) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited, by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line.strip())}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto.  Piece 0 is the unknown piece; token of rank r is piece r + 1."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks have to be 0, 1, 2, ... without gaps")
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(by_rank):
        pieces.append(_field(1, _field(1, "".join(chr(_FIRST_CHAR + b) for b in token)) + _field(2, float(-rank)) + _field(3, 1)))
    none = (1 << 64) - 1  # -1 as a varint: no such piece
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, blob: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(blob)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache = self.cache
        new = set(chain.from_iterable(cut)).difference(cache)
        long: dict[str, bytes] = {}
        rest: list[str] = []
        for p in new:
            data = p.encode()
            if (rank := self.ranks.get(data)) is not None:
                cache[p] = struct.pack("<I", rank)
            else:
                rest.append(p)
        mapped = [p.encode().decode("latin-1").translate(_SHIFT) for p in rest]
        for p, ids in zip(rest, self.model.encode(mapped, out_type=int, num_threads=1) if rest else [], strict=True):
            (cache if len(p) <= CACHE_CHARS else long)[p] = struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids])
        if long:
            return [b"".join([cache[p] if p in cache else long[p] for p in pieces]) for pieces in cut]
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_SHIFT = {b: _FIRST_CHAR + b for b in range(256)}


def _model(blob: bytes, pattern: str) -> ByteBpe:
    key = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = ByteBpe(blob, pattern)
    return _MODELS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: bool = True) -> DataFrame:
    """``keep`` columns plus n_tokens, the ids (array<int>, unless ``ids`` is false) and digests of ids and decoded bytes.

    The rank file is read once on the driver and shipped with the tasks (its
    size is that of a fixed vocabulary, about 1 MB), so executors need no file.
    """
    with open(ranks_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    frame, fields, take = text_frame(docs, keep, text)

    def run(cols: dict[str, list]) -> dict[str, list]:
        model = _model(shipped.value, pattern)
        packed = model.encode([t or "" for t in take(cols)])
        cols["n_tokens"] = [len(p) // 4 for p in packed]
        if ids:
            cols["ids"] = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
        cols["ids_sha256"] = [hashlib.sha256(p).hexdigest() for p in packed]
        cols["decoded_sha256"] = [hashlib.sha256(model.decode(p)).hexdigest() for p in packed]
        return cols

    return map_batches(frame, run, f"{fields}, n_tokens bigint, {'ids array<int>, ' if ids else ''}ids_sha256 string, decoded_sha256 string")
