"""N-gram Jaccard self-join of documents by grouped prefixes.

A document is the set of its distinct n-word shingles (bytes A-Z in lower case,
words apart by ASCII white space); with fewer words the whole sequence is one
shingle.  Two documents link when 100 * |A and B| >= percent * |A or B|.

1. Shingles are 64-bit hashes, ordered by how often they occur and then by
   hash.  Any order is exact, a frequency order is fast: counts are gathered
   from all documents, as far as a shingle occurs twice in a stretch of one
   task's input, and the most frequent ``ORDER_ENTRIES`` take part (the bound
   is on the order only, not on candidates).
2. The prefix of a set of s shingles is its first s - ceil(percent * s / 100) + 1:
   linked sets share a shingle of their prefixes.  Documents of equal sets fall
   into one class, classes of equal prefix and size into one group.
3. One row per group and prefix shingle is dealt by shingle.  Pairs of groups
   that share one pass the length and position filters; pairs are expanded to
   the classes of their groups and verified on the texts.
   Verification interns the words themselves, so a link never rests on a hash.
4. Where more than ``RUN`` groups share a shingle, only each one with its
   neighbour and with the run's hub are tried at once, and of the classes of one
   group each with the first.  Components are found; then the runs, groups and
   short pairs whose classes are not in one component yet are opened: every pair
   of classes in different components is tried, unless parity sketches show that
   the sets differ too much (they never differ in more bits than the sets do, so
   no link is lost).  So a group of near copies costs a line of comparisons, not
   a square, and yet no pair that could join two components is left out.
   ``all_links`` opens everything instead, for callers that want each link
   between classes.
   A frequent shingle is dealt by salt, as many as its count asks for, and opened
   runs are dealt in chunks of ``UNIT`` classes: those of the largest component
   each once, the others to every chunk they have to meet.  So no task gets a
   whole run of a shingle that a third of all rows hold.
5. ``count_links`` gives each document the number of classes that its class
   links with.  Linked classes are of one component, so its classes are dealt
   into chunks of at most ``CHUNK`` classes and about ``CHUNK_SHINGLES`` shingles,
   every two chunks meet in a task's unit and all pairs of a unit are compared
   there, by words: only counts leave it, never pairs.

Shingle hashes choose candidates and name classes: a word is hashed by a table
over place and byte, in blocks of 64 bytes that are mixed with their number, and
classes are named by 128 bits over a set's hashes.

Edge cases: null texts and texts without words have the empty set and link
with nothing; a null id links with nothing and has a null component; rows that
share an id are one document when components are named; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.common import SLICE_CHARS, drop_stash, small_batches, stash
from formweave.llm.components import components

ORDER_ENTRIES, ORDER_LEAST = 1 << 18, 4
#: Tokens that one task counts at a time for the frequency order.
COUNT_TOKENS = 1 << 20
RUN = 4
#: Rows of one shingle in a task, about; classes in a chunk of an opened run.
SPLIT, UNIT = 1 << 10, 1 << 10
#: Bits of the smallest sketch and of the largest, powers of two.
SKETCH_BITS, MOST_SKETCH_BITS = 1 << 10, 1 << 24
#: Sets that a task remembers to leave out the prefixes of copies.
SEEN_SETS = 1 << 20
#: Classes of one component in a chunk, shingles of a chunk, and shingles that are spread out at once to compare it.
CHUNK, CHUNK_SHINGLES, SPREAD = 512, 1 << 17, 1 << 12
#: Ids of candidate documents up to this many are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 1 << 20
_U = np.uint64
_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, 64 * 256, dtype=np.uint64)  # byte by place in its word


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    data = [(t or "").encode() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(data):
        stop, size = at, 0
        while stop < len(data) and (stop == at or size + len(data[stop]) <= SLICE_CHARS):
            size += len(data[stop])
            stop += 1
        out += _sets(data[at:stop], n)
        at = stop
    return out


def _sets(data: list[bytes], n: int) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    upper = (raw >= 65) & (raw <= 90)
    raw = np.where(upper, raw | 32, raw)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    inside = np.flatnonzero(~gap)
    none = np.zeros(0, _U)
    if not len(inside):
        return [none] * len(data)
    first = np.flatnonzero(before[inside])  # of each word, among the bytes inside words
    starts = inside[first]
    lengths = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    value = _RANDOM[(place & 63) * 256 + raw[inside]]
    block = np.flatnonzero((place & 63) == 0)  # words in blocks of 64 bytes, each but the first mixed with its number
    value = np.add.reduceat(value, block)
    later = np.flatnonzero(place[block])
    value[later] = _mix(value[later] + (place[block[later]] >> 6).astype(_U) * _U(0x9E3779B97F4A7C15))
    word = _mix(np.add.reduceat(value, np.searchsorted(block, first)) + lengths.astype(_U))
    ends = np.cumsum([len(d) + 1 for d in data])
    cut = np.searchsorted(starts, np.concatenate([[0], ends]))  # words before each document
    grams = word[: max(0, len(word) - n + 1)]
    for i in range(1, n):
        grams = _mix(grams * _U(0x9E3779B97F4A7C15) + word[i : i + len(grams)])
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.array([b - a], _U)
            for w in word[a:b]:
                h = _mix(h * _U(0x9E3779B97F4A7C15) + w)
            out.append(h)
        else:
            out.append(none)
    return out


def word_ids(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The text's words as numbers from 1 on; ``known`` holds the words seen so far."""
    return np.array([known.setdefault(w, len(known) + 1) for w in (text or "").encode().lower().split()], np.int64)


def exact_sets(ids: list[np.ndarray], words: int, n: int) -> list[np.ndarray]:
    """Distinct n-word shingles of ``word_ids`` up to ``words``, as integers that are equal just where all words are."""
    length = np.array([len(x) for x in ids], np.int64)
    wide = np.where(length > 0, np.maximum(length, n), 0)  # fewer words than n: zeros behind them
    offset = np.cumsum(wide) - wide
    flat = np.zeros(int(wide.sum()), np.int64)
    flat[np.arange(int(length.sum())) + np.repeat(offset - np.cumsum(length) + length, length)] = np.concatenate([*ids, np.zeros(0, np.int64)])
    grams = np.maximum(wide - n + 1, 0)
    cut = np.concatenate([[0], np.cumsum(grams)])
    start = np.arange(cut[-1]) + np.repeat(offset - cut[:-1], grams)
    key, top = flat[start], words + 1
    for i in range(1, n):
        if top > (1 << 62) // (words + 1):
            found, key = np.unique(key, return_inverse=True)
            top = len(found)
        key, top = key * (words + 1) + flat[start + i], top * (words + 1)
    return [np.unique(key[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


@contextmanager
def _arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of another size, for frames of numbers, while an action runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def frequency_order(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and a weight (log2 of the count) for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            if often.any():
                yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), n):
                key = xxhash.xxh3_64_intdigest(s)
                if len(s) and key not in seen:  # copies count once
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if size >= COUNT_TOKENS:
                yield from counted()
                held, size = [], 0
                seen.clear()
        if held:
            yield from counted()

    found = docs.select("text").mapInArrow(run, "token bigint, n bigint")
    top = found.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= ORDER_LEAST).orderBy(F.desc("n"), "token").limit(ORDER_ENTRIES)
    rows = top.toArrow()
    tokens = rows["token"].to_numpy().view(_U)
    order = np.argsort(tokens)
    return tokens[order], np.log2(rows["n"].to_numpy()[order]).astype(np.uint8) + 1 if len(tokens) else np.zeros(0, np.uint8)


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set, SKETCH_BITS or about one for each of its shingles: those in which two sketches of one
    length differ are at most as many as their sets do."""
    m = min(MOST_SKETCH_BITS, max(SKETCH_BITS, 1 << (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s >> _U(40)).astype(np.int64) % m, minlength=m) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> int:
    """A sketch as a number, folded to ``size`` bytes: what the set's sketch of that size is."""
    value, now = int.from_bytes(bits), len(bits)
    while now > size:
        now //= 2
        value = (value >> 8 * now) ^ (value & ((1 << 8 * now) - 1))
    return value


def signatures(docs: DataFrame, n: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, size, setkey, ghash, sketch, prefix, salts of each document; keys are null for the empty set.

    salts says over how many tasks the rows of each prefix shingle are dealt, null if one for all.  ghash names the group (prefix and size).  Of equal sets within a task only the first carries
    its prefix, so copies by the thousand do not meet in the tasks of their shingles."""
    shipped = docs.sparkSession.sparkContext.broadcast(order)  # at most ORDER_ENTRIES of 9 bytes
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, weights = shipped.value
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > SEEN_SETS:
                seen.clear()
            sizes, sets, groups, sketches, prefixes, salts = [], [], [], [], [], []
            for s, named in zip(shingle_sets(batch.column(1).to_pylist(), n), batch.column(0).is_valid().to_pylist(), strict=True):
                sizes.append(len(s))
                if not len(s):
                    sets.append(None)
                    groups.append(None)
                    sketches.append(None)
                    prefixes.append(None)
                    salts.append(None)
                    continue
                k = prefix_length(len(s), percent)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    weight = np.where(tokens[at] == s, weights[at], 0)
                    light = s[weight == 0]
                    chosen = None if len(light) >= k else np.lexsort((s, weight))[:k]
                    head = light[:k] if chosen is None else s[chosen]
                    many = None if chosen is None else np.maximum((1 << np.minimum(weight[chosen], 40).astype(np.int64)) // SPLIT, 1)
                else:
                    head, many = s[:k], None
                key = xxhash.xxh3_128_digest(s)
                sets.append(key)
                groups.append(xxhash.xxh3_64_intdigest(head.tobytes() + len(s).to_bytes(8, "little")) - (1 << 63))
                sketches.append(sketch(s))
                sent = named and key not in seen
                prefixes.append(head.view(np.int64) if sent else None)
                salts.append(many if sent and many is not None and many.max() > 1 else None)
                if named:  # rows without an id are left out, so they carry no prefix for others
                    seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary()), pa.array(groups, pa.int64()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int64()))],
                names=["doc_id", "size", "setkey", "ghash", "sketch", "prefix", "salts"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, size int, setkey binary, ghash bigint, sketch binary, prefix array<bigint>, salts array<bigint>")


def _passes(sa: np.ndarray, sb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Length and position filters of pairs: sizes and places of the shared shingle."""
    small, large = np.minimum(sa, sb), np.maximum(sa, sb)
    need = -(-percent * (sa + sb) // (100 + percent))
    most = np.minimum(pa_, pb) + 1 + np.minimum(sa - pa_ - 1, sb - pb - 1)
    return (100 * small >= percent * large) & (most >= need)


def _runs(batches: Iterable[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that no run of equal ``keys`` first columns is divided."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = len(cols[0]) - int(np.logical_and.reduce([c == c[-1] for c in cols[:keys]]).sum())
        held = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if held is not None and len(held[0]):
        yield held


def bucket_pairs(rows: DataFrame, percent: int, run_limit: int) -> DataFrame:
    """From (token, grp, size, pos, salts) sorted in partitions: candidate pairs (a, b, token null), and the
    rows of runs that are dealt by salt or longer than ``run_limit`` (token, grp, size, pos, salts)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, grp, size, pos, salts in _runs(batches):
            once = np.concatenate([[True], (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])])  # repeated rows count once
            token, grp, size, pos, salts = token[once], grp[once], size[once].astype(np.int64), pos[once].astype(np.int64), salts[once]
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(begin, len(token)))
            salted = np.maximum.reduceat(salts, begin) > 1
            use = (length > 1) | salted
            if not use.any():
                continue
            more = np.repeat(use, length)
            token, grp, size, pos, salts = token[more], grp[more], size[more], pos[more], salts[more]
            length, salted = length[use], salted[use]
            begin = np.cumsum(length) - length
            end = np.repeat(begin + length, length)
            long = np.repeat((length > run_limit) | salted, length)
            none = np.zeros(0, np.int64)
            left, right = [none], [none]

            def keep(i: np.ndarray, j: np.ndarray, size=size, pos=pos, left=left, right=right) -> None:
                ok = _passes(size[i], size[j], pos[i], pos[j], percent)
                left.append(i[ok])
                right.append(j[ok])

            here = np.arange(len(token))
            for d in range(1, min(int(length.max()), run_limit + 1)):
                i = here[here + d < end]
                if d > 1:
                    i = i[~long[i]]
                if len(i):
                    keep(i, i + d)
            a, b = grp[np.concatenate(left)], grp[np.concatenate(right)]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            k, m = pairs.shape[1], int(long.sum())
            null = [None] * k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(pairs[0]), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(pairs[1]), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(null, pa.int64()), pa.array(token[long])]),
                    pa.concat_arrays([pa.array(null, pa.int64()), pa.array(grp[long])]),
                    pa.concat_arrays([pa.array(null, pa.int32()), pa.array(size[long].astype(np.int32))]),
                    pa.concat_arrays([pa.array(null, pa.int32()), pa.array(pos[long].astype(np.int32))]),
                    pa.concat_arrays([pa.array(null, pa.int64()), pa.array(salts[long])]),
                ],
                names=["a", "b", "token", "grp", "size", "pos", "salts"],
            )

    return rows.mapInArrow(run, "a bigint, b bigint, token bigint, grp bigint, size int, pos int, salts bigint")


def _salt(of: str) -> Column:
    """Where a row of a shingle that is dealt over ``salts`` tasks goes."""
    return F.pmod(F.xxhash64(of), F.col("salts")).alias("salt")


def _for_salts(df: DataFrame) -> DataFrame:
    """One row for each salt of a shingle, to meet the rows that are dealt by it."""
    return df.select(*[c for c in df.columns if c != "salts"], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))


def _hub_pairs(long: DataFrame, percent: int) -> DataFrame:
    """From rows of long runs: each group with the hub of its run, the group that is in most long runs.

    An edited copy has shingles of its own in its prefix; the text that the copies
    were made from has only shared ones, so it scores highest."""
    score = long.groupBy("grp").agg(F.count("*").alias("score"))
    scored = long.join(score, "grp")
    hub = scored.groupBy("token").agg(F.max(F.struct("score", F.col("size").alias("s"), F.col("grp").alias("g"), F.col("pos").alias("p"))).alias("hub"), F.max("salts").alias("salts"))
    both = long.withColumn("salt", _salt("grp")).join(_for_salts(hub.select("token", "hub.s", "hub.g", "hub.p", "salts")), ["token", "salt"]).where("grp <> g")
    need = F.ceil(percent * (F.col("size") + F.col("s")) / (100 + percent))
    most = F.least("pos", "p") + 1 + F.least(F.col("size") - F.col("pos") - 1, F.col("s") - F.col("p") - 1)
    both = both.where((100 * F.least("size", "s") >= percent * F.greatest("size", "s")) & (most >= need))
    return both.select(F.least("grp", "g").alias("a"), F.greatest("grp", "g").alias("b")).distinct()


def _opened(long: DataFrame, short: DataFrame, members: DataFrame, labelled: DataFrame) -> DataFrame:
    """(token, rep, size, pos, component, salts): the classes of every run, group and short pair that are not of one
    component yet.  Groups and short pairs of groups are runs of their own token, all of whose places are 0.

    ``members`` has name, classes of each group, ``labelled`` rep, grp, size, component of each class."""
    span = labelled.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("classes"))
    span = stash(span, "spans")
    apart = long.join(span, "grp").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("salts").alias("salts")).where("low <> high")
    runs = long.withColumn("salt", _salt("grp")).join(_for_salts(apart.select("token", "salts")), ["token", "salt"]).select("token", "grp", "pos", "salts")
    inner = span.where("low <> high").select(F.xxhash64("grp").alias("token"), "grp", F.lit(0).alias("pos"), F.lit(1).cast("bigint").alias("salts"))
    pairs = short.join(span.toDF("a", "la", "ha", "ca"), "a").join(span.toDF("b", "lb", "hb", "cb"), "b")
    pairs = pairs.where((F.least("la", "lb") != F.greatest("ha", "hb")) & (F.col("ca") + F.col("cb") > 2))
    pairs = pairs.select(F.xxhash64("a", "b").alias("token"), F.explode(F.array("a", "b")).alias("grp"), F.lit(0).alias("pos"), F.lit(1).cast("bigint").alias("salts"))
    found = runs.unionByName(inner).unionByName(pairs).join(span.select("grp", "classes"), "grp").join(labelled, "grp")
    return found.select("token", "rep", "size", "pos", "component", F.greatest("salts", F.ceil(F.col("classes") / SPLIT)).alias("salts"))


def _units(opened: DataFrame, sketches: DataFrame) -> DataFrame:
    """(token, low, high, own, size, rep, pos, component, sketch): chunks of runs, two by two where they have to meet.

    Classes of a run's largest component are in chunks that need not meet each other."""
    by = opened.groupBy("token", "component").agg(F.count("*").alias("n"), F.max("salts").alias("salts"))
    by = by.groupBy("token").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.max("salts").alias("salts"))
    by = by.where("top.n < all").select("token", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / UNIT).alias("k"), F.ceil((F.col("all") - F.col("top.n")) / UNIT).alias("more"), "salts")
    rows = opened.withColumn("salt", _salt("rep")).drop("salts").join(_for_salts(by), ["token", "salt"])
    is_main = F.col("component") == F.col("main")
    own = F.when(is_main, F.pmod(F.xxhash64("rep"), F.col("k"))).otherwise(F.col("k") + F.pmod(F.xxhash64("rep"), F.col("more")))
    rows = rows.select("token", own.alias("own"), "size", "rep", "pos", "component", F.when(is_main, F.col("k")).otherwise(0).alias("first"), (F.col("k") + F.col("more") - 1).alias("last")).join(sketches, "rep")
    rows = rows.withColumn("other", F.explode(F.sequence("first", "last")))
    return rows.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "size", "rep", "pos", "component", "sketch")


def _open_pairs(units: DataFrame, percent: int) -> DataFrame:
    """From ``_units`` sorted in partitions: the pairs of a unit in different components that pass the filters
    and whose sketches do not differ too much."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, low, high, own, size, rep, pos, comp, bits in _runs(batches, 3):
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            least = SKETCH_BITS // 8
            words = np.frombuffer(b"".join(x if len(x) == least else folded(x, least).to_bytes(least) for x in bits), np.uint64).reshape(len(bits), -1)
            begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            for a, b in zip(begin, np.append(begin[1:], len(token)), strict=True):
                left, right = [], []
                for i in range(a, b - 1):  # sizes ascend: partners reach up to 100 / percent times the size
                    stop = a + int(np.searchsorted(size[a:b], size[i] * 100 // percent, side="right"))
                    j = np.arange(i + 1, stop)
                    j = j[comp[j] != comp[i]]
                    if low[a] != high[a]:  # pairs of one chunk are tried in its own unit
                        j = j[own[j] != own[i]]
                    j = j[_passes(size[i], size[j], pos[i], pos[j], percent)]
                    if len(j):
                        both = size[i] + size[j]
                        differ = both - 2 * (-(-percent * both // (100 + percent)))
                        j = j[np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64) <= differ]
                    if len(j):
                        left.append(np.minimum(rep[i], rep[j]))
                        right.append(np.maximum(rep[i], rep[j]))
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return units.mapInArrow(run, "a bigint, b bigint")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches, in the smaller one's length, do not rule a link out, so that few texts travel."""
    side = classes.select("rep", "size", "sketch")
    both = pairs.join(side.toDF("a", "za", "ka"), "a").join(side.toDF("b", "zb", "kb"), "b").select("a", "b", "za", "zb", "ka", "kb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            differ = size - 2 * (-(-percent * size // (100 + percent)))
            both = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), differ.tolist(), strict=True)
            ok = pa.array([(folded(x, min(len(x), len(y))) ^ folded(y, min(len(x), len(y)))).bit_count() <= d for x, y, d in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _by_chars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches of pairs (a, b, ta, tb) with texts of about SLICE_CHARS."""
    for batch in batches:
        size = np.cumsum([len(x) + len(y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_CHARS, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, overlap, either) of the pairs that link, from the documents' texts; ``docs`` has doc_id, text."""
    spark = docs.sparkSession
    ids = stash(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidates")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    small_batches(spark)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_chars(batches):
            known: dict[bytes, int] = {}
            left, right = ([word_ids(t, known) for t in batch.column(i).to_pylist()] for i in (2, 3))
            both = exact_sets(left + right, len(known), n)
            left, right = both[: batch.num_rows], both[batch.num_rows :]
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
            either = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - common
            ok = (100 * common >= percent * either) & (common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(common[ok]), pa.array(either[ok])], names=["a", "b", "overlap", "either"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, overlap bigint, either bigint")


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of the sets link (a square of truth values, false on its diagonal)."""
    size = np.array([len(s) for s in sets], np.int64)
    token, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(place, minlength=len(token)) > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[place]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(shared.sum()), SPREAD):
        a, b = np.searchsorted(column, [low, low + SPREAD])
        here = np.zeros((len(sets), min(SPREAD, int(shared.sum()) - low)), np.float32)
        here[row[a:b], column[a:b] - low] = 1
        common += (here @ here.T).astype(np.int64)  # exact: sums stay below 2^24
    linked = (100 * common >= percent * (size[:, None] + size - common)) & (common > 0)
    np.fill_diagonal(linked, False)
    return linked


def link_counts(docs: DataFrame, named: DataFrame, n: int, percent: int) -> DataFrame:
    """(setkey, n_links): the other classes that each class of a component of several links with.

    ``named`` has setkey, size, class_id, component_id of the classes; ``docs`` doc_id, text."""
    sizes = named.groupBy("component_id").agg(F.count("*").alias("m"), F.sum("size").alias("all"), (F.min("class_id") != F.max("class_id")).alias("apart")).where("m > 1")
    inside = stash(named.join(sizes, "component_id"), "inside")
    two = F.col("apart") & (F.col("m") == 2)  # a component of two is their link
    k = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("all") / CHUNK_SHINGLES)).cast("int")
    many = inside.where(~two).select("setkey", F.col("class_id").alias("doc_id"), F.col("component_id").alias("comp"), k.alias("k"), F.pmod(F.xxhash64("setkey"), k).cast("int").alias("own"))
    small_batches(docs.sparkSession)
    wanted = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    met = docs.join(wanted, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("comp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "setkey", "text")
    met = met.repartition(max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "comp", "low", "high").sortWithinPartitions("comp", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, words = None, {}, {}

        def counted() -> pa.RecordBatch:
            keys = list(held)
            own = np.array([held[x][0] for x in keys])
            linked = _linked(exact_sets([held[x][1] for x in keys], len(words), n), percent)
            if unit[1] != unit[2]:  # two chunks meet: pairs of one chunk count in its own unit
                linked &= own[:, None] != own
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(linked.sum(axis=1), pa.int64())], names=["setkey", "n"])

        for batch in batches:
            comp, low, high, own, keys, texts = (c.to_pylist() for c in batch.columns)
            for at, s in enumerate(shingle_sets(texts, n)):
                if (here := (comp[at], low[at], high[at])) != unit:
                    if held:
                        yield counted()
                    unit, held, words = here, {}, {}
                if xxhash.xxh3_128_digest(s) == keys[at]:  # not the other text of a repeated id
                    held[keys[at]] = (own[at], word_ids(texts[at], words))
        if held:
            yield counted()

    counts = met.mapInArrow(run, "setkey binary, n bigint").groupBy("setkey").agg(F.sum("n").alias("n_links"))
    return inside.where(two).select("setkey", F.lit(1).cast("bigint").alias("n_links")).unionByName(counts)


@dataclass(frozen=True)
class Join:
    """documents: doc_id, n_shingles, class_id, component_id, and with ``count_links`` n_links, the number of other
    classes that link with the document's own.  links: verified pairs of class ids (a, b, overlap, either), all of
    them with ``all_links``, else as many as join the components."""

    documents: DataFrame
    links: DataFrame


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, all_links: bool = False, count_links: bool = False) -> Join:
    """Join ``docs`` (doc_id bigint, text) with itself.  See the module for the method and edge cases."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done: list[DataFrame] = []  # written frames that nothing reads in the end

    def keep(df: DataFrame, name: str) -> DataFrame:
        done.append(stash(df, name))
        return done[-1]

    sig = stash(signatures(docs, n, percent, frequency_order(docs, n)), "signatures")
    known = sig.where(F.col("setkey").isNotNull() & F.col("doc_id").isNotNull())
    classes = keep(known.groupBy("setkey").agg(F.min("doc_id").alias("rep"), F.min("ghash").alias("ghash"), F.min("size").alias("size"), F.min("sketch").alias("sketch")), "classes")
    # a group is named by its smallest class, and by its hash while its shingles are dealt
    members = keep(classes.groupBy("ghash").agg(F.min("rep").alias("name"), F.count("*").alias("classes")), "members")
    rows = known.where(F.col("prefix").isNotNull()).select(F.posexplode("prefix").alias("pos", "token"), F.col("ghash").alias("grp"), "size", "salts")
    rows = rows.select("token", "grp", "size", "pos", F.coalesce(F.get("salts", F.col("pos")), F.lit(1)).alias("salts"))
    rows = rows.withColumn("salt", _salt("grp")).repartition(parts, "token", "salt").drop("salt").sortWithinPartitions("token", "size", "grp")
    with _arrow_rows(spark, 20_000):
        found = keep(bucket_pairs(rows, percent, RUN), "buckets")
    names = members.select("ghash", "name")
    pairs = found.where(F.col("a").isNotNull()).select("a", "b").distinct()
    pairs = pairs.join(names.toDF("a", "na"), "a").join(names.toDF("b", "nb"), "b").where("na <> nb")
    short = keep(pairs.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "short")
    long = found.where(F.col("token").isNotNull()).join(names.toDF("grp", "name"), "grp").select("token", "size", F.col("name").alias("grp"), "pos", "salts")
    # classes of one group: each with the first at once, the rest if these do not join them
    spine = members.where("classes > 1").join(classes, "ghash").where("name <> rep").select(F.col("name").alias("a"), F.col("rep").alias("b"))
    first = keep(short.unionByName(_hub_pairs(long, percent)).unionByName(spine).distinct(), "pairs")
    links = stash(verify(docs, keep(plausible(first, classes, percent), "plausible"), n, percent), "links")
    comps = stash(components(links.select("a", "b")), "components")

    def component(df: DataFrame, of: str, name: str) -> DataFrame:
        own = comps.select(F.col("node").alias(of), F.col("component").alias(name))
        return df.join(own, of, "left").withColumn(name, F.coalesce(name, of))

    labelled = classes.join(names, "ghash").select("rep", F.col("name").alias("grp"), "size")
    labelled = labelled.withColumn("component", F.col("rep")) if all_links else component(labelled, "rep", "component")
    opened = keep(_opened(long, short, members, keep(labelled, "labelled")), "opened")
    if not opened.isEmpty():
        units = _units(opened, classes.select("rep", "sketch"))
        units = units.repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high", "size", "rep")
        with _arrow_rows(spark, 4_000):
            rest = keep(_open_pairs(units, percent).distinct().join(first, ["a", "b"], "left_anti"), "rest")
        rest = keep(plausible(rest, classes, percent), "plausible")
        if not rest.isEmpty():
            done.append(links)
            done.append(comps)
            links = stash(links.unionByName(verify(docs, rest, n, percent)), "links")
            comps = stash(components(links.select("a", "b")), "components")
    named = stash(component(classes.select("setkey", "size", F.col("rep").alias("class_id")), "class_id", "component_id"), "named")
    if count_links:
        done.append(named)
        counts = keep(link_counts(docs, named, n, percent), "counts")
        named = stash(named.join(counts, "setkey", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))), "named")
    done.append(comps)
    for frame in done:
        drop_stash(frame)
    documents = sig.select("doc_id", F.col("size").cast("bigint").alias("n_shingles"), "setkey").join(named.drop("size"), "setkey", "left")
    empty = F.col("component_id").isNull() | F.col("doc_id").isNull()
    own = F.when(empty, F.col("doc_id"))
    documents = documents.select("doc_id", "n_shingles", own.otherwise(F.col("class_id")).alias("class_id"), own.otherwise(F.col("component_id")).alias("component_id"), *([F.when(empty, 0).otherwise(F.col("n_links")).alias("n_links")] if count_links else []))
    return Join(documents, links)
