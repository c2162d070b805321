"""The n-gram Jaccard join over long words and hot shingles, against sets of word tuples."""

import random

import numpy as np
import pytest

from formweave.llm import jaccard_join
from test_tables import brute_components, near_copies, sets


def long_words():
    rng = random.Random(9)
    a, b = "".join(rng.choice("xyz") for _ in range(64)), "".join(rng.choice("xyz") for _ in range(64))
    rows = [(1, a + b + b + a), (2, b + a + a + b), (3, a + b + b + a), (4, b + b + a + a), (5, a * 4), (6, b * 4)]
    tail = " ".join(f"w{i}" for i in range(40))
    rows += [(10, tail + " " + a + b + b + a), (11, tail + " " + b + a + a + b)]
    for k, size in enumerate((65, 127, 128, 129, 640, 5000)):
        word = "".join(rng.choice("abcdef") for _ in range(size))
        rows += [(20 + 3 * k, word), (21 + 3 * k, word[64:] + word[:64]), (22 + 3 * k, word.upper())]
    signs = [chr(0x4E00 + rng.randrange(300)) for _ in range(200)]
    for k in range(6):  # texts without a space
        blocks = ["".join(signs[i : i + 64]) for i in range(0, 192, 64)]
        rng.shuffle(blocks)
        rows.append((60 + k, "".join(blocks)))
    return rows


def test_sets_of_long_words():
    texts = [t for _, t in long_words()]
    for n in (1, 4, 5):
        want = [sets(t, n) for t in texts]
        got = jaccard_join.shingle_sets(texts, n)
        known: dict[bytes, int] = {}
        ids = [jaccard_join.word_ids(t, known) for t in texts]
        exact = jaccard_join.exact_sets(ids, len(known), n)
        for i in range(len(texts)):
            assert len(got[i]) == len(want[i]) == len(exact[i])
            for j in range(i):
                common = len(want[i] & want[j])
                assert len(np.intersect1d(got[i], got[j])) == common == len(np.intersect1d(exact[i], exact[j]))


def test_many_words_need_new_numbers():
    texts = [" ".join(f"v{(i * k) % 70000}" for i in range(70000)) for k in (1, 3)] + ["", "v1", "v1 v2"]
    known: dict[bytes, int] = {}
    got = jaccard_join.exact_sets([jaccard_join.word_ids(t, known) for t in texts], len(known), 5)
    want = [sets(t, 5) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    assert len(np.intersect1d(got[0], got[1])) == len(want[0] & want[1])


@pytest.mark.parametrize("split,unit,run", [(2, 3, 4), (1, 1, 2)])
def test_hot_shingles(spark, monkeypatch, split, unit, run):
    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    monkeypatch.setattr(jaccard_join, "UNIT", unit)
    monkeypatch.setattr(jaccard_join, "RUN", run)
    monkeypatch.setattr(jaccard_join, "ORDER_LEAST", 2)
    rng = random.Random(3)
    rows = near_copies() + [(8000 + i, t) for i, t in long_words()]
    # groups of several classes: one prefix and size, and other shingles that differ
    stem = " ".join(f"s{i}" for i in range(30))
    rows += [(5000 + i, stem + " " + " ".join(rng.choice("uv") for _ in range(12))) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for n, percent in ((4, 85), (2, 60)):
        got = jaccard_join.ngram_jaccard_join(d, n, percent).documents.collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, percent)
    own = {i: sets(t, 3) for i, t in rows}
    first = {}
    for i in sorted(own):
        first.setdefault(own[i], i)
    reps = sorted(i for s, i in first.items() if s)
    want = {(a, b): (len(own[a] & own[b]), len(own[a] | own[b])) for a in reps for b in reps if a < b and own[a] & own[b] and 100 * len(own[a] & own[b]) >= 70 * len(own[a] | own[b])}
    links = {(r.a, r.b): (r.overlap, r.either) for r in jaccard_join.ngram_jaccard_join(d, 3, 70, all_links=True).links.collect()}
    assert links == want


def test_sketches_fold_and_bound_differences():
    rng = np.random.default_rng(7)
    for n in (1, 500, 1025, 9000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 8 + 400).astype(np.uint64)])
        x, y = jaccard_join.sketch(a), jaccard_join.sketch(b)
        size = min(len(x), len(y))
        bits = (jaccard_join.folded(x, size) ^ jaccard_join.folded(y, size)).bit_count()
        assert bits <= len(np.setxor1d(a, b))
        if len(x) == size:  # folding gives the sketch of the smaller size
            own = np.bincount((b >> np.uint64(40)).astype(np.int64) % (8 * size), minlength=8 * size) & 1
            assert jaccard_join.folded(y, size) == int.from_bytes(np.packbits(own.astype(np.uint8)).tobytes())
