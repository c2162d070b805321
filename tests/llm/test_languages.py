"""Language identification with many languages, large alphabets, long texts and odd ones."""

import random

import numpy as np

from formweave.llm import language_id, mixing

COLUMNS = "doc_id bigint, text string, lang string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash") for i, (t, lang) in enumerate(rows)], COLUMNS)


def test_only_letters_count(spark):
    texts = ["½ ²", "①", "Ⅷ 12", None, "", "ª", "é"]
    assert [bool(language_id.fold(t or "")) for t in texts] == [False] * 5 + [True] * 2
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(table(spark, [(t, None) for t in texts]), {"x": "abc é", "y": "q"}).collect()}
    assert [got[i][0] for i in range(7)] == ["und"] * 5 + ["y", "x"] and got[0][1] == 0
    assert language_id.identify(table(spark, []), {"x": "abc"}).count() == 0
    assert language_id.fit_sample(table(spark, [("½ 12", "x"), (None, "x")])) == {}
    assert language_id.fit_sample(table(spark, [])) == {}


def test_many_languages_of_long_texts(spark):
    rng = random.Random(4)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(60)] for k in range(300)}

    def text(k, size):
        return " ".join(rng.choice(words[k]) for _ in range(size // 6))

    rows = [(text(k, 50_000), f"l{k:03}") for k in range(300)]
    rows[7] = ("\n12 ½ " * 9000 + rows[7][0], "l007")  # letters come late
    d = table(spark, rows)
    d = d.unionByName(d.withColumn("doc_id", d.doc_id + 1000))  # a second chance for ids that are held out
    samples = language_id.fit_sample(d)
    assert len(samples) == len({r.lang for r in d.where(~language_id.held_out()).collect()}) > 250
    assert sum(map(len, samples.values())) <= language_id.SAMPLE_CHARS and min(map(len, samples.values())) > 100
    some = [(text(k, 900), f"l{k:03}") for k in range(0, 300, 10) if f"l{k:03}" in samples]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(table(spark, some), samples).collect()}
    assert sum(got[i] == lang for i, (_, lang) in enumerate(some)) >= 0.8 * len(some)


def test_large_alphabet_keeps_tables_small():
    rng = random.Random(5)
    signs = [chr(0x4E00 + rng.randrange(4000)) for _ in range(3000)]
    parser = language_id.CrossParser({"zh": "".join(rng.choice(signs) for _ in range(20_000)), "en": "the cat sat on the mat " * 40, "ja": "".join(chr(0x3041 + rng.randrange(80)) for _ in range(5000))})
    assert sum(t.nbytes for t in parser.tables) < 200 << 20
    texts = ["".join(rng.choice(signs) for _ in range(300)), "a cat on a mat " * 900, "".join(chr(0x3041 + rng.randrange(80)) for _ in range(300)), "the 𝒳"]
    assert parser.predict(texts)[0] == ["zh", "en", "ja", "en"]


def brute_costs(samples, text):
    """Greedy longest matches by substring search."""
    out = {}
    for name, sample in samples.items():
        n, i = 0, 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in sample and text[i : i + k] in sample:
                k += 1
            i, n = i + k, n + 1
        out[name] = n * np.log2(len(sample) + 2) / len(text)
    return out


def test_predictions_and_scores_against_brute_force(spark):
    rng = random.Random(6)
    samples = {"a": "".join(rng.choice("abcd ") for _ in range(300)), "b": "".join(rng.choice("cdef ") for _ in range(200)), "c": "xyz xyz zy"}
    rows = [("".join(rng.choice("abcdefxyz") for _ in range(rng.randrange(1, 200))), None) for _ in range(60)]
    for r in language_id.identify(table(spark, rows), samples).collect():
        want = brute_costs(samples, rows[r.doc_id][0])
        best = min(sorted(want), key=want.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum((want[best] / x) ** 2 for x in want.values())) < 1e-9


def test_scaled_lengths_are_fitted_exactly():
    assert mixing.fit(np.array([50_000, 45_000]), np.array([1, 2]), 90_000).tolist() == [0, 2]
    huge = 10**9
    assert mixing.fit(np.array([5 * huge, 3 * huge, 7]), np.array([3, 4, 0]), 19 * huge + 5).tolist() == [2, 3, 0]
    assert mixing.fit(np.array([0, 6, 4]), np.array([5, 0, 9]), 11).tolist() == [0, 0, 2]
