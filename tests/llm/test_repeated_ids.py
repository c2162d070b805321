import corpus_pipeline as p


def test_texts_of_one_id_are_kept_apart(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (3, c), (3, c.replace("c39", "d")), (3, b + " again"), (None, a)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in p.drop_near_copies(spark, d, sf).collect()]
    assert len(got) == 4 and got.count((None, a)) == 1 and got.count((1, a)) == 1
    for letter in "bc":  # one row of each component of near copies
        assert sum(t.startswith(f"{letter}0 ") for _, t in got) == 1
