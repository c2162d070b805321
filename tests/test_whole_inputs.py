"""Queries see every row and the whole of each text; expected values are made here, not by the SQL oracles."""

from collections import defaultdict

from formweave.queries import QUERIES
from formweave.sources import derived

LEAD = "the same lead-in of all turns: "


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_text_pairs_are_whole(spark, tmp_path):
    rows = [(c, t, "user", f"{LEAD}{c}-{t // 2 if c == 2 else t}") for c in range(1, 8) for t in range(6)]
    write(spark, tmp_path, "conversations", rows, "conv_id bigint, turn bigint, role string, text string")
    text = {(c, t): x for c, t, _, x in rows}
    keys = [(c, t) for c, t in text if (c, t + 1) in text]
    want = [(text[k], text[k[0], k[1] + 1]) for k in keys]
    got = derived.text_pairs(spark, str(tmp_path)).where("row_index % 4 = 0").collect()
    assert sorted((r.candidate, r.reference) for r in got) == sorted(want) and len(want) == 35
    n = [c * 1000 + t for c, t in keys]
    boxes = {f"red | blue|{k % 4}": k for k in n if k % 3 == 0}
    exact = defaultdict(int)
    for (c, t), (a, b) in zip(keys, want, strict=True):
        exact[f"f{c % 7}"] += (a == b) + ((c * 1000 + t) % 4 == 0)
    score = {r.fixture_id: r for r in QUERIES["answer_sets"](spark, str(tmp_path)).collect()}
    same = defaultdict(int)
    for k in n:
        same[f"f{k // 1000 % 7}"] += k % 3 == 0 and k % 4 == k % 2
    assert {f: r.numerator for f, r in score.items()} == {f: exact[f] + same[f] for f in score} and boxes
    assert sum(r.denominator for r in score.values()) == len(n) + sum(k % 4 == 0 for k in n) + sum(k % 3 == 0 for k in n)
    open_pairs = {p for p in want if p[0] != p[1]} | {(f"red | blue|{k % 4}", f"{k % 2}|red|blue|") for k in n if k % 3 == 0 and k % 4 != k % 2}
    assert sum(r.pairs for r in QUERIES["judge_calls"](spark, str(tmp_path)).collect()) == len(open_pairs)
    assert sum(r.denominator for r in QUERIES["text_equivalence"](spark, str(tmp_path)).collect()) == sum(r.denominator for r in score.values())


def test_block_texts_are_whole(spark, tmp_path):
    rows = [(i, f"{LEAD}{'long ' * 50}{i} date of birth", "en", "s", 9) for i in range(50)]
    write(spark, tmp_path, "documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    text = {f"b{r[0]}": r[1] for r in rows}
    got = QUERIES["map_rows"](spark, str(tmp_path)).collect()
    assert got and all(r.question_text == text[r.block_id] and r.auto_populated == "Yes" for r in got)
    assert {r.section for r in got} - {None} <= set(text.values())
    assert {o for r in got if r.answer_text for o in r.answer_text.split("|")} <= set(text.values())
    title = QUERIES["document_titles"](spark, str(tmp_path)).first().assessment_title
    assert title in text.values()


def test_page_blocks_are_whole(spark, tmp_path):
    body = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(14))
    write(spark, tmp_path, "pages", [(1, "http://a.example/1", f"<body>{body}</body>")], "page_id bigint, url string, html string")
    got = {r.block_id: r for r in QUERIES["classified_blocks"](spark, str(tmp_path)).collect()}
    assert all(got[f"p1-{i}"].block_type == "display" for i in range(14))
    assert got["made-p1-1"].block_type == "question_label" and got["made-p1-3"].block_type != "checkbox_option"
    assert sum(b.startswith("made-") for b in got) == 14


def test_vocabulary_reads_all_parts(spark, tmp_path):
    rows = [(i, f"Brand#{i % 4}{i % 7}") for i in range(1, 60)]
    write(spark, tmp_path, "part", rows, "p_partkey bigint, p_brand string")
    want = {}
    for k, b in rows:
        if not b.endswith("5"):
            want.setdefault((f"part{k % 3}", b.lower()), (b.upper() if k % 2 == 0 else b, k + 1))
    got = {(r.fixture_id, r.key): (r.value, r.row) for r in QUERIES["controlled_vocabulary"](spark, str(tmp_path)).collect()}
    assert got == want
