import unicodedata

import pytest
from pyspark.sql import functions as F

from formweave.functions import branching, coerce, headers, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


SPACES = ["  a b\t", "\xa0x\xa0", "\x1cx\x1f", "é", "", None, " \n", " x　", "Straße", "ﬁ"]


@pytest.mark.parametrize("s", SPACES)
def test_normalize(spark, s):
    assert one(spark, text.normalize_string("s"), s=s) == unicodedata.normalize("NFC", s or "").strip()
    assert one(spark, text.normalize_case_insensitive("s"), s=s) == unicodedata.normalize("NFC", s or "").strip().casefold()
    assert one(spark, text.is_blank("s"), s=s) == ((s or "").strip() == "")


def test_small_text_functions(spark):
    assert one(spark, text.canonicalize_header("s"), s="Alert\n(Yes / No)") == "alertyesno"
    assert one(spark, text.canonical_quotes("s"), s=" a  'b'\n c ") == 'a "b" c'
    assert one(spark, text.split_options("s"), s="red| blue ||red") == ["blue", "red"]
    assert [one(spark, text.a1(F.lit(3), F.lit(c)), s="") for c in (1, 26, 27, 702, 703, 16384)] == ["A3", "Z3", "AA3", "ZZ3", "AAA3", "XFD3"]
    assert one(spark, text.bbox_key(*map(F.lit, (5.0, -5.0, 1.0, 7.0)))[0], s="") == 2
    assert one(spark, F.round(text.combine_confidences(F.array(F.lit(0.8), F.lit(0.7))), 6), s="") == 0.94
    assert one(spark, text.clean_extracted("s"), s="ﬁne oﬃce") == "fine office"
    assert one(spark, text.latency_s(F.lit(2.0), F.lit(1.0)), s="") == 0


@pytest.mark.parametrize("s,n", [("1,234.5", 1234.5), ("1_000", 1000.0), ("1d", None), ("1.5f", None), (" 7 ", 7.0), ("", None), ("abc", None), ("1e3", 1000.0), ("-.5", -0.5), ("inf", float("inf")), ("1__0", None)])
def test_numbers(spark, s, n):
    assert one(spark, coerce.number_of_text(F.col("s")), s=s) == n


@pytest.mark.parametrize("s,d", [("2024-01-15", "2024-01-15"), ("Jan 15, 2024", "2024-01-15"), ("january 15 2024", "2024-01-15"), ("1/15/2024", "2024-01-15"), ("15/1/2024", "2024-01-15"), ("2024-01-15T10:00:00", "2024-01-15"), ("2024-02-30", None), ("5", None), ("May", None), (None, None)])
def test_dates(spark, s, d):
    got = one(spark, coerce.date_of_text(F.col("s")), s=s)
    assert (str(got) if got else None) == d


def test_cells_equal(spark):
    t, n, d = coerce.text_value, coerce.number_value, coerce.date_value
    eq = lambda a, b: one(spark, coerce.cells_equal(a, b), s="")
    assert eq(t(F.lit(None).cast("string")), t(F.lit(" ")))
    assert eq(n(F.lit(5), F.lit("5")), t(F.lit("5.0")))
    assert eq(n(F.lit(0.1 + 0.2), F.lit("0.30000000000000004")), n(F.lit(0.3), F.lit("0.3")))
    assert eq(d(F.lit("2024-01-15").cast("date")), t(F.lit("Jan 15, 2024")))
    assert not eq(t(F.lit("5")), t(F.lit("5.0")))
    assert not eq(n(F.lit(float("nan")), F.lit("x")), n(F.lit(float("nan")), F.lit("y")))


CASES = [
    ('Q3="yes" AND Q5="no"', 'Display if Q3 = "yes" AND Q5 = "no"'),
    ('display if Q5 = "no" and Q3 = \'yes\'', 'Display if Q3 = "yes" AND Q5 = "no"'),
    (r"Q1 = 'other\'s'", 'Display if Q1 = "other\'s"'),
    ("Q1 = 'other''s'", 'Display if Q1 = "other\'s"'),
    ('Q1 in "a"', 'Display if Q1 in ("a")'),
    ('Q1 IN ("b", "a", "b")', 'Display if Q1 in ("a", "b", "b")'),
    ('Q1 = (("b"), ())', 'Display if Q1 = (("b"), ())'),
    ('Q1 != "a\\\\b"', 'Display if Q1 != "a\\\\b"'),
    ('Q1 in ()', "Display if Q1 in ()"),
]
BAD = ["", None, "  ", "garbage", 'Q1 = "a" x', "Q1 = yes", 'Q1 = "a AND b"', 'Q1 = "a', 'Q1 in ("a",)', "Q1 in (,)", 'q1 = "a"', 'Q1 inn "a"', 'Q1 = "a" AND ', 'Q1 = "a")', 'Q1 = ("a" "b")', "Display if", 'Q1 = "a""']


@pytest.mark.parametrize("s,canon", CASES)
def test_branching(s, canon):
    assert branching.canonicalize(s) == canon
    assert branching.canonicalize(canon) == canon


@pytest.mark.parametrize("s", BAD)
def test_branching_errors(s):
    with pytest.raises(branching.BranchingError):
        branching.canonicalize(s)
    assert branching.try_canonicalize(s) is None and not branching.equivalent_texts(s, s)


def test_branching_columns(spark):
    assert one(spark, branching.equivalent(F.col("a"), F.col("b")), a=CASES[0][0], b=CASES[1][0])
    for s, ok in (("If Q1 anything", True), ("display if Q12", True), ("If q1 x", True), ("bad", False), ("If Q1 a\rb", True), ("If Q1 a\nb", False), (None, False)):
        assert one(spark, branching.loosely_valid("s"), s=s) == ok


def test_priorities(spark):
    for h, p, t, w in (("questiontype", "critical", 0.97, 5), ("required", "high", 0.92, 3), ("alert", "medium", 0.85, 1), ("itnotes", "low", 0.99, 0), ("x", "unclassified", 0, 0)):
        pr = headers.column_priority(F.lit(h))
        assert (one(spark, pr, s=""), one(spark, headers.priority_threshold(pr), s=""), one(spark, headers.priority_weight(pr), s="")) == (p, t, w)
