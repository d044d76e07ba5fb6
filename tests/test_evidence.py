"""Places of quotes, spellings of dates, layout and rankings on small rows."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.ranking import ranked_by_buckets
from ledgerloom.operators import evaluation, evidence


def test_quotes_are_cited_any_or_adjacent(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "gamma delta"), (1, 2, "alpha beta")], "doc_id int, para int, text string")
    quotes = spark.createDataFrame([(1, 0, "alpha", 2), (1, 1, "alpha", 9), (1, 2, "beta gamma", 0), (1, 3, "nowhere", 0), (2, 0, "alpha", 0)], "doc_id int, claim int, quote string, cited int")
    found = {(r["doc_id"], r["claim"]): (r["para"], r["way"]) for r in evidence.located(quotes, chunks).collect()}
    assert found == {(1, 0): (2, "cited"), (1, 1): (0, "any"), (1, 2): (0, "adjacent"), (1, 3): (None, None), (2, 0): (None, None)}


def test_spellings_of_dates(spark):
    rows = spark.createDataFrame([("2025-09-05",), ("2025-10",), ("2025",), ("2025-13",), ("text",)], "v string")
    found = {r["v"]: r["t"] for r in rows.select("v", evidence.search_terms(F.col("v")).alias("t")).collect()}
    assert found["2025-09-05"] == ["2025-09-05", "September 5, 2025", "5 September 2025", "Sep 5, 2025", "Sept 5, 2025"]
    assert found["2025-10"] == ["2025-10", "October 2025", "Oct 2025"] and found["2025"] == [] and found["2025-13"] == ["2025-13"] and found["text"] == ["text"]


def test_given_page_comes_first(spark):
    pages = spark.createDataFrame([(1, 1, 0, "on May 2, 2025 x"), (1, 2, 0, "2 May 2025 " + "y" * 300)], "doc_id int, page int, para int, text string")
    fields = spark.createDataFrame([(1, "a", "2025-05-02", 2), (1, "b", "2025-05-02", None), (1, "c", "2025", None)], "doc_id int, field string, value string, page int")
    found = {r["field"]: (r["page"], r["quote"]) for r in evidence.located_values(fields, pages).collect()}
    assert found["a"][0] == 2 and len(found["a"][1]) == 241 and found["b"] == (1, "on May 2, 2025 x") and "c" not in found


def test_cleaned_pdf(spark):
    text = "COURT OF RECORD\r\n12\r\nofﬁce self-\ngoverned\n\n\n 7 \n1982\na  b"
    assert spark.range(1).select(evidence.cleaned_pdf(F.lit(text))).first()[0] == "office self-governed\n\n1982 a b"


def test_one_column_and_two(spark):
    items = spark.createDataFrame([(1, 0, 10.0, 0.0, "a"), (1, 1, 90.0, 0.0, "b"), (2, 0, 10.0, 0.0, "a"), (2, 1, 20.0, 0.0, "b"), (3, 0, 5.0, 0.0, "a")], "page int, i int, x double, y double, text string")
    found = {r["page"]: (r["left"], r["right"], r["two"]) for r in evidence.two_columns(items).collect()}
    assert found == {1: ("a", "b", True), 2: ("a", "b", False), 3: ("", "a", False)}


def test_ranks_by_buckets_equal_one_window(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("b"), F.col("id"))
    found = ranked_by_buckets(rows, ["g"], [(F.col("a"), True), (F.col("b"), False)], [F.col("id")]).select("id", "rank").collect()
    from pyspark.sql import Window

    expected = rows.select("id", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("a"), "b", "id")).cast("long").alias("rank")).collect()
    assert sorted(found) == sorted(expected)


def test_sign_tail(spark):
    rows = spark.createDataFrame([(8, 2), (10, 0), (0, 0), (5, 5), (10_100, 9_900), (5_040, 4_950)], "a long, b long")
    p = [r[0] for r in rows.select(evaluation.sign_tail(F.col("a"), F.col("b"))).collect()]
    assert p[:2] == pytest.approx([0.109375, 0.001953125]) and p[2] is None and p[3] == 1
    assert p[4] == pytest.approx(0.1594, abs=2e-3) and p[5] == pytest.approx(0.3734, abs=2e-3)


def test_sign_tail_of_many_trials(spark):
    """Against exact sums of whole numbers, and at a size that no sum of all terms would bear."""
    pairs = [(a, n - a) for n in (1, 2, 7, 60, 1_001, 30_000) for a in {n, n // 2 + n // 97, (n + 1) // 2}]
    rows = spark.createDataFrame([*pairs, (5_000_050_000, 4_999_950_000)], "a long, b long")
    got = {(r["a"], r["b"]): r["p"] for r in rows.select("a", "b", evaluation.sign_tail(F.col("a"), F.col("b")).alias("p")).collect()}
    for a, b in pairs:
        n, k = a + b, max(a, b)
        term, total = math.comb(n, k), 0
        for i in range(k, n + 1):
            total += term
            term = term * (n - i) // (i + 1)
        assert got[a, b] == pytest.approx(float(min(Fraction(1), Fraction(2 * total, 2**n))), rel=1e-8, abs=1e-300)
    assert got[5_000_050_000, 4_999_950_000] == pytest.approx(0.3173, abs=1e-3)  # one deviation


def test_search_terms(spark):
    values = {
        "2025-09-05": ["2025-09-05", "September 5, 2025", "5 September 2025", "Sep 5, 2025", "Sept 5, 2025"], "2025-05": ["2025-05", "May 2025"], "2025-09": ["2025-09", "September 2025", "Sep 2025", "Sept 2025"],
        "2025": [], "2025-13": ["2025-13"], "2025-02-31": ["2025-02-31", "February 31, 2025", "31 February 2025", "Feb 31, 2025"], " 12 % ": ["12 %"], "a-b-c": ["a-b-c"], "2025-9": ["2025-9"],
    }
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", evidence.search_terms(F.col("v")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == dict(enumerate(values.values()))


def test_cleaned_pages(spark):
    pages = {
        "COURT OF RECORD\r\n12\r\nThe ﬁrst line\nand self-\ndetermination.\n\n\n7\nNext  page": "The first line and self-determination.\n\nNext page",
        "a\n12\nb": "a b", "self-\n12\ndet": "self- det", "Act,\n1982": "Act, 1982", "a\n \nb": "a b", "": "", "\n\n": "", "x-\n5": "x-", "ﬅ\rﬆ": "ft st",
    }
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, v string").select("i", evidence.cleaned_pdf(F.col("v")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == dict(enumerate(pages.values()))
