"""Textbook values of the rules of functions/rules.py, and joins on odd rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.operators import rules


def of(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", column(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_target_values(spark):
    texts = ["$1.8B", "$855 million", "5%", "212", "1,250 mm", "3 thousand", "none", None, "~$503M"]
    assert of(spark, texts, R.target_value) == [1.8e9, 855e6, 5, 212, 1.25e9, 3000, None, None, 503e6]


def test_odd_phrases(spark):
    texts = ["$5 million (12 %)", "section 12: $5", "5 mm", "5 boats", "1,2,3 k", "C$ 1.5bn", "US dollars 3 b", "% 5", "12 %, then $5"]
    assert [(m["amount"], m["unit"]) for m in of(spark, texts, R.money)] == [(12, "percent"), (12, "money"), (None, None), (None, None), (None, None), (1.5e9, "money"), (3, "money"), (None, None), (12, "percent")]
    assert of(spark, texts, R.target_value) == [5e6, 12, 5e6, 5e9, 123e3, 1.5e9, 3e9, 5, 12]


def test_money_needs_a_marker(spark):
    texts = ["49%", "$10 million", "CAD 1,500", "12 dollars", "section 35", "$2bn", None]
    assert [(m["amount"], m["unit"]) for m in of(spark, texts, R.money)] == [(49, "percent"), (1e7, "money"), (1500, "money"), (12, "money"), (None, None), (2e9, "money"), (None, None)]


def test_business_numbers(spark):
    texts = ["119314938", "119314938RC0001", "119 314 938 rt 0002", "119314938XX0001", "119314939", "1193149", None]
    assert of(spark, texts, R.business_number) == ["119314938"] * 3 + [None] * 4


def test_pages(spark):
    assert of(spark, ["7", "99", "0", "abc", None, "2.9"], lambda c: R.clamped_page(c, F.lit(55).cast("long"))) == [7, 55, 1, 1, 1, 2]
    shown = spark.range(1).select(R.page_window(F.lit(7).cast("long"), F.lit(55).cast("long")), R.page_window(F.lit(1).cast("long"), F.lit(1).cast("long")), R.sliding_pages(F.lit(7).cast("long"), F.lit(11).cast("long")), R.sliding_pages(F.lit(11).cast("long"), F.lit(11).cast("long"))).first()
    assert shown[0] == ["1", "...", "5", "6", "7", "8", "9", "...", "55"] and shown[1] == ["1"] and shown[2] == [5, 6, 7, 8, 9] and shown[3] == [7, 8, 9, 10, 11]


def test_halves(spark):
    found = of(spark, ["a\n\nb\n \nc", "one", "", None, "a\n\n\n"], R.halves)
    assert found[0] == ("a\n\nb", "c") and found[1:] == [None] * 4


def test_classes_fail_closed(spark):
    rows = spark.createDataFrame([("staff", True), ("staff", None), ("owner", True), (None, True)], "k string, d boolean")
    assert [r[0] for r in rows.select(R.upload_class(F.col("k"), F.col("d"))).collect()] == ["public", "submitted", "submitted", "submitted"]


def test_remapped_keys(spark):
    keys = ["COMMIT#training#a#b", "COMMIT#other#a", "NOTE#training#a", "COMMIT#training", None]
    assert of(spark, keys, lambda c: R.remapped_key(c, {"training": "learning"})) == ["COMMIT#learning#a#b", "COMMIT#other#a", "NOTE#training#a", "COMMIT#training", None]


def test_verified_names(spark):
    rows = spark.createDataFrame([(["Haida", "haida", "Ab", "Cree ", "Nobody"], "The HAIDA and the Cree")], "n array<string>, t string")
    assert rows.select(R.verified_names(F.col("n"), F.col("t"))).first()[0] == ["Haida", "Cree"]


def test_verified_briefing(spark):
    told = [(1, "x", "y"), (1, "x", "y"), (2, " ", "y"), (3, "x", "y"), (9, "x", "y")]
    rows = spark.createDataFrame([(told, [("p", [1, 2]), ("", [1]), ("q", [2])], [1, 2, 3]), (told, [], [1])], "p array<struct<case_id: int, establishes: string, relevance: string>>, r array<struct<text: string, case_ids: array<int>>>, g array<int>")
    first, second = [r[0] for r in rows.select(R.verified_briefing(F.col("p"), F.col("r"), F.col("g"))).collect()]
    assert first["cases"] == [1, 3] and [(p["text"], p["case_ids"]) for p in first["principles"]] == [("p", [1])] and first["dropped"] == 5 and second is None


def test_cosine_of_zero_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    found = rows.select(R.cosine(F.col("a"), F.col("b")), R.unit_length(F.col("a"))).collect()
    assert found[0][0] == pytest.approx(1) and found[0][1] == pytest.approx([0.6, 0.8]) and found[1][0] == 0 and found[1][1] == [0, 0]


def test_wilson_and_bars(spark):
    rows = spark.createDataFrame([(0, 0), (192, 384), (0, 80), (80, 80)], "k int, n int")
    low, high = R.wilson_clamped(F.col("k"), F.col("n"))
    found = rows.select(low, high, R.against_bar(low, high, F.col("n"), 0.05)).collect()
    assert found[0][:2] == (0, 0) and found[0][2] == "empty" and found[1][0] == pytest.approx(0.4502, abs=1e-4) and found[1][1] == pytest.approx(0.5498, abs=1e-4)
    assert found[2][2] == "clears" and found[3][1] == 1 and found[3][2] == "fails"


def test_directions(spark):
    rows = spark.createDataFrame([("granted", True), ("granted", False), ("refused", False), ("partly", True)], "g string, o boolean")
    assert [r[0] for r in rows.select(R.implied_direction(F.col("g"), F.col("o"))).collect()] == ["prevailed", "did_not_prevail", "prevailed", "partly"]


def test_patches_write_nulls_only_when_told(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "k int, x string, y int")
    patch = spark.createDataFrame([(1, None, None, True), (2, "z", None, False)], "k int, x string, y int, set_y boolean")
    assert sorted(map(tuple, rules.merge_patch(base, patch, "k", ("x", "y")).collect())) == [(1, "a", None), (2, "z", 6), (3, "c", 7)]


def test_updates_by_claim(spark):
    updates = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 2, 11), (None, 2, None)], "org_id int, by_org int, number int")
    claims = spark.createDataFrame([(2, 10), (2, 10)], "org int, number int")
    assert sorted((r["by_org"], r["number"] or 0, r["ok"]) for r in rules.owned_updates(updates, claims).collect()) == [(1, 10, True), (2, 0, False), (2, 10, True), (2, 11, False)]
