"""Textbook values and brute-force checks of operators that SQL can't express."""

import math

from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.functions import text as T
from ledgerloom.operators import evaluation, nearness, passages, retrieval
from ledgerloom.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_is_half_up(spark):
    assert [one(spark, scalars.round_up(F.lit(x))) for x in (0.5, -0.5, 1.5, 2.4)] == [1, 0, 2, 2]


def test_ratio_of_nothing_is_zero(spark):
    assert one(spark, scalars.ratio(F.lit(3), F.lit(0))) == 0.0


def test_wilson(spark):
    low, high = scalars.wilson(F.lit(192), F.lit(384))
    assert round(one(spark, low), 4) == 0.4502 and round(one(spark, high), 4) == 0.5498


def test_f1(spark):
    row = spark.range(1).select(*evaluation.f1(F.lit(2), F.lit(1), F.lit(1))).first()
    assert set(row) == {0.666667}


def test_bm25_micro_corpus(spark):
    rows = spark.createDataFrame([("d1", 1, "the quick brown fox"), ("d2", 2, "the lazy dog sleeps"), ("d3", 3, "quick quick fox runs")], "unit_id string, case_id long, text string")
    asked = spark.createDataFrame([(0, "quick fox"), (1, "")], "query_id long, text string")
    found = retrieval.ranked(retrieval.bm25(retrieval.index(rows), asked), F.col("score"), "unit_id", 10).orderBy("rank").collect()
    assert [(r["query_id"], r["unit_id"]) for r in found] == [(0, "d3"), (0, "d1")]


def test_reciprocal_rank_fusion(spark):
    lists = [spark.createDataFrame([(0, u, i + 1) for i, u in enumerate(us)], "query_id long, unit_id string, rank long") for us in ("abc", "acb")]
    scores = {r["unit_id"]: r["score"] for r in retrieval.fuse(lists, "unit_id").collect()}
    assert math.isclose(scores["a"], 2 / 60, abs_tol=1e-9) and scores["a"] > scores["b"] == scores["c"]


def test_quote_occurs(spark):
    ask = lambda q, t: one(spark, T.quote_occurs(F.lit(q), F.lit(t)))
    assert ask("A b ... D", "a, b c d") and not ask("a b ... x", "a b c") and ask("…", "anything")


def test_due_dates(spark):
    dates = [one(spark, T.due_date(F.lit(s))) for s in ("by 2027", "2025-06-30", "Q3 2026", "sometime")]
    assert dates == ["2027-12-31", "2025-06-30", "2026-09-30", None]


def test_longest_common_substring():
    brute = lambda a, b: max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
    for a, b in (("abcde", "xbcdx"), ("", "a"), ("aaa", "aa"), ("éa", "aé")):
        assert nearness.longest_run(a, b)[0] == brute(a, b)


def test_packed_chunks_lose_nothing(spark):
    docs = spark.createDataFrame([(1, "a\n" * 5 + "bb"), (2, None), (3, "x" * 50)], "doc_id long, text string")
    rows = passages.packed_chunks(docs, limit=6).collect()
    assert {(r["doc_id"], sum(q["paragraphs"] for q in rows if q["doc_id"] == r["doc_id"])) for r in rows} == {(1, 6), (2, 1), (3, 1)}
    assert all(r["chars"] <= 6 for r in rows if r["doc_id"] == 1)


def test_limiter_opens_windows_at_first_event(spark):
    rows = spark.createDataFrame([(1, f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 3, 12, 13)], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert tuple(flows.failures_allowed(rows, most=2, seconds=10).first()) == (1, 2, 2)


def test_stream_replayed_gives_the_same_rows(spark, sf_dir):
    a, b = (sorted(map(tuple, flows.stream_rollup(spark, sf_dir).collect())) for _ in range(2))
    assert a == b and len(a) > 0


def test_html_to_text(spark):
    html = "<head><title>t</title></head><p>a &amp; b</p><script>x()</script><div>c<br>d</div>"
    assert one(spark, T.html_to_text(F.lit(html))) == "a & b\nc\nd"


def test_layout_lines_join_runs_left_to_right(spark):
    from ledgerloom.operators import extraction

    runs = spark.createDataFrame([(1, 30.0, 700.0, 10.0, "b"), (1, 0.0, 701.5, 20.0, "a"), (1, 40.5, 699.8, 5.0, "c"), (1, 0.0, 650.0, 9.0, "next"), (2, 5.0, 1.0, 1.0, "x")], "page_id long, x double, y double, width double, str string")
    found = sorted(map(tuple, extraction.page_lines(runs).collect()))
    assert found == [(1, 0, "a bc"), (1, 1, "next"), (2, 0, "x")]


def test_greedy_pairs_take_the_first_free(spark):
    from ledgerloom.operators import extraction

    rows = spark.createDataFrame([(1, "gold", 1, "Hire people"), (1, "gold", 2, "hire people"), (1, "found", 1, "we HIRE, people now"), (2, "gold", 1, "x")], "group long, side string, seq long, text string")
    assert [tuple(r) for r in extraction.greedy_pairs(rows).collect()] == [(1, 1, 1)]


def test_hash_embedding_has_unit_length():
    from ledgerloom.operators.extraction import embedding

    assert abs((embedding("a b c") ** 2).sum() - 1) < 1e-9 and not embedding("").any()
