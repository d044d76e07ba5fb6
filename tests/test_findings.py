"""Inputs on which a query once differed from its SQL, or did work that grew faster than its input."""

from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from ledgerloom.operators import blocks, evidence, retrieval
from ledgerloom.operators.heads import Head
from ledgerloom.plans import registry
from tests.oracle import assert_same


@pytest.fixture
def beside(sf_dir, tmp_path):
    """A folder with given tables; the others are those of the smallest scale."""

    def made(**tables):
        for file in Path(sf_dir).glob("*.parquet"):
            (tmp_path / file.name).symlink_to(file)
        for name, rows in tables.items():
            (tmp_path / f"{name}.parquet").unlink()
            rows.toPandas().to_parquet(tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return made


def same(spark, folder, name):
    assert_same(spark, folder, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_dates_located_passes_over_other_numbers(spark, beside):
    """Texts that open with a month's number, which after the award's year looks like an ISO date."""
    texts = [(45, "10.0.0.1 is a host"), (46, "11 19\n2025-11-19 and sept 19, 2025"), (58, "x\nNovember 3, 2025"), (60, "January 2025")]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    same(spark, beside(documents=docs), "dates_located")


def test_layout_paragraphs_at_the_bound_of_a_gap(spark, beside):
    """Gaps just at 1.5 times the quartile, and values halfway between two hundredths."""
    pages = [[14.01, 29.93, 64.23, 88.53, 132.83, 133.33, 150.37], [4.3, 23.01, 39.6, 65.28, 65.78, 111.46, 147.14], [28.95, 43.63, 59.03, 101.32, 123.61, 124.11, 156.4], [14.06, 29.44, 44.9, 45.4, 68.5, 111.6, 144.7], [0.0, 1.005, 2.0, 3.51, 4.5]]
    rows = [(1000 * u + i, u, "click", v) for u, values in enumerate(pages) for i, v in enumerate(values)]
    same(spark, beside(events=spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")), "layout_paragraphs")


def test_checked_names_changes_case_and_trims_as_its_sql(spark, beside):
    """Capitals of several signs whose letters stand in the text as well, a sigma within a word, blanks of other kinds, and nulls."""
    texts = ["ßau Kosten SSAU x", "Maße\nMASSE fﬁn FFIN", "İzmir i̇zmir IZMIR", "ΟΔΟΣ\nοδοσα ΌΣΟΣ", "ᾳδω ΑΙΔΩ αιδω", "\u00a0nbsp\u00a0\u3000wide\u3000 \u00a0\u00a0\u00a0 x", "a\vb web\vcrawl\twide", "\n\nfoo FOO Foo fOO", "“Quoted”—it’s ſoo soo", "", "𐐀𐐁𐐂 ŉab ʼNAB"]
    rows = [(i, t, "en", "web crawl" if i % 2 == 0 else None, len(t)) for i, t in enumerate(texts)] + [(50, None, "en", "web", 0), (51, "some text here", None, "web", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(spark, beside(documents=docs), "checked_names")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fusion", "hybrid_case_rank", "pool_candidates", "bm25_pool_normalized"])
def test_word_lists_make_no_row_for_each_query_and_passage(spark, sf_dir, name):
    plan = planned(registry.QUERIES[name](spark, sf_dir))
    assert "MapInArrow" in plan and "Join" not in plan


def test_postings_deal_by_term_alone(spark, sf_dir):
    assert planned(registry.QUERIES["postings"](spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_heads_keep_the_best_of_many_equals():
    rng = np.random.default_rng(3)
    head, ids = Head(5, 7), np.array([f"{i:04d}" for i in range(900)], object)
    scores, there = rng.integers(0, 4, (900, 5)).astype(float), rng.random((900, 5)) < 0.8
    there[:, 4] = False
    there[[3, 700], 4] = True
    for rows in np.array_split(rng.permutation(900), 6):
        rows = np.sort(rows)
        head.offer(scores[rows], there[rows], ids[rows])
    mine = sorted(zip(head.q.tolist(), head.ids, head.score.tolist(), strict=True))
    wanted = [(q, ids[i], scores[i, q]) for q in range(5) for i in sorted(np.flatnonzero(there[:, q]), key=lambda i: (-scores[i, q], ids[i]))[:7]]
    assert mine == sorted(wanted)


def test_questions_too_many_for_every_task_give_the_same_lists(spark, sf_dir, monkeypatch):
    lists = lambda: sorted(map(tuple, retrieval._listed(spark, sf_dir, 3).select("by", "query_id", "unit_id", "value", "rank").where("query_id < 8").collect()))
    few = lists()
    monkeypatch.setattr(retrieval, "MOST_CELLS", 0)
    assert lists() == few


@pytest.mark.parametrize("name", ["dense_exact_topk", "hamming_topk", "two_stage_dense", "quant_fidelity", "ndcg_by_label", "cosine_topk"])
def test_vectors_meet_in_blocks(spark, sf_dir, name):
    plan = planned(registry.QUERIES[name](spark, sf_dir))
    assert "FlatMapCoGroupsInPandas" in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["dense_exact_topk", "hamming_topk", "two_stage_dense", "cosine_topk"])
def test_small_blocks_and_vectors_with_gaps(spark, beside, monkeypatch, name):
    rng = np.random.default_rng(4)
    values = np.round(rng.integers(-2, 3, (230, 64)) / 7, 3)  # many equal products
    rows = lambda some: spark.createDataFrame([(i, [float(x) for x in values[i % 150]], i % 4) for i in some], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(blocks, "VECTORS", 40)
    monkeypatch.setattr(blocks, "QUERIES", 2)
    monkeypatch.setattr(blocks, "CELLS", 100)
    same(spark, beside(embeddings=rows(range(230))), name)
    assert retrieval._matrices(rows(range(3)).selectExpr("vec_id", "if(vec_id = 1, null, embedding) AS v")) is None


@pytest.mark.parametrize(("name", "call", "most"), [("checked_names", "regexp_replace(", 2), ("briefing_check", "array_contains(", 1), ("pdf_cleanup", "split(", 2)])
def test_what_is_the_same_for_all_elements_is_computed_once(spark, sf_dir, name, call, most):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count(call) <= most


def test_columns_are_one_aggregate_of_a_page(spark):
    """A page's runs are grouped once, with no join, and places that are null are on the right."""
    items = spark.createDataFrame([(1, 2, 10.0, "b"), (1, 1, 12.0, "a"), (1, 3, 90.0, "d"), (1, 4, None, "e"), (2, 1, 5.0, "x"), (3, 1, None, "n")], "page long, i long, x double, text string")
    df = evidence.two_columns(items)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.select("page", "left", "right", "whole", F.coalesce("two", F.lit(False))).collect())) == [(1, "a\nb", "d\ne", "a\nb\nd\ne", True), (2, "", "x", "x", False), (3, "", "n", "n", False)]


def test_parts_grow_with_the_rows(spark):
    rows = spark.range(3 * evidence.DEALT)
    assert evidence._dealt(rows, "id").rdd.getNumPartitions() == max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert evidence._dealt(spark.range(9 * evidence.DEALT), "id").rdd.getNumPartitions() == 9
