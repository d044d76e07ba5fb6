"""Hybrid search: both backends alike, what happens without usable vectors, routes; alignment's pairs; two-stage vectors; likeness."""

import pytest

from ledgerloom.operators import alignment, search, similar
from ledgerloom.operators.retrieval import HEAD, _pairs, quant_fidelity, two_stage
from ledgerloom.sources.views import table
from ledgerloom.streaming import flows

UNITS = [("1#meta", 1, "Haida land title"), ("1#chunk#0", 1, "the forest and the river"), ("2#meta", 2, "royalty of the river"), ("2#chunk#0", 2, "compensation and damages"), ("x#chunk#0", None, "river river river")]
VECTORS = [("1#chunk#0", [1.0, 0.0]), ("2#chunk#0", [0.0, 1.0]), ("x#chunk#0", [1.0, 1.0]), ("2#meta", [1.0, 0.0, 0.0]), ("1#meta", None)]


def world(spark):
    units = spark.createDataFrame(UNITS, "unit_id string, case_id long, text string")
    vectors = spark.createDataFrame(VECTORS, "unit_id string, vector array<double>")
    asked = spark.createDataFrame([(1, "who owns the river bank today", [0.0, 1.0]), (2, "land title", [0.0, 1.0]), (3, "what of damages to forest land", None), (4, "what of the river and its fish", [1.0, 0.0, 0.0]), (5, "2014 SCC 44", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    names = spark.createDataFrame([("Haida land title",), ("The Queen v. First Nation",)], "text string")
    return search.Passages(units, vectors, ("e", 2)), asked, names


def rows(df):
    return sorted((r["query_id"], r["rank"], r["case_id"], round(r["score"], 9), r["reason"], r["way"]) for r in df.collect())


def test_built_index_equals_frames(spark, tmp_path):
    passages, asked, names = world(spark)
    search.build(passages, str(tmp_path / "index"), 3)
    built = search.Built(spark, str(tmp_path / "index"))
    assert built.embedder == ("e", 2)
    mine = rows(search.hybrid_search(passages, asked, names, ("e", 2)))
    assert mine == rows(search.hybrid_search(built, asked, names, ("e", 2)))
    ways = {q: (reason, way) for q, _, _, _, reason, way in mine}
    assert ways == {1: ("semantic", "hybrid"), 2: ("case_name", "words"), 3: ("semantic", "no query vector"), 4: ("semantic", "no query vector")}  # 5 has no word in common
    assert all(case in (1, 2) for _, _, case, *_ in mine)  # a passage without a case is dropped


def test_fusion_by_hand(spark):
    passages, asked, names = world(spark)
    one = [(r[1], r[2], r[3]) for r in rows(search.hybrid_search(passages, asked.where("query_id = 1"), names, ("e", 2)))]
    words = [r["unit_id"] for r in passages.bm25_rank(asked.where("query_id = 1")).orderBy("score", ascending=False).collect()]
    dense = ["2#chunk#0", "x#chunk#0", "1#chunk#0"]  # ties in order of unit_id
    score = lambda u: sum(1 / (60 + ranks.index(u)) for ranks in (words, dense) if u in ranks)
    best = {c: max(score(u) for u, case, _ in UNITS if case == c) for c in (1, 2)}
    assert one == [(i + 1, c, round(best[c], 9)) for i, c in enumerate(sorted(best, key=lambda c: (-best[c], c)))]


def test_other_embedder_or_no_vectors_is_told(spark):
    passages, asked, names = world(spark)
    assert {r[5] for r in rows(search.hybrid_search(passages, asked, names, ("other", 2))) if r[4] == "semantic"} == {"other embedder"}
    bare = search.Passages(passages.units)
    assert {r[5] for r in rows(search.hybrid_search(bare, asked, names, ("e", 2))) if r[4] == "semantic"} == {"no vectors"}


def test_unknown_index_format(spark, tmp_path):
    spark.createDataFrame([('{"format": 9}',)], "value string").write.text(str(tmp_path / "manifest"))
    with pytest.raises(ValueError, match="format 9"):
        search.Built(spark, str(tmp_path))


def test_routes(spark):
    names = spark.createDataFrame([("Haida Nation v. British Columbia (Minister of Forests)",), ("R v Sparrow",), ("",)], "text string")
    told = {
        "2014 SCC 44": "citation", "see 1999 onca 12 there": "citation", "[1990] 1 SCR 1075": "citation", "[1990] 1 S. C. R. 1075": "citation", "2004-scc-73": "citation", "20014 SCC 4": "semantic",
        "haida nation": "case_name", "nation v british": "semantic", "Columbia Minister of Forests": "case_name", "British Columbia": "semantic", "nation haida": "semantic", "sparrow": "case_name", "": "semantic", "haida nation v british columbia minister": "semantic", "the queen": "semantic", "unheard of": "semantic",
    }
    got = {r["query_id"]: r["reason"] for r in search.routed(spark.createDataFrame(list(enumerate(told)), "query_id long, text string"), names).collect()}
    assert got == dict(enumerate(told.values()))


def test_alignment_makes_few_pairs(spark):
    """At the larger scale the pairs are far below demands times suppliers."""
    sf = "/root/testdata/sf0.1"
    _, candidates, pool = alignment._matched(spark, sf)
    pairs, wanted, n = candidates.count(), candidates.select("demand").distinct().count(), pool.count()
    assert wanted > 600 and n > 600 and pairs < 0.1 * wanted * n


def test_a_batch_makes_its_own_matches_only(spark, sf_dir, tmp_path):
    pool = flows.kept_pool(spark, sf_dir, str(tmp_path))
    orders = table(spark, sf_dir, "orders")
    every = {tuple(r) for r in flows.matches_of(orders, pool, sf_dir).where("supplier_id IS NOT NULL").collect()}
    some = orders.where("o_orderkey % 10 = 3")
    ids = {r[0] for r in some.select("o_orderkey").collect()}
    assert {tuple(r) for r in flows.matches_of(some, pool, sf_dir).where("supplier_id IS NOT NULL").collect()} == {r for r in every if r[0] in ids} != set()


@pytest.mark.parametrize("head", [1, 40, HEAD, 10_000])
def test_two_stage_is_exact_for_any_head(spark, sf_dir, head):
    pairs = _pairs(spark, sf_dir).where("query_id % 100 = 0")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in two_stage(pairs, 10, head).collect())
    scored = {}
    for r in pairs.select("query_id", "vec_id", "q8", "qq").collect():
        scored.setdefault(r["query_id"], []).append((-sum(a * b for a, b in zip(r["q8"], r["qq"], strict=True)), r["vec_id"]))
    assert found == sorted((q, i + 1, v) for q, s in scored.items() for i, (_, v) in enumerate(sorted(s)[:10]))


def test_recall(spark, sf_dir):
    two = quant_fidelity(spark, sf_dir).where("method = 'two_stage'").first()
    assert two["recall10"] >= 0.9 and two["recall50"] >= 0.9


def test_similar_cases_by_hand(spark):
    cases = spark.createDataFrame([(1, ["a", "b"], "x", 5, 2000, [1.0, 0.0]), (2, ["a"], "y", 9, 2001, [0.0, 1.0]), (3, [], "x", 9, 2001, None), (4, [], "x", 9, 2002, [-1.0, 0.0]), (5, [], None, 9, 2002, [1.0])], "case_id long, themes array<string>, level string, citing long, year long, vector array<double>")
    asked = spark.createDataFrame([(1, ["a", "a", "b"], "x", [1.0, 0.0]), (2, [], None, [1.0, 0.0]), (3, None, "x", None)], "query_id long, themes array<string>, level string, vector array<double>")
    got = {}
    for r in similar.similar_cases(asked, cases).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["case_id"], r["composite"], r["strength"]))
    assert got[1] == [(1, 1.0, "strong"), (2, 0.15, "weak"), (4, 0.1, "weak"), (3, 0.1, "weak"), (5, 0.0, "weak")]
    assert got[2] == [(1, 1.0, "strong"), (4, 0.0, "weak"), (5, 0.0, "weak"), (2, 0.0, "weak"), (3, 0.0, "weak")]
    assert [c for c, *_ in got[3]] == [4, 3, 1, 5, 2] and got[3][0][1] == round(0.1 / 0.7, 6)


@pytest.mark.parametrize("depth", [1, 3, None])
def test_best_of_whole_lists_from_heads(spark, depth):
    """The heads' answer is that of the fused whole lists, at any first depth, with ties, gaps and cases of many passages."""
    words = "river land title forest damage fish".split()
    units = [(f"{i % 40}#chunk#{i}", None if i % 40 == 7 else i % 40, " ".join(words[j] for j in range(6) if (i * 7 + j * j) % (j + 2) == 0)) for i in range(600)]
    vectors = [(u, [float(i % 5), None if i % 50 == 3 else float(i % 7) - 3]) for i, (u, _, _) in enumerate(units) if i % 9]
    passages = search.Passages(spark.createDataFrame(units, "unit_id string, case_id long, text string").repartition(5), spark.createDataFrame(vectors, "unit_id string, vector array<double>"), ("e", 2))
    asked = spark.createDataFrame([(1, "river river land", [1.0, 0.5]), (2, "fish", [0.0, 0.0]), (3, "nothing here", [-1.0, 0.25]), (4, "title", None)], "query_id long, text string, vector array<double>")
    lists = passages.in_blocks(asked.select("query_id", "text"), asked.select("query_id", "vector"))
    whole = {}
    for blocks in lists:
        for r in search.placed_together([blocks], 600)[0].itertuples():
            whole[r.query_id, r.unit_id] = whole.get((r.query_id, r.unit_id), 0.0) + 1 / (59 + r.rank)
    ranked = [(r["query_id"], r["unit_id"], r["rank"]) for r in search.ranked_by_buckets(passages.bm25_rank(asked), ["query_id"], [(search.F.floor("score"), True)], [search.F.desc("score"), search.F.col("unit_id")]).collect()]
    assert sorted(ranked) == sorted((r.query_id, r.unit_id, r.rank) for r in search.placed_together(lists[:1], 600)[0].itertuples())
    by_unit, by_case = {}, {}
    cases = {u: c for u, c, _ in units}
    for (q, u), s in whole.items():
        by_unit.setdefault(q, []).append((-round(s, 9), u))
        if cases[u] is not None:
            by_case.setdefault(q, {})[cases[u]] = max(by_case.get(q, {}).get(cases[u], 0.0), round(s, 9))
    got = lambda df, key: sorted((r["query_id"], r["rank"], r[key], round(-r["score"], 9)) for r in df.collect())
    assert got(search.best_fused(lists, 10, depth=depth), "unit_id") == sorted((q, i + 1, u, s) for q, rows in by_unit.items() for i, (s, u) in enumerate(sorted(rows)[:10]))
    assert got(search.best_fused(lists, 10, case_of=passages.case_of(), depth=depth), "case_id") == sorted((q, i + 1, c, s) for q, held in by_case.items() for i, (s, c) in enumerate(sorted((-s, c) for c, s in held.items())[:10]))
