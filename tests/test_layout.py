"""Gutters against a plain search on tilted, ragged, one-column and table pages; splitters; order inversions."""

import random

import pytest

from ledgerloom.functions import splitting as S
from ledgerloom.operators import layout, pieces

RUN = "page long, line long, x double, width double, text string"


def plain_gutters(runs):
    """Bands of one page by trying every gap, without sweeps or windows."""
    if not runs or any(w is None or w < 0 for _, _, w, _ in runs):
        return []
    left, right = min(x for _, x, _, _ in runs), max(x + w for _, x, w, _ in runs)
    least = 0.12 * (right - left)
    gaps = []
    for line in {r[0] for r in runs}:
        mine = sorted((x, w) for ln, x, w, _ in runs if ln == line)
        for i in range(1, len(mine)):
            reach = max(x + w for x, w in mine[:i])
            if mine[i][0] - reach > least:
                gaps.append((reach, mine[i][0]))
    votes = {(a + b) / 2: sum(lo < (a + b) / 2 < hi for lo, hi in gaps) for a, b in gaps}
    chosen = []
    for mid in sorted((m for m, v in votes.items() if v >= 3), key=lambda m: (-votes[m], m)):
        if all(abs(mid - c) >= least for c in chosen):
            chosen.append(mid)
    if not 0 < len(chosen) < 3:
        return []
    chosen.sort()
    bands = []
    for i, guess in enumerate(chosen):
        xs = [x for _, x, _, _ in runs if guess < x < (chosen[i + 1] if i + 1 < len(chosen) else right)]
        aligned = [x for x in xs if sum(abs(y - x) <= 1 for y in xs) >= 3]
        ends = [x + w for _, x, w, _ in runs if aligned and x + w <= min(aligned)]
        if not ends or min(aligned) - max(ends) < 1 or (bands and max(ends) <= bands[-1][1]):
            return []
        bands.append((max(ends), min(aligned)))
    edges = [left, *((a + b) / 2 for a, b in bands), right]
    return bands if all(b - a >= 0.15 * (right - left) for a, b in zip(edges, edges[1:], strict=False)) else []


def page(kind, rng):
    rows = []
    for line in range(14):
        if kind == "one":
            rows.append((line, 0.0, rng.uniform(250, 400), "words of one column " * 2))
        elif kind == "three":
            rows += [(line, c * 200.0, rng.uniform(110, 150), "some words here") for c in range(3)]
        elif kind == "table":
            rows += [(line, c * 200.0, 12.0, "42") for c in range(2)]
        elif line % 6 == 5:
            rows.append((line, 0.0, 480.0, "a heading straight across both of the columns"))
        else:
            tilt = rng.uniform(0, 0.8) if kind == "tilted" else 0
            rows.append((line, 0.0, rng.uniform(120, 235) if kind == "ragged" else 230.0, "words on the left side"))
            rows.append((line, 250.0 + 20 * (kind != "tight") + tilt, rng.uniform(150, 220), "words on the right side"))
            if kind == "nested":
                rows.append((line, 20.0, 2.0, "²"))
    return rows


KINDS = ["one", "two", "ragged", "tilted", "three", "table", "tight", "nested"]


def test_gutters_equal_a_plain_search(spark):
    rng = random.Random(3)
    pages = {i: page(kind, rng) for i, kind in enumerate(KINDS * 6)}
    pages[100] = [(ln, rng.uniform(0, 500), rng.uniform(5, 120), "noise") for ln in range(30) for _ in range(3)]
    pages[101] = [(0, 0.0, None, "no width"), *page("two", rng)]
    pages[102] = [(0, 5.0, 0.0, "x")]
    df = spark.createDataFrame([(p, *r) for p, rows in pages.items() for r in rows] + [(103, 0, 1.0, 2.0, "  ")], RUN)
    found = {}
    for r in sorted(layout.column_gutters(df).collect()):
        found.setdefault(r["page"], []).append((r["lo"], r["hi"]))
    assert found == {p: b for p, rows in pages.items() if (b := plain_gutters(rows))}
    prose = {r["page"] for r in layout.prose_columns(df, layout.column_gutters(df)).where("prose").collect()}
    table_pages = {p for p in found if p < 100 and KINDS[p % len(KINDS)] == "table"}
    assert table_pages and not table_pages & prose and {p for p in found if p < 100} - table_pages <= prose | {p for p in found if KINDS[p % len(KINDS)] == "ragged"}


def test_reading_order(spark):
    runs = [(1, ln, x, w, f"{side}{ln} of the running text") for ln in range(8) if ln != 4 for side, x, w in (("left", 0.0, 200.0), ("right", 260.0, 190.0))] + [(1, 4, 0.0, 450.0, "heading")]
    lines = sorted(layout.reading_lines(spark.createDataFrame(runs, RUN)).collect(), key=lambda r: (r["section"], r["column"], r["line"]))
    told = [r["text"].split()[0] for r in lines]
    assert told == ["left0", "left1", "left2", "left3", "right0", "right1", "right2", "right3", "heading", "left5", "left6", "left7", "right5", "right6", "right7"]


TEXTS = ["", " \n\n ", "one", "a b.\n \nc d. e f! g? h", "x" * 9000, "wörd. " * 900, "é" * 5000 + ". " + "tail. " * 10, "p.\n\n" * 30, "Sentence one is here. " * 40 + "\n\n" + "short"]


@pytest.mark.parametrize("cut, limit, size", [(lambda t: S.case_pieces(t, 100, 400), 400, S.octets), (lambda t: S.document_pieces(t, 120), None, len), (lambda t: S.marked_pieces([(7, t)], 120), None, len)])
def test_pieces_give_the_text_back(cut, limit, size):
    squeeze = lambda s: "".join(s.replace("[p.7]\n", "").split())
    for text in TEXTS:
        out = list(cut(text))
        assert squeeze("".join(out)) == squeeze(text) and all(out)
        assert limit is None or all(size(p) <= limit for p in out)
        over = [p for p in out if size(p) > 120]
        assert limit or all(". " not in p.strip() for p in over)  # only a sentence on its own


def test_hard_cuts_keep_code_points():
    for text in ("é" * 999, "😀" * 500, "ab😀" * 300):
        out = list(S.hard_cut(text, 64, S.octets))
        assert "".join(out) == text and all(S.octets(p) <= 64 for p in out)


def test_units_fill_their_pieces():
    out = list(S.put_together(iter(["aa", "bb", "cc", "d" * 9, "e"]), 5, " "))
    assert out == ["aa bb", "cc", "d" * 9, "e"]


def test_inversions(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 50):
        places = [rng.randrange(20) for _ in range(n)]
        assert pieces.inversions_of(places) == sum(places[i] > places[j] for i in range(n) for j in range(i + 1, n))
    rows = [(1, i, 100_000 - i) for i in range(100_000)] + [(2, 0, 5)]
    got = {r["doc"]: (r["units"], r["inversions"]) for r in pieces.order_inversions(spark.createDataFrame(rows, "doc long, unit long, place long"), "doc").collect()}
    assert got == {1: (100_000, 100_000 * 99_999 // 2), 2: (1, 0)}


def test_reference_units(spark):
    text = "[p.2]\nOne two three four five six seven eight. Too short.\n\nNo mark: nine words are in this very sentence here!\n\n[p.3]\nMore words than eight are in here as well, surely?"
    rows = pieces.reference_units(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("unit").collect()
    assert [(r["unit"], r["page"]) for r in rows] == [(1, 2), (2, 2), (3, 3)] and all(len(r["key"]) == 16 for r in rows)


def test_words_stay_where_their_texts_were_dealt(spark, sf_dir):
    """All shuffles of the layout queries are of texts dealt by page; none is of runs."""
    for query in (layout.page_gutters, layout.reading_order):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "")


def test_long_texts_leave_in_small_batches(spark):
    texts = [(i, "word. " * 60_000) for i in range(8)]
    rows = spark.createDataFrame(texts, "doc_id int, text string").coalesce(1)
    sizes = [len("".join(r)) for r in S.pieces(rows, S.case_pieces).mapInPandas(lambda batches: (b.head(1)[["text"]] for b in batches), "text string").collect()]
    assert S.pieces(rows, S.case_pieces).count() == sum(len(list(S.case_pieces(t))) for _, t in texts) and sizes and hasattr(S, "HELD")
