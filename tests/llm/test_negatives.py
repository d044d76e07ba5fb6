"""Hard negatives: the dual-tree search against SQL over all pairs, against plain loops on odd rows, and its bounds."""

import numpy as np
import pytest

from ledgerloom.llm import hard_negatives as H
from tests.conftest import DATA
from tests.oracle import assert_same

SCHEMA = "vec_id long, label int, embedding array<float>, row long, score double, a int, block int"


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, size):
    assert_same(spark, str(DATA / size), H.op13_hard_negatives, H.OP13_SQL)


def plain(rows):
    """All pairs in plain Python."""
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, l, e in rows if None not in (i, l, e) and all(x is not None and np.isfinite(x) for x in e)]
    dot, out = lambda p, q: sum(x * y for x, y in zip(p, q, strict=False)), []
    for n, (i, label, e) in enumerate(rows):
        if i % 100:
            continue
        other = sorted(((-dot(e, v), j, m) for k, (j, m, v) in enumerate(rows) if k != n), key=lambda x: x[:2])
        for ps, pid, _ in [o for o in other if o[2] == label][:5]:
            hits = [o for o in other if o[2] != label and 30 * -ps <= 100 * -o[0] <= 90 * -ps][:10]
            out += [(i, pid, rank, j, -ps, -s) for rank, (s, j, _) in enumerate(hits, 1)]
    return sorted(out)


def test_odd_rows_and_small_blocks(spark):
    rng, nan, inf = np.random.default_rng(1), float("nan"), float("inf")
    rows = [(i, int(rng.integers(0, 3)), rng.normal(0.4, 1, 5).astype(np.float32).tolist()) for i in range(420)]
    rows += [(None, 1, [1.0] * 5), (500, None, [1.0] * 5), (501, 1, None), (502, 1, [1.0, None, 1.0, 1.0, 1.0]), (503, 1, [nan] * 5), (504, 1, [inf] * 5), (600, 1, []), (601, 2, [2.0]), (700, 9, [0.0] * 5)]
    rows += [(800 + i, i % 2, [1.0, 2.0, 0.5, 0.25, 0.0]) for i in range(150)] + [(0, 1, [1.0] * 5)] * 3  # equal vectors; repeated rows
    df = spark.createDataFrame([(*r, 1, 2.0, 3, 4) for r in rows], SCHEMA)
    expected = plain(rows)
    for a, c in ((1024, 4096), (2, 50)):
        assert sorted(map(tuple, H.mined(df, a, c).collect())) == expected
    assert len(expected) > 100


def test_empty(spark):
    assert H.mined(spark.createDataFrame([], SCHEMA)).collect() == []
    assert H.mined(spark.createDataFrame([(1, 1, [1.0], 1, 1.0, 1, 1)], SCHEMA)).collect() == []  # no anchor


def test_wide_components_stay_exact(spark):
    rows = [(0, 1, [float(2**20), 1.0]), (1, 1, [float(2**20), 1.0]), (2, 1, [float(2**20), 2.0]), (3, 2, [float(2**19), 3.0]), (4, 2, [float(2**19), 4.0])]
    assert sorted(map(tuple, H.mined(spark.createDataFrame([(*r, 1, 2.0, 3, 4) for r in rows], SCHEMA)).collect())) == plain(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x = np.rint(np.concatenate([rng.normal(c, 0.05, (200, 8)) for c in (-2, 0, 2)]) * 256)
    labels = np.repeat([0, 1, 2], 200)
    tree = H.Ball(x, labels, np.arange(len(x)), 16)
    seen, floor, todo = [], float(np.sort((x @ x.T).ravel())[-5000]), [tree]
    while todo:
        node = todo.pop()
        low, high = H.interval(tree.parts[0], node)
        scores = x[tree.parts[0].rows] @ x[node.rows].T
        assert low <= scores.min() and scores.max() <= high
        todo += node.parts
    scored = H.dual(tree, tree, lambda a, b, low, high: high >= floor, lambda a, b: seen.append((a, b)))
    best = {(int(i), int(j)) for a, b in seen for i in a for j in b}
    assert {tuple(map(int, p)) for p in np.argwhere(x @ x.T >= floor)} <= best
    assert scored < len(x) ** 2 / 3  # whole groups were dropped
