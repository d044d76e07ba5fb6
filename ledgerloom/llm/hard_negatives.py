"""Hard-negative mining by dual-tree search over anchors and candidates.

Vectors are turned into whole numbers (floor of 256 times each component), so inner products are exact. An anchor's
positives are its best five other rows of the same label; for each positive the best ten rows of another label count
whose score lies between 30 and 90 % of the positive's.

Search. Anchors and candidates are dealt into blocks of bounded size, neighbours along (label, projection) together; each
pair of blocks is one group of a cogroup, so the stated query set meets all rows in blocks and no group grows with the
data. In a group both sides are trees of balls (centre, radius, labels). For two nodes every inner product lies in
``c.c' +- (|c| r' + |c'| r + r r')``; a pair of nodes whose interval misses what all of its anchors still look for is
dropped with all of its rows, other pairs are opened, two leaves are scored exactly. The blocks' best lists are merged by
a window of one anchor (one anchor and positive), cut to the wanted ranks before the shuffle.

Defined cases: rows with a null label, vec_id or vector, or with a null or non-finite component, take no part; shorter
vectors count as padded with zeros; repeated rows are rows of their own, so an anchor's twin may be its positive, and
each twin anchor gets its rows; ties in score go to the smaller vec_id; a positive score below zero has no negatives
(its range is empty); an empty table gives an empty result. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settle

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
ANCHOR_BLOCK, CANDIDATE_BLOCK, LEAF = 1024, 4096, 64


class Ball:
    """Node of a tree over rows of whole-numbered vectors: its rows, centre, radius, labels and two children or none."""

    __slots__ = ("rows", "centre", "norm", "radius", "labels", "parts")

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> None:
        mine = vectors[rows]
        self.rows, self.centre, self.labels, self.parts = rows, mine.mean(axis=0), frozenset(labels[rows].tolist()), ()
        self.norm, self.radius = float(np.linalg.norm(self.centre)), float(np.sqrt(((mine - self.centre) ** 2).sum(axis=1).max()))
        if len(rows) > leaf and self.radius > 0:  # equal vectors are one ball however many
            axis = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
            order, half = np.argsort(mine[:, axis], kind="stable"), len(rows) // 2
            self.parts = (Ball(vectors, labels, rows[order[:half]], leaf), Ball(vectors, labels, rows[order[half:]], leaf))


def interval(a: Ball, b: Ball) -> tuple[float, float]:
    """Bounds of every inner product of a row of one node with a row of the other."""
    middle, reach = float(a.centre @ b.centre), a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    reach += 1 + 1e-9 * (abs(middle) + reach)  # what floats may lose
    return middle - reach, middle + reach


def dual(a: Ball, b: Ball, wanted: Callable[[Ball, Ball, float, float], bool], leaves: Callable[[np.ndarray, np.ndarray], None]) -> int:
    """Visit the pairs of leaves that wanted lets through, highest bounds first; returns the number of pairs scored."""
    todo, scored = [(a, b)], 0
    while todo:
        a, b = todo.pop()
        if not wanted(a, b, *interval(a, b)):
            continue
        if not a.parts and not b.parts:
            for at in range(0, len(b.rows), 1024):  # a leaf of equal vectors may be large
                leaves(a.rows, b.rows[at : at + 1024])
            scored += len(a.rows) * len(b.rows)
        elif not b.parts or a.parts and a.radius > b.radius:
            todo += sorted(((x, b) for x in a.parts), key=lambda p: interval(*p)[1])
        else:
            todo += sorted(((a, y) for y in b.parts), key=lambda p: interval(*p)[1])
    return scored


class Best:
    """The best k (score, id, row) of each of n seekers; higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, kind: type) -> None:
        self.score, self.id, self.row = np.full((n, k), -np.inf, kind), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores (len(at), m), minus infinity where a row doesn't count; ids, rows (m) of the offered rows."""
        some = (scores >= np.maximum(self.score[at, -1:], -1e300)).any(axis=1)
        if not some.any():
            return
        at, scores, k = at[some], scores[some], self.score.shape[1]
        s = np.concatenate([self.score[at], scores], axis=1)
        i, r = (np.concatenate([old[at], np.broadcast_to(new, scores.shape)], axis=1) for old, new in ((self.id, ids), (self.row, rows)))
        order = np.lexsort((i, -s), axis=-1)[:, :k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(x, order, axis=1) for x in (s, i, r))


def whole(rows: list, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _found(anchors: pd.DataFrame, best: Best, extra: dict) -> pd.DataFrame:
    seeker, place = np.nonzero(best.row >= 0)
    mine = {name: anchors[name].to_numpy()[seeker] for name in ("anchor_row", "anchor_id")} | {k: v[seeker] for k, v in extra.items()}
    return pd.DataFrame(mine | {"score": best.score[seeker, place].astype(np.int64), "other_id": best.id[seeker, place], "other_row": best.row[seeker, place]})


def _sides(anchors: pd.DataFrame, others: pd.DataFrame):
    sides = anchors["vector"].tolist(), others["vector"].tolist()
    width, (p, q) = max(len(v) for side in sides for v in side), (max((int(abs(x)) for v in side if len(v) for x in (v.min(), v.max())), default=0) for side in sides)
    kind = float if p * q * width < 2**53 else np.longdouble  # either holds every partial sum exactly
    x, y = (whole(side, width, kind) for side in sides)
    la, lb = anchors["label"].to_numpy(), others["label"].to_numpy()
    return x, y, la, lb, Ball(x, la, np.arange(len(x))), Ball(y, lb, np.arange(len(y)))


def positives_of(anchors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """The best five of these others with the anchor's label, itself left out."""
    if not len(anchors) or not len(others):
        return pd.DataFrame(columns=["anchor_row", "anchor_id", "score", "other_id", "other_row"])
    x, y, la, lb, a_tree, b_tree = _sides(anchors, others)
    ra, ids, rows, best = anchors["anchor_row"].to_numpy(), others["vec_id"].to_numpy(), others["row"].to_numpy(), Best(len(anchors), POSITIVES, x.dtype)

    def wanted(a: Ball, b: Ball, low: float, high: float) -> bool:
        return not a.labels.isdisjoint(b.labels) and high >= best.score[a.rows, -1].min()

    def leaves(a: np.ndarray, b: np.ndarray) -> None:
        fits = (la[a][:, None] == lb[b]) & (ra[a][:, None] != rows[b])
        best.offer(a, np.where(fits, x[a] @ y[b].T, -np.inf), ids[b], rows[b])

    dual(a_tree, b_tree, wanted, leaves)
    return _found(anchors, best, {})


def negatives_of(anchors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """The best ten of these others for each anchor and positive: another label, score within the positive's range."""
    if not len(anchors) or not len(others):
        return pd.DataFrame(columns=["anchor_row", "anchor_id", "place", "score", "other_id", "other_row"])
    x, y, la, lb, a_tree, b_tree = _sides(anchors, others)
    ids, rows = others["vec_id"].to_numpy(), others["row"].to_numpy()
    low, high = np.full((POSITIVES, len(x)), np.inf, x.dtype), np.full((POSITIVES, len(x)), -np.inf, x.dtype)
    for i, scores in enumerate(anchors["positive_scores"]):
        for j, s in enumerate(scores):
            low[j, i], high[j, i] = -(-LOW * int(s) // 100), HIGH * int(s) // 100
    bests = [Best(len(x), NEGATIVES, x.dtype) for _ in range(POSITIVES)]

    def wanted(a: Ball, b: Ball, least: float, most: float) -> bool:
        if len(a.labels) == 1 and a.labels == b.labels:
            return False
        for j, best in enumerate(bests):
            floor = np.maximum(low[j, a.rows], best.score[a.rows, -1])
            if ((most >= floor) & (least <= high[j, a.rows]) & (floor <= high[j, a.rows])).any():
                return True
        return False

    def leaves(a: np.ndarray, b: np.ndarray) -> None:
        scores = np.where(la[a][:, None] != lb[b], x[a] @ y[b].T, -np.inf)
        for j, best in enumerate(bests):
            best.offer(a, np.where((scores >= low[j, a][:, None]) & (scores <= high[j, a][:, None]), scores, -np.inf), ids[b], rows[b])

    dual(a_tree, b_tree, wanted, leaves)
    return pd.concat([_found(anchors, best, {"place": np.full(len(x), j, np.int32)}) for j, best in enumerate(bests)])


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector of whole numbers: the rows that take part."""
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    vector = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")))
    return rows.where("label is not null and vec_id is not null and embedding is not null").where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """rows with a block: neighbours along (label, projection), about so many rows each; vec_id splits equal vectors."""
    along = F.aggregate(F.transform("vector", lambda x, i: x * F.when(F.pmod(F.hash(i), F.lit(2)) == 0, 1).otherwise(-1)), F.lit(0).cast("double"), lambda s, x: s + x)
    blocks = -(-rows.count() // size) or 1
    return settle(rows.withColumn("along", along).repartitionByRange(blocks, "label", "along", "vec_id", "row").withColumn("block", F.spark_partition_id()).drop("along"))


def mined(rows: DataFrame, anchor_block: int = ANCHOR_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vectors (vec_id, label, embedding)."""
    every = settle(taking_part(rows).withColumn("row", F.monotonically_increasing_id()))
    others = _dealt(every, candidate_block)
    anchors = _dealt(every.where(F.col("vec_id") % EVERY == 0), anchor_block).select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("label"), F.col("vector").alias("vector"), F.col("block").alias("a"))
    n_others, n_anchors = (t.agg(F.coalesce(F.max(c), F.lit(-1))).first()[0] + 1 for t, c in ((others, "block"), (anchors, "a")))
    over = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias(name)
    every_block = others.select("vec_id", "label", "vector", "row", F.col("block").alias("b"), over(n_anchors, "a"))

    def searched(side: DataFrame, search, schema: str) -> DataFrame:
        return side.select("*", over(n_others, "b")).groupBy("a", "b").cogroup(every_block.groupBy("a", "b")).applyInPandas(search, schema)

    first = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "other_id", "other_row")
    found = searched(anchors, positives_of, "anchor_row long, anchor_id long, score long, other_id long, other_row long")
    positives = settle(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES))
    per_anchor = positives.groupBy("anchor_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("positive_scores"))
    found = searched(anchors.join(per_anchor, "anchor_row"), negatives_of, "anchor_row long, anchor_id long, place int, score long, other_id long, other_row long")
    best = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "other_id", "other_row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
    named = positives.select("anchor_row", (F.col("place") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = f"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS row_no,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row_no AS anchor_row, a.vec_id AS anchor_id, o.row_no AS other_row, o.vec_id AS other_id, a.label = o.label AS same,
         list_inner_product(a.vector, o.vector)::BIGINT AS score
  FROM vectors a JOIN vectors o ON a.row_no <> o.row_no WHERE a.vec_id % {EVERY} = 0),
positives AS (
  SELECT anchor_row, anchor_id, other_row AS positive_row, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, other_id, other_row) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_row, p.positive_row ORDER BY s.score DESC, s.other_id, s.other_row)::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_row = p.anchor_row AND NOT s.same
 AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
