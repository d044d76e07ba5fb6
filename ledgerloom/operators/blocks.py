"""Nearest vectors by blocks: a block of queries meets a block of vectors as two matrices, and only the block's best leave it.

The stated queries are a share of the vectors, so the products are quadratic by nature. They aren't rows, though: a block sends
on k rows a query, memory follows the block's size alone, and what is shuffled is the vectors, once for each QUERIES queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VECTORS, QUERIES, CELLS = 1 << 14, 1 << 12, 1 << 21  # vectors and queries a block; products at a time

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (v @ q.T).round(6) + 0.0


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """0 where either vector is zero."""
    norms = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((q * q).sum(1))
    return np.divide(v @ q.T, norms, out=np.zeros(norms.shape), where=norms > 0).round(6) + 0.0


def distance(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Signs in which the first 64 places differ."""
    a, b = (np.where(x[:, :64] > 0, 1, -1).astype(np.float32) for x in (v, q))
    return ((a.shape[1] - a @ b.T) / 2).astype(float)


def small(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Product of 8-bit values."""
    a, b = (np.clip(np.floor(x * 127 + 0.5), -127, 127) for x in (v, q))
    return a @ b.T


def in_blocks(rows: DataFrame, asked: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work on each block of rows (vec_id, v) with each block of asked (query_id, v, ...)."""
    n, m = rows.count(), asked.count()
    most = rows.sparkSession.sparkContext.defaultParallelism
    across, down = max(-(-n // VECTORS), min(most, -(-n // 512)), 1), max(-(-m // QUERIES), 1)
    block = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = rows.withColumn("a", block("vec_id", across)).withColumn("d", every(down))
    right = asked.toDF(*asked.columns).withColumn("d", block("query_id", down)).withColumn("a", every(across))  # columns of its own
    return left.groupBy("a", "d").cogroup(right.groupBy("a", "d")).applyInPandas(work, schema)


def _parts(rows: pd.DataFrame, asked: pd.DataFrame):
    """The vectors in order of vec_id, and the queries a few at a time."""
    if not len(rows) or not len(asked):
        return
    rows = rows.sort_values("vec_id")
    v = np.stack(rows["v"].to_list()).astype(float)
    step = max(1, CELLS // len(rows))
    for at in range(0, len(asked), step):
        part = asked.iloc[at : at + step]
        yield rows["vec_id"].to_numpy(), v, part, np.stack(part["v"].to_list()).astype(float)


def best(rows: DataFrame, asked: DataFrame, k: int, score: Score, side: str = "") -> DataFrame:
    """query_id, vec_id, score, rank of the k best of each query (score falling, then vec_id) but itself. side 'inside' or 'outside':
    only vectors within, or beyond, the asked one's ``bound`` of distance."""

    def work(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, v, part, q in _parts(held, wanted):
            queries = part["query_id"].to_numpy()
            scores = score(v, q)
            lacks = ids[:, None] == queries
            if side:
                within = distance(v, q) <= part["bound"].to_numpy(float)
                lacks |= ~within if side == "inside" else within
            scores[lacks] = -np.inf
            least = np.partition(scores, -k, axis=0)[-k] if len(ids) > k else np.full(len(queries), -np.inf)
            row, at = np.nonzero((scores >= least) & ~lacks)
            found = scores[row, at]
            order = np.lexsort((row, -found, at))
            of = at[order]
            kept = order[np.arange(len(of)) - np.searchsorted(of, of) < k]
            out.append(pd.DataFrame({"query_id": queries[at[kept]], "vec_id": ids[row[kept]], "score": found[kept]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    first = in_blocks(rows, asked, work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a block
    return first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def distances(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, distance, n: how many vectors but itself lie at each distance."""

    def work(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, v, part, q in _parts(held, wanted):
            queries, far = part["query_id"].to_numpy(), distance(v, q).astype(np.int64)
            at = np.nonzero(ids[:, None] != queries)
            n = np.bincount(at[1] * 65 + far[at], minlength=65 * len(queries))
            some = np.flatnonzero(n)
            out.append(pd.DataFrame({"query_id": queries[some // 65], "distance": some % 65, "n": n[some]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "distance": [], "n": []})

    return in_blocks(rows, asked, work, "query_id long, distance long, n long").groupBy("query_id", "distance").agg(F.sum("n").alias("n"))
