"""Document fingerprints by winnowing.

Rolling hashes of all ``K``-character grams; in every window of ``W`` successive hashes the least is chosen, of equal
ones the rightmost; a chosen hash is kept once, with its position. Any passage of at least ``K + W - 1`` characters
that two texts share therefore leaves a common hash in both. Likeness is the Jaccard index of the two hash sets.

Spark's part: fingerprints alone are a batch-wise projection. Comparing each document with the next one (descending
doc_id) takes one shuffle of the texts: doc_ids are range-partitioned once by themselves (a narrow pass) to get the
bounds of even ranges, each document goes to its range and the first of a range also to the range before it, and a
sorted scan of each range meets all neighbours. What reaches the driver is two ids a range.

Defined cases: null text is empty; a text shorter than ``K`` has one hash, of all of it; an empty one has none, and two
empty ones are alike (1.0), an empty and another not at all (0.0); null doc_ids come last; rows with one doc_id stand
in the order of their text's hash; a single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, partitions, whole_text

K = 32
W = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash (32 bits, in uint64) of each run of k codes: doubled pieces, joined polynomially modulo 2**64."""
    n = len(codes) - k + 1
    done, out, piece, size, power = 0, np.zeros(n, np.uint64), (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER, 1, _MULTIPLIER
    while True:
        if k & size:
            out = out * power + piece[done : done + n]
            done += size
        if size * 2 > k:
            break
        piece = piece[:-size] * power + piece[size:]
        size, power = size * 2, np.uint64(int(power) ** 2 % 2**64)
    return (out ^ (out >> np.uint64(29))) * _MULTIPLIER >> np.uint64(32)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes and their positions (code points), in order."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = rolling(codes, min(k, len(codes)))
    keyed = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    reach, low = 1, keyed
    w = min(w, len(keyed))
    while reach * 2 <= w:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < w:
        low = np.minimum(low[: len(low) - (w - reach)], low[w - reach :])
    chosen = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return chosen >> np.uint64(32), np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))


def digest(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    """One string for the hashes and positions, the same for the same text."""
    return hashlib.sha256(chosen[0].astype("<u4").tobytes() + chosen[1].astype("<u4").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, hashes and positions (arrays of long)."""

    @F.pandas_udf("hashes array<long>, positions array<long>")
    def choose(texts: pd.Series) -> pd.DataFrame:
        found = [winnow(t, k, w) for t in texts]
        return pd.DataFrame({"hashes": [x.astype(np.int64) for x, _ in found], "positions": [x.astype(np.int64) for _, x in found]})

    return docs.select("doc_id", choose(whole_text()).alias("f")).select("doc_id", "f.*")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first characters of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, per_row, schema: str) -> DataFrame:
    """Rows per_row(doc_id, text, following text) for every document, the following one by descending doc_id, in a ring.

    per_row is made anew for each task (a class or a factory), so it may remember the last text it saw.
    """
    n = 4 * partitions(docs.sparkSession)
    spans = docs.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low IS NOT NULL").orderBy("low").collect()
    lows, highs = np.array([r["low"] for r in spans], np.int64), np.array([r["high"] for r in spans], np.int64)

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        values = ids.fillna(0).astype("int64").to_numpy()
        own = np.where(null, 0, np.searchsorted(lows, values, "right") - 1) if len(lows) else np.zeros(len(ids), np.int64)
        first = ~null & (values == highs[own]) if len(lows) else null
        return pd.Series([[int(b), int((b + 1) % len(lows)) if len(lows) else 0] if f else [int(b)] for b, f in zip(own, first, strict=True)])

    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select("doc_id", "text", F.posexplode(ranges("doc_id")).alias("lent", "part"))
    rows = rows.repartition("part").sortWithinPartitions("part", "lent", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, held = per_row(), None  # held: the last document, which waits for its next
        for pdf in batches:
            out = []
            for doc_id, text, lent, part in zip(pdf["doc_id"], pdf["text"], pdf["lent"], pdf["part"], strict=True):
                if held and held[2] == part:
                    out.append(make(held[0], held[1], text))
                elif held:
                    raise ValueError("a range has no following document")
                held = None if lent else (doc_id, text, part)
            if out:
                yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in schema.split(",")]
    return rows.mapInPandas(scan, schema)


class _Compare:
    """The digest columns of one document; what it has computed of the following text serves for the next row."""

    def __init__(self) -> None:
        self.text, self.known = None, None

    def of(self, text: str) -> tuple:
        if text != self.text:
            chosen = winnow(text)
            self.text, self.known = text, (digest(chosen), np.unique(chosen[0]))
        return self.known

    def __call__(self, doc_id, text: str, following: str) -> tuple:
        name, hashes = self.of(text)
        new = edited(text, following)
        chosen = winnow(new)
        _, after = self.of(following)
        sha = hashlib.sha256(new.encode()).hexdigest()
        return doc_id, len(text), sha, name, digest(chosen), likeness(hashes, np.unique(chosen[0])), likeness(hashes, after)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir), _Compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
