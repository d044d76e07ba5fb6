"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Two fingerprints link
at ``radius`` (2) or fewer differing bits; a document's class is the least doc_id reachable over links.

Search. Of the 8 bytes of a fingerprint two linked ones differ in at most 2, so they agree in some 6 bytes: each
fingerprint goes to the 28 shards named by a choice of 6 bytes and their values. A shard's members differ in its two
free bytes only, so a shard has at most 65,536 distinct fingerprints however many near copies there are: the proven
bound of its tree. Each shard builds one BK-tree, children keyed by their integer Hamming distance to the parent; a
lookup follows only the edges within the radius of the distance found. A shard's links are cut down to a spanning
forest, then connected components join the shards' forests.

Spark's part: fingerprints in Arrow batches (no shuffle), written to the shared checkpoint folder as narrow rows; one
shuffle of distinct fingerprints to shards; star rounds over the links (components.py); one join back on the
fingerprint, whose hot values Spark's skew join may split. Exact copies meet as one fingerprint in the first
aggregation and cost nothing after it.

Defined cases: null text is empty; a text without words has fingerprint zero, linked like any other; fewer words than
a shingle make one shingle of all; null doc_id is never a class's least id unless the class has no other (then null);
repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, settle, whole_text
from ledgerloom.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and the six blanks only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, n - shingle)].tolist()]
    stops = (ends[min(shingle, n) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long; and more columns if asked for."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", simhash(whole_text()).alias("fp"), *more)


class BKTree:
    """Of 64-bit integers under Hamming distance; a node is [value, position, {distance: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near(self, x: int, radius: int) -> list[int]:
        """Positions of the values within the radius."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, position, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(position)
            for edge in range(max(1, d - radius), d + radius + 1):
                if edge in children:
                    todo.append(children[edge])
        return found

    def add(self, x: int, position: int) -> None:
        if self.root is None:
            self.root = [x, position, {}]
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            nxt = node[2].get(d)
            if nxt is None:
                node[2][d] = [x, position, {}]
                return
            node = nxt


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links (value, value) of the values of one shard, found by its BK-tree."""
    tree, head, links = BKTree(), list(range(len(values))), []

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, x in enumerate(values):
        for j in tree.near(x, radius):
            a, b = top(i), top(j)
            if a != b:
                head[max(a, b)] = min(a, b)
                links.append((x, values[j]))
        tree.add(x, i)
    return links


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> spanning links (u, v) between those within the radius."""
    if radius != 2:
        raise ValueError("shards agree in 6 of 8 bytes, which holds for a radius of 2")
    masks = [sum(0xFF << (8 * b) for b in kept) for kept in combinations(range(8), 6)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "kept"))
    placed = shards.repartition(F.col("choice"), F.col("kept")).sortWithinPartitions("choice", "kept", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in _with_end(batches):
            if pdf is not None:
                choice, kept, fp = pdf["choice"].to_numpy(), pdf["kept"].to_numpy(), pdf["fp"].to_numpy()
                if rest is not None:
                    choice, kept, fp = (np.concatenate(x) for x in zip(rest, (choice, kept, fp), strict=True))
                if not len(fp):
                    continue
                new = np.flatnonzero((choice[1:] != choice[:-1]) | (kept[1:] != kept[:-1])) + 1
                cut = new[-1] if len(new) else 0  # the last shard may go on in the next batch
                rest, (choice, kept, fp) = (choice[cut:], kept[cut:], fp[cut:]), (choice[:cut], kept[:cut], fp[:cut])
                bounds = np.concatenate(([0], new)) if len(new) else np.array([0])
            elif rest is None:
                return
            else:
                choice, kept, fp = rest
                bounds = np.array([0, len(fp)])
            sizes = np.diff(bounds)
            out = [link for a, n in zip(bounds[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True) for link in forest(fp[a : a + n].view(np.uint64).tolist(), radius)]
            if out:
                yield pd.DataFrame(np.array(out, dtype=np.uint64).view(np.int64), columns=["u", "v"])

    return placed.mapInPandas(search, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _rooted(prints: DataFrame, radius: int, least: Column) -> DataFrame:
    """fp, root and what least aggregates, for every distinct fingerprint; root is the same throughout a class."""
    each = settle(prints.groupBy("fp").agg(least))
    roots = components(links(each.select("fp"), radius))
    return each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    prints = settle(fingerprints(docs, shingle))
    classes = _rooted(prints, radius, F.min("doc_id").alias("least"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(classes.join(ids, "root").select("fp", "component_id"))
    return prints.join(named, "fp")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows that stand for their class, one each, with all their columns; exactly repeated rows leave one.

    It is the class's least row by doc_id (null last), hash of the text and hash of the whole row, so rows that share a
    doc_id or have none are told apart by what they hold.
    """
    whole = F.xxhash64(*[c for name in docs.columns for c in (docs[name], docs[name].isNull())])  # a null alone leaves a hash as it was
    row = F.struct(docs["doc_id"].isNull().alias("null_id"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text_hash"), whole.alias("row_hash"))
    least = _rooted(fingerprints(docs, shingle, row.alias("row")), radius, F.min("row").alias("row"))
    kept = least.groupBy("root").agg(F.min("row").alias("row")).select("row.id", "row.row_hash")
    mine = docs.select(F.struct(*docs.columns).alias("doc"), docs["doc_id"].alias("id"), whole.alias("row_hash"))
    mine = mine.join(kept, (mine["row_hash"] == kept["row_hash"]) & mine["id"].eqNullSafe(kept["id"]), "left_semi")
    return mine.dropDuplicates(["id", "row_hash"]).select("doc.*")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
