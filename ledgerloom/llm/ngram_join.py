"""Jaccard self-join on word n-grams by prefix filters under several global token orders.

A document's set holds its distinct shingles of four words. Two sets of n and m shingles link if they share i with
100 i >= 85 (n + m - i). Of n sorted by any order that all sets follow, a linked partner must share one of the first
``n - ceil(0.85 n) + 1``: the prefix. Three orders are used, all with shingles of one document only first (nothing can
share these, so most documents have no prefix left): rarest first; scrambled; coarse rarity, scrambled otherwise. A pair
must share a prefix shingle under every order before its whole sets are compared. No pair can be missed by any of them.

Spark's part.
1. Texts become hashed sets in Arrow batches (no shuffle). Equal sets are one node from here on.
2. Exact document frequencies: blocks of about half a million shingles are sorted and sent packed (some six bytes a shingle)
   to ranges of the hash space; a shingle that a block holds often is sent as one count. Ranges give back, block by
   block, only the shingles of two documents or more. Blocks name the prefixes of their documents.
3. Prefix shingles are postings. A posting list isn't paired out: its member with the fewest shingles of its own is the
   hub, every member meets the hub, and pairs that pass the filters are verified on whole sets, whose links join
   components. Only members of one list that are still in different components are then paired, in blocks of bounded size,
   each pair at its first common prefix shingle, and only if their known overlaps with the hub leave room for a link. So
   near copies cost a row each, however many there are, and no link that could join two components is left out.

Whole sets are made again for nodes in a posting list of two or more only; their texts are found by a fixed-size bitmap of
text hashes (2 MB), then exactly by a join.

Defined cases: null text is empty; an empty set is linked with nothing; one to three words are one shingle; repeated rows
get a row each; null doc_id is never a component's least id unless the component has no other (then null); an empty table
gives an empty result; texts of any length are taken whole. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, given_back, groups, partitions, settle, slices, whole_text
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import BKTree

BLOCK, OFTEN, PAIRED = 1 << 19, 64, 1024  # shingles a block; documents of a block that make a shingle a count; members a block of pairs
KEPT_WORDS = 1 << 18
FEW = 1 << 16  # pairs whose nodes' ids go to every task
BITMAP = 1 << 24
KEY_BITS = 48
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SCRAMBLES = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Rule(NamedTuple):
    """What links: words a shingle, per cent of the union; and (if not none) the bits in which SimHashes may differ where BK-trees
    look hubs up first."""

    words: int = 4
    like: int = 85
    radius: int | None = None


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_SCRAMBLES[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_SCRAMBLES[1])
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; remembers the hashes of words."""

    def __init__(self, words: int) -> None:
        self.known, self.size = {}, words

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words, known = text.encode().lower().split(), self.known  # bytes: A-Z only, and the six blanks only
        if len(known) > KEPT_WORDS:
            known.clear()
        new = set(words).difference(known)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < self.size:
            return _mixed((h * _ODD[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))) if len(h) else h
        n = len(h) - self.size + 1
        return np.unique(_mixed(sum((h[i : i + n] * _ODD[i] for i in range(1, self.size)), h[:n] * _ODD[0])))


def simhash(shingles: np.ndarray) -> int:
    """The bits that over half of the shingles' hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 4096):  # bounded memory for very long texts
        ones += np.unpackbits(shingles[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def sets(docs: DataFrame, words: int, *more: Column) -> DataFrame:
    """doc_id, text_hash, node (null for an empty set), n; and more columns if asked for."""

    @F.pandas_udf("struct<node: long, n: long>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        shingler = Shingler(words)
        found = [shingler(t) for t in texts]
        nodes = np.array([_node(s) if len(s) else 0 for s in found], np.uint64).view(np.int64)
        n = np.array([len(s) for s in found], np.int64)
        return pd.DataFrame({"node": nodes, "n": n})

    named = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), judged(whole_text()).alias("s"), *more)
    return named.select("doc_id", "text_hash", F.when(F.col("s.n") > 0, F.col("s.node")).alias("node"), F.col("s.n").alias("n"), *[c for c in named.columns if c not in ("doc_id", "text_hash", "s")])


# Packed blocks. A row is (part, block, keys, refs, often, counts): a sorted run of keys with the places of their documents
# in the block, and keys held often with their counts; the block's own row (part < 0) has nodes, sizes, and for keys held
# often every (key, place).
PACKED = "part int, block long, keys binary, refs binary, often binary, counts binary"


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and their differences, in four bytes each where they fit."""
    steps = np.diff(keys)
    if len(steps) and int(steps.max()) >= 2**32 or not len(keys):
        return b"\0" + keys.tobytes()
    return b"\1" + keys[:1].tobytes() + steps.astype(np.uint32).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, np.uint64, offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(data[1:9], np.uint64), np.frombuffer(data, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64)


def _block_rows(block: int, found: list[np.ndarray], nodes: list[int], parts: int) -> pd.DataFrame:
    sizes = np.array([len(s) for s in found], np.int32)
    keys, refs = np.concatenate(found) >> np.uint64(64 - KEY_BITS), np.repeat(np.arange(len(found), dtype=np.uint16), sizes)
    order = np.argsort(keys, kind="stable")
    keys, refs = keys[order], refs[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    held = np.diff(np.append(starts, len(keys)))
    often = held >= OFTEN
    often_keys, often_counts, flags = keys[starts[often]], held[often].astype(np.uint32), np.repeat(often, held)
    rows = [(-1 - block % (1 << 30), block, np.array(nodes, np.uint64).tobytes(), sizes.tobytes(), keys[flags].tobytes(), refs[flags].tobytes())]
    keys, refs = keys[~flags], refs[~flags]
    width = -(-(1 << KEY_BITS) // parts)
    edges = np.arange(1, parts, dtype=np.uint64) * np.uint64(width)
    cuts, often_cuts = ([0, *np.searchsorted(k, edges).tolist(), len(k)] for k in (keys, often_keys))
    for part in range(parts):
        (a, b), (c, d) = cuts[part : part + 2], often_cuts[part : part + 2]
        if b > a or d > c:
            rows.append((part, block, _packed(keys[a:b]), refs[a:b].tobytes(), often_keys[c:d].tobytes(), often_counts[c:d].tobytes()))
    return pd.DataFrame(rows, columns=["part", "block", "keys", "refs", "often", "counts"])


def _blocks(docs: DataFrame, parts: int, most: int, words: int) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shingler, block = Shingler(words), TaskContext.get().partitionId() << 24
        held: dict[int, np.ndarray] = {}
        total = 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices([len(t) for t in texts]):
                for text in texts[a:b]:
                    s = shingler(text)
                    if len(s) and (node := _node(s)) not in held:
                        held[node] = s
                        total += len(s)
                    if total >= most or len(held) >= 60_000:
                        yield _block_rows(block, list(held.values()), list(held), parts)
                        held, total, block = {}, 0, block + 1
        if held:
            yield _block_rows(block, list(held.values()), list(held), parts)

    return docs.select(whole_text().alias("text")).mapInPandas(lambda batches: given_back(pack(batches)), PACKED)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range each -> the same rows with the keys of two documents or more only, and their frequencies as counts."""
    for rows in groups(batches, ["part"]):
        if rows["part"].iloc[0] < 0:
            yield rows
            continue
        keys, often = [_unpacked(k) for k in rows["keys"]], [np.frombuffer(k, np.uint64) for k in rows["often"]]
        every = np.concatenate(keys + often)
        weight = np.concatenate([np.ones(sum(map(len, keys)), np.int64), *(np.frombuffer(c, np.uint32).astype(np.int64) for c in rows["counts"])])
        order = np.argsort(every, kind="stable")
        every = every[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        frequency = np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0, np.int64)
        of = np.empty(len(every), np.int64)
        of[order] = np.repeat(frequency, np.diff(np.append(starts, len(every))))
        at, out = 0, []
        after = sum(map(len, keys))
        for block, k, o, refs in zip(rows["block"], keys, often, rows["refs"], strict=True):
            mine, theirs = of[at : at + len(k)], of[after : after + len(o)]
            at, after, some = at + len(k), after + len(o), mine > 1
            if some.any() or len(o):
                out.append((0, block, k[some].tobytes(), np.frombuffer(refs, np.uint16)[some].tobytes(), o.tobytes(), np.concatenate([mine[some], theirs]).tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["part", "block", "keys", "refs", "often", "counts"])


def _prefixes(batches: Iterator[pd.DataFrame], like: int) -> Iterator[pd.DataFrame]:
    """Rows of one block each -> node, n, own (shingles of no other document) and three prefixes of its shared shingles."""
    for rows in groups(batches, ["block"]):
        own, rest = rows[rows["part"] < 0].iloc[0], rows[rows["part"] >= 0]
        nodes, sizes = np.frombuffer(own["keys"], np.uint64).view(np.int64), np.frombuffer(own["refs"], np.int32).astype(np.int64)
        if not len(rest):
            continue
        keys, refs = (np.concatenate([np.frombuffer(x, kind) for x in rest[c]]) for c, kind in (("keys", np.uint64), ("refs", np.uint16)))
        counts = [np.frombuffer(x, np.int64) for x in rest["counts"]]
        frequency = np.concatenate([c[: len(k) // 8] for c, k in zip(counts, rest["keys"], strict=True)])
        often, often_of = np.concatenate([np.frombuffer(x, np.uint64) for x in rest["often"]]), np.concatenate([c[len(k) // 8 :] for c, k in zip(counts, rest["keys"], strict=True)])
        if len(often):
            order = np.argsort(often)
            pairs = np.frombuffer(own["often"], np.uint64)
            keys, refs = np.concatenate([keys, pairs]), np.concatenate([refs, np.frombuffer(own["counts"], np.uint16)])
            frequency = np.concatenate([frequency, often_of[order][np.searchsorted(often[order], pairs)]])
        shared = np.bincount(refs, minlength=len(nodes))
        slots = shared - -(-like * sizes // 100) + 1
        fits = slots[refs] > 0
        keys, refs, frequency = keys[fits], refs[fits], frequency[fits]
        if not len(keys):
            continue
        scrambled = [(keys * np.uint64(s)) >> np.uint64(16) for s in _SCRAMBLES]
        ends = np.cumsum(np.bincount(refs, minlength=len(nodes)))
        prefixes = []
        for order in (np.lexsort((keys, frequency, refs)), np.lexsort((scrambled[0], refs)), np.lexsort((scrambled[1], np.log2(frequency).astype(int), refs))):
            ranked = keys[order].astype(np.int64)
            prefixes.append([ranked[ends[i] - shared[i] : ends[i] - shared[i] + slots[i]] for i in np.flatnonzero(slots > 0)])
        some = slots > 0
        yield pd.DataFrame({"node": nodes[some], "n": sizes[some], "own": (sizes - shared)[some]} | {f"p{i}": p for i, p in enumerate(prefixes, 1)})


def prefixes(docs: DataFrame, parts: int, block: int, rule: Rule) -> DataFrame:
    """node, n, own, p1, p2, p3 of every node that can have a link at all."""
    ranges = _blocks(docs, parts, block, rule.words).repartition("part").sortWithinPartitions("part")
    back = ranges.mapInPandas(lambda batches: given_back(_shared(batches)), PACKED).repartition("block").sortWithinPartitions("block")
    found = back.mapInPandas(lambda batches: given_back(_prefixes(batches, rule.like)), "node long, n long, own long, p1 array<long>, p2 array<long>, p3 array<long>")
    return settle(found.dropDuplicates(["node"]))


def _whole_sets(docs: DataFrame, named: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """node, shingles (and SimHash if the rule asks for it) of the wanted nodes, from one text each."""
    texts = settle(named.where("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash")).join(wanted, "node", "left_semi"))
    at = F.pmod("text_hash", F.lit(BITMAP))
    words = texts.select((at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    bits = np.zeros(BITMAP // 64, np.int64)
    for word, mask in words.groupBy("word").agg(F.bit_or("bit")).toLocalIterator():
        bits[word] = mask
    bitmap = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy() % BITMAP
        return pd.Series((bitmap.value[h // 64] >> (h % 64)) & 1 == 1)

    @F.pandas_udf("struct<shingles: array<long>, simhash: long>")
    def shingled(texts: pd.Series) -> pd.DataFrame:
        shingler = Shingler(rule.words)
        found = [shingler(t) for t in texts]
        prints = np.array([0 if rule.radius is None else simhash(s) for s in found], np.uint64).view(np.int64)
        return pd.DataFrame({"shingles": [s.view(np.int64) for s in found], "simhash": prints})

    found = docs.select(whole_text().alias("text"), F.xxhash64(whole_text()).alias("text_hash")).where(may("text_hash"))
    found = found.join(texts, "text_hash").dropDuplicates(["node"])
    return found.select("node", shingled("text").alias("s")).select("node", "s.*")


class Prints:
    """SimHashes of a block of a shard as a BK-tree; members with equal ones share its node."""

    def __init__(self, simhashes: np.ndarray) -> None:
        self.each, self.tree, self.alike = simhashes.astype(np.int64).view(np.uint64).tolist(), BKTree(), {}
        for at, x in enumerate(self.each):
            if x not in self.alike:
                self.tree.add(x, at)
            self.alike.setdefault(x, []).append(at)

    def near(self, x: int, radius: int) -> list[int]:
        """Places of the members within the radius."""
        return [at for first in self.tree.near(x, radius) for at in self.alike[self.each[first]]]


def near_hubs(stars: DataFrame, prints: DataFrame, radius: int, paired: int = PAIRED) -> DataFrame:
    """Pairs (u, v) of a member and its hub -> those within the radius, by node's simhash. The members of a hub are a shard, dealt
    into blocks of bounded size; each block is a BK-tree, in which the hub is looked up."""
    blocks = stars.groupBy("v").agg(F.ceil(F.count("*") / paired).cast("int").alias("blocks")).where("blocks > 1")  # at most a row for so many pairs
    dealt = stars.join(F.broadcast(blocks), "v", "left").select("v", "u", F.pmod(F.hash("u"), F.coalesce("blocks", F.lit(1))).alias("block"))
    dealt = dealt.unionByName(dealt.select("v", F.col("v").alias("u"), "block").distinct())  # the hub goes to each of its blocks
    placed = dealt.join(prints.withColumnRenamed("node", "u"), "u").repartition("v", "block").sortWithinPartitions("v", "block")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, ["v", "block"]):
            is_hub = rows["u"] == rows["v"]
            others = rows[~is_hub]
            found = Prints(others["simhash"].to_numpy()).near(int(rows["simhash"][is_hub].iloc[0]) % 2**64, radius)
            if found:
                yield others[["u", "v"]].iloc[found]

    return placed.mapInPandas(lambda batches: given_back(look_up(batches)), "u long, v long")


def _overlaps(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (u, v) whose prefixes overlap under the other orders, with the size of the sets' overlap and whether they link."""
    for end in "uv":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "p2", "p3", "shingles")]), end)
    pairs = pairs.where(F.arrays_overlap("p2_u", "p2_v") & F.arrays_overlap("p3_u", "p3_v"))
    pairs = pairs.withColumn("same", F.size(F.array_intersect("shingles_u", "shingles_v")))
    return pairs.select("u", "v", "same", ((100 + rule.like) * F.col("same") >= rule.like * (F.col("n_u") + F.col("n_v"))).alias("linked"))


def _ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of pairs, if these are few enough to go to every task; else all nodes."""
    if pairs.count() > FEW:
        return nodes
    return settle(nodes.join(F.broadcast(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "node"))


def _apart(postings: DataFrame, paired: int, rule: Rule) -> DataFrame:
    """Pairs (u, v) of members of one list with different roots that share a prefix under every order and that their overlaps with
    the list's hub don't rule out: two sets share at most the smaller of what each shares with the hub, and the smaller of
    what each shares with other documents beyond the hub."""
    lists = postings.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key", F.ceil(F.col("members") / paired).cast("int").alias("blocks"))
    members = postings.join(lists, "key").withColumn("i", F.pmod(F.hash("node"), F.col("blocks")))
    dealt = members.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "node", "root", "n", "with_hub", "beyond", "p1", "p2", "p3")
    like = rule.like

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, ["key", "low", "high"]):
            key, low, high = (rows[c].iloc[0] for c in ("key", "low", "high"))
            node, root, n, i = (rows[c].to_numpy() for c in ("node", "root", "n", "i"))
            with_hub, beyond = (rows[c].to_numpy(float) for c in ("with_hub", "beyond"))  # not a number where not measured
            before = [set(p[: p.index(key)]) for p in (p.tolist() for p in rows["p1"])]
            p2, p3 = [set(p) for p in rows["p2"]], [set(p) for p in rows["p3"]]
            out = []
            for a in range(len(rows)):
                fit = (root != root[a]) & (node > node[a]) & (100 * np.minimum(n, n[a]) >= like * np.maximum(n, n[a]))
                most = np.minimum(with_hub, with_hub[a]) + np.minimum(beyond, beyond[a])
                fit &= ~((100 + like) * most < like * (n + n[a]))
                if low != high:
                    fit &= i != i[a]
                for b in np.flatnonzero(fit).tolist():
                    if before[a].isdisjoint(before[b]) and not p2[a].isdisjoint(p2[b]) and not p3[a].isdisjoint(p3[b]):
                        out.append((node[a], node[b]))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    placed = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.mapInPandas(lambda batches: given_back(pairs(batches)), "u long, v long")


class Met(NamedTuple):
    """Posting lists of two nodes and more, and what their members share with the lists' hubs."""

    members: DataFrame  # key, node, n, hub, hub_n
    nodes: DataFrame  # node, n, own, p1, p2, p3, shingles, simhash
    met: DataFrame  # u, v (the hub), same, linked


def met_hubs(docs: DataFrame, named: DataFrame, rule: Rule, block: int = BLOCK, paired: int = PAIRED) -> Met:
    """With a radius, a hub first meets what a BK-tree finds for it; then members that have no link with a hub yet meet the hubs for
    which no tree found them, so nothing is left out."""
    found = prefixes(docs, 4 * partitions(docs.sparkSession), block, rule)
    postings = found.select(F.explode("p1").alias("key"), "node", "n", "own")
    hub = F.min(F.struct("own", "node", "n")).alias("hub")
    lists = settle(postings.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), hub).where("a <> b").select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    members = settle(postings.select("key", "node", "n").join(lists, "key"))
    nodes = settle(found.join(_whole_sets(docs, named, members.select("node").distinct(), rule), "node"))
    long_enough = 100 * F.least("n", "hub_n") >= rule.like * F.greatest("n", "hub_n")
    stars = members.where((F.col("node") != F.col("hub")) & long_enough).select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    if rule.radius is None:
        return Met(members, nodes, settle(_overlaps(stars, nodes, rule)))
    stars = settle(stars)
    near = settle(near_hubs(stars, nodes.select("node", "simhash"), rule.radius, paired))
    met = settle(_overlaps(near, nodes, rule))
    rest = settle(stars.join(near, ["u", "v"], "left_anti").join(met.where("linked").select("u"), "u", "left_anti"))
    return Met(members, nodes, met.unionByName(settle(_overlaps(rest, _ends(rest, nodes), rule))))


def links_apart(rooted: DataFrame, hubs: Met, rule: Rule, paired: int = PAIRED) -> DataFrame:
    """Members with roots -> links (u, v) between members of one list with different roots."""
    several = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    with_hub = hubs.met.select(F.col("u").alias("node"), F.col("v").alias("hub_node"), "same")
    rest = rooted.join(several, "key", "left_semi").select("key", "node", "n", "root", F.col("hub").alias("hub_node")).join(with_hub, ["node", "hub_node"], "left")
    rest = rest.join(hubs.nodes.select("node", "own", "p1", "p2", "p3"), "node").withColumn("with_hub", F.when(F.col("node") == F.col("hub_node"), F.col("n")).otherwise(F.col("same")))
    apart = _apart(rest.withColumn("beyond", F.col("n") - F.col("own") - F.col("with_hub")), paired, rule)
    return settle(_overlaps(apart, hubs.nodes, rule).where("linked").select("u", "v"))


def joined(docs: DataFrame, block: int = BLOCK, paired: int = PAIRED, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node, n of every document; node, root of every node with a link but the roots)."""
    named = settle(sets(docs, rule.words))
    hubs = met_hubs(docs, named, rule, block, paired)
    links = hubs.met.where("linked").select("u", "v")
    rooted = hubs.members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named, components(links.unionByName(links_apart(rooted, hubs, rule, paired)))


def near_groups(docs: DataFrame, block: int = BLOCK, paired: int = PAIRED) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    named, roots = joined(docs, block, paired)
    each = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    each = each.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = settle(each.join(least, "root").select("node", "component_id"))
    linked = named.join(ids, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(named.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
