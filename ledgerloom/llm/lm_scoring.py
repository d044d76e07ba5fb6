"""Scoring texts by a causal self-attention language model on subword ids, beside a word-count base score.

Tokens of the model are a public tokenizer's ids and one end. The ids that are frequent in the training documents are
classes of their own, the others share classes by frequency: p(id | earlier ids) = p(class | earlier classes) *
p(id | class). The first factor is the attention model (attention.py), the second comes from the counts over all
training documents. A word's probability is the mean of the product over its ids and of its plain share of all training
words, so the score knows a word that the corpus repeats, and spells one that it hasn't met.

Spark's part: (1) texts are read and tokenised once, into chunks in the shared checkpoint folder: a chunk holds its
distinct words with their hashes and ids, and the place among them of every word of every document; counting, training
and scoring read the chunks. Words are counted with a combine in each task before the shuffle; (2) the attention model is trained in rounds. Every
training document belongs to one round (``ROUNDS`` are shares of the corpus) and to one bucket of about ``BUCKET`` ids
of it, both by its hash alone. In a round each bucket is trained on by itself from the same parameters, in the order of
the hashes, and the buckets' parameters are averaged, weighted by ids. So every training document is learned from
once at every size (a bucket with less than ``LEAST_STEPS`` steps is gone over again), and neither partitions nor tasks
have a say in the result; (3) one pass scores every document whole. Counts of the words that make up 1/``HEAD`` of all
words or more go to the tasks with the function: there can't be more than HEAD of them, 16 bytes each. The rarer words
of a document are joined to the word table by hash, and none of those can be a hot key.

Memory: a chunk has at most ``CHUNK`` bytes of text, or one longer text; words and classes are laid out by some hundred
thousand at a time, long texts by pieces (attention.py); a bucket is held whole.

Defined cases: null and empty texts have the end alone; a null doc_id counts as empty text, so it is held out; words
are told apart by 64-bit XXH64; repeated rows get a row each; without training documents every count is 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import attention
from ledgerloom.llm.attention import CLASSES, END
from ledgerloom.llm.common import documents, settle, slices, whole_text
from ledgerloom.llm.tokens import WordIds, default_path, id_kind, word_ids

SHARED = 64  # classes of the ids past the frequent ones: half for ids that end a word, half for the others
OWN = CLASSES - 1 - SHARED
HEAD = 1 << 21
ROUNDS = (1, 4, 16, 43)  # of 64 parts
BUCKET = 1 << 21
LEAST_STEPS = 100
MOST_PARTITIONS = 20_000
CHUNK = 1 << 25  # bytes of text
AT_ONCE = 1 << 15  # words spelled at a time
PARTS = 64
_LN10 = float(np.log(10))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z only, and the six blanks only


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words)).view(np.int64)


class Places:
    """Words met, each with its place in the order in which they were met."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = defaultdict(count().__next__)

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
        """Places of the words of some texts in a row, and the words that are new, in the order of their places."""
        before = len(self.at)
        places = np.fromiter(map(self.at.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        return places, list(islice(reversed(self.at), len(self.at) - before))[::-1]


class Words(NamedTuple):
    """Distinct words of a chunk of documents: their hashes, how many ids each has, and the ids in a row."""

    hash: np.ndarray
    size: np.ndarray
    ids: np.ndarray


def told(words: pa.Array, spelling: WordIds) -> Words:
    """Words with their hashes and ids."""
    data, stops = words.buffers()[2].to_pybytes() if len(words) else b"", np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1].tolist()
    hash, size, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int64)]
    for a in range(0, len(words), AT_ONCE):
        b = min(a + AT_ONCE, len(words))
        some = [data[i:j] for i, j in zip(stops[a:b], stops[a + 1 : b + 1], strict=True)]
        hash[a:b] = hashes(some)
        found, size[a:b] = spelling.flat_ids(some)
        ids.append(found)
    return Words(hash, size, np.concatenate(ids))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Place of every word of the texts among the distinct words, how many words each text has, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))  # A-Z only, and the six blanks only
    found = lists.flatten().dictionary_encode()
    words, at, stops = found.dictionary.cast(pa.large_binary()), found.indices.to_numpy(), lists.offsets.to_numpy()
    is_word = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, bool)  # a text that begins or ends with a blank has an empty one there
    return at[is_word], np.diff(np.concatenate(([0], np.cumsum(is_word)))[stops]), words


def packed(values: np.ndarray, kind: str) -> bytes:
    """Values compressed, all first bytes before all second ones."""
    raw = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T)
    return raw.nbytes.to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Documents in chunks, a row each: of every document doc_id, whether it is held out (without that column: none is), tie
    (a hash of the row) and n (words); place of every word among the chunk's; of those hash, size (ids) and ids."""
    held, kind = F.col("held_out") if "held_out" in docs.columns else F.lit(False), id_kind(path)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = word_ids(path)
        for batch in batches:
            for a, b in slices(pc.binary_length(batch["text"]).to_pylist(), CHUNK):
                some = batch.slice(a, b - a)
                at, n, words = split(some["text"])
                now = told(words, spelling)
                blobs = {"place": packed(at, "<u4"), "hash": now.hash.tobytes(), "size": packed(now.size, "<u4"), "ids": packed(now.ids, kind)}
                whole = {"doc_id": some["doc_id"], "held_out": some["held_out"], "tie": some["tie"], "n": pa.array(n, pa.int64())}
                yield pa.RecordBatch.from_pydict({k: pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), v) for k, v in whole.items()} | {k: pa.array([v], pa.binary()) for k, v in blobs.items()})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), F.xxhash64("doc_id", "text").alias("tie"))
    return rows.mapInArrow(chunks, "doc_id array<long>, held_out array<boolean>, tie array<long>, n array<long>, place binary, hash binary, size binary, ids binary")


class Chunk:
    """A row of tokenised."""

    def __init__(self, batch: pa.RecordBatch, row: int, kind: str) -> None:
        one, blob = batch.slice(row, 1), lambda name: batch[name][row].as_py()
        self.doc_id, self.held_out, self.tie, n = (one[name].flatten() for name in ("doc_id", "held_out", "tie", "n"))
        self.n, self.tie, self.learned = n.to_numpy(), self.tie.to_numpy(), ~self.held_out.to_numpy(zero_copy_only=False)
        self.place, self.size, self.ids = unpacked(blob("place"), "<u4"), unpacked(blob("size"), "<u4").astype(np.int64), unpacked(blob("ids"), kind)
        self.hash, self.first = np.frombuffer(blob("hash"), np.int64), np.cumsum(self.size) - self.size
        self.starts = np.cumsum(self.n) - self.n

    def places(self, docs: np.ndarray) -> np.ndarray:
        return self.place[ranges(self.starts[docs], self.n[docs])]

    def counts(self) -> np.ndarray:
        """How often each word stands in the documents that are learned from."""
        return np.bincount(self.place[np.repeat(self.learned, self.n)], minlength=len(self.size))


def chunks_of(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[Chunk]:
    return (Chunk(batch, row, kind) for batch in batches for row in range(len(batch)))


def counted(tokens: DataFrame, path: str) -> DataFrame:
    """hash, c of the words of all documents of tokenised that are learned from."""
    kind = id_kind(path)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches, kind):
            n = chunk.counts()
            yield pa.RecordBatch.from_pydict({"hash": chunk.hash[n > 0], "n": n[n > 0]})

    return tokens.mapInArrow(words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("c"))


def word_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """hash, c over all rows of docs."""
    return counted(tokenised(docs.select(F.lit(0).alias("doc_id"), "text"), path or default_path()), path or default_path())


def id_counts(tokens: DataFrame, path: str) -> np.ndarray:
    """How often each id of the vocabulary stands in the documents of tokenised that are learned from."""
    kind, size = id_kind(path), max(word_ids(path).vocabulary().values()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for chunk in chunks_of(batches, kind):
            total += np.bincount(chunk.ids, np.repeat(chunk.counts(), chunk.size), size).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"id": np.flatnonzero(total), "n": total[total > 0]})

    found = np.zeros(size, np.int64)
    for row in tokens.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        found[row["id"]] = row["n"]
    return found


class Classes:
    """Class of every id and its share in its class, from the counts over the training documents; which classes end a word."""

    def __init__(self, counts: np.ndarray, ends: int, ends_word: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        self.of = np.empty(len(counts), np.uint16)
        own = order[:OWN]
        self.of[own] = np.arange(len(own))
        self.stops = np.zeros(CLASSES, bool)
        self.stops[: len(own)] = ends_word[own]
        for first, wanted in ((OWN, False), (OWN + SHARED // 2, True)):
            rest = order[OWN:][ends_word[order[OWN:]] == wanted]
            mass = np.cumsum(counts[rest] + 0.1)
            self.of[rest] = first + np.minimum(SHARED // 2 - 1, (mass / mass[-1] * (SHARED // 2)).astype(int)) if len(rest) else 0
            self.stops[first : first + SHARED // 2] = wanted
        self.stops[END] = True
        total = np.bincount(self.of, counts + 0.1, CLASSES)
        self.share = np.log10((counts + 0.1) / total[self.of])
        self.counts = np.bincount(self.of, counts, CLASSES)
        self.counts[END] = ends


def trained(tokens: DataFrame, classes: Classes, path: str, rounds: tuple = ROUNDS, bucket: int = BUCKET, least_steps: int = LEAST_STEPS) -> attention.Params:
    """The attention model's parameters after all rounds, which share out all rows of tokenised."""
    p, kind, first = attention.start(classes.counts), id_kind(path), 0
    total, of, stops = int(classes.counts.sum()), classes.of, classes.stops
    for part in rounds:
        buckets = max(1, round(total * part / sum(rounds) / bucket))

        def spelled(batches: Iterator[pa.RecordBatch], first=first, part=part) -> Iterator[pa.RecordBatch]:
            """tie and classes of the documents of the round."""
            for chunk in chunks_of(batches, kind):
                place, own = chunk.tie % sum(rounds), of[chunk.ids]
                docs = np.flatnonzero(chunk.learned & (place >= first) & (place < first + part))
                for a, b in slices(chunk.n[docs].tolist(), 1 << 18):
                    at = chunk.places(docs[a:b])
                    size = chunk.size[at]
                    stops = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(chunk.n[docs[a:b]])))]
                    data = own[ranges(chunk.first[at], size)]
                    texts = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(stops * data.itemsize), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_pydict({"tie": chunk.tie[docs[a:b]], "classes": texts.cast(pa.binary())})

        rows = tokens.mapInArrow(spelled, "tie long, classes binary").select(F.pmod(F.xxhash64("tie"), F.lit(buckets)).alias("bucket"), "tie", "classes")
        rows = rows.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket", "tie")
        first += part

        def local(batches: Iterator[pd.DataFrame], p=p) -> Iterator[pd.DataFrame]:
            total, weight, held, now = 0.0, 0, [], None
            end = np.array([END], np.uint16)

            def learn() -> None:
                nonlocal total, weight
                if held:
                    size = sum(map(len, held))
                    total, weight = total + attention.flat(attention.train(p, held, stops, least_steps)).astype(np.float64) * size, weight + size

            for pdf in batches:
                for number, own in zip(pdf["bucket"], pdf["classes"], strict=True):
                    if number != now:
                        learn()
                        held, now = [], number
                    held.append(np.concatenate((np.frombuffer(own, np.uint16), end)))
            learn()
            if weight:
                cut = np.array_split(total, PARTS)
                yield pd.DataFrame({"part": range(PARTS), "task": TaskContext.get().partitionId(), "weight": float(weight), "values": [c.tobytes() for c in cut]})

        def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, list] = {}
            for pdf in batches:
                for number, weight, values in zip(pdf["part"], pdf["weight"], pdf["values"], strict=True):
                    own = sums.setdefault(number, [0.0, 0.0])
                    own[0], own[1] = own[0] + np.frombuffer(values), own[1] + weight
            yield pd.DataFrame({"part": list(sums), "values": [(v / w).astype("<f4").tobytes() for v, w in sums.values()]})

        each = rows.select("bucket", "classes").mapInPandas(local, "part int, task int, weight double, values binary")
        mean = each.repartition(PARTS, "part").sortWithinPartitions("part", "task").mapInPandas(average, "part int, values binary")
        found = dict(mean.collect())  # PARTS rows, together as large as the model
        if found:
            p = attention.shaped(np.concatenate([np.frombuffer(found[i], "<f4") for i in range(PARTS)]), p)
    return p


def mean_with_share(spelled: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 of the mean of 10**spelled and share."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(spelled * _LN10, np.log(share)) / _LN10 - np.log10(2)


def score(docs: DataFrame, path: str | None = None, params: attention.Params | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    params: of a model trained before; else one is trained here.
    """
    path = path or default_path()
    docs = docs.select("doc_id", whole_text().alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    tokens, ends = settle(tokenised(docs, path)), docs.where(~F.col("held_out")).count()
    words = settle(counted(tokens, path))
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_words += ends
    scale = n_words + 0.1 * (distinct + (ends > 0) + 1)
    classes = Classes(id_counts(tokens, path), ends, word_ids(path).ends())
    top = words.where(F.col("c") * HEAD >= F.lit(int(n_words))).toArrow()  # at most HEAD rows, each with 1/HEAD of all words
    keys = top["hash"].to_numpy()
    head = (keys[order := np.argsort(keys)], top["c"].to_numpy()[order])
    params = params or trained(tokens, classes, path)
    send = docs.sparkSession.sparkContext.broadcast((classes, head, params))
    n_all, kind = max(1, int(n_words)), id_kind(path)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (keys, counts), params = send.value
        for chunk in chunks_of(batches, kind):  # its last word, beyond those of the texts, is the end
            own, size = np.append(classes.of[chunk.ids], np.uint16(END)), np.append(chunk.size, 1)
            first = np.cumsum(size) - size
            so_far = np.concatenate(([0.0], np.cumsum(classes.share[chunk.ids])))
            share = np.append(so_far[first[:-1] + chunk.size] - so_far[first[:-1]], 0)
            spot = np.minimum(np.searchsorted(keys, chunk.hash), max(0, len(keys) - 1))
            count = np.append(np.where(keys[spot] == chunk.hash, counts[spot], np.nan) if len(keys) else np.full(len(chunk.hash), np.nan), ends)
            for a, b in slices(chunk.n.tolist(), 1 << 18):
                n = chunk.n[a:b] + 1
                at = np.insert(chunk.places(np.arange(a, b)).astype(np.int64), np.cumsum(n - 1), len(chunk.size))
                stops = np.cumsum(size[at])
                texts = np.split(own[ranges(first[at], size[at])], stops[np.cumsum(n) - 1][:-1])
                so_far = np.concatenate(([0.0], np.cumsum(attention.log_probabilities(params, texts, classes.stops), dtype=np.float64)))
                spelled = (so_far[stops] - so_far[stops - size[at]]) / _LN10 + share[at]
                rare, begin = np.isnan(count[at]), np.cumsum(n) - n
                known = np.where(rare, 0, count[at])
                told = np.where(rare, 0, mean_with_share(spelled, known / n_all))
                base = np.where(rare, 0, np.log10((known + 0.1) / scale))
                cut = pa.array(np.concatenate(([0], np.cumsum(rare)))[np.append(begin, len(at))], pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": chunk.doc_id.slice(a, b - a), "held_out": chunk.held_out.slice(a, b - a), "n_tokens": n, "n_head": np.add.reduceat((known > 0).astype(np.int64), begin),
                    "head_base": np.add.reduceat(base, begin), "head_score": np.add.reduceat(told, begin),
                    "rare": pa.ListArray.from_arrays(cut, pa.array(chunk.hash[at[rare]])), "spelled": pa.ListArray.from_arrays(cut, pa.array(spelled[rare])),
                })

    rows = tokens.mapInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_head long, head_base double, head_score double, rare array<long>, spelled array<double>")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    count, spelled = F.coalesce("c", F.lit(0)), F.col("spelled")
    share = F.log10(F.col("c") / F.lit(float(n_all)))
    most = F.greatest(spelled, F.coalesce(share, spelled))
    told = most + F.log10((F.pow(F.lit(10.0), spelled - most) + F.coalesce(F.pow(F.lit(10.0), share - most), F.lit(0.0))) / 2)
    rare = (
        rows.select("row", F.explode(F.arrays_zip("rare", "spelled")).alias("x"))
        .select("row", F.col("x.rare").alias("hash"), "x.spelled")
        .join(words, "hash", "left")
        .groupBy("row")
        .agg(F.sum(F.log10((count + 0.1) / F.lit(scale))).alias("rare_base"), F.sum(told).alias("rare_score"), F.count_if(count > 0).alias("n_rare"))
    )
    zero = F.lit(0.0)
    return rows.drop("rare", "spelled").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(int(n_words)).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("head_score") + F.coalesce("rare_score", zero)).alias("score"),
    )


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
