"""Toxicity by a subsequence string kernel and a linear SVM over Nystroem landmarks.

The kernel compares two words by their common character subsequences of length 3 (gaps allowed, each skipped character
costs a factor ``DECAY``, a span is at most ``SPAN`` characters; the start of a word counts as a character), normalised
to 1 for equal words. An insult with characters left out, changed or put in therefore stays close to the plain one;
signs inside a word are dropped first, accents taken off, digits read as the letters they stand for, and letters spelled
out one by one joined; letters of other scripts share five codes. Landmarks are words that tell toxic from clean
documents in the labelled sample. A document's kernel value to a landmark is the best of its words' (words that come
within ``CLOSE`` of no landmark count as far from all); the values are mapped by the inverse root of the landmarks'
kernel matrix (Nystroem), and a linear SVM in that space with a Platt sigmoid gives the score. In training a toxic
document stands a second time, disguised; the disguise is drawn by its doc_id, so batches have no say in it.

Spark's part: labels are sampled by the hash of doc_id up to ``MAX_TOXIC`` and ``MAX_CLEAN`` rows (documented bounds of
the fit), which alone are joined to documents; landmark statistics are an aggregation over the sample's words; the
model (some hundred kB) goes to the tasks with the function. Scoring is one projection in Arrow batches, no shuffle.

Defined cases: null text is empty; an empty text is scored like any other (no word is close to a landmark); labels with
null or repeated doc_id: nulls are left out, of repeated ones the highest toxic counts; without both classes among the
labels every score is the share of toxic labels (0 without labels); repeated rows get a row each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, given_back, settle, whole_text

MAX_TOXIC, MAX_CLEAN = 2000, 3000
LANDMARKS = 96
SPAN, DECAY = 7, 0.5
CLOSE = 0.5
POWER = 8
LONGEST = 16
CACHE = 1 << 17
_LEET = str.maketrans("01345789", "oieastbg") | {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o"}
_LEET |= {c: plain for c in range(0xE0, 0x250) if (plain := unicodedata.normalize("NFD", chr(c))[0]) in "abcdefghijklmnopqrstuvwxyz"}
_SIGNS = re.compile(r"[^\w\n]+|_+")
_RUNS = re.compile(r"([^\n])\1{2,}")


def fold(words: list[str]) -> list[str]:
    """Each word (without line ends) in lower case, no signs or accents, digits as letters, runs of three and more letters as one."""
    return _RUNS.sub(r"\1", _SIGNS.sub("", "\n".join(words).lower().translate(_LEET))).split("\n") if words else []


def words_of(text: str) -> list[str]:
    """Words of a text; runs of three and more single characters also as one word."""
    words = text.split()
    lengths, at = list(map(len, words)), 0
    while 1 in lengths[at : at + 4096] or at + 4096 < len(lengths):
        try:
            at = stop = lengths.index(1, at)
        except ValueError:
            break
        while stop < len(lengths) and lengths[stop] == 1:
            stop += 1
        if stop - at > 2:
            words.append("".join(words[at:stop]))
        at = stop
    return words


def codes_of(words: list[str]) -> np.ndarray:
    """Folded words of one length as rows of codes below 32, the start being 0."""
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)
    return np.pad(np.where((c >= 97) & (c <= 122), c - 96, 27 + c % 5), ((0, 0), (1, 0)))


def windows_of(codes: np.ndarray) -> list[np.ndarray]:
    """A long word's codes as overlapping windows, a word of up to LONGEST codes as one."""
    n = codes.shape[1]
    return [codes] if n <= LONGEST else [codes[:, a : a + LONGEST] for a in range(0, n - LONGEST // 2, LONGEST // 2)]


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index triples of a word of n codes within the span, and their weights."""
    found = [(i, j, k) for i, j, k in combinations(range(n), 3) if k - i < SPAN]
    at = np.array(found, np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2], (DECAY ** (at[:, 2] - at[:, 0] - 2)).astype(np.float32)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of words of one length, a row each."""
    i, j, k, w = triples(codes.shape[1])
    return (codes[:, i] * 32 + codes[:, j]) * 32 + codes[:, k], w


def embedding(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and unit-length weights of one word."""
    f, w = subsequences(codes[None, :])
    u, at = np.unique(f[0], return_inverse=True)
    v = np.bincount(at, w, len(u))
    return u, (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


@dataclass
class Landmarks:
    """Words with the kernel values of any other word to them."""

    words: list[str]
    table: np.ndarray = field(init=False, repr=False)  # feature x landmark
    most: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.table = np.zeros((32**3, max(1, len(self.words))), np.float32)
        for m, word in enumerate(self.words):
            u, v = embedding(windows_of(codes_of([word]))[0][0])
            self.table[u, m] = v
        self.most = self.table.max(axis=1)

    def matrix(self) -> np.ndarray:
        return (self.table.T @ self.table) ** POWER

    def close(self, words: list[str]) -> dict[str, np.ndarray]:
        """Kernel values of those words that come within CLOSE of any landmark (others are left out)."""
        by_length: dict[int, tuple[list, list]] = {}
        for word, plain in zip(words, fold(words), strict=True):
            if len(plain) > 2:
                own = by_length.setdefault(len(plain), ([], []))
                own[0].append(word)
                own[1].append(plain)
        found: dict[str, np.ndarray] = {}
        for own, plain in by_length.values():
            step = max(1, 40_000 // len(plain[0]))
            for a in range(0, len(own), step):
                for codes in windows_of(codes_of(plain[a : a + step])):
                    if codes.shape[1] > 2:
                        self._close(own[a : a + step], codes, found)
        return found

    def _close(self, words: list[str], codes: np.ndarray, found: dict[str, np.ndarray]) -> None:
        f, w = subsequences(codes)
        # an upper bound of every kernel value: the largest landmark weight of each feature, the least norm
        may = np.flatnonzero((self.most[f] * w).sum(axis=1) >= CLOSE * np.linalg.norm(w))
        for b in range(0, len(may), 64):
            at = may[b : b + 64]
            same = f[at][:, :, None] == f[at][:, None, :]  # a feature found twice adds up before the norm is taken
            norms = np.sqrt(np.einsum("rij,i,j->r", same, w, w))
            kernel = np.einsum("rij,i->rj", self.table[f[at]], w) / norms[:, None]
            for r in np.flatnonzero(kernel.max(axis=1) >= CLOSE):
                word, k = words[at[r]], kernel[r] ** POWER
                found[word] = np.maximum(found[word], k) if word in found else k


@lru_cache(maxsize=2)
def _landmarks(words: tuple[str, ...]) -> Landmarks:
    return Landmarks(list(words))


class Features:
    """Features of texts; remembers the words it has met (up to CACHE of them)."""

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks, self.seen, self.hits, self.hot = landmarks, set(), {}, set()

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen, self.hits, self.hot = set(), {}, set()
        split, m = [words_of(t) for t in texts], max(1, len(self.landmarks.words))
        each = [set(words) for words in split]
        new = list(set().union(*each).difference(self.seen))
        self.seen.update(new)
        hits = self.landmarks.close(new)
        self.hits.update(hits)
        self.hot.update(hits)
        out = np.zeros((len(texts), 2 * m), np.float32)
        for row, words, own in zip(out, split, each, strict=True):
            if near := own.intersection(self.hot):
                k = np.stack([self.hits[w] for w in words if w in near])
                row[:m], row[m:] = k.max(axis=0), np.log1p(k.sum(axis=0))
        return out


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (features @ self.weights + self.bias) + self.shift, -40, 40)))


def disguise(text: str, landmarks: set[str], rng: np.random.Generator) -> str:
    """The text with its landmark words gapped: a letter put in, doubled, or a sign between letters."""

    def change(word: str) -> str:
        at, way = int(rng.integers(1, len(word))), int(rng.integers(3))
        return word[:at] + (word[at - 1] if way == 0 else "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] if way == 1 else "-") + word[at:]

    words = text.split()
    return " ".join(change(word) if plain in landmarks else word for word, plain in zip(words, fold(words), strict=True))


def fit(x: np.ndarray, y: np.ndarray, share: float, kernel: np.ndarray, rounds: int = 1500, ridge: float = 1e-3) -> tuple[np.ndarray, float, float, float]:
    """Linear SVM (squared hinge, accelerated gradient steps) in the Nystroem coordinates, then a Platt sigmoid.

    share: of toxic rows among all labels, which the sample need not keep.
    """
    val, vec = np.linalg.eigh(kernel + 1e-3 * np.eye(len(kernel)))
    root = (vec / np.sqrt(np.maximum(val, 1e-3))) @ vec.T
    turn = np.kron(np.eye(x.shape[1] // len(kernel)), root)
    z, sign = x @ turn, np.where(y > 0, 1.0, -1.0)
    mean_toxic = y.mean()
    cost = np.where(y > 0, share / mean_toxic, (1 - share) / (1 - mean_toxic)) / len(y)
    z1 = np.hstack([z, np.ones((len(z), 1))])
    penalty = np.r_[np.full(z.shape[1], ridge), 0.0]
    step = 1 / (2 * np.linalg.norm(z1 * np.sqrt(cost)[:, None], 2) ** 2 + ridge)
    w = v = np.zeros(z1.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - sign * (z1 @ v))
        new = v - step * (-2 * z1.T @ (cost * sign * slack) + penalty * v)
        w, v = new, new + t / (t + 3) * (new - w)
    margin = z1 @ w
    a, b = 2.0, 0.0
    for _ in range(100):  # Newton steps for the sigmoid
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = cost * (p - y), cost * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin + 1e-4 * a, g.sum()])
        hess = np.array([[h @ margin**2 + 1e-4, h @ margin], [h @ margin, h.sum() + 1e-9]])
        d = np.linalg.solve(hess, grad)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return turn @ w[:-1], float(w[-1]), float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, n_landmarks: int = LANDMARKS) -> Model:
    """labels (doc_id, toxic): fit on the max_toxic and max_clean labelled documents of least md5(doc_id)."""
    clean = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in clean.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model(Landmarks([]), np.zeros(2, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    least = lambda toxic, n: clean.where(f"(toxic > 0) = {toxic}").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n)
    chosen = least("true", max_toxic).unionByName(least("false", max_clean)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = settle(docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id"))

    @F.pandas_udf("array<string>")
    def folded(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({f for f in fold(words_of(t)) if 4 <= len(f) < LONGEST}) for t in texts])

    seen = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model(Landmarks([]), np.zeros(2, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    per_word = rows.dropDuplicates(["text", "toxic"]).select("toxic", F.explode(folded("text")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("ct"), F.sum(1 - F.col("toxic")).alias("cc")).where("ct >= 3")
    odds = F.log((F.col("ct") + 0.5) / (seen[1] + 1) / ((F.col("cc") + 0.5) / (seen[0] + 1)))
    ranked = per_word.withColumn("gain", F.round(F.col("ct") * odds, 6)).where("gain > 0").orderBy(F.desc("gain"), "word").limit(n_landmarks).collect()
    landmarks = Landmarks([r["word"] for r in ranked])
    lexicon = set(landmarks.words)

    @F.pandas_udf("array<array<float>>")
    def features(ids: pd.Series, texts: pd.Series, toxic: pd.Series) -> pd.Series:
        make = Features(landmarks)
        plain = make(texts.tolist())
        gapped = make([disguise(t, lexicon, np.random.default_rng([7, i % 2**63])) if y else "" for i, t, y in zip(ids, texts, toxic, strict=True)])
        return pd.Series([[p.tolist(), g.tolist()] if y else [p.tolist()] for p, g, y in zip(plain, gapped, toxic, strict=True)])

    table = rows.select("doc_id", "toxic", F.posexplode(features("doc_id", "text", "toxic")).alias("form", "x")).orderBy("doc_id", "form", "x").toPandas()  # a row a sampled document: bounded
    x, y = np.array(table["x"].tolist(), np.float64), table["toxic"].to_numpy(np.float64)
    weights, bias, slope, shift = fit(x, y, share, landmarks.matrix().astype(np.float64))
    return Model(landmarks, weights.astype(np.float32), bias, slope, shift)


def score(docs: DataFrame, model: Model, keep: tuple = ("doc_id",)) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 from a score of 0.5)."""
    words, rest = model.landmarks.words, (model.weights, model.bias, model.slope, model.shift)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = _landmarks(tuple(words))  # built in the worker from the words alone
        own, make = Model(tables, *rest), Features(tables)
        for texts in batches:
            yield pd.Series(np.concatenate([own.scores(make(texts.iloc[a : a + 500].tolist())) for a in range(0, len(texts), 500)]) if len(texts) else [], dtype="float64")

    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return given_back(scores(batches))

    scored = F.pandas_udf(toxic, "double")
    return docs.select(*keep, scored(whole_text()).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Fit on the labels whose crc32(doc_id as text) mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, train_on(spark, docs, sf_dir)).select("doc_id", held.alias("held_out"), "score", "predicted")
