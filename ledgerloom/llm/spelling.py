"""Spelling variants: words at one edit from each other, found by forward and backward minimal acyclic automata.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. The edit lies in one half of a
word, so the other half stands unchanged at the same end of both. A forward automaton holds the words of a shard, a backward
one the words reversed; a lookup walks the exact half through the automaton and completes the rest with one error, in
either direction. Automata are minimal (equal endings share states) and number their words: each edge knows how many
words of its state come before it, so the sum along a path is the word's rank in its shard. What both directions find
is put together once.

Spark's part: runs are taken, altered and counted with built-in functions, combined in each task first. Each word then goes
to two shards, named by its first three and by its last three code points: with six or more code points every half has
three. A shard with over MOST words is split by the whole half: a lookup of length g goes to (g, its half), and a word to
the halves for lengths one less, its own and one more. Tasks read their shards in order, one shard in memory at a time.
Forms follow from one aggregation a word; roots by pointer doubling, whose rounds are few as every step multiplies n by
five or more.

Bounds: shards grow with the distinct words, not with the text; a split shard holds words that share a whole half, so its
size is bounded by the words with that half and the same length up to one.

Defined cases: null text has no words; a null doc_id is written as nothing before the colon; repeated rows count as often
as they stand; ties in n go to the word smallest by code points; a table without words gives an empty result; words of any
length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, documents, groups, settle, whole_text

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
ALTERED = 199
MOST = 20_000
LETTERS = "[A-Za-zÀ-ÿ]"


class Automaton:
    """Minimal acyclic automaton over sorted distinct words; a word's number is its rank among them."""

    def __init__(self, words: list[str]) -> None:
        edges, final, known = [{}], [False], {}
        path: list[tuple[int, str, int]] = []  # (state, letter, next) along the last word, not yet shared

        def share(down_to: int) -> None:
            while len(path) > down_to:
                state, letter, nxt = path.pop()
                shape = (final[nxt], tuple(edges[nxt].items()))
                edges[state][letter] = known.setdefault(shape, nxt)

        last = ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))  # noqa: B905
            share(same)
            state = path[-1][2] if path else 0
            for letter in word[same:]:
                edges.append({})
                final.append(False)
                edges[state][letter] = len(edges) - 1
                path.append((state, letter, len(edges) - 1))
                state = len(edges) - 1
            final[state], last = True, word
        share(0)
        self.final, self.states = final, 1 + len(known)
        size: dict[int, int] = {}
        todo = [0]
        while todo:  # words reachable from a state, children first
            state = todo[-1]
            if waiting := [t for t in edges[state].values() if t not in size]:
                todo += waiting
                continue
            size[todo.pop()] = final[state] + sum(size[t] for t in edges[state].values())
        self.edges: dict[int, dict[str, tuple[int, int]]] = {}
        for state in size:
            before, self.edges[state] = int(final[state]), {}
            for letter, nxt in edges[state].items():  # letters came in sorted order
                self.edges[state][letter] = (nxt, before)
                before += size[nxt]

    def walk(self, text: str, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        edges = self.edges
        for letter in text:
            step = edges[state].get(letter)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin as word's first half and go on as its rest with exactly one error."""
        found: set[int] = set()
        at = self.walk(word[:half])

        def end(rest: str, state: int, number: int) -> None:
            if (last := self.walk(rest, state, number)) and self.final[last[0]]:
                found.add(last[1])

        for i in range(half, len(word) + 1):
            if at is None:
                break
            state, number = at
            here, step = word[i : i + 1], None
            if here:
                end(word[i + 1 :], state, number)  # without this letter
            for letter, (nxt, before) in self.edges[state].items():
                end(word[i:], nxt, number + before)  # one letter more
                if letter != here:
                    if here:
                        end(word[i + 1 :], nxt, number + before)  # another letter
                else:
                    step = nxt, number + before
            at = step
        return found


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: distinct words (altered runs included) of the least length and count."""
    run = F.explode(F.regexp_extract_all(whole_text(), F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), 1))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % ALTERED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def shards(words: DataFrame, most: int = MOST) -> DataFrame:
    """forward, key, asks, held, word, n: each word in the shards where it asks, is held, or both."""
    ends = F.explode(F.array(*[F.struct(F.lit(f).alias("forward"), k.alias("key")) for f, k in ((True, F.substring("word", 1, 3)), (False, F.expr("right(word, 3)")))])).alias("e")
    placed = words.select("word", "n", ends).select("e.forward", "e.key", "word", "n")
    large = placed.groupBy("forward", "key").agg((F.count("*") > most).alias("large"))
    placed = placed.join(large, ["forward", "key"])
    length = F.length("word")

    def half(g):  # the half that a lookup of length g has unchanged, taken from this word
        front = F.floor(g / 2).cast("int")
        return F.when(F.col("forward"), F.substring(F.col("word"), F.lit(1), front)).otherwise(F.reverse(F.substring(F.reverse("word"), F.lit(1), (g - front).cast("int"))))

    one = lambda asks, held, key: F.struct(F.lit(asks).alias("asks"), F.lit(held).alias("held"), key.alias("at"))
    whole = F.array(one(True, True, F.col("key")))
    split = F.array(*[one(d == 0, True, F.concat((length + d).cast("string"), F.lit(":"), half(length + d))) for d in (-1, 0, 1)])
    return placed.select("forward", F.explode(F.when(F.col("large"), split).otherwise(whole)).alias("s"), "word", "n").select("forward", F.col("s.at").alias("key"), "s.asks", "s.held", "word", "n")


def _near_in(forward: bool, shard: pd.DataFrame) -> tuple[list, list, list, list]:
    spelled = [w if forward else w[::-1] for w in shard["word"]]
    order = sorted(range(len(spelled)), key=spelled.__getitem__)
    counts, asks = shard["n"].to_numpy(), shard["asks"].to_numpy()
    words, sizes = [spelled[i] for i in order], [int(counts[i]) for i in order]
    automaton, out = Automaton(words), ([], [], [], [])
    for i, word in enumerate(words):
        if asks[order[i]]:
            half = len(word) // 2
            for j in automaton.near(word, half if forward else len(word) - half):
                for column, value in zip(out, (word if forward else word[::-1], sizes[i], words[j] if forward else words[j][::-1], sizes[j]), strict=True):
                    column.append(value)
    return out


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, near, near_n: every ordered pair of near words, once."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in groups(batches, ["forward", "key"]):
            found = _near_in(bool(shard["forward"].iloc[0]), shard)
            if found[0]:
                yield pd.DataFrame(dict(zip(("word", "n", "near", "near_n"), found, strict=True)))

    placed = shards(words, most).repartition("forward", "key").sortWithinPartitions("forward", "key", "word")
    return placed.mapInPandas(search, "word string, n long, near string, near_n long").repartition("word").distinct()


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = settle(word_counts(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left")
    formed = F.col("best.less") * -1 >= TIMES * F.col("n")
    forms = settle(found.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, -F.col("best.less")).alias("form_n")))
    root = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps followed
        further = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = settle(root.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not root.where("moved").limit(1).count():
            break
        root = root.drop("moved")
    return forms.join(root.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
