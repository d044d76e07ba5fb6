"""N-gram join against all pairs in plain Python: real texts, planted likeness at the threshold, groups of near copies."""

import numpy as np
import pytest

from ledgerloom.llm import ngram_join as N

SCHEMA = "doc_id long, text string, lang string, source string, node long, n long, key long, root long, part int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


def shingles(text):
    words = [w for w in (text or "").translate(UPPER).translate(BLANKS).split(" ") if w]
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain(docs):
    sets = [shingles(t) for _, t in docs]
    distinct = sorted(set(sets) - {frozenset()}, key=len)
    root = {s: s for s in distinct}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 100 * len(a) < 85 * len(b):
                break
            same = len(a & b)
            if 100 * same >= 85 * (len(a) + len(b) - same):
                root[top(a)] = top(b)
    least = {}
    for (i, _), s in zip(docs, sets, strict=True):
        if s and i is not None:
            least[top(s)] = min(least.get(top(s), i), i)
    return sorted((str(i), len(s), str(least.get(top(s)) if s else i)) for (i, _), s in zip(docs, sets, strict=True))


def found(spark, docs, **more):
    df = spark.createDataFrame([(i, t, None, "s", 1, 2, 3, 4, 5) for i, t in docs], SCHEMA).repartition(5)
    rows = N.near_groups(df, **more).collect()
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows)


def edited(rng, words, changes):
    words = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        words[at] = f"x{rng.integers(1 << 40)}"
    return " ".join(words)


def test_equals_all_pairs_on_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(spark, docs) == plain(docs)


@pytest.mark.parametrize("small", [{}, {"block": 500, "paired": 8}])
def test_planted_likeness_and_chains(spark, small):
    rng, docs = np.random.default_rng(2), []
    common = [f"c{i}" for i in range(40)]
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(int(rng.integers(10, 260)))]
        docs += [(len(docs), " ".join(base))]
        docs += [(len(docs) + k, edited(rng, base, int(rng.integers(0, max(2, len(base) // 20))))) for k in range(14)]  # around the threshold
        docs += [(len(docs), " ".join(base[: int(len(base) * 0.86)])), (len(docs) + 1, " ".join(base[int(len(base) * 0.1) :]))]
        docs += [(len(docs), " ".join(common + base[:30]))]  # a passage that many texts share
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(docs)), (t for _, t in docs), strict=True)]
    expected = plain(docs)
    assert found(spark, docs, **small) == expected
    assert 20 < len({c for _, _, c in expected}) < len(docs) - 60


def test_one_group_of_near_copies_without_its_original(spark):
    """Members of a list whose hub doesn't link with them are paired with one another."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(300)]
    docs = [(i, edited(rng, base, int(rng.integers(4, 9)))) for i in range(120)]
    expected = plain(docs)
    assert found(spark, docs, paired=32) == expected
    assert 1 < len({c for _, _, c in expected}) < 120


def test_defined_cases(spark):
    assert found(spark, []) == []
    long = " ".join(f"w{i % 9000}" for i in range(40_000))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (5, "ONE"), (None, "one"), (None, "two words"), (6, "a b c"), (7, "a b c d"), (8, "a b c d d"), (9, "É b c d"), (10, "é b c d"), (11, long), (12, long + " end"), (13, "x" * 70_000)]
    assert found(spark, docs) == plain(docs)


def test_packed_keys_round_trip():
    for keys in ([], [5], [5, 5, 9], [1, 2**40, 2**47]):
        keys = np.array(keys, np.uint64)
        assert N._unpacked(N._packed(keys)).tolist() == keys.tolist()
