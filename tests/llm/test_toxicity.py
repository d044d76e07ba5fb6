"""The subsequence kernel against plain enumeration; fitting on other layouts and on odd labels."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity
from ledgerloom.llm.toxicity import DECAY, LONGEST, POWER, SPAN


def features(word):
    """Every subsequence of three characters (the start is one), by what a gap costs."""
    out, chars = {}, "^" + word
    for at in combinations(range(len(chars)), 3):
        if at[2] - at[0] < SPAN:
            key = tuple(chars[i] for i in at)
            out[key] = out.get(key, 0.0) + DECAY ** (at[2] - at[0] - 2)
    return out


def kernel(a, b):
    x, y = features(a), features(b)
    norm = lambda f: sum(v * v for v in f.values()) ** 0.5
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / (norm(x) * norm(y))


def test_kernel_equals_enumeration():
    landmarks = ["idiot", "stupid", "worthless"]
    words = [w for w in "idiot idi0t idiiot id-iot ixdiot stupid stuupid stpid worthless worthlss hello the idea dot stupidity".split() if len(w) < LONGEST]
    close = toxicity.Landmarks(landmarks).close(words)
    for word, plain in zip(words, toxicity.fold(words), strict=True):
        expected = np.array([kernel(plain, m) for m in landmarks])
        if word in close:
            assert np.allclose(close[word], expected**POWER, atol=1e-5), word
        else:
            assert expected.max() < toxicity.CLOSE + 1e-6, word
    assert {"idiot", "idi0t", "idiiot", "stuupid", "worthlss"} <= set(close) and "hello" not in close
    matrix = toxicity.Landmarks(landmarks).matrix()
    assert np.allclose(matrix, [[kernel(a, b) ** POWER for b in landmarks] for a in landmarks], atol=1e-5)


def test_documents_pool_their_words():
    make = toxicity.Features(toxicity.Landmarks(["idiot", "stupid"]))
    one, two, none = make(["you idiot", "idiot stupid idiot", "plain words"])
    assert abs(one[0] - 1) < 1e-5 and abs(two[2] - np.log1p(2)) < 1e-4 and abs(two[1] - 1) < 1e-5 and not none.any()


def labelled(spark, n=120):
    rows = [(i, f"word{i % 7} some text {'idiot fool' if i % 3 == 0 else 'plain good'} more {i}", int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_fit_does_not_hang_on_the_layout(spark):
    docs = labelled(spark)
    found = []
    for rows in (docs.repartition(1), docs.repartition(5)):
        model = toxicity.train(rows, rows.select("doc_id", "toxic"))
        found.append({r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()})
    assert all(abs(found[0][i] - found[1][i]) < 1e-6 for i in found[0])
    truth = {r["doc_id"]: r["toxic"] for r in docs.collect()}
    assert all((found[0][i] >= 0.5) == bool(truth[i]) for i in truth)


def test_odd_labels(spark):
    docs = labelled(spark)
    odd = spark.createDataFrame([(None, 1), (3, None), (1, 0), (1, 1)], "doc_id long, toxic int")
    both = docs.select("doc_id", "toxic").unionByName(odd)
    assert toxicity.score(docs, toxicity.train(docs, both)).where("score IS NULL").count() == 0
    for labels, expected in ((docs.where("toxic = 0"), 0.0), (docs.where("toxic = 1"), 1.0), (docs.where("false"), 0.0)):
        found = toxicity.score(docs, toxicity.train(docs, labels.select("doc_id", "toxic"))).agg(F.min("score"), F.max("score")).first()
        assert abs(found[0] - expected) < 1e-6 and abs(found[1] - expected) < 1e-6
