"""Spelling variants against brute force in plain Python, the automaton's guarantees, and split shards."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import spelling as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, n long, forward boolean"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def found(spark, docs, **more):
    df = spark.createDataFrame([(i, t, None, "s", 1, "w", "k", 2, True) for i, t in docs], SCHEMA)
    return sorted(map(tuple, S.variants(df, **more).collect()))


@pytest.mark.parametrize("most", [20_000, 3])
def test_equals_brute_force_on_corpus_words(spark, sf_dir, most):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = plain(docs)
    assert found(spark, docs, most=most) == expected
    assert any(x[1] for x in expected) and len(expected) > 200


@pytest.mark.parametrize("most", [20_000, 1])
def test_equals_brute_force_on_dense_words(spark, most):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(300)]
    times = [int(5 ** rng.integers(0, 4)) for _ in words]
    docs = [(i, " ".join([w.upper() if i % 2 else w] * n)) for i, (w, n) in enumerate(zip(words, times, strict=True))]
    expected = plain(docs)
    assert found(spark, docs, most=most) == expected
    assert any(r[1] and r[2] != r[1] for r in expected)  # a chain of forms


def test_defined_cases(spark):
    assert found(spark, []) == []
    docs = [(None, "colour colour colour colour colour"), (1, None), (2, ""), (3, "colours," * 30), (3, "colours," * 30), (4, "x" * 70_000), (5, "×÷" * 3 + " short"), (6, "Straßen " * 7), (7, "colour's " * 9)]
    assert found(spark, docs) == plain(docs)


def test_automaton_is_minimal_and_numbers_its_words():
    words = sorted({a + b + c for a in ("", "pre", "re") for b in ("sort", "form", "port") for c in ("", "s", "ed", "ing")})
    automaton = S.Automaton(words)
    for i, word in enumerate(words):
        state, number = automaton.walk(word)
        assert number == i and automaton.final[state]
    endings = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert automaton.states == len(endings)  # one state for each set of endings
    for word in (*words, "presorts", "resortt", "reort"):
        for half in (2, 3):
            assert {words[j] for j in automaton.near(word, half)} == {v for v in words if one_edit(word, v) and v[:half] == word[:half] and one_edit(word[half:], v[half:])}
