"""Winnowing against a plain loop over windows, and the query's columns against Python on every row."""

import hashlib

import numpy as np

from ledgerloom.llm import winnowing
from ledgerloom.llm.winnowing import K, W

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def gram(codes):
    """Polynomial hash of a run of codes, high bits mixed."""
    h = 0
    for c in codes:
        h = (h * BASE + (c + 1) * BASE) & MASK
    return ((h ^ (h >> 29)) * BASE & MASK) >> 32


def naive(text, k=K, w=W):
    """(hash, position) of the least hash of each window, the rightmost of equal ones, each position once."""
    codes = [ord(c) for c in text]
    if not codes:
        return []
    k = min(k, len(codes))
    grams = [gram(codes[i : i + k]) for i in range(len(codes) - k + 1)]
    w, chosen = min(w, len(grams)), []
    for a in range(len(grams) - w + 1):
        window = grams[a : a + w]
        at = a + max(i for i in range(w) if window[i] == min(window))
        if not chosen or chosen[-1][1] != at:
            chosen.append((grams[at], at))
    return chosen


def texts():
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("ab é\n"), n)) for n in (0, 1, 5, K - 1, K, K + 1, K + W - 1, 300, 700)]
    return [*made, "a" * 200, "abc" * 90, "\U0001f600" * 120]


def test_winnow_equals_plain_windows():
    for text in texts():
        hashes, places = winnowing.winnow(text)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == naive(text), repr(text[:40])


def test_query_against_python(spark, tmp_path):
    rows = [(i * 3 if i % 4 else None, t) for i, t in enumerate([*texts(), None, "same text " * 30, "same text " * 30])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = winnowing.op9_winnowing(spark, str(tmp_path)).toPandas()
    known = found[found["doc_id"].notna()].set_index("doc_id")
    ids = sorted((i for i, _ in rows if i is not None), reverse=True)
    text_of = {i: t or "" for i, t in rows if i is not None}
    likeness = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    assert len(found) == len(rows)
    for i, following in zip(ids[:-1], ids[1:], strict=True):  # the last one's next is a row without doc_id
        text, after = text_of[i], text_of[following]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row, sets = known.loc[i], [{h for h, _ in naive(t)} for t in (text, edited, after)]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row["near_edited"] - likeness(sets[0], sets[1])) < 1e-12 and abs(row["near_next"] - likeness(sets[0], sets[2])) < 1e-12
    by_text = found.assign(text=[text_of.get(i, "?") for i in found["doc_id"]])
    assert by_text[by_text.text == "same text " * 30].fingerprint.nunique() == 1
