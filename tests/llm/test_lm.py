"""The attention model against plain loops, finite differences and other layouts; its scores against the base score."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import attention, lm_scoring
from ledgerloom.llm.attention import BLOCK, CLASSES, END, EXPERTS, FLOOR, START, WIDTH

KINDS = 60


def world(seed=0):
    rng = np.random.default_rng(seed)
    stops = np.zeros(CLASSES, bool)
    stops[: KINDS // 2] = stops[END] = True
    counts = np.zeros(CLASSES)
    counts[:KINDS] = rng.integers(1, 50, KINDS)
    counts[END] = 3
    texts = [np.append(rng.integers(0, KINDS, n), END) for n in (0, 1, 37, 90, 5, 200)]
    return rng, stops, attention.start(counts), texts


def naive(p, text, stops):
    """One class at a time, one key at a time."""
    runs, run = [], []
    for c in text:
        run.append(int(c))
        if stops[c]:
            runs.append(run)
            run = []
    assert not run
    inputs = [p["embed"][START]] + [np.mean([p["embed"][c] for c in r], axis=0) for r in runs[:-1]]
    z = [x @ p["inner"] + p["inner_bias"] for x in inputs]
    expert = (1 - FLOOR) * p["expert"] / p["expert"].sum(axis=0) + FLOOR * p["share"][:, None]
    out = []
    for i, run in enumerate(runs):
        seen = range(max(0, (i // BLOCK - 1) * BLOCK), i + 1)
        weights = np.array([np.exp(z[i][:WIDTH] @ z[j][WIDTH : 2 * WIDTH] + p["back"][i - j]) for j in seen])
        attended = sum(w * z[j][2 * WIDTH : 3 * WIDTH] for w, j in zip(weights / weights.sum(), seen, strict=True))
        hidden = np.maximum(attended + z[i][3 * WIDTH :], 0)
        for before, c in zip([START, *run[:-1]], run, strict=True):
            gate = np.exp(hidden @ p["gate"] + p["gate_bias"] + p["before"][before])
            out.append(np.log(gate @ expert[c] / gate.sum()))
    return np.array(out)


def test_batched_masked_attention_equals_one_class_at_a_time():
    _, stops, p, texts = world()
    expected = np.concatenate([naive(p, t, stops) for t in texts])
    for tokens in (16, 64, 4096):
        assert np.allclose(attention.log_probabilities(p, texts, stops, tokens), expected, atol=2e-4)


def test_long_texts_in_pieces_equal_whole_ones():
    rng, stops, p, _ = world(1)
    texts = [np.append(rng.integers(0, KINDS, n), END) for n in (30, 3000, 10, 1500)]
    whole = attention.log_probabilities(p, texts, stops)
    assert len(whole) == sum(map(len, texts))
    for portion in (50, 211, 1000):
        assert np.allclose(attention.log_probabilities(p, texts, stops, portion=portion), whole, atol=1e-4)


def test_probabilities_sum_to_one_and_look_back_only():
    rng, stops, p, _ = world(2)
    text = np.append(rng.integers(0, KINDS, 60), END)
    logs = attention.log_probabilities(p, [text], stops)
    other = text.copy()
    other[40:60] = rng.integers(0, KINDS, 20)
    assert np.allclose(attention.log_probabilities(p, [other], stops)[:40], logs[:40], atol=1e-5)
    total = 0.0
    for c in range(CLASSES):
        other = text[:31].copy()
        other[30] = c
        total += float(np.exp(attention.log_probabilities(p, [other], stops)[30]))
    assert abs(total - 1) < 1e-3


def test_gradients_against_finite_differences():
    rng, stops, p, texts = world(3)
    grid = attention.Grid(texts, stops)
    expert = p["expert"]
    for a, b in ((0, grid.total), (2, grid.total - 1)):
        found, (kinds, counts) = attention.gradients(p, expert, expert.sum(axis=0), grid, a, b)
        classes = attention.Pass(p, expert, expert.sum(axis=0), grid, a, b).classes
        assert np.allclose(np.bincount(kinds, counts.sum(axis=1), CLASSES), np.bincount(classes, minlength=CLASSES), atol=1e-2)
        for name, (rows, g) in found.items():
            way = np.zeros_like(p[name])
            way[slice(None) if rows is None else rows] = np.sign(g)
            loss = []
            for step in (1e-2, -1e-2):
                moved = p | {name: p[name] + np.float32(step) * way}
                loss.append(-attention.Pass(moved, expert, expert.sum(axis=0), grid, a, b).logs.mean(dtype=np.float64))
            slope, expected = (loss[0] - loss[1]) / 2e-2, float((g * way[slice(None) if rows is None else rows]).sum())
            assert abs(slope - expected) < 0.05 * abs(expected) + 1e-4, (name, slope, expected)
    assert EXPERTS == counts.shape[1]


def test_training_learns_what_follows_what():
    rng, stops, p, _ = world(4)
    texts = [np.append(np.concatenate([[a, a + 1] for a in rng.integers(0, 5, 40) * 2]), END) for _ in range(60)]  # each even class is followed by the next
    stops = stops.copy()
    before = attention.log_probabilities(p, texts, stops).mean()
    assert attention.log_probabilities(attention.train(p, texts, stops, 150, tokens=512), texts, stops).mean() > before + 1


def test_every_document_belongs_to_one_round_and_scores_do_not_hang_on_the_layout(spark, sf_dir):
    assert sum(lm_scoring.ROUNDS) == 64
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    found = []
    for rows in (docs.repartition(1), docs.repartition(7)):
        found.append({r["doc_id"]: r["score"] for r in lm_scoring.score(rows).collect()})
    assert found[0].keys() == found[1].keys()
    assert all(abs(found[0][i] - found[1][i]) <= 1e-3 * abs(found[0][i]) for i in found[0])


def test_training_reads_every_document(spark):
    path = lm_scoring.default_path()
    letters = "abcdefghijklmnopqrstuvwxyz"
    ids = {w: np.frombuffer(lm_scoring.word_ids(path).ids_of([w])[0], np.uint32) for w in letters}
    counts = np.zeros(len(lm_scoring.word_ids(path).ends()), np.int64)
    for own in ids.values():
        counts[own] += 3
    classes = lm_scoring.Classes(counts, len(letters), lm_scoring.word_ids(path).ends())
    train = spark.createDataFrame([(i, f"{w} {w} {w}") for i, w in enumerate(ids)], "doc_id long, text string")
    before, after = attention.start(classes.counts), lm_scoring.trained(lm_scoring.tokenised(train, path), classes, path, least_steps=5)
    moved = abs(after["embed"] - before["embed"]).max(axis=1)
    assert [w for w, own in ids.items() if moved[classes.of[own]].max() < 1e-3] == []


def test_held_out_score_is_above_the_base_score(spark, sf_dir):
    found = lm_scoring.op7_attention_lm(spark, sf_dir.replace("sf0.001", "sf0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_mean_with_share_is_the_mean_of_both():
    spelled, share = np.array([-2.0, -400.0, -3.0]), np.array([0.5, 0.25, 0.0])
    assert np.allclose(lm_scoring.mean_with_share(spelled, share), np.log10([(0.01 + 0.5) / 2, 0.125, 0.0005]))


def test_places_and_counts_of_words(spark):
    met = lm_scoring.Places()
    for texts, places, new in (([[b"a", b"b", b"a"], []], [0, 1, 0], [b"a", b"b"]), ([[b"b"], [b"d", b"c", b"a", b"c"]], [1, 2, 3, 0, 3], [b"d", b"c"]), ([[b"c"]], [3], []), ([], [], [])):
        at, words = met.of(texts)
        assert at.tolist() == places and words == new
    docs = spark.createDataFrame([("a B a",), ("",), ("b c",)], "text string").repartition(2)
    found = {r["hash"]: r["c"] for r in lm_scoring.word_counts(docs).collect()}
    assert found == dict(zip(lm_scoring.hashes([b"a", b"b", b"c"]).tolist(), (2, 2, 1), strict=True))


def test_sums_by_key_with_few_and_many_rows():
    rng = np.random.default_rng(7)
    for kinds, n in ((1, 300), (40, 900), (5000, 900), (3, 1)):
        keys, rows = rng.integers(0, min(kinds, CLASSES), n), rng.standard_normal((n, EXPERTS)).astype(np.float32)
        found, sums = attention._summed(keys, rows)
        expected = np.zeros((CLASSES, EXPERTS))
        np.add.at(expected, keys, rows)
        assert found.tolist() == np.unique(keys).tolist() and np.allclose(sums, expected[found], atol=1e-4)


def test_chunks_hold_every_word_of_every_text_and_count_those_learned_from(spark):
    path = lm_scoring.default_path()
    texts = [" A b\x0b\u00c9a. ", "", "b\x85c  b\n", "\t", "a b", "x1\x1cy a"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, i == 4) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").coalesce(1)
    (chunk,) = lm_scoring.chunks_of(lm_scoring.tokenised(docs, path).toArrow().to_batches(), lm_scoring.id_kind(path))
    assert chunk.doc_id.to_pylist() == [0, 1, 2, 3, None, 5] and chunk.n.tolist() == [len(t.encode().split()) for t in texts]
    for i, text in enumerate(texts):
        at = chunk.places(np.array([i]))
        assert chunk.hash[at].tolist() == lm_scoring.hashes(text.encode().lower().split()).tolist()
        ids = lm_scoring.word_ids(path).encode(text.encode().lower().decode(), add_special_tokens=False).ids if i != 5 else None
        assert ids is None or chunk.ids[lm_scoring.ranges(chunk.first[at], chunk.size[at])].tolist() == ids
    counts = dict(zip(chunk.hash.tolist(), chunk.counts().tolist(), strict=True))
    assert [counts[h] for h in lm_scoring.hashes([b"a", b"b", b"\xc3\x89a."]).tolist()] == [2, 2, 1]


def test_classes_by_depth_in_their_runs():
    starts, lengths = np.array([0, 2, 3, 9]), np.array([2, 1, 6, 1])
    depths = attention.Depths(starts, lengths)
    rows = np.arange(10, dtype=np.float32)[:, None]
    assert sorted(depths.places.tolist()) == list(range(10))
    assert dict(zip(depths.order.tolist(), depths.sums(rows[depths.places])[:, 0].tolist(), strict=True)) == {0: 1, 1: 2, 2: 33, 3: 9}
    assert (starts[depths.order][depths.runs()] <= depths.places).all()


def test_ranks_of_pairs_are_those_of_the_merge_table():
    merges = lm_scoring.word_ids(lm_scoring.default_path()).merges
    held = merges.keys[merges.keys >= 0]
    a, b = held >> 32, held & 0xFFFFFFFF
    assert sorted(merges._ranks(a, b).tolist()) == list(range(merges.never)) == list(range(len(held)))
    assert set(merges._ranks(a, b + (1 << 20)).tolist()) == {merges.never}
