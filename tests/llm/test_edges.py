"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import attention, common, licenses, lm_scoring, mixing, packing, pii, quality_rules, registry, simhash, toxicity, url_filters, winnowing
from tests.oracle import assert_same

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, words array<string>, key long, fp long, row long, score double, spans string, _bucket long, part int, ids binary, hash long"
TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h", "idiot " * 30, "x" * 70_000, "word " * 30_000, "mail a@b.com or +1 (499) 555-6503", "Ünïcödé — ﬁne\x1c\x85\xa0 text", "a\n\nb\na"]


def rows(spark, texts=TEXTS, null_ids=True):
    data = [(None if null_ids and i == 5 else 3 if i == 4 else i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None, 7, ["w"], 1, 2, 3, 0.5, "s", 1, 1, b"i", 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, CLASHING)


def model():
    return toxicity.Model(toxicity.Landmarks(["idiot"]), toxicity.np.array([1.0, 1.0], toxicity.np.float32), -0.02, 90.0, 0.0)


OPERATORS = {
    "pii": pii.find,
    "redacted": pii.redacted,
    "mix": mixing.mix,
    "mixed": mixing.mixed,
    "licenses": licenses.scan,
    "quality": quality_rules.judge,
    "simhash": simhash.near_duplicates,
    "packing": packing.pack,
    "lm": lm_scoring.score,
    "winnowing": winnowing.fingerprints,
    "neighbours": lambda docs: winnowing.with_next(docs, winnowing._Compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"),
    "toxicity": lambda docs: toxicity.score(docs, model()),
}
ONE_ROW_EACH = set(OPERATORS) - {"mixed", "packing"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = rows(spark)
    found = OPERATORS[name](docs).collect()
    if name in ONE_ROW_EACH:
        assert len(found) == len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](rows(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    docs = rows(spark, [None, None])
    found = OPERATORS[name](docs.withColumn("doc_id", F.lit(None).cast("long"))).count()
    assert found == (2 if name in ONE_ROW_EACH or name == "packing" else 0)


def test_urls(spark):
    rules = spark.createDataFrame(list(url_filters.RULES), "verdict string, host string, path string")
    urls = [None, "", "no scheme", "http://", "http://com/en/", "HTTP://A.B.COM/en/x", "http://xcom/en/", "http://a.example.com/en/7?q#f", "http://a.example.com/en/8", "http://de.net/de/8", "http://b.example.net/de/81", "http://x.org#/es/", "http://x.org/es/"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls + urls)], "page_id long, url string, host string, key string")
    found = {r["page_id"]: r for r in url_filters.judge(pages, rules).collect()}
    assert len(found) == 2 * len(urls)
    assert [found[i]["verdict"] for i in range(len(urls))] == ["allow"] * 4 + ["block", "block", "allow", "allow", "block", "allow", "block", "allow", "block"]
    assert found[7]["rule"] == "example.com/en/7" and found[0]["host"] == found[0]["path"] == "" and found[4]["rule"] == "com/en/"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert_same(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_licence_signs_cover_all_sentences():
    import re

    assert all(re.search(licenses.SIGNS, s) for s in licenses.SENTENCES.values())


def brute_mix(rows_):
    """doc_id -> words taken, by one sorted list of all copies."""
    import hashlib

    flows = {}
    for doc_id, text, source in rows_:
        key = hashlib.md5(f"mix:{doc_id}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        flows.setdefault(source, []).append((key, doc_id, len(text.split())))
    copies = []
    for rank, source in enumerate(sorted(flows)):
        total, at, weight = sum(x[2] for x in flows[source]), 0, mixing.WEIGHTS[rank % 3]
        for _, doc_id, size in sorted(flows[source]):
            pieces = [min(mixing.PIECE, size - a) for a in range(0, size, mixing.PIECE)]
            for piece in pieces:
                at += piece
                copies += [((at + e * total) / weight, rank, doc_id, piece) for e in range(3)]
    left, taken = sum(x[2] for f in flows.values() for x in f), dict.fromkeys((r[0] for r in rows_), 0)
    for _, _, doc_id, size in sorted(copies):
        taken[doc_id] += min(size, left)
        left -= min(size, left)
    return taken


def test_mix_is_cut_in_order_of_virtual_finish(spark):
    data = [(i, "w " * (i * 7 % 11 if i % 20 else 700), f"s{i % 4}") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    found = mixing.mix(docs, keep=("source",)).select("doc_id", "kept_source", "target", F.expr("aggregate(copies, 0L, (a, x) -> a + x)").alias("taken"), "size").toPandas()
    assert dict(zip(found["doc_id"], found["taken"], strict=True)) == brute_mix(data)
    taken = found.groupby("kept_source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(taken["taken"] - taken["target"]) <= 2 * mixing.PIECE).all() and (found["taken"] <= 3 * found["size"]).all() and found["taken"].sum() == found["size"].sum()
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(7)).collect()) == sorted(mixing.mix(docs, bucket_rows=10).collect())


def test_mixed_rows_hold_the_words_taken(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c", f"s{i % 2}", "en", 1) for i in range(40)], "doc_id long, text string, source string, lang string, n_chars long")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = mixing.mix(docs).select(F.expr("aggregate(copies, 0L, (a, x) -> a + x)").alias("t")).agg(F.sum("t")).first()[0]
    assert out.select(F.sum(F.size(common.words_of(F.col("text"))))).first()[0] == taken


def brute_fingerprint(text):
    import xxhash

    words = text.translate(str.maketrans(common.UPPER, common.LOWER)).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plain = {r["doc_id"]: brute_fingerprint(r["text"] or "") for r in docs.collect()}
    root = {i: i for i in plain}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(plain)
    for a in ids:
        for b in ids:
            if a < b and (plain[a] ^ plain[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op5_simhash_groups(spark, sf_dir).collect()}
    assert found == {i: (plain[i], top(i)) for i in ids}


def test_representatives_leave_one_row_of_every_class(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey")
    data = [(None, a, "en"), (None, b, "en"), (7, b, "de"), (3, a, "en"), (3, c, "en"), (3, c, "en"), (None, "x y z", "en"), (None, "x y z", "en"), (9, None, "t"), (None, "t", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for rows_ in (docs, docs.repartition(5)):
        found = simhash.representatives(rows_)
        assert found.columns == docs.columns
        assert sorted(map(tuple, found.collect()), key=str) == sorted([(3, a, "en"), (7, b, "de"), (3, c, "en"), (None, "x y z", "en"), (9, None, "t"), (None, "t", None)], key=str)
    assert simhash.representatives(rows(spark)).columns == rows(spark).columns and simhash.representatives(rows(spark, [])).count() == 0


def test_bk_tree_finds_all_within_the_radius():
    import random

    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    distinct = list(dict.fromkeys(values))
    for i, v in enumerate(distinct):
        tree.add(v, i)
    for x in values[:40]:
        assert sorted(tree.near(x, 2)) == [i for i, v in enumerate(distinct) if (v ^ x).bit_count() <= 2]


def test_winnowing_guarantee_and_ties():
    import random

    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.W - 1))
    a, b = ("".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) + shared + "q" * 70 for _ in range(2))
    assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())
    hashes, places = winnowing.winnow("a" * 200)
    assert len(set(hashes.tolist())) == 1 and places.tolist() == list(range(winnowing.W - 1, 200 - winnowing.K + 1))


def test_packing_gives_every_id_once(spark):
    from tokenizers import Tokenizer

    from ledgerloom.llm.tokens import default_path

    t = Tokenizer.from_file(default_path())
    docs = rows(spark, null_ids=False).withColumn("doc_id", F.col("row") + F.monotonically_increasing_id())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = packing.pack(docs).toPandas()
    for doc_id, text in texts.items():
        mine = pieces[pieces.doc_id == doc_id].sort_values("start")
        assert b"".join(mine["ids"]) == packing.np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert mine["start"].tolist() == [0, *mine["length"].cumsum().tolist()[:-1]] and set(mine["doc_tokens"]) == {mine["length"].sum()}
    for _, mine in pieces.groupby("sequence_id"):
        mine = mine.sort_values("offset")
        n = int(mine["length"].sum())
        assert mine["offset"].tolist() == [0, *mine["length"].cumsum().tolist()[:-1]] and n <= packing.LENGTH and n & (n - 1) == 0


def test_packing_with_ids_beyond_two_bytes(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    from ledgerloom.llm.tokens import default_path, id_kind

    model = json.load(open(default_path()))
    model["model"]["vocab"] = {piece: i + 65_536 for piece, i in model["model"]["vocab"].items()}
    model["added_tokens"] = []
    path = str(tmp_path / "wide.json")
    json.dump(model, open(path, "w"))
    assert id_kind(path) == "<u4" and id_kind(default_path()) == "<u2"
    pieces = packing.pack(spark.createDataFrame([(1, "some words, and zebra 12 more")], "doc_id long, text string"), path).toPandas()
    ids = Tokenizer.from_file(path).encode("some words, and zebra 12 more", add_special_tokens=False).ids
    assert b"".join(pieces.sort_values("start")["ids"]) == packing.np.array([*ids, 2], "<u4").tobytes() and max(ids) > 65_535


def test_packing_tells_rows_apart(spark):
    docs = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (None, "d e"), (None, None)], "doc_id long, text string")
    pieces = packing.pack(docs).toPandas()
    sizes = pieces.groupby("document_row").agg(n=("length", "sum"), whole=("doc_tokens", "max"))
    assert len(sizes) == 4 and (sizes.n == sizes.whole).all()


def test_hilbert_curve_visits_neighbours():
    cells = packing.np.array([(a, b) for a in range(8) for b in range(8)])
    path = cells[packing.np.argsort(packing.hilbert_keys(cells, bits=3))]
    assert (abs(path[1:] - path[:-1]).sum(axis=1) == 1).all()


def test_toxicity_finds_disguised_words():
    m = model()
    scores = m.scores(toxicity.Features(m.landmarks)(["you idiot", "an i d i o t", "idiiot", "id-iot!", "id1ot", "plain words here", ""]))
    assert (scores[:5] > 0.5).all() and (scores[5:] < 0.5).all()


def test_toxicity_held_out(spark, sf_dir):
    directory = sf_dir.replace("sf0.001", "sf0.01")
    found = toxicity.op10_toxicity(spark, directory).join(spark.read.parquet(f"{directory}/labels.parquet"), "doc_id").where("held_out")
    assert found.select(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.85


def test_pii_base_against_patterns():
    import random
    import re

    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def brute(text):
        found = []
        for kind, pattern in enumerate(kinds):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[kind]
                if ok:
                    found.append((kind, *m.span()))
        return found

    rng = random.Random(5)
    for alphabet in ("ab12 .@+-()\n", "125.@a-", "0123456789 -+"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(text) == brute(text), text


def test_pii_field_on_new_sentences():
    rng, model_ = pii.random.Random(12345), pii.field()
    right = wrong = missed = 0
    for _ in range(400):
        text, gold = pii.example(rng)
        base, found = pii.all_spans(text, model_)
        found = {(a, b, k) for k, a, b in found} - {(a, b, k) for k, a, b in base}
        gold = {g for g in gold if not any(a < g[1] and g[0] < b for _, a, b in base)}
        right, wrong, missed = right + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_semicrf_sums_over_all_labellings():
    from itertools import combinations
    from math import exp, log

    from ledgerloom.llm.semicrf import SemiCRF

    crf = SemiCRF(2)
    crf.weights = {("x", 0): 0.4, ("x", 1): -0.3, ("y", 1): 0.9}
    crf.steps = [[0.1, -0.2], [0.3, 0.0], [-0.1, 0.2]]
    offered = [(0, 2, ("x",), (0, 1)), (1, 3, ("y",), (1,)), (3, 5, ("x", "y"), (0, 1)), (2, 3, ("y",), (0, 1))]
    arcs = [(a, b, t, f) for a, b, f, ts in offered for t in ts]

    def score(chosen):
        total, state = 0.0, 2
        for _, _, t, f in sorted(chosen):
            total += crf.steps[state][t] + sum(crf.weights.get((x, t), 0.0) for x in f)
            state = t
        return total

    labellings = [c for n in range(4) for c in combinations(arcs, n) if all(x[1] <= y[0] for x, y in zip(sorted(c), sorted(c)[1:]))]
    gold = {(0, 2, 1), (3, 5, 0)}
    value, by_feature, _ = crf.gradient(offered, gold)
    whole = log(sum(exp(score(c)) for c in labellings))
    assert abs(value - (score([a for a in arcs if a[:3] in gold]) - whole)) < 1e-9
    assert [x[:3] for x in sorted(max(labellings, key=score))] == crf.decode(offered)
    mean = sum(exp(score(c) - whole) * sum(t == 1 and "y" in f for _, _, t, f in c) for c in labellings)
    assert abs(by_feature["y", 1] - (0 - mean)) < 1e-6


def test_lm_base_score_and_counts(spark):
    from math import log10

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["A b a", "b c", None, "a a  d", "b", "x y", "a", "c c", "e", "a b", "b a c", ""])], "doc_id long, text string")
    texts = {r["doc_id"]: [*(r["text"] or "").lower().split(), None] for r in docs.collect()}
    train = [w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in ws]
    scale = len(train) + 0.1 * (len(set(train)) + 1)
    for r in lm_scoring.score(docs).collect():
        words = texts[r["doc_id"]]
        assert abs(r["base_score"] - sum(log10((train.count(w) + 0.1) / scale) for w in words)) < 1e-9
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in train for w in words), len(train)) and r["score"] < 0


def test_quality_keeps_plain_and_fails_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "same words here " * 40)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality_rules.judge(docs.unionByName(extra, allowMissingColumns=True)).collect()}
    assert found[10**6]["base_failed"] and not found[10**6]["kept"] and found[10**6]["n_repeat_words"] == 120
    plain = [r for r in found.values() if not r["base_failed"]]
    assert sum(r["kept"] for r in plain) > 0.5 * len(plain)
