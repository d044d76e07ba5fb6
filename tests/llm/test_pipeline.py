import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_run_end_to_end(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        left.append((name, docs.count()))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert all(count for _, count in left)
    counts = dict(left)
    assert counts["near_copies"] <= counts["toxicity"] and counts["personal_data"] == counts["near_copies"]
    assert sorted(map(tuple, docs.select("doc_id", "start", "length", "doc_tokens").collect()), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "doc_tokens").collect()), key=str)


def test_odd_rows_through_all_stages(spark, sf_dir, tmp_path):
    words = lambda n, k: " ".join(f"{w}{i}" for i in range(n) for w in k)
    docs = [
        (1, words(30, ("ab", "cd")), "en", "a", 1), (None, words(30, ("ef", "gh")), "en", "a", 1), (None, words(30, ("ij", "kl")), None, None, None), (3, words(30, ("mn", "op")), "en", "b", 1),
        (3, words(30, ("qr", "st")), "en", "b", 1), (3, words(30, ("qr", "st")), "en", "b", 1), (9, words(30, ("ab", "cd")), "en", "c", 1), (5, None, "en", "a", 0), (6, "", "en", None, 0), (8, "mail a@b.com now " * 20, "en", "c", 1),
    ]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").select(*schema.names)
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, sf_dir).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        after[name] = rows.collect()
    assert len(after["toxicity"]) == len(docs)
    texts = sorted(r["text"] or "" for r in after["near_copies"])
    assert texts == sorted([*{t for _, t, *_ in docs if t}, ""])  # the null and the empty text are one class
    assert {r["doc_id"] for r in after["near_copies"] if r["text"] == docs[0][1]} == {1}
    assert len(after["personal_data"]) == len(after["near_copies"]) and not any("a@b.com" in (r["text"] or "") for r in after["personal_data"])
    kept = {r["text"] for r in after["personal_data"] if r["text"]}
    assert all(any(t.split()[: len(r["text"].split())] == r["text"].split() for t in kept) for r in after["mixing"])
    sizes = {}
    for r in after["packing"]:
        sizes.setdefault(r["document_row"], []).append(r)
    assert len(sizes) == len(after["mixing"]) and all(sum(p["length"] for p in ps) == ps[0]["doc_tokens"] for ps in sizes.values())


def test_an_empty_table_stays_empty(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
    assert rows.count() == 0
