"""The sweeps against every rule on every url; odd urls and rules."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import url_filters


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("#")[0].split("?")[0]
    host, path = rest.split("/", 1)[0].lower(), "/" + rest.split("/", 1)[1] if "/" in rest else ""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    longest = max((n for n, *_ in fits), default=None)
    best = [f for f in fits if f[0] == longest]
    return (host, path, None, "allow") if not best else (host, path, max(f[1] for f in best), min(v for _, r, v in best if r == max(f[1] for f in best)))


def test_sweeps_equal_all_rules_on_all_urls(spark):
    rng = random.Random(8)
    labels, parts = ["a", "b", "ab", "a-b", "com"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/\U0001f600", "/z/x"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(h, p): (rng.choice(("block", "allow")), h, p) for h, p in ((host(), rng.choice(parts)) for _ in range(60))}.values())
    urls = [f"http://{host()}{rng.choice(parts)}{rng.choice(('', '/x', 'y', '?q', '#f/x'))}" for _ in range(1500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, frame, sweeps=5).collect()}
    for i, url in enumerate(urls):
        expected = brute(url, rules)
        assert found[i][:2] == expected[:2] and found[i][3] == expected[3] and len(found[i][2] or "") == len(expected[2] or ""), (url, found[i], expected)


def test_odd_pages_and_rules(spark):
    rules = spark.createDataFrame([("block", "x.com", "/"), ("allow", "x.com", "/"), ("block", "", "/a"), ("block", "y.org", "")], "verdict string, host string, path string")
    long = "http://a.x.com/" + "p" * 100_000
    pages = spark.createDataFrame([(None, long, 1), (None, None, 2), (3, "http://y.org", 3), (3, "http://y.org", 3), (4, "http:///a", 4)], "page_id long, url string, row long")
    found = url_filters.judge(pages, rules)
    by = {(r["page_id"], r["path"][:2]): r["verdict"] for r in found.collect()}
    assert by == {(None, "/p"): "allow", (None, ""): "allow", (3, ""): "block", (4, "/a"): "allow"} and found.count() == 5
    assert url_filters.judge(pages.where("false"), rules).count() == 0
    assert url_filters.judge(pages, rules.where("false")).where("verdict = 'allow' AND rule IS NULL").count() == 5


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "MOST_RULES", 2)
    rules = spark.range(3).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit("/").alias("path"))
    with pytest.raises(ValueError, match="rules"):
        url_filters.judge(spark.createDataFrame([], "page_id long, url string"), rules)
