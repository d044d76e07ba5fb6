"""Order-dependent folds on one document, page or conversation: layout, greedy matching and packing, embedding, parsing.

A fold that needs one row's text alone runs batch-wise in the row's own partition; only folds over several rows group
them, and those groups are a page's runs or a conversation's turns, which the source bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.views import table

SAME_LINE, DIM = 2.0, 32


def page_lines(runs: DataFrame, same_line: float = SAME_LINE) -> DataFrame:
    """runs (page_id, x, y, width, str) -> (page_id, line, text): runs within ``same_line`` of a line's first run are that
    line's, from left to right, a blank where the gap is over a fifth of a run's height."""

    ordered = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "width", "str")))
    run = lambda r: F.array(F.struct(r["x"].alias("x"), r["width"].alias("width"), r["str"].alias("str")))

    def add(lines, r):
        last = F.element_at(lines, -1)
        joins = (F.size(lines) > 0) & (F.abs(r["down"] - last["down"]) <= same_line)
        grown = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.struct(last["down"].alias("down"), F.concat(last["runs"], run(r)).alias("runs"))))
        return F.when(joins, grown).otherwise(F.concat(lines, F.array(F.struct(r["down"].alias("down"), run(r).alias("runs")))))

    empty = F.array().cast("array<struct<down:double,runs:array<struct<x:double,width:double,str:string>>>>")
    pages = runs.groupBy("page_id").agg(ordered.alias("o")).select("page_id", F.aggregate("o", empty, lambda acc, r: F.when(F.size(acc) == 0, F.array(F.struct(r["down"].alias("down"), run(r).alias("runs")))).otherwise(add(acc, r))).alias("lines"))
    start = F.struct(F.lit("").alias("line"), F.lit(None).cast("double").alias("end"))
    told = lambda rs: F.aggregate(
        F.array_sort(rs), start, lambda acc, r: F.struct(F.concat(acc["line"], F.when(r["x"] - acc["end"] > 2.0, " ").otherwise(""), r["str"]).alias("line"), (r["x"] + r["width"]).alias("end"))
    )["line"]
    rows = pages.select("page_id", F.posexplode("lines").alias("line", "l"))
    return rows.select("page_id", F.col("line").cast("long").alias("line"), told(F.col("l.runs")).alias("text"))


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made of lineitems: a page is an order."""
    runs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 500).cast("double").alias("x"), F.floor(F.col("l_quantity") / 3).cast("double").alias("y"), F.lit(20.0).alias("width"), F.col("l_suppkey").cast("string").alias("str")
    )
    return page_lines(runs)


def greedy_pairs(rows: DataFrame, prefix: int = 40) -> DataFrame:
    """rows (group, side 'gold' or 'found', seq, text) -> pairs matched one to one in order of gold: a gold text takes the
    first free found one that contains its normalised prefix, or is contained so."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        plain = lambda s: "".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()
        sides = {s: [(r.seq, " ".join(plain(r.text))) for r in pdf[pdf["side"] == s].sort_values(["seq", "text"]).itertuples()] for s in ("gold", "found")}
        free, out = list(sides["found"]), []
        for seq, gold in sides["gold"]:
            hit = next((f for f in free if gold and f[1] and (gold[:prefix] in f[1] or f[1][:prefix] in gold)), None)
            if hit:
                free.remove(hit)
                out.append((seq, hit[0]))
        return pd.DataFrame([(pdf["group"].iloc[0], a, b) for a, b in out], columns=["group", "gold", "found"])

    return rows.groupBy("group").applyInPandas(match, "group long, gold long, found long")


def gold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against themselves told again (capitals, other punctuation), later turns first."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), F.lit("gold").alias("side"), F.col("turn").alias("seq"), "text")
    again = turns.select("group", F.lit("found").alias("side"), (-F.col("seq")).alias("seq"), F.upper(F.regexp_replace("text", "[ .,]+", " - ")).alias("text"))
    return greedy_pairs(turns.unionByName(again))


def agreement_clusters(spark: SparkSession, sf_dir: str, least: float = 0.6) -> DataFrame:
    """Turns of a conversation in greedy clusters: a turn joins the first cluster whose first member's words it shares enough."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, out = [], []
        for r in pdf.sort_values(["turn", "text"]).itertuples():
            words = set(r.text.lower().split())
            at = next((i for i, h in enumerate(heads) if (words or h) and len(words & h) / len(words | h) >= least), len(heads))
            if at == len(heads):
                heads.append(words)
            out.append((r.conv_id, r.turn, at))
        return pd.DataFrame(out, columns=["conv_id", "turn", "cluster"])

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(cluster, "conv_id long, turn long, cluster long")


def embedding(text: str, dim: int = DIM) -> np.ndarray:
    """Deterministic hashed embedding: SHA-256 bytes of every word, centred and added up, of unit length."""
    total = np.zeros(dim)
    for word in text.lower().split():
        total += np.frombuffer(hashlib.sha256(word.encode()).digest()[:dim], np.uint8) - 127.5
    return total / (np.linalg.norm(total) or 1.0)


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([embedding(t or "").round(6).tolist() for t in texts])

    return table(spark, sf_dir, "benchmark").select("item_id", embed("text").alias("v"))


def budgeted_input(spark: SparkSession, sf_dir: str, budget: int = 2000, first: int = 2) -> DataFrame:
    """Paragraphs of each text that fit a budget: the first ones, then those with a key word, then the rest; what is too
    big is skipped, and the order of the text is kept."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                parts, left, kept = text.split("\n"), budget, []
                rank = lambda i: (0 if i < first else 1 if "licen" in parts[i].lower() else 2, i)  # noqa: B023, E731
                for i in sorted(range(len(parts)), key=rank):
                    if len(parts[i]) <= left:
                        left -= len(parts[i])
                        kept.append(i)
                out.append((doc_id, len(parts), len(kept), budget - left))
            yield pd.DataFrame(out, columns=["doc_id", "paragraphs", "kept", "chars"])

    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(choose, "doc_id long, paragraphs long, kept long, chars long")


def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object between the first and the last brace of a reply, parsed by a schema; broken ones are counted as such."""
    reply = F.concat(F.lit("Sure: "), F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("props")), F.lit(" done"))
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "k long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(parsed["k"].isNotNull()).alias("parsed"), F.count_if(parsed["k"].isNull()).alias("unparsed"), F.sum(parsed["k"]).alias("total"))


def seeded_draw(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """A seeded draw of n documents of each language, in md5 order."""
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("draw:"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.row_number().over(w).cast("long").alias("place")).where(F.col("place") <= n)


def reading_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a page's units that stand in another order than the reference's: self join within the page."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("place"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.place") > F.col("b.place")))
    return pairs.groupBy(F.col("a.l_orderkey").alias("page")).agg(F.count("*").alias("inversions"))


QUERIES = {f.__name__: f for f in (layout_lines, gold_match, agreement_clusters, hash_embeddings, budgeted_input, json_in_text, seeded_draw, reading_inversions)}
ORACLE_SQL = {
    "json_in_text": """SELECT event_type, count(k) AS parsed, count(*) - count(k) AS unparsed, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY 1""",
    "seeded_draw": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('draw:', doc_id)), doc_id) AS place FROM documents QUALIFY place <= 20",
    "reading_inversions": """WITH u AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS place FROM lineitem GROUP BY 1, 2)
        SELECT a.l_orderkey AS page, count(*) AS inversions FROM u a JOIN u b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.place > b.place GROUP BY 1""",
    "budgeted_input": """WITH RECURSIVE p AS (SELECT doc_id, len(l) AS n, i, length(l[i]) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN i <= 2 THEN 0 WHEN contains(lower(l[i]), 'licen') THEN 1 ELSE 2 END, i) AS r
        FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
        f AS (SELECT doc_id, 0 AS r, 0 AS kept, 0 AS chars FROM (SELECT DISTINCT doc_id FROM p)
        UNION ALL SELECT f.doc_id, p.r, f.kept + (f.chars + p.size <= 2000)::INT, f.chars + CASE WHEN f.chars + p.size <= 2000 THEN p.size ELSE 0 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.r = f.r + 1)
        SELECT f.doc_id, CAST(n AS BIGINT) AS paragraphs, CAST(kept AS BIGINT) AS kept, CAST(chars AS BIGINT) AS chars FROM f JOIN (SELECT doc_id, max(n) AS n FROM p GROUP BY 1) m ON f.doc_id = m.doc_id AND f.r = m.n""",
}
