"""Cases like a situation: nearness of vectors, themes and jurisdiction, weighted over what the situation tells.

A situation (stated query set) meets all cases of a tier once; a case's part of themes and level is known before its vector is
looked at, so a case whose vector couldn't lift it to the least of the ten best seen in its task is dropped there by the
limit on the window. Weights of what a situation leaves out are given up, and the others are scaled to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import questions
from ledgerloom.sources.views import oracle, table

#: Weights of vectors, themes and level, bounds of a strong and a moderate likeness, cases shown.
WEIGHTS, STRONG, MODERATE, SHOWN = (0.6, 0.3, 0.1), 0.55, 0.40, 10


def profile_text(name: Column, themes: Column, holding: Column, claims: Column) -> Column:
    """What a case is about, in one text for its vector; empty parts are left out."""
    parts = F.filter(F.array(name, F.array_join(F.transform(themes, lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", "), holding, F.array_join(claims, " ")), lambda p: p.isNotNull() & (p != ""))
    return F.trim(F.regexp_replace(F.array_join(parts, ". "), r"\s+", " "))


def similar_cases(situations: DataFrame, cases: DataFrame, shown: int = SHOWN) -> DataFrame:
    """situations (query_id, themes, level or null, vector or null) and cases (case_id, themes, level, citing, year, vector or null)
    -> the cases most like each: query_id, case_id, semantic, theme_overlap, same_level, composite, strength, rank.

    Order: composite, then most cited, then newest, then case_id. Vectors of other lengths than the situation's count as
    none; a nearness below zero counts as zero; repeated themes count once.
    """
    asked = situations.select("query_id", F.array_distinct(F.coalesce("themes", F.array().cast("array<string>"))).alias("wanted"), F.col("level").alias("wanted_level"), F.col("vector").alias("q"))
    active, placed = F.size("wanted") > 0, F.col("wanted_level").isNotNull()
    total = WEIGHTS[0] + F.when(active, WEIGHTS[1]).otherwise(0.0) + F.when(placed, WEIGHTS[2]).otherwise(0.0)
    rows = cases.join(asked, F.lit(True))  # a stated query set beside every case: by size sent to all tasks, else in blocks
    dot = F.aggregate(F.zip_with("vector", "q", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    semantic = F.when(F.col("vector").isNotNull() & F.col("q").isNotNull() & (F.size("vector") == F.size("q")), F.greatest(F.lit(0.0), dot)).otherwise(0.0)
    shared = F.when(active, F.size(F.array_intersect("themes", "wanted")) / F.size("wanted")).otherwise(0.0)
    same = F.coalesce(placed & (F.col("level") == F.col("wanted_level")), F.lit(False))
    rows = rows.select("query_id", "case_id", "citing", "year", F.round(semantic, 6).alias("semantic"), F.round(F.coalesce(shared, F.lit(0.0)), 6).alias("theme_overlap"), same.alias("same_level"), total.alias("total"))
    composite = F.round((WEIGHTS[0] * F.col("semantic") + WEIGHTS[1] * F.col("theme_overlap") + WEIGHTS[2] * F.col("same_level").cast("double")) / F.col("total"), 6)
    rows = rows.withColumn("composite", composite)
    order = Window.partitionBy("query_id").orderBy(F.desc("composite"), F.desc("citing"), F.desc("year"), "case_id")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= shown)
    strength = F.when(F.col("composite") >= STRONG, "strong").when(F.col("composite") >= MODERATE, "moderate").otherwise("weak")
    return rows.select("query_id", "case_id", "semantic", "theme_overlap", "same_level", "composite", strength.alias("strength"), "rank")


def _unit(v: str) -> Column:
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return F.transform(v, lambda x: x.cast("double") / norm)


def similar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated situations against all core records; records have a stored vector, but for some, and so have situations."""
    stored = table(spark, sf_dir, "embeddings").select("vec_id", _unit("embedding").alias("vector"))
    record = table(spark, sf_dir, "record").where("tier = 'core'")
    themes = F.array_compact(F.array(F.col("win_type"), F.when(F.col("full_text"), "text"), F.when(F.col("n_chars") > 1000, "long")))
    cases = record.select(F.col("doc_id").alias("case_id"), themes.alias("themes"), "level", (F.col("doc_id") % 17).alias("citing"), "year", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 500).alias("vec_id")).join(stored, "vec_id", "left")
    n = F.col("query_id")
    wanted = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("won"), F.lit("long"))).otherwise(F.array(F.lit("lost"), F.lit("text"), F.lit("none")))
    level = F.when(n % 3 == 0, "appeal").when(n % 3 == 1, "supreme")
    asked = questions(spark, sf_dir).select("query_id", wanted.alias("themes"), level.alias("level"), F.when(n % 5 > 0, n * 13 % 500).alias("vec_id")).join(stored, "vec_id", "left")
    return similar_cases(asked, cases)


QUERIES = {"similar_records": similar_records}
ORACLE_SQL = {
    "similar_records": oracle(
        """WITH vecs AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
        cases AS (SELECT doc_id AS case_id, list_filter([win_type, CASE WHEN full_text THEN 'text' END, CASE WHEN n_chars > 1000 THEN 'long' END], lambda x: x IS NOT NULL) AS themes, level, doc_id % 17 AS citing, year, v FROM record LEFT JOIN vecs ON doc_id % 7 > 0 AND vec_id = doc_id % 500 WHERE tier = 'core'),
        asked AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['won', 'long'] ELSE ['lost', 'text', 'none'] END AS wanted, CASE item_id % 3 WHEN 0 THEN 'appeal' WHEN 1 THEN 'supreme' END AS wl, v AS q FROM benchmark LEFT JOIN vecs ON item_id % 5 > 0 AND vec_id = item_id * 13 % 500),
        pairs AS (SELECT query_id, case_id, citing, year, round(coalesce(greatest(0, list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2]))), 0), 6) AS semantic, round(coalesce(len(list_intersect(themes, wanted)) / CAST(nullif(len(wanted), 0) AS DOUBLE), 0), 6) AS theme_overlap, coalesce(level = wl, false) AS same_level,
        0.6::DOUBLE + CASE WHEN len(wanted) > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN wl IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END AS total FROM cases, asked),
        told AS (SELECT *, round((0.6::DOUBLE * semantic + 0.3::DOUBLE * theme_overlap + 0.1::DOUBLE * CAST(same_level AS INT)) / total, 6) AS composite FROM pairs)
        SELECT query_id, case_id, semantic, theme_overlap, same_level, composite, CASE WHEN composite >= 0.55 THEN 'strong' WHEN composite >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, citing DESC, year DESC, case_id) AS rank FROM told QUALIFY rank <= 10""",
        "record",
    ),
}
