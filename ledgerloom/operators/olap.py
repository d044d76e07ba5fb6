"""Exploring a denormalised fact table: shares, crosstabs, hierarchies, edges and drill-downs.

Facts are commitments beside their organisation's size and their latest observation (hash joins); each operator is one
aggregation, and windows run over aggregated keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import mapped, ratio
from ledgerloom.sources.views import oracle, table

#: Status of an observation as shown in facts, and as percent done.
SHOWN = {"not_started": "committed", "on_track": "in_progress", "delayed": "in_progress", "met": "reported", "missed": "stalled"}
DONE = {"not_started": "0", "on_track": "50", "delayed": "25", "met": "100", "missed": "0"}


def latest(observations: DataFrame) -> DataFrame:
    """Count, latest status and percent of each commitment's observations (ties: highest event_id)."""
    last = F.max_by("status", F.struct("observed_at", "event_id"))
    out = observations.groupBy("commit_id").agg(F.count("*").alias("observations"), last.alias("status"))
    return out.withColumn("pct", mapped(F.col("status"), DONE, "0").cast("long"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = latest(table(spark, sf_dir, "observation")).select("commit_id", F.col("status").alias("seen"), "pct")
    rows = table(spark, sf_dir, "commitment").join(rolled, F.col("id") == F.col("commit_id"), "left")
    state = mapped(F.coalesce("seen", F.lit("not_started")), SHOWN, "committed")
    return rows.select("id", "org_name", "org_size", "sector", "region", "type", state.alias("status"), "unit", "target_value", F.coalesce("pct", F.lit(0)).alias("pct"), "target_year")


def measure(kind: str) -> Column:
    """count, currency (sum of targets in currency) or avgProgress, as double."""
    return {"count": F.count("*").cast("double"), "currency": F.coalesce(F.sum(F.when(F.col("unit") == "currency", F.col("target_value"))), F.lit(0)).cast("double"), "avgProgress": F.avg("pct")}[kind]


def share_of_total(rows: DataFrame, dim: str, kind: str) -> DataFrame:
    out = rows.groupBy(F.col(dim).alias("key")).agg(measure(kind).alias("value"))
    return out.withColumn("share", F.round(ratio(F.col("value"), F.sum("value").over(Window.partitionBy())), 9)).withColumn("value", F.round("value", 6))


def facts_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("target_value", F.col("target_value").cast("double"))


def facts_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted facts replace seeded ones of the same id (last wins), as one aggregation."""
    rows = facts(spark, sf_dir).select("id", "status")
    both = rows.withColumn("priority", F.lit(0)).unionByName(rows.where("id % 3 = 0").select("id", F.lit("extracted").alias("status"), F.lit(1).alias("priority")))
    return both.groupBy("id").agg(F.max_by("status", "priority").alias("status"))


def aggregate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_of_total(facts(spark, sf_dir), "sector", "count")


def measure_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_of_total(facts(spark, sf_dir), "region", "currency")


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = facts(spark, sf_dir).groupBy("sector", "status").agg(measure("count").alias("value"))
    return cells.withColumn("most", F.max("value").over(Window.partitionBy()))


def treemap_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).rollup("sector", "type").agg(F.grouping_id().cast("long").alias("level"), measure("count").alias("value"))


def cube_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).cube("org_size", "status").agg(F.grouping_id().cast("long").alias("level"), measure("currency").alias("value"))


def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("region", "type").agg(measure("currency").alias("weight")).where("weight > 0")


def drilldown(spark: SparkSession, sf_dir: str, stack: tuple = (("sector", "building"), ("type", "training"), ("sector", "building"))) -> DataFrame:
    """The stack's distinct equalities, all at once."""
    rows = facts(spark, sf_dir)
    for dim, key in dict.fromkeys(stack):
        rows = rows.where(F.col(dim) == key)
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def active_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions with two or more values, in one aggregation."""
    dims = ("sector", "org_size", "region", "type", "status", "unit")
    counts = facts(spark, sf_dir).agg(*[F.countDistinct(d).alias(d) for d in dims])
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("n")) for d in dims])
    return counts.select(F.inline(pairs)).where("n >= 2")


def color_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("region").distinct().select("region", (F.dense_rank().over(Window.orderBy("region")) - 1).cast("long").alias("color"))


def latest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "observation"))


_LATEST = """SELECT commit_id, count(*) AS observations, max_by(status, (observed_at, event_id)) AS status FROM observation GROUP BY 1"""
_PCT = "CAST(CASE s WHEN 'on_track' THEN 50 WHEN 'delayed' THEN 25 WHEN 'met' THEN 100 ELSE 0 END AS BIGINT)"
_FACTS = f"""WITH latest AS ({_LATEST}), facts AS (
SELECT id, org_name, org_size, sector, region, type, CASE coalesce(s, 'not_started') WHEN 'not_started' THEN 'committed' WHEN 'on_track' THEN 'in_progress' WHEN 'delayed' THEN 'in_progress' WHEN 'met' THEN 'reported' ELSE 'stalled' END AS status,
unit, target_value, coalesce({_PCT}, 0) AS pct, target_year FROM commitment LEFT JOIN (SELECT commit_id, status AS s FROM latest) ON id = commit_id) """
_CURRENCY = "CAST(coalesce(sum(target_value) FILTER (unit = 'currency'), 0) AS DOUBLE)"
QUERIES = {f.__name__: f for f in (facts_build, facts_union_dedupe, aggregate_share, measure_currency, crosstab, treemap_rollup, cube_currency, bipartite_edges, drilldown, active_dimensions, color_ordinal, latest_rollup)}
ORACLE_SQL = {name: oracle(_FACTS + sql, "commitment", "observation") for name, sql in {
    "facts_build": "SELECT * REPLACE (CAST(target_value AS DOUBLE) AS target_value) FROM facts",
    "facts_union_dedupe": "SELECT id, CASE WHEN id % 3 = 0 THEN 'extracted' ELSE status END AS status FROM facts",
    "aggregate_share": "SELECT sector AS key, CAST(count(*) AS DOUBLE) AS value, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM facts GROUP BY 1",
    "measure_currency": f"SELECT region AS key, round({_CURRENCY}, 6) AS value, round({_CURRENCY} / sum({_CURRENCY}) OVER (), 9) AS share FROM facts GROUP BY 1",
    "crosstab": "SELECT sector, status, CAST(count(*) AS DOUBLE) AS value, CAST(max(count(*)) OVER () AS DOUBLE) AS most FROM facts GROUP BY 1, 2",
    "treemap_rollup": "SELECT sector, type, grouping(sector, type) AS level, CAST(count(*) AS DOUBLE) AS value FROM facts GROUP BY ROLLUP (sector, type)",
    "cube_currency": f"SELECT org_size, status, grouping(org_size, status) AS level, {_CURRENCY} AS value FROM facts GROUP BY CUBE (org_size, status)",
    "bipartite_edges": f"SELECT region, type, {_CURRENCY} AS weight FROM facts GROUP BY 1, 2 HAVING weight > 0",
    "drilldown": "SELECT status, count(*) AS n FROM facts WHERE sector = 'building' AND type = 'training' GROUP BY 1",
    "active_dimensions": " UNION ALL ".join(f"SELECT '{d}' AS dim, count(DISTINCT {d}) AS n FROM facts HAVING count(DISTINCT {d}) >= 2" for d in ("sector", "org_size", "region", "type", "status", "unit")),
    "color_ordinal": "SELECT region, row_number() OVER (ORDER BY region) - 1 AS color FROM (SELECT DISTINCT region FROM facts)",
    "latest_rollup": f"SELECT commit_id, observations, status, {_PCT.replace('CASE s', 'CASE status')} AS pct FROM latest",
}.items()}
