"""Economic-flow ledger: coverage, index rollups, integrity checks and supplier records.

Every rollup is one grouped aggregation with a partial sum in each task; suppliers' tiers come by an equi join that
Spark broadcasts when the supplier table is small by its statistics, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import percent
from ledgerloom.sources.views import oracle, table


def live() -> Column:
    return ~F.col("withdrawn")


def totals(lines: DataFrame, *keys: str) -> DataFrame:
    """reported, confirmed, pct and counts by keys (or over all)."""
    out = lines.groupBy(*keys).agg(
        F.sum("reported").cast("double").alias("reported"),
        F.sum("confirmed").cast("double").alias("confirmed"),
        F.count_if(live()).alias("lines"),
        F.count_if(live() & (F.col("status") == "disputed")).alias("disputed"),
    )
    return out.withColumn("pct", percent(F.col("confirmed"), F.col("reported")))


def index_by_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(table(spark, sf_dir, "counted"), "flow_type")


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(table(spark, sf_dir, "counted"))


def index_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = table(spark, sf_dir, "party").select("supplier_id", "tier")
    lines = table(spark, sf_dir, "counted").join(tiers, "supplier_id", "left")
    return totals(lines.withColumn("tier", F.coalesce("tier", F.lit("self_declared"))), "tier")


def index_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.explode(F.array_compact(F.array("tag_a", "tag_b")))
    return totals(table(spark, sf_dir, "counted").withColumn("tag", tags), "tag")


def coverage_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per company: both flows, zero where there is none, and the total (one pass, no pivot join)."""
    flow = lambda name, c: F.coalesce(F.sum(F.when(F.col("flow_type") == name, F.col(c))), F.lit(0)).cast("double").alias(f"{name}_{c}")
    out = table(spark, sf_dir, "counted").groupBy("company_id").agg(
        *[flow(f, c) for f in ("procurement", "capital") for c in ("reported", "confirmed")], F.sum("reported").cast("double").alias("reported"), F.sum("confirmed").cast("double").alias("confirmed")
    )
    return out.withColumn("pct", percent(F.col("confirmed"), F.col("reported")))


def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals at every level of (flow, period) by ROLLUP; level tells the grand total from a null key."""
    return table(spark, sf_dir, "counted").rollup("flow_type", "period").agg(
        F.grouping_id().cast("long").alias("level"), F.sum("reported").cast("double").alias("reported"), F.sum("confirmed").cast("double").alias("confirmed")
    )


def integrity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "counted").groupBy("supplier_id").agg(F.sum("reported").alias("reported"), F.sum("confirmed").alias("confirmed"))
    rows = table(spark, sf_dir, "party").select("supplier_id", "tier").join(sums, "supplier_id", "left").fillna(0, ["reported", "confirmed"])
    certified = F.col("tier") != "self_declared"
    return rows.agg(
        F.count_if(certified & (F.col("reported") > 0) & (F.col("confirmed") == 0)).alias("certified_no_activity"),
        F.count_if(~certified & (F.col("confirmed") > 0)).alias("self_declared_active"),
    )


def supplier_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "counted").groupBy("supplier_id").agg(
        F.sum("confirmed").cast("double").alias("confirmed"), F.count_if(live() & (F.col("status") == "pending")).alias("pending"), F.count_if(live() & (F.col("status") == "disputed")).alias("disputed")
    )


def supplier_showcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "party").where("profile_public").select("supplier_id", "supplier_name")
    lines = table(spark, sf_dir, "counted").where("confirmed > 0")
    sums = lines.groupBy("supplier_id").agg(
        F.sum("confirmed").cast("double").alias("confirmed"),
        F.countDistinct("company_id").alias("buyers"),
        F.array_join(F.array_sort(F.array_compact(F.array_union(F.collect_set("tag_a"), F.collect_set("tag_b")))), ",").alias("tags"),
        F.max("period").cast("long").alias("latest"),
    )
    return shown.join(sums, "supplier_id")


def pending_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "line").where(live() & (F.col("status") == "pending")).select("supplier_id", "line_id", F.col("amount").cast("double").alias("amount"))


def active_verifications(spark: SparkSession, sf_dir: str, as_of: str = "2000-01-01") -> DataFrame:
    active = (F.col("verification") == "verified") & (F.col("expires_on").isNull() | (F.col("expires_on") >= F.lit(as_of).cast("date")))
    return table(spark, sf_dir, "party").select("supplier_id", active.alias("active"), F.when(active, F.col("tier")).otherwise("self_declared").alias("effective_tier"))


def supplier_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First letter facet and rank by name; ranks are within a region, so no task sorts the whole directory."""
    w = Window.partitionBy("region").orderBy(F.desc("ownership_pct"), "supplier_name", "supplier_id")
    return table(spark, sf_dir, "party").select("supplier_id", "region", F.upper(F.substring(F.trim("supplier_name"), 1, 1)).alias("letter"), F.row_number().over(w).cast("long").alias("rank"))


def confirmation_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as events on a line key: the latest not withdrawn one rules, earlier ones are retired."""
    w = Window.partitionBy("company_id", "supplier_id").orderBy(F.desc("reported_at"), F.desc("line_id"))
    ranked = table(spark, sf_dir, "line").where(live() & (F.col("status") != "pending")).withColumn("n", F.row_number().over(w))
    return ranked.where("n = 1").select("company_id", "supplier_id", "line_id", "status")


def withdraw_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What withdrawing takes from each flow's reported and confirmed sums."""
    rows = table(spark, sf_dir, "counted")
    gross = F.when(F.col("status") == "confirmed", F.col("amount")).when(F.col("status") == "corrected", F.coalesce("corrected_amount", "amount")).otherwise(F.lit(0).cast("decimal(18,4)"))
    return rows.groupBy("flow_type").agg((F.sum("amount") - F.sum("reported")).cast("double").alias("reported_lost"), (F.sum(gross) - F.sum("confirmed")).cast("double").alias("confirmed_lost"))


def party_export(spark: SparkSession, sf_dir: str, supplier_id: int = 7) -> DataFrame:
    """All records of one party, withdrawn ones too, as (kind, JSON): the filter reaches the scan."""
    mine = lambda name: table(spark, sf_dir, name).where(F.col("supplier_id") == supplier_id)
    party = mine("party").select(F.lit("party").alias("kind"), F.to_json(F.struct("supplier_id", "supplier_name", "tier")).alias("body"))
    return party.unionByName(mine("line").select(F.lit("line").alias("kind"), F.to_json(F.struct("line_id", "status", "withdrawn")).alias("body")))


_TOTALS = """CAST(sum(reported) AS DOUBLE) AS reported, CAST(sum(confirmed) AS DOUBLE) AS confirmed, count(*) FILTER (NOT withdrawn) AS lines,
count(*) FILTER (NOT withdrawn AND status = 'disputed') AS disputed, CAST(floor(coalesce(CAST(sum(confirmed) AS DOUBLE) / nullif(CAST(sum(reported) AS DOUBLE), 0), 0) * 100 + 0.5) AS BIGINT) AS pct"""
QUERIES = {f.__name__: f for f in (
    index_by_flow, index_totals, index_by_tier, index_by_tag, coverage_by_company, coverage_rollup, integrity_mismatch, supplier_record, supplier_showcase, pending_inbox,
    active_verifications, supplier_directory, confirmation_supersede, withdraw_effect, party_export,
)}
ORACLE_SQL = {
    "index_by_flow": oracle(f"SELECT flow_type, {_TOTALS} FROM counted GROUP BY flow_type", "counted"),
    "index_totals": oracle(f"SELECT {_TOTALS} FROM counted", "counted"),
    "index_by_tier": oracle(f"SELECT coalesce(tier, 'self_declared') AS tier, {_TOTALS} FROM counted LEFT JOIN party USING (supplier_id) GROUP BY 1", "counted", "party"),
    "index_by_tag": oracle(f"SELECT tag, {_TOTALS} FROM (SELECT *, tag_a AS tag FROM counted UNION ALL SELECT *, tag_b FROM counted WHERE tag_b IS NOT NULL) GROUP BY tag", "counted"),
    "coverage_by_company": oracle(
        """SELECT *, CAST(floor(coalesce(confirmed / nullif(reported, 0), 0) * 100 + 0.5) AS BIGINT) AS pct FROM (
        SELECT company_id, """
        + ", ".join(f"CAST(coalesce(sum({c}) FILTER (flow_type = '{f}'), 0) AS DOUBLE) AS {f}_{c}" for f in ("procurement", "capital") for c in ("reported", "confirmed"))
        + ", CAST(sum(reported) AS DOUBLE) AS reported, CAST(sum(confirmed) AS DOUBLE) AS confirmed FROM counted GROUP BY company_id)",
        "counted",
    ),
    "coverage_rollup": oracle("SELECT flow_type, period, grouping(flow_type, period) AS level, CAST(sum(reported) AS DOUBLE) AS reported, CAST(sum(confirmed) AS DOUBLE) AS confirmed FROM counted GROUP BY ROLLUP (flow_type, period)", "counted"),
    "integrity_mismatch": oracle(
        """SELECT count(*) FILTER (tier <> 'self_declared' AND reported > 0 AND confirmed = 0) AS certified_no_activity, count(*) FILTER (tier = 'self_declared' AND confirmed > 0) AS self_declared_active
        FROM (SELECT tier, coalesce(r, 0) AS reported, coalesce(c, 0) AS confirmed FROM party LEFT JOIN (SELECT supplier_id, sum(reported) AS r, sum(confirmed) AS c FROM counted GROUP BY 1) USING (supplier_id))""",
        "counted", "party",
    ),
    "supplier_record": oracle("SELECT supplier_id, CAST(sum(confirmed) AS DOUBLE) AS confirmed, count(*) FILTER (NOT withdrawn AND status = 'pending') AS pending, count(*) FILTER (NOT withdrawn AND status = 'disputed') AS disputed FROM counted GROUP BY 1", "counted"),
    "supplier_showcase": oracle(
        """SELECT supplier_id, supplier_name, CAST(sum(confirmed) AS DOUBLE) AS confirmed, count(DISTINCT company_id) AS buyers,
        array_to_string(list_sort(list_filter(list_distinct(list_concat(list(DISTINCT tag_a), list(DISTINCT tag_b))), lambda x: x IS NOT NULL)), ',') AS tags, CAST(max(period) AS BIGINT) AS latest
        FROM counted JOIN party USING (supplier_id) WHERE confirmed > 0 AND profile_public GROUP BY 1, 2""",
        "counted", "party",
    ),
    "pending_inbox": oracle("SELECT supplier_id, line_id, CAST(amount AS DOUBLE) AS amount FROM line WHERE NOT withdrawn AND status = 'pending'", "line"),
    "active_verifications": oracle("SELECT supplier_id, active, CASE WHEN active THEN tier ELSE 'self_declared' END AS effective_tier FROM (SELECT *, verification = 'verified' AND (expires_on IS NULL OR expires_on >= DATE '2000-01-01') AS active FROM party)", "party"),
    "supplier_directory": oracle("SELECT supplier_id, region, upper(substr(trim(supplier_name), 1, 1)) AS letter, row_number() OVER (PARTITION BY region ORDER BY ownership_pct DESC, supplier_name, supplier_id) AS rank FROM party", "party"),
    "confirmation_supersede": oracle("SELECT company_id, supplier_id, line_id, status FROM line WHERE NOT withdrawn AND status <> 'pending' QUALIFY row_number() OVER (PARTITION BY company_id, supplier_id ORDER BY reported_at DESC, line_id DESC) = 1", "line"),
    "withdraw_effect": oracle(
        """SELECT flow_type, CAST(sum(amount) - sum(reported) AS DOUBLE) AS reported_lost,
        CAST(sum(CASE status WHEN 'confirmed' THEN amount WHEN 'corrected' THEN coalesce(corrected_amount, amount) ELSE 0 END) - sum(confirmed) AS DOUBLE) AS confirmed_lost FROM counted GROUP BY 1""",
        "counted",
    ),
    "party_export": oracle(
        """SELECT 'party' AS kind, CAST(json_object('supplier_id', supplier_id, 'supplier_name', supplier_name, 'tier', tier) AS VARCHAR) AS body FROM party WHERE supplier_id = 7
        UNION ALL SELECT 'line', CAST(json_object('line_id', line_id, 'status', status, 'withdrawn', withdrawn) AS VARCHAR) FROM line WHERE supplier_id = 7""",
        "line", "party",
    ),
}
