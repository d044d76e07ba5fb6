"""Commitments index: faceted filter, grouped statistics, risk, leaderboards, digests and page slices.

Ranks are windows over grouped results (a row per organisation, sector, ...), or within a key; no window spans the
commitments themselves. ``current_year`` and ``as_of`` are always parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import iso_week, percent, round_up, slug
from ledgerloom.functions.ranking import ranked_by_buckets
from ledgerloom.sources.views import oracle, table

STATUSES = ("committed", "in_progress", "reported", "confirmed", "stalled")
NOW = 1999


def facet_filter(rows: DataFrame, text: str = "", **facets) -> DataFrame:
    """Conjunction of the facets given (empty ones don't filter) and a case-insensitive substring in any text field."""
    for name, value in facets.items():
        if value:
            rows = rows.where(F.col(name) == value)
    if text:
        fields = [F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in ("title", "org_name", "sector", "region", "type", "rap_type")]
        rows = rows.where(F.greatest(*fields))
    return rows


def risk(current_year: int = NOW) -> Column:
    """overdue, at_risk or on_track; a confirmed commitment is exempt (on_track)."""
    late = F.col("target_year") < current_year
    near = (F.col("target_year") <= current_year + 1) & ((F.col("progress") < 60) | (F.col("status") == "stalled"))
    return F.when(F.col("status") == "confirmed", "on_track").when(late, "overdue").when(near, "at_risk").otherwise("on_track")


def group_stat(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), round_up(F.avg("progress")).alias("avg_progress"))


def history(rows: DataFrame) -> DataFrame:
    """A row for each past point of a commitment: one a year back from its target year."""
    points = rows.select("id", "target_year", "progress", F.explode(F.sequence(F.lit(0), F.col("n_history").cast("int"))).alias("back"))
    state = F.element_at(F.array(*map(F.lit, STATUSES)), ((F.col("id") + F.col("back")) % 5 + 1).cast("int"))
    return points.select("id", (F.col("target_year") - F.col("back")).alias("period"), state.alias("status"), F.greatest(F.lit(0), F.col("progress") - 10 * F.col("back")).alias("progress"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "commitment")


def commitment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_filter(_rows(spark, sf_dir), text="HIGH", sector="building", org_size="large", target_year=0).select("id", "org_name", "status")


def summary_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("status") == "confirmed")
    return _rows(spark, sf_dir).agg(F.count("*").alias("total"), F.countDistinct("org_name").alias("orgs"), round_up(F.avg("progress")).alias("avg_progress"), percent(done, F.count("*")).alias("confirmed_pct"))


def by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_stat(_rows(spark, sf_dir), "sector")


def by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_stat(_rows(spark, sf_dir), "org_size")


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_stat(_rows(spark, sf_dir), "type")


def by_rap_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_stat(_rows(spark, sf_dir), "rap_type")


def sector_type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("sector", "type").agg(F.count("*").alias("n"))


def progress_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a period with zero-filled counts of every status."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return history(_rows(spark, sf_dir)).groupBy("period").agg(*counts, round_up(F.avg("progress")).alias("avg_progress"))


def deadline_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest commitments of each sector in order: kind, progress, id (top 20 a sector)."""
    rows = _rows(spark, sf_dir).withColumn("risk", risk()).where("risk <> 'on_track'")
    w = Window.partitionBy("sector").orderBy(F.when(F.col("risk") == "overdue", 0).otherwise(1), "progress", "id")
    return rows.select("sector", "id", "risk", "progress", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 20")


def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy(risk().alias("risk")).agg(F.count("*").alias("n"))


def confirmation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, told = F.count_if(F.col("status") == "confirmed"), F.count_if(F.col("status") == "reported")
    return _rows(spark, sf_dir).agg(done.alias("confirmed"), told.alias("reported"), percent(done, done + told).alias("pct"))


def org_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per organisation: sectors, totals, mean, share confirmed, risks; ranked within its size band."""
    orgs = _rows(spark, sf_dir).withColumn("risk", risk()).groupBy("org_size", "org_name").agg(
        F.min("org_id").alias("org_id"), F.array_join(F.array_sort(F.collect_set("sector")), ",").alias("sectors"), F.count("*").alias("total"), round_up(F.avg("progress")).alias("avg_progress"),
        percent(F.count_if(F.col("status") == "confirmed"), F.count("*")).alias("confirmed_pct"), F.count_if(F.col("risk") == "overdue").alias("overdue"), F.count_if(F.col("risk") == "at_risk").alias("at_risk"),
    )
    return ranked_by_buckets(orgs, ["org_size"], [(F.col("avg_progress"), True), (F.col("total"), True)], [F.col("org_name")])


def org_scorecard(spark: SparkSession, sf_dir: str, name: str = "customer-000000007") -> DataFrame:
    """One organisation's commitments by target year, beside its sector's mean progress."""
    rows = _rows(spark, sf_dir)
    means = rows.groupBy("sector").agg(round_up(F.avg("progress")).alias("sector_avg"))
    w = Window.orderBy(F.desc("target_year"), "id")
    mine = rows.where(slug(F.col("org_name")) == name).select("sector", "id", "target_year", "progress")
    return mine.join(means, "sector").withColumn("rank", F.row_number().over(w).cast("long"))


def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commitments beside what the ledger has confirmed for the organisation: procurement with confirmed sums is evidence."""
    sums = table(spark, sf_dir, "counted").where("flow_type = 'procurement'").groupBy("company_id").agg(F.sum("confirmed").alias("ledger"))
    rows = _rows(spark, sf_dir).join(sums, F.col("org_id") == F.col("company_id"), "left").withColumn("ledger", F.coalesce("ledger", F.lit(0)))
    tier = F.when((F.col("type") == "procurement") & (F.col("ledger") > 0), "confirmed").when(F.col("status") == "reported", "reported").otherwise("stated")
    return rows.groupBy("type", tier.alias("evidence")).agg(F.count("*").alias("n"))


def weekly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per organisation and ISO week of an as-of date: overdue and at-risk counts, items in order."""
    rows = _rows(spark, sf_dir).withColumn("risk", risk()).where("risk <> 'on_track'")
    return rows.groupBy("org_name").agg(
        F.max(iso_week(F.lit("1999-06-15").cast("date"))).alias("iso_week"), F.count_if(F.col("risk") == "overdue").alias("overdue"), F.count_if(F.col("risk") == "at_risk").alias("at_risk"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_year", "id"))), lambda x: x["id"].cast("string")), ",").alias("items"),
    )


def insight_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst sector by mean progress, first name on ties, as sentences."""
    stat = group_stat(_rows(spark, sf_dir), "sector").agg(F.max_by(F.struct("key", "avg_progress"), F.struct("avg_progress", F.col("key"))).alias("hi"), F.min_by(F.struct("key", "avg_progress"), F.struct("avg_progress", "key")).alias("lo"))
    told = lambda which, c: F.format_string(f"%s has the {which} mean progress (%d%%)", F.col(f"{c}.key"), F.col(f"{c}.avg_progress"))
    return stat.select(told("highest", "hi").alias("best"), told("lowest", "lo").alias("worst"))


def page_slice(spark: SparkSession, sf_dir: str, page: int = 3, size: int = 10) -> DataFrame:
    """A page of the listing, newest target year first: a distributed top-k, then its last rows."""
    top = _rows(spark, sf_dir).select("id", "target_year", "title").orderBy(F.desc("target_year"), "id").limit(page * size)
    return top.orderBy(F.desc("target_year"), "id").offset((page - 1) * size)


def bn_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rows united with rows of claimed organisations, each once; claims are a semi join."""
    rows = _rows(spark, sf_dir)
    claims = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("org_id"))
    return rows.where("org_id = 7").unionByName(rows.join(claims, "org_id", "left_semi").select(rows.columns)).dropDuplicates(["id"]).select("id", "org_id")


def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new point for each commitment's target year: it replaces the point of that period, or is added."""
    old = history(_rows(spark, sf_dir)).select("id", "period", F.col("progress"), F.lit(0).alias("version"))
    new = _rows(spark, sf_dir).where("id % 10 = 0").select("id", (F.col("target_year") + F.col("id") % 2).alias("period"), F.lit(100).cast("long").alias("progress"), F.lit(1).alias("version"))
    return old.unionByName(new).groupBy("id", "period").agg(F.max_by("progress", "version").alias("progress"))


_STAT = "count(*) AS n, CAST(floor(avg(progress) + 0.5) AS BIGINT) AS avg_progress"
_RISK = "CASE WHEN status = 'confirmed' THEN 'on_track' WHEN target_year < 1999 THEN 'overdue' WHEN target_year <= 2000 AND (progress < 60 OR status = 'stalled') THEN 'at_risk' ELSE 'on_track' END"
_HISTORY = """SELECT id, target_year - back AS period, ['committed', 'in_progress', 'reported', 'confirmed', 'stalled'][(id + back) % 5 + 1] AS status, greatest(0, progress - 10 * back) AS progress
FROM (SELECT *, unnest(range(0, n_history + 1)) AS back FROM commitment)"""
_PCT = "CAST(floor(coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0) * 100 + 0.5) AS BIGINT)"
_DONE = "count(*) FILTER (status = 'confirmed')"
QUERIES = {f.__name__: f for f in (
    commitment_filter, summary_kpis, by_sector, by_size, by_type, by_rap_type, sector_type_matrix, progress_over_time, deadline_risk, risk_counts, confirmation_integrity, org_leaderboard,
    org_scorecard, evidence_tiers, weekly_digest, insight_argmax, page_slice, bn_crosswalk, history_upsert,
)}
ORACLE_SQL = {name: oracle(sql, "commitment") for name, sql in {
    "commitment_filter": "SELECT id, org_name, status FROM commitment WHERE sector = 'building' AND org_size = 'large' AND lower(concat_ws('|', title, org_name, sector, region, type, rap_type)) LIKE '%high%'",
    "summary_kpis": f"SELECT count(*) AS total, count(DISTINCT org_name) AS orgs, CAST(floor(avg(progress) + 0.5) AS BIGINT) AS avg_progress, {_PCT.format(a=_DONE, b='count(*)')} AS confirmed_pct FROM commitment",
    **{f"by_{n}": f"SELECT {c} AS key, {_STAT} FROM commitment WHERE {c} IS NOT NULL GROUP BY 1" for n, c in (("sector", "sector"), ("size", "org_size"), ("type", "type"), ("rap_type", "rap_type"))},
    "sector_type_matrix": "SELECT sector, type, count(*) AS n FROM commitment GROUP BY ALL",
    "progress_over_time": f"SELECT period, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in STATUSES)}, CAST(floor(avg(progress) + 0.5) AS BIGINT) AS avg_progress FROM ({_HISTORY}) GROUP BY period",
    "deadline_risk": f"SELECT * FROM (SELECT sector, id, risk, progress, row_number() OVER (PARTITION BY sector ORDER BY CASE risk WHEN 'overdue' THEN 0 ELSE 1 END, progress, id) AS rank FROM (SELECT *, {_RISK} AS risk FROM commitment) WHERE risk <> 'on_track') WHERE rank <= 20",
    "risk_counts": f"SELECT {_RISK} AS risk, count(*) AS n FROM commitment GROUP BY 1",
    "confirmation_integrity": f"SELECT {_DONE} AS confirmed, count(*) FILTER (status = 'reported') AS reported, {_PCT.format(a=_DONE, b='''count(*) FILTER (status IN ('confirmed', 'reported'))''')} AS pct FROM commitment",
    "org_leaderboard": f"""SELECT *, row_number() OVER (PARTITION BY org_size ORDER BY avg_progress DESC, total DESC, org_name) AS rank FROM (
        SELECT org_size, org_name, min(org_id) AS org_id, array_to_string(list_sort(list(DISTINCT sector)), ',') AS sectors, count(*) AS total, CAST(floor(avg(progress) + 0.5) AS BIGINT) AS avg_progress,
        {_PCT.format(a=_DONE, b='count(*)')} AS confirmed_pct, count(*) FILTER (risk = 'overdue') AS overdue, count(*) FILTER (risk = 'at_risk') AS at_risk FROM (SELECT *, {_RISK} AS risk FROM commitment) GROUP BY org_size, org_name)""",
    "org_scorecard": """SELECT c.sector, id, target_year, progress, sector_avg, row_number() OVER (ORDER BY target_year DESC, id) AS rank
        FROM commitment c JOIN (SELECT sector, CAST(floor(avg(progress) + 0.5) AS BIGINT) AS sector_avg FROM commitment GROUP BY 1) s ON c.sector = s.sector WHERE lower(replace(org_name, '#', '-')) = 'customer-000000007'""",
    "weekly_digest": f"""SELECT org_name, max(strftime(DATE '1999-06-15', '%G-W%V')) AS iso_week, count(*) FILTER (risk = 'overdue') AS overdue, count(*) FILTER (risk = 'at_risk') AS at_risk, string_agg(id, ',' ORDER BY target_year, id) AS items
        FROM (SELECT *, {_RISK} AS risk FROM commitment) WHERE risk <> 'on_track' GROUP BY 1""",
    "insight_argmax": f"""SELECT printf('%s has the highest mean progress (%d%%)', max_by(key, (avg_progress, key)), max(avg_progress)) AS best, printf('%s has the lowest mean progress (%d%%)', min_by(key, (avg_progress, key)), min(avg_progress)) AS worst
        FROM (SELECT sector AS key, {_STAT} FROM commitment GROUP BY 1)""",
    "page_slice": "SELECT id, target_year, title FROM commitment ORDER BY target_year DESC, id LIMIT 10 OFFSET 20",
    "bn_crosswalk": "SELECT id, org_id FROM commitment WHERE org_id = 7 OR org_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0)",
    "history_upsert": f"SELECT id, period, max_by(progress, version) AS progress FROM (SELECT id, period, progress, 0 AS version FROM ({_HISTORY}) UNION ALL SELECT id, target_year + id % 2, 100, 1 FROM commitment WHERE id % 10 = 0) GROUP BY 1, 2",
}.items()} | {
    "evidence_tiers": oracle(
        """SELECT type, CASE WHEN type = 'procurement' AND coalesce(ledger, 0) > 0 THEN 'confirmed' WHEN status = 'reported' THEN 'reported' ELSE 'stated' END AS evidence, count(*) AS n
        FROM commitment LEFT JOIN (SELECT company_id, sum(confirmed) AS ledger FROM counted WHERE flow_type = 'procurement' GROUP BY 1) ON org_id = company_id GROUP BY 1, 2""",
        "commitment", "counted",
    ),
}
