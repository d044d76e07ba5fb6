"""Evaluation statistics: agreement, precision and recall, intervals, confusion, sign tests, selections and splits.

Each is a count of a few cells by one grouped aggregation, then expressions over those cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ratio, wilson
from ledgerloom.sources.views import table



def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gold (labelled quality) and predicted (long enough text), with language and a second flag."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", "lang", F.col("quality").alias("gold"), (F.col("n_chars") >= 400).cast("int").alias("predicted"), "toxic")


def cells(rows: DataFrame, *keys: str) -> DataFrame:
    both = lambda g, p: F.count_if((F.col("gold") == g) & (F.col("predicted") == p))
    return rows.groupBy(*keys).agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn"))


def f1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1")]


def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(raters(spark, sf_dir)).select("tp", "fp", "fn", *f1(F.col("tp"), F.col("fp"), F.col("fn")))


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed agreement, kappa (1 where chance agreement is 1) and PABAK by language."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    po = ratio(F.col("tp") + F.col("tn"), n)
    pe = ratio((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("fp") + F.col("tn")) * (F.col("fn") + F.col("tn")), n * n)
    kappa = F.when(pe >= 1, 1.0).otherwise(ratio(po - pe, 1 - pe))
    return cells(raters(spark, sf_dir), "lang").select("lang", F.round(po, 6).alias("po"), F.round(kappa, 6).alias("kappa"), F.round(2 * po - 1, 6).alias("pabak"))


def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raters(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("hits"), F.count("*").alias("n"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return rows.select("lang", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(F.greatest(F.lit(0.0), low), 6).alias("low_clamped"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four cells of outcome by verdict, zero-filled, with the decision that they lead to."""
    c = cells(raters(spark, sf_dir))
    alarm, found = ratio(F.col("fp"), F.col("fp") + F.col("tn")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    decision = F.when((alarm <= 0.05) & (found >= 0.8), "ship").when(alarm <= 0.05, "safe_but_weak").otherwise("unusable")
    return c.select("tp", "fp", "fn", "tn", F.round(alarm, 6).alias("false_alarm"), F.round(found, 6).alias("found"), decision.alias("decision"))


def select_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations (orders' priority and status) under the bars, the best by refusal, leakage and name."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.avg((F.col("o_orderkey") % 7 == 0).cast("double")).alias("leakage"), F.avg((F.col("o_orderkey") % 11 == 0).cast("double")).alias("unparsed"), F.avg((F.col("o_orderkey") % 13 == 0).cast("double")).alias("refusal")
    )
    rows = rows.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("config"), *[F.round(c, 6).alias(c) for c in ("leakage", "unparsed", "refusal")])
    return rows.where("leakage <= 0.2 AND unparsed <= 0.1").orderBy("refusal", "leakage", "config").limit(1)


def log_factorial(m: Column) -> Column:
    """Logarithm of m!, by Stirling's series taken twenty further on, where it is right to the last digits of a double."""
    x = (m + 20).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    for j in range(1, 21):
        series = series - F.log((m + j).cast("double"))
    return series


def sign_tail(a: Column, b: Column) -> Column:
    """Two-sided p of a sign test with a wins and b losses: the binomial tail by one running sum of terms, each made from the log
    of the one before; null without trials. The sum's length grows with the root of the trials."""
    n, k = a + b, F.greatest(a, b)
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def further(so_far: Column, i: Column) -> Column:
        t = so_far["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.when(i <= n, F.struct(t.alias("t"), (so_far["s"] + F.exp(t)).alias("s"))).otherwise(so_far)

    last = F.least(n, k + 64 + F.ceil(12 * F.sqrt(n.cast("double"))))  # terms from twelve deviations on are nothing to a double
    tail = F.aggregate(F.sequence(k + 1, F.greatest(k + 1, last)), start, further)["s"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided sign test of customers' first against last order prices, by segment; ties are left out."""
    at = F.struct("o_orderdate", "o_orderkey")
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", at).alias("first"), F.max_by("o_totalprice", at).alias("last"))
    rows = ends.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sides = rows.groupBy("c_mktsegment").agg(F.count_if(F.col("last") > F.col("first")).alias("a"), F.count_if(F.col("last") < F.col("first")).alias("b"))
    return sides.select("c_mktsegment", "a", "b", F.round(sign_tail(F.col("a"), F.col("b")), 6).alias("p"))


def dev_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the labelled ids by md5 order of (seed, id): a hash bound, so nothing is sorted globally."""
    side = F.when(F.substring(F.md5(F.concat(F.lit("split:"), F.col("doc_id").cast("string"))), 1, 1) < "8", "dev").otherwise("test")
    return table(spark, sf_dir, "labels").select("doc_id", side.alias("side"))


def theme_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa-style cells of every theme (language x flag), exploded from each record once."""
    pairs = F.array(F.struct(F.lit("quality").alias("theme"), F.col("gold").alias("gold"), F.col("predicted").alias("predicted")), F.struct(F.lit("toxic").alias("theme"), F.col("toxic").alias("gold"), (1 - F.col("predicted")).alias("predicted")))
    c = cells(raters(spark, sf_dir).select(F.inline(pairs)), "theme")
    return c.select("theme", "tp", "fp", "fn", "tn", *f1(F.col("tp"), F.col("fp"), F.col("fn")))


def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of question kinds with separate denominators: all, answered, decided."""
    answered, right = F.col("event_id") % 4 != 0, F.col("event_id") % 3 != 0
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("attempted"), F.count_if(answered).alias("answered"), F.count_if(answered & right).alias("supported"))
    return rows.select("kind", "attempted", "answered", "supported", F.round(1 - ratio(F.col("answered"), F.col("attempted")), 6).alias("refusal_rate"), F.round(ratio(F.col("supported"), F.col("answered")), 6).alias("support_rate"))


def drop_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tally of values by band."""
    band = F.when(F.col("value") >= 80, "80+").when(F.col("value") >= 50, "50-79").when(F.col("value") >= 20, "20-49").otherwise("under 20")
    return table(spark, sf_dir, "events").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


_RATERS = "WITH raters AS (SELECT doc_id, lang, quality AS gold, CAST(n_chars >= 400 AS INT) AS predicted, toxic FROM labels JOIN documents USING (doc_id))"
_N = {n: f"CAST(count(*) FILTER (gold = {g} AND predicted = {p}) AS DOUBLE)" for n, g, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))}
_CELLS = ", ".join(f"{v} AS {k}" for k, v in _N.items())
_LONG = ", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in _N)
_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
QUERIES = {f.__name__: f for f in (prf1, cohen_kappa, wilson_interval, confusion, select_config, sign_test, dev_test_split, theme_validation, answer_quality, drop_bands)}
ORACLE_SQL = {
    "prf1": f"{_RATERS} SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {_PRF} FROM (SELECT {_CELLS} FROM raters)",
    "cohen_kappa": f"""{_RATERS}, p AS (SELECT lang, (tp + tn) / n AS po, ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (n * n) AS pe FROM (SELECT *, tp + fp + fn + tn AS n FROM (SELECT lang, {_CELLS} FROM raters GROUP BY 1)))
        SELECT lang, round(po, 6) AS po, round(CASE WHEN pe >= 1 THEN 1 ELSE coalesce((po - pe) / nullif(1 - pe, 0), 0) END, 6) AS kappa, round(2 * po - 1, 6) AS pabak FROM p""",
    "wilson_interval": f"""{_RATERS}, c AS (SELECT lang, count(*) FILTER (toxic = 1) AS hits, count(*) AS n FROM raters GROUP BY 1), w AS (SELECT *, hits / CAST(n AS DOUBLE) AS p, CAST(1.96 AS DOUBLE) AS z FROM c),
        b AS (SELECT *, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS lo, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS hi FROM w)
        SELECT lang, hits, n, round(lo, 6) AS low, round(hi, 6) AS high, round(greatest(CAST(0 AS DOUBLE), lo), 6) AS low_clamped FROM b""",
    "confusion": f"""{_RATERS}, r AS (SELECT *, coalesce(fp / nullif(fp + tn, 0), 0) AS a, coalesce(tp / nullif(tp + fn, 0), 0) AS f FROM (SELECT {_CELLS} FROM raters))
        SELECT {_LONG}, round(a, 6) AS false_alarm, round(f, 6) AS found, CASE WHEN a <= 0.05 AND f >= 0.8 THEN 'ship' WHEN a <= 0.05 THEN 'safe_but_weak' ELSE 'unusable' END AS decision FROM r""",
    "select_config": """SELECT * FROM (SELECT concat_ws('/', o_orderpriority, o_orderstatus) AS config, round(avg(CAST(o_orderkey % 7 = 0 AS DOUBLE)), 6) AS leakage, round(avg(CAST(o_orderkey % 11 = 0 AS DOUBLE)), 6) AS unparsed,
        round(avg(CAST(o_orderkey % 13 = 0 AS DOUBLE)), 6) AS refusal FROM orders GROUP BY 1) WHERE leakage <= 0.2 AND unparsed <= 0.1 ORDER BY refusal, leakage, config LIMIT 1""",
    "sign_test": """WITH e AS (SELECT o_custkey, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS f, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS l FROM orders GROUP BY 1),
        s AS (SELECT c_mktsegment, count(*) FILTER (l > f) AS a, count(*) FILTER (l < f) AS b FROM e JOIN customer ON o_custkey = c_custkey GROUP BY 1), t AS (SELECT *, unnest(range(greatest(a, b), a + b + 1)) AS i FROM s)
        SELECT c_mktsegment, a, b, round(least(CAST(1 AS DOUBLE), 2 * sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))), 6) AS p FROM t GROUP BY 1, 2, 3""",
    "dev_test_split": "SELECT doc_id, CASE WHEN substr(md5(concat('split:', doc_id)), 1, 1) < '8' THEN 'dev' ELSE 'test' END AS side FROM labels",
    "theme_validation": f"""{_RATERS} SELECT theme, {_LONG}, {_PRF} FROM (SELECT theme, {_CELLS} FROM (SELECT 'quality' AS theme, gold, predicted FROM raters UNION ALL SELECT 'toxic', toxic, 1 - predicted FROM raters) GROUP BY 1)""",
    "answer_quality": """SELECT kind, attempted, answered, supported, round(1 - answered / CAST(attempted AS DOUBLE), 6) AS refusal_rate, round(coalesce(supported / CAST(nullif(answered, 0) AS DOUBLE), 0), 6) AS support_rate FROM (
        SELECT event_type AS kind, count(*) AS attempted, count(*) FILTER (event_id % 4 <> 0) AS answered, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 <> 0) AS supported FROM events GROUP BY 1)""",
    "drop_bands": "SELECT CASE WHEN value >= 80 THEN '80+' WHEN value >= 50 THEN '50-79' WHEN value >= 20 THEN '20-49' ELSE 'under 20' END AS band, count(*) AS n FROM events GROUP BY 1",
}
