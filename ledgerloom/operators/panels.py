"""Panels over judgements and records: confusion of two scales, adjudicated pairs, seeded halves, themes by two coders, facets of
arrays, bundles of a party's records, and the route that a query takes.

Counts are one grouped aggregation with every cell there, zero or not; rates and decisions are expressions over the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.ranking import ranked_by_buckets
from ledgerloom.functions.rules import wilson_clamped
from ledgerloom.functions.scalars import ratio
from ledgerloom.operators.evaluation import sign_tail
from ledgerloom.operators.retrieval import questions
from ledgerloom.operators.search import GENERIC, routed
from ledgerloom.sources.views import oracle, table

VERDICTS, LABELS = ("supported", "overstated", "contradicted", "unrelated"), ("entailment", "neutral", "contradiction")


def confusion_cells(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, verdict, label) -> a column of counts for each of 4 verdicts by 3 labels."""
    return rows.groupBy(*keys).agg(*[F.count_if((F.col("verdict") == v) & (F.col("label") == lb)).alias(f"{v}_{lb}") for v in VERDICTS for lb in LABELS])


def probe_decision(false_alarm: Column, recall: Column, most: float = 0.05, least: float = 0.8) -> Column:
    """A gate with false alarms is unusable at any recall; a quiet one with misses is safe but weak."""
    return F.when(false_alarm > most, "unusable").when(recall >= least, "ship").otherwise("safe-but-weak")


def probe_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", F.element_at(F.array(*map(F.lit, VERDICTS)), (k % 4 + 1).cast("int")).alias("verdict"), F.element_at(F.array(*map(F.lit, LABELS)), (k % 7 % 3 + 1).cast("int")).alias("label"))
    cells = confusion_cells(rows, "event_type")
    of = lambda v: F.col(f"{v}_entailment") + F.col(f"{v}_neutral") + F.col(f"{v}_contradiction")
    alarm, recall = ratio(F.col("supported_contradiction"), of("supported")), ratio(F.col("contradicted_contradiction"), of("contradicted"))
    return cells.select("*", F.round(alarm, 6).alias("false_alarm"), F.round(recall, 6).alias("recall"), probe_decision(alarm, recall).alias("decision"))


def adjudicated(pairs: DataFrame, *keys: str) -> DataFrame:
    """pairs (keys, forward, backward: 'a', 'b' or 'abstain', the second with the sides exchanged and told in the first's names):
    how many flip with the order, abstain or agree, wins of either side, and the sign test's p."""
    abstains = (F.col("forward") == "abstain") | (F.col("backward") == "abstain")
    flips, same = ~abstains & (F.col("forward") != F.col("backward")), ~abstains & (F.col("forward") == F.col("backward"))
    won = lambda side: F.count_if(same & (F.col("forward") == side))
    found = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(abstains).alias("abstained"), F.count_if(flips).alias("flipped"), won("a").alias("a"), won("b").alias("b"))
    decided = F.col("flipped") + F.col("a") + F.col("b")
    return found.select("*", F.round(ratio(F.col("flipped"), decided), 6).alias("flip_rate"), F.round(ratio(F.col("a") + F.col("b"), decided), 6).alias("agreement"), F.round(sign_tail(F.col("a"), F.col("b")), 6).alias("p"))


def pair_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") + F.col("l_suppkey")
    side = lambda m: F.when(k % m == 0, "abstain").when(k % 3 == 0, "b").otherwise("a")
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", side(11).alias("forward"), F.when(k % 5 == 0, "b").otherwise(side(13)).alias("backward"))
    return adjudicated(rows.withColumn("year", F.year("l_shipdate").cast("long")), "year")


def seeded_half(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """key and side: the first half (rounded up) of the keys in a seeded order is dev, the rest test."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    keyed = rows.select(key).withColumn("all", F.lit(1)).withColumn("digest", digest)
    placed = ranked_by_buckets(keyed, ["all"], [(F.substring("digest", 1, 3), False)], [F.col("digest"), F.col(key)])
    size = rows.agg(F.count("*").alias("n"))  # one row
    return placed.join(F.broadcast(size)).select(key, F.when(F.col("rank") * 2 <= F.col("n") + 1, "dev").otherwise("test").alias("side"))


def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_half(table(spark, sf_dir, "labels"), "doc_id", "half")


def theme_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coders' themes of labelled records: kappa, PABAK, precision, recall and F1 a theme, and the off-topic share's interval."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    theme = lambda name, a, b: F.struct(F.lit(name).alias("theme"), a.alias("x"), b.alias("y"))
    pairs = F.array(theme("quality", F.col("quality") == 1, F.col("n_chars") >= 400), theme("toxic", F.col("toxic") == 1, F.col("n_chars") % 9 == 0), theme("english", F.col("lang") == "en", F.col("doc_id") % 3 > 0))
    c = rows.select(F.inline(pairs)).groupBy("theme").agg(*[F.count_if(cell).cast("double").alias(n) for n, cell in (("tp", F.col("x") & F.col("y")), ("fp", ~F.col("x") & F.col("y")), ("fn", F.col("x") & ~F.col("y")), ("tn", ~F.col("x") & ~F.col("y")))])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    po = ratio(F.col("tp") + F.col("tn"), n)
    pe = ratio((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("fp") + F.col("tn")) * (F.col("fn") + F.col("tn")), n * n)
    kappa = F.when(pe >= 1, 1.0).otherwise(ratio(po - pe, 1 - pe))
    low, high = wilson_clamped(F.col("tn"), n)
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select("theme", *[F.round(v, 6).alias(k) for k, v in {"kappa": kappa, "pabak": 2 * po - 1, "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": f1, "off_low": low, "off_high": high}.items()])


def array_facets(rows: DataFrame, names: list[str]) -> DataFrame:
    """facet, value, n: in how many rows each value of some array columns stands (once a row)."""
    each = F.array(*[F.struct(F.lit(n).alias("facet"), F.array_distinct(n).alias("values")) for n in names])
    return rows.select(F.inline(each)).select("facet", F.explode("values").alias("value")).groupBy("facet", "value").agg(F.count("*").alias("n"))


def _themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with arrays of themes and places."""
    themes = F.filter(F.array(F.col("win_type"), F.when(F.col("full_text"), "text"), F.when(F.col("n_chars") > 1000, "long")), lambda t: t.isNotNull())
    return table(spark, sf_dir, "record").select("doc_id", "tier", "level", themes.alias("themes"), F.array("lang", "source").alias("places"))


def record_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return array_facets(_themed(spark, sf_dir).where("tier = 'core'"), ["themes", "places"])


def any_of_filter(spark: SparkSession, sf_dir: str, themes: tuple[str, ...] = ("won", "long"), place: str = "en", tier: str = "core") -> DataFrame:
    """Records of a tier with any of some themes and a place."""
    rows = _themed(spark, sf_dir).where((F.col("tier") == tier) & F.arrays_overlap("themes", F.array(*map(F.lit, themes))) & F.array_contains("places", place))
    return rows.select("doc_id", "level")


def record_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A party's lines, withdrawn ones too, as one JSON text a line, for writing as a bundle."""
    rows = table(spark, sf_dir, "line")
    return rows.select("supplier_id", "line_id", F.to_json(F.struct("line_id", "status", "withdrawn", "period")).alias("json"))


def query_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated queries of every kind against the first lines of all documents as names."""
    q = questions(spark, sf_dir)
    first, name = F.array_join(F.slice(F.split("text", " "), 1, 3), " "), F.split("text", "\n")[0].alias("text")
    text = F.when(F.col("query_id") % 4 == 0, F.concat(F.lit("see 2014 scc "), F.col("query_id").cast("string"))).when(F.col("query_id") % 4 == 1, first).when(F.col("query_id") % 4 == 2, "the of and").otherwise(F.col("text"))
    return routed(q.select("query_id", text.alias("text")), table(spark, sf_dir, "benchmark").select(name).unionByName(table(spark, sf_dir, "documents").select(name)))


QUERIES = {f.__name__: f for f in (probe_confusion, pair_adjudication, seeded_split, theme_panel, record_facets, any_of_filter, record_bundles, query_routes)}

_THEMED = "themed AS (SELECT *, list_filter([win_type, CASE WHEN full_text THEN 'text' END, CASE WHEN n_chars > 1000 THEN 'long' END], lambda x: x IS NOT NULL) AS themes, [lang, source] AS places FROM record)"
_W = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
ORACLE_SQL = {
    "probe_confusion": "WITH e AS (SELECT event_type, ['supported', 'overstated', 'contradicted', 'unrelated'][event_id % 4 + 1] AS v, ['entailment', 'neutral', 'contradiction'][event_id % 7 % 3 + 1] AS l FROM events), c AS (SELECT event_type, "
    + ", ".join(f"count(*) FILTER (v = '{v}' AND l = '{lb}') AS {v}_{lb}" for v in VERDICTS for lb in LABELS)
    + """, count(*) FILTER (v = 'supported' AND l = 'contradiction') / CAST(nullif(count(*) FILTER (v = 'supported'), 0) AS DOUBLE) AS fa, count(*) FILTER (v = 'contradicted' AND l = 'contradiction') / CAST(nullif(count(*) FILTER (v = 'contradicted'), 0) AS DOUBLE) AS rc FROM e GROUP BY 1)
    SELECT * EXCLUDE (fa, rc), round(coalesce(fa, 0), 6) AS false_alarm, round(coalesce(rc, 0), 6) AS recall, CASE WHEN fa > 0.05 THEN 'unusable' WHEN rc >= 0.8 THEN 'ship' ELSE 'safe-but-weak' END AS decision FROM c""",
    "pair_adjudication": """WITH k AS (SELECT year(l_shipdate) AS year, l_partkey + l_suppkey AS k FROM lineitem), p AS (SELECT year, CASE WHEN k % 11 = 0 THEN 'abstain' WHEN k % 3 = 0 THEN 'b' ELSE 'a' END AS f, CASE WHEN k % 5 = 0 THEN 'b' WHEN k % 13 = 0 THEN 'abstain' WHEN k % 3 = 0 THEN 'b' ELSE 'a' END AS g FROM k),
        c AS (SELECT year, count(*) AS n, count(*) FILTER ('abstain' IN (f, g)) AS abstained, count(*) FILTER ('abstain' NOT IN (f, g) AND f <> g) AS flipped, count(*) FILTER (f = 'a' AND g = 'a') AS a, count(*) FILTER (f = 'b' AND g = 'b') AS b FROM p GROUP BY 1), t AS (SELECT *, unnest(range(greatest(a, b), a + b + 1)) AS i FROM c)
        SELECT year, n, abstained, flipped, a, b, round(flipped / CAST(flipped + a + b AS DOUBLE), 6) AS flip_rate, round((a + b) / CAST(flipped + a + b AS DOUBLE), 6) AS agreement, round(least(CAST(1 AS DOUBLE), 2 * sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))), 6) AS p FROM t GROUP BY ALL""",
    "seeded_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('half:' || doc_id), doc_id) <= ceil((SELECT count(*) FROM labels) / 2) THEN 'dev' ELSE 'test' END AS side FROM labels",
    "theme_panel": """WITH r AS (SELECT * FROM labels JOIN documents USING (doc_id)), p AS (SELECT 'quality' AS theme, quality = 1 AS x, n_chars >= 400 AS y FROM r UNION ALL SELECT 'toxic', toxic = 1, n_chars % 9 = 0 FROM r UNION ALL SELECT 'english', lang = 'en', doc_id % 3 > 0 FROM r),
        c AS (SELECT theme, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (x AND y) AS DOUBLE) AS tp, count(*) FILTER (y AND NOT x) AS fp, count(*) FILTER (x AND NOT y) AS fn, count(*) FILTER (NOT x AND NOT y) AS tn FROM p GROUP BY 1),
        q AS (SELECT *, (tp + tn) / n AS po, ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (n * n) AS pe, tn / n AS o, CAST(1.96 AS DOUBLE) AS z FROM c)
        SELECT theme, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa, round(2 * po - 1, 6) AS pabak, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
        round(greatest(0, (o + z * z / (2 * n) - z * sqrt(o * (1 - o) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS off_low, round(least(1, (o + z * z / (2 * n) + z * sqrt(o * (1 - o) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS off_high FROM q""",
    "record_facets": oracle(f"WITH {_THEMED} SELECT facet, value, count(*) AS n FROM (SELECT 'themes' AS facet, unnest(list_distinct(themes)) AS value FROM themed WHERE tier = 'core' UNION ALL SELECT 'places', unnest(list_distinct(places)) FROM themed WHERE tier = 'core') GROUP BY 1, 2", "record"),
    "any_of_filter": oracle("SELECT doc_id, level FROM record WHERE tier = 'core' AND (win_type = 'won' OR n_chars > 1000) AND (lang = 'en' OR source = 'en')", "record"),
    "record_bundles": oracle("SELECT supplier_id, line_id, printf('{\"line_id\":\"%s\",\"status\":\"%s\",\"withdrawn\":%s,\"period\":%d}', line_id, status, CASE WHEN withdrawn THEN 'true' ELSE 'false' END, period) AS json FROM line", "line"),
    "query_routes": f"""WITH q AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'see 2014 scc ' || item_id WHEN 1 THEN array_to_string(string_split(text, ' ')[:3], ' ') WHEN 2 THEN 'the of and' ELSE text END AS text FROM benchmark),
        n AS (SELECT ' ' || {_W.format("string_split(text, chr(10))[1]")} || ' ' AS name FROM benchmark UNION ALL SELECT ' ' || {_W.format("string_split(text, chr(10))[1]")} || ' ' FROM documents), w AS (SELECT query_id, {_W.format("text")} AS w FROM q),
        r AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'citation' WHEN w <> '' AND len(string_split(w, ' ')) <= 5 AND len(list_filter(string_split(w, ' '), lambda x: x NOT IN ({", ".join(f"'{g}'" for g in GENERIC)}))) > 0 AND EXISTS (SELECT 1 FROM n WHERE contains(name, ' ' || w || ' ')) THEN 'case_name' ELSE 'semantic' END AS reason FROM w)
        SELECT query_id, reason, reason = 'semantic' AS use_dense FROM r""",
}
