"""Predicates, crosswalks and checks on records: gates, scrubbing, set differences, cascades, agreement of raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import mapped
from ledgerloom.functions.text import alnum, unit_of
from ledgerloom.sources.views import oracle, table

ADVICE = r"\b(should i|can i|am i allowed|do i need|what should|my rights|sue|advise)\b"
LEGAL_SUFFIXES = r"\b(inc|ltd|llc|corp|company|co|limited)\b\.?"
SIZES = {"lt_50": "small", "50_249": "medium", "250_999": "large", "1000_plus": "enterprise"}


def granted(c: Column) -> Column:
    """A grant verb without a context that takes it back."""
    return c.rlike(r"(?i)\b(granted|allowed|upheld)\b") & ~c.rlike(r"(?i)\b(not|denied|leave to|dismissed)\b")


def advice_seeking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role", F.lower("text").rlike(ADVICE).alias("advice")).agg(F.count("*").alias("n"))


def well_formed_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long enough, with a question mark, ending like a sentence."""
    t = F.trim("text")
    ok = (F.length(t) >= 40) & t.contains("?") & t.rlike(r"[.?!]$")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(ok).alias("formed"), F.count("*").alias("n"))


def court_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on made-up dispositions of every order."""
    n = F.col("o_orderkey") % 5
    text = F.when(n == 0, "The appeal is allowed.").when(n == 1, "Application granted in part").when(n == 2, "Leave to appeal granted").when(n == 3, "The motion is not granted").otherwise("Dismissed")
    return table(spark, sf_dir, "orders").groupBy(n.alias("kind"), granted(text).alias("granted")).agg(F.count("*").alias("n"))


def scrub_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are flagged, or whose quote is missing, become null; how many are left by priority."""
    n = F.col("o_orderkey")
    value = F.when((n % 7 == 0) | (n % 11 == 0), F.lit(None)).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(value).alias("left"), F.count("*").alias("n"))


def needs_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a vector, or with one by another embedder."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 2 == 0, "v2").otherwise("v1").alias("embedder"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(held, "doc_id", "left")
    return rows.where(F.col("embedder").isNull() | (F.col("embedder") != "v2")).select("doc_id", F.coalesce("embedder", F.lit("none")).alias("embedder"))


def prose_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    prose = F.coalesce(F.try_divide(F.length("text"), lines) >= 200, F.lit(False))
    return table(spark, sf_dir, "documents").groupBy("lang", prose.alias("prose")).agg(F.count("*").alias("n"))


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension values with their label, or the value made readable."""
    rows = table(spark, sf_dir, "part").select("p_type").distinct()
    readable = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substr("p_type", F.lit(2))))
    return rows.select("p_type", F.coalesce(mapped(F.col("p_type"), {"ECONOMY": "Economy class"}), F.regexp_replace(readable, "_", " ")).alias("label"))


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored against replayed rows, both ways, with EXCEPT ALL."""
    stored = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    replayed = table(spark, sf_dir, "lineitem").where("l_linenumber <> 2").select("l_orderkey", "l_linenumber").unionByName(stored.limit(0))
    gone = stored.exceptAll(replayed).withColumn("side", F.lit("stored"))
    return gone.unionByName(replayed.exceptAll(stored).withColumn("side", F.lit("replayed"))).groupBy("side").agg(F.count("*").alias("n"))


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id")
    return rows.where("doc_id % 4 <> 0").intersect(rows.where("doc_id % 6 = 0")).agg(F.count("*").alias("shared"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after some customers go: their orders, and those orders' lines, go too (anti joins)."""
    gone = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    left = orders.join(gone, "o_custkey", "left_anti")
    dead = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").join(dead, "l_orderkey", "left_anti")
    return left.agg(F.count("*").alias("orders")).join(lines.agg(F.count("*").alias("lines")))


def loose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as token sets without legal suffixes and short tokens, matched on any shared token with brands' size class."""
    kept = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower("p_name"), LEGAL_SUFFIXES, " "), "[^a-z0-9]+", " ")), " "), lambda t: F.length(t) > 2))
    return table(spark, sf_dir, "part").select(F.explode(kept).alias("token")).groupBy("token").agg(F.count("*").alias("parts"))


def word_scars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-boundary counts of a list of words over all texts, by language: one pass, the list is a literal."""
    words = ("the", "license", "ofce", "under")
    split = table(spark, sf_dir, "documents").select("lang", F.split(F.lower("text"), r"[^\p{L}\p{N}_]+").alias("w"))
    counts = F.array(*[F.struct(F.lit(w).alias("word"), (F.size("w") - F.size(F.array_remove("w", w))).alias("n")) for w in words])
    return split.select("lang", F.inline(counts)).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def highlight(spark: SparkSession, sf_dir: str, term: str = "and") -> DataFrame:
    """Marks of a term in benchmark texts: how many segments, how many marked, and the text put together again."""
    pieces = F.split(F.regexp_replace("text", f"(?i)({term})", "\x01$1\x01"), "\x01")
    marked = F.filter(pieces, lambda p: F.lower(p) == term)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(F.filter(pieces, lambda p: p != "")).cast("long").alias("segments"), F.size(marked).cast("long").alias("marked"), (F.array_join(pieces, "") == F.col("text")).alias("whole"))


def rater_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters' outcomes: agreed value, confidence and review flag."""
    n = F.col("o_orderkey")
    a, b = F.element_at(F.array(F.lit("won"), F.lit("lost"), F.lit("partial")), (n % 3 + 1).cast("int")), F.element_at(F.array(F.lit("won"), F.lit("lost"), F.lit("partial")), (n % 5 % 3 + 1).cast("int"))
    steady = (n % 4 != 0) & (n % 7 != 0)
    confidence = F.when((a == b) & steady, "high").when(a == b, "medium").otherwise("low")
    return table(spark, sf_dir, "orders").groupBy(F.when(a == b, a).otherwise("unclear").alias("outcome"), confidence.alias("confidence"), (confidence == "low").alias("review")).agg(F.count("*").alias("n"))


def unit_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of made-up targets and sizes of organisations by crosswalk, unknown ones named so."""
    n = F.col("o_orderkey") % 5
    text = F.when(n == 0, "$10M per year").when(n == 1, "5% of spend").when(n == 2, "12 people").when(n == 3, "49% (~$503M)").otherwise("more")
    size = F.element_at(F.array(*map(F.lit, (*SIZES, "odd"))), (n + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(unit_of(text).alias("unit"), mapped(size, SIZES, "unknown").alias("size")).agg(F.count("*").alias("n"))


def gold_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark quotes of six and more words, by whether their normal form stands once among the benchmark texts."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", alnum(F.col("text")).alias("q"))
    counted = rows.withColumn("same", F.count("*").over(Window.partitionBy("q")))
    reason = F.when(F.size(F.split("q", " ")) < 6, "short").when(F.col("same") > 1, "not_unique").otherwise("sound")
    return counted.select("item_id", reason.alias("reason"))


def reason_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by reason with the first three ids of each (a report's samples): a bounded aggregate, not a collected group."""
    w = Window.partitionBy("reason").orderBy("doc_id")
    rows = table(spark, sf_dir, "record").select("doc_id", F.when(~F.col("full_text"), "no_text").when(F.col("n_chars") < 300, "short").otherwise("kept").alias("reason"))
    first = rows.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("samples"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(first, "reason")


QUERIES = {f.__name__: f for f in (
    advice_seeking, well_formed_question, court_granted, scrub_fields, needs_embedding, prose_shape, label_table, set_difference, split_overlap, cascade_delete, loose_names, word_scars, highlight, rater_merge, unit_crosswalk, gold_soundness, reason_samples,
)}
ORACLE_SQL = {
    "advice_seeking": f"SELECT role, regexp_matches(lower(text), '{ADVICE}') AS advice, count(*) AS n FROM conversations GROUP BY 1, 2",
    "well_formed_question": "SELECT role, count(*) FILTER (length(trim(text)) >= 40 AND contains(text, '?') AND regexp_matches(trim(text), '[.?!]$')) AS formed, count(*) AS n FROM conversations GROUP BY 1",
    "court_granted": "SELECT o_orderkey % 5 AS kind, o_orderkey % 5 IN (0, 1) AS granted, count(*) AS n FROM orders GROUP BY 1, 2",
    "scrub_fields": "SELECT o_orderpriority, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS left, count(*) AS n FROM orders GROUP BY 1".replace("AS left", 'AS "left"'),
    "needs_embedding": "SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'none' ELSE 'v1' END AS embedder FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR vec_id % 2 <> 0",
    "prose_shape": "SELECT lang, coalesce(length(text) / CAST(nullif(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), 0) AS DOUBLE) >= 200, false) AS prose, count(*) AS n FROM documents GROUP BY 1, 2",
    "label_table": "SELECT DISTINCT p_type, CASE WHEN p_type = 'ECONOMY' THEN 'Economy class' ELSE replace(concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))), '_', ' ') END AS label FROM part",
    "set_difference": "SELECT 'stored' AS side, count(*) AS n FROM lineitem WHERE l_linenumber = 2 HAVING count(*) > 0",
    "split_overlap": "SELECT count(DISTINCT doc_id) AS shared FROM labels WHERE doc_id % 4 <> 0 AND doc_id % 6 = 0",
    "cascade_delete": "SELECT (SELECT count(*) FROM orders WHERE o_custkey % 10 <> 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orders, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 = 0)) AS lines",
    "loose_names": rf"SELECT token, count(*) AS parts FROM (SELECT unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '{LEGAL_SUFFIXES}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 2))) AS token FROM part) GROUP BY 1",
    "word_scars": " UNION ALL ".join(rf"SELECT lang, '{w}' AS word, CAST(sum(len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x = '{w}'))) AS BIGINT) AS n FROM documents GROUP BY 1" for w in ("the", "license", "ofce", "under")),
    "highlight": """SELECT item_id, CAST(len(list_filter(p, lambda x: x <> '')) AS BIGINT) AS segments, CAST(len(list_filter(p, lambda x: lower(x) = 'and')) AS BIGINT) AS marked, array_to_string(p, '') = text AS whole
        FROM (SELECT item_id, text, string_split(regexp_replace(text, '(?i)(and)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM benchmark)""".replace("\\\\1", "\\1"),
    "rater_merge": """SELECT CASE WHEN a = b THEN a ELSE 'unclear' END AS outcome, CASE WHEN a = b AND s THEN 'high' WHEN a = b THEN 'medium' ELSE 'low' END AS confidence, a <> b AS review, count(*) AS n
        FROM (SELECT ['won', 'lost', 'partial'][o_orderkey % 3 + 1] AS a, ['won', 'lost', 'partial'][o_orderkey % 5 % 3 + 1] AS b, o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AS s FROM orders) GROUP BY 1, 2, 3""",
    "unit_crosswalk": "SELECT ['currency', 'percent', 'count', 'currency', 'none'][o_orderkey % 5 + 1] AS unit, ['small', 'medium', 'large', 'enterprise', 'unknown'][o_orderkey % 5 + 1] AS size, count(*) AS n FROM orders GROUP BY 1, 2",
    "gold_soundness": """SELECT item_id, CASE WHEN len(string_split(q, ' ')) < 6 THEN 'short' WHEN count(*) OVER (PARTITION BY q) > 1 THEN 'not_unique' ELSE 'sound' END AS reason
        FROM (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS q FROM benchmark)""",
    "reason_samples": oracle(
        """SELECT reason, count(*) AS n, array_to_string(list_sort(list(doc_id) FILTER (r <= 3)), ',') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS r FROM (
        SELECT doc_id, CASE WHEN NOT full_text THEN 'no_text' WHEN n_chars < 300 THEN 'short' ELSE 'kept' END AS reason FROM record)) GROUP BY 1""",
        "record",
    ),
}
