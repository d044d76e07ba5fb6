"""Document-corpus analytics: filters, facets, figure ranges, coverage, citation graph, lenses and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.ranking import ranked_by_buckets
from ledgerloom.sources.views import oracle, table

#: The denominator of the coverage report, in its order.
LANGUAGES = ("en", "fr", "de", "es", "it", "pt")
SIGNAL = r"(?i)\b(licensed|license|copyright|terms)\b"
LENS_BUCKET = 100_000
TOPIC = r"(?i)\b(under|rights|use)\b"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record")


def relevance(terms: str) -> Column:
    """Weighted substring relevance of a record; a null field weighs nothing."""
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains(terms), F.lit(False))
    return sum((F.when(has(c), w).otherwise(0) for c, w in (("citation", 10), ("source", 8), ("level", 5), ("win_type", 3), ("text", 2))), F.lit(0))


def case_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where("tier = 'core' AND year BETWEEN 1990 AND 2010 AND full_text")
    return rows.where(F.col("lang").isin("en", "fr") & F.col("win_type").isin("won", "partial")).select("doc_id", "year", "level")


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with any relevance, the best first within their level (top 50 each)."""
    rows = _records(spark, sf_dir).select("doc_id", "level", "year", relevance("and").alias("score")).where("score > 0")
    w = Window.partitionBy("level").orderBy(F.desc("score"), F.desc("year"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 50")


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by every facet from one pass: the facets of a record are exploded, then counted once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("key")) for c in ("lang", "level", "win_type", "tier", "source")])
    return _records(spark, sf_dir).select(F.inline(pairs)).where("key IS NOT NULL").groupBy("facet", "key").agg(F.count("*").alias("n"))


def figure_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and case the largest amount, then count, range and median per kind; amounts are never summed."""
    most = table(spark, sf_dir, "line").where("NOT withdrawn").groupBy("tag_a", "supplier_id").agg(F.max("amount").cast("double").alias("amount"))
    return most.groupBy(F.col("tag_a").alias("kind")).agg(F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.percentile("amount", 0.5).alias("median"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    decade = (F.floor(F.col("year") / 10) * 10).cast("long")
    return _records(spark, sf_dir).groupBy(decade.alias("decade"), "level").agg(F.count("*").alias("n"), F.count_if("full_text").alias("with_text"), F.count_if(F.col("tier") == "core").alias("core"))


def jurisdiction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed list with zero rows kept, and one row for what the list doesn't name."""
    known = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("unmapped")
    counts = _records(spark, sf_dir).groupBy(known.alias("lang")).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, (*LANGUAGES, "unmapped")))).alias("lang"))
    return listed.join(counts, "lang", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def citation_edges(records: DataFrame) -> DataFrame:
    """(citing, cited text): each record cites one by its first and one by its second form of citation."""
    year = lambda i: F.concat((1980 + i % 45).cast("string"))
    a, b = F.col("doc_id") * 7 % 997, F.col("doc_id") * 3 % 700
    return records.select(F.col("doc_id").alias("citing"), F.explode(F.array(F.concat(year(a), F.lit(" XC "), a.cast("string")), F.concat(F.lit("["), year(b), F.lit("] R "), b.cast("string")))).alias("cited"))


def resolved(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges to records by either form of citation: two equi joins instead of one with OR, first match by doc_id."""
    forms = records.select("doc_id", F.inline(F.array(F.struct(F.lit(1).alias("form"), F.col("citation").alias("cited")), F.struct(F.lit(2).alias("form"), F.col("citation2").alias("cited")))))
    first = forms.groupBy("cited").agg(F.min(F.struct("form", "doc_id")).alias("first"))
    return edges.join(first, "cited").select("citing", F.col("first.doc_id").alias("target"))


def citation_graph_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("doc_id", "citation", "citation2")
    return resolved(citation_edges(rows), rows).distinct()


def landmark_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation_graph_1hop(spark, sf_dir).groupBy("target").agg(F.count("*").alias("citing")).orderBy(F.desc("citing"), "target").limit(5)


def lens_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable reorder of each language's records: emphasis first, then level, then original order."""
    emphasis = F.size(F.array_intersect(F.array("win_type", "tier"), F.array(F.lit("won"), F.lit("core"))))
    place = F.array_position(F.array(*map(F.lit, ("supreme", "appeal", "superior", "tribunal"))), F.col("level"))
    rows = _records(spark, sf_dir).select("doc_id", "lang", emphasis.alias("emphasis"), place.alias("place"))
    buckets = [(F.col("emphasis"), True), (F.col("place"), False), (F.floor(F.col("doc_id") / LENS_BUCKET), False)]
    return ranked_by_buckets(rows, ["lang"], buckets, [F.col("doc_id")]).select("doc_id", "lang", "rank")


def situation_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A situation (level, outcome, year) against all records; weights of absent signals are shared out again."""
    level, win = (F.col("level") == "appeal").cast("double"), (F.col("win_type") == "won").cast("double")
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("year") - 2000) / 25.0)
    score = F.when(F.col("full_text"), 0.6 * near + 0.3 * win + 0.1 * level).otherwise((0.3 * win + 0.1 * level) / 0.4)
    rows = _records(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"))
    strength = F.when(F.col("score") >= 0.55, "strong").when(F.col("score") >= 0.4, "moderate").otherwise("weak")
    return rows.withColumn("strength", strength)


def citing_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of a needle in each text with up to 60 characters on either side, cut marks where it goes on."""
    at = F.instr(F.lower("text"), "license")
    rows = _records(spark, sf_dir).withColumn("at", at).where("at > 0")
    start, stop = F.greatest(F.lit(1), F.col("at") - 60), F.least(F.length("text"), F.col("at") + 66)
    body = F.substr("text", start, stop - start + 1)
    return rows.select("doc_id", F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(stop < F.length("text"), "…").otherwise("")).alias("passage"))


def inclusion_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of records by first failing reason."""
    reason = F.when(~F.col("text").rlike(SIGNAL), "no_signal").when(~F.col("text").rlike(TOPIC), "no_topic").when(F.col("n_chars") < 200, "too_short").otherwise("included")
    return _records(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def dedupe_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by normalised second citation, the first seen of each."""
    key = F.regexp_replace(F.lower("citation2"), r"[^a-z0-9]+", "")
    return _records(spark, sf_dir).groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offered rows whose key isn't stored yet (anti join), counted by level."""
    rows = _records(spark, sf_dir).select("doc_id", "level")
    return rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("level").agg(F.count("*").alias("added"))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellers' sets: full, partial or no agreement, with the labels both gave."""
    a = F.array_distinct(F.array("lang", "level"))
    b = F.array_distinct(F.array(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("xx"), F.when(F.col("doc_id") % 3 == 0, F.col("level")).otherwise("other")))
    both, either = F.array_intersect(a, b), F.array_union(a, b)
    kind = F.when(F.size(both) == F.size(either), "full").when(F.size(both) > 0, "partial").otherwise("none")
    return _records(spark, sf_dir).groupBy(kind.alias("agreement")).agg(F.count("*").alias("n"), F.sum(F.size(both)).alias("shared"))


def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations put together from their turns in order."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sha2(F.array_join(turns, "\n"), 256).alias("digest"))


_EDGES = """SELECT doc_id AS citing, unnest([concat(1980 + (doc_id * 7 % 997) % 45, ' XC ', doc_id * 7 % 997), concat('[', 1980 + (doc_id * 3 % 700) % 45, '] R ', doc_id * 3 % 700)]) AS cited FROM record"""
_GRAPH = f"""SELECT DISTINCT citing, target FROM ({_EDGES}) e JOIN (SELECT cited, min_by(doc_id, (form, doc_id)) AS target FROM (
SELECT citation AS cited, 1 AS form, doc_id FROM record UNION ALL SELECT citation2, 2, doc_id FROM record) GROUP BY 1) f ON e.cited = f.cited"""
QUERIES = {f.__name__: f for f in (
    case_filter, keyword_search, facets, figure_ranges, corpus_stats, jurisdiction_coverage, citation_graph_1hop, landmark_top5, lens_reorder, situation_similarity, citing_passage, inclusion_screen, dedupe_citation, insert_if_absent,
    label_agreement, reassembled,
)}
ORACLE_SQL = {name: oracle(sql, "record", "line") for name, sql in {
    "case_filter": "SELECT doc_id, year, level FROM record WHERE tier = 'core' AND year BETWEEN 1990 AND 2010 AND full_text AND lang IN ('en', 'fr') AND win_type IN ('won', 'partial')",
    "keyword_search": """SELECT doc_id, level, year, score, row_number() OVER (PARTITION BY level ORDER BY score DESC, year DESC, doc_id) AS rank FROM (SELECT *, CAST(10 * contains(lower(citation), 'and')::INT
        + 8 * contains(lower(source), 'and')::INT + 5 * contains(level, 'and')::INT + 3 * contains(win_type, 'and')::INT + 2 * contains(lower(text), 'and')::INT AS INT) AS score FROM record) WHERE score > 0 QUALIFY rank <= 50""",
    "facets": " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS key, count(*) AS n FROM record WHERE {c} IS NOT NULL GROUP BY 2" for c in ("lang", "level", "win_type", "tier", "source")),
    "figure_ranges": "SELECT kind, count(*) AS n, min(a) AS low, max(a) AS high, median(a) AS median FROM (SELECT tag_a AS kind, CAST(max(amount) AS DOUBLE) AS a FROM line WHERE NOT withdrawn GROUP BY tag_a, supplier_id) GROUP BY kind",
    "corpus_stats": "SELECT CAST(floor(year / 10) * 10 AS BIGINT) AS decade, level, count(*) AS n, count(*) FILTER (full_text) AS with_text, count(*) FILTER (tier = 'core') AS core FROM record GROUP BY 1, 2",
    "jurisdiction_coverage": """SELECT l.lang, coalesce(n, 0) AS n, first_year, last_year FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'it', 'pt', 'unmapped']) AS lang) l LEFT JOIN (
        SELECT CASE WHEN lang IN ('en', 'fr', 'de', 'es', 'it', 'pt') THEN lang ELSE 'unmapped' END AS lang, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM record GROUP BY 1) c ON l.lang = c.lang""",
    "citation_graph_1hop": _GRAPH,
    "landmark_top5": f"SELECT target, count(*) AS citing FROM ({_GRAPH}) GROUP BY 1 ORDER BY citing DESC, target LIMIT 5",
    "lens_reorder": """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (win_type = 'won')::INT + (tier = 'core')::INT DESC, list_position(['supreme', 'appeal', 'superior', 'tribunal'], level), doc_id) AS rank FROM record""",
    "situation_similarity": """SELECT doc_id, score, CASE WHEN score >= 0.55 THEN 'strong' WHEN score >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT doc_id, round(CASE WHEN full_text
        THEN 0.6 * greatest(0.0, 1 - abs(year - 2000) / CAST(25 AS DOUBLE)) + CAST(0.3 AS DOUBLE) * (win_type = 'won')::INT + CAST(0.1 AS DOUBLE) * (level = 'appeal')::INT
        ELSE (CAST(0.3 AS DOUBLE) * (win_type = 'won')::INT + CAST(0.1 AS DOUBLE) * (level = 'appeal')::INT) / CAST(0.4 AS DOUBLE) END, 6) AS score FROM record)""",
    "citing_passage": """SELECT doc_id, concat(CASE WHEN a > 1 THEN '…' ELSE '' END, substr(text, a, b - a + 1), CASE WHEN b < length(text) THEN '…' ELSE '' END) AS passage
        FROM (SELECT *, greatest(1, spot - 60) AS a, least(length(text), spot + 66) AS b FROM (SELECT *, instr(lower(text), 'license') AS spot FROM record) WHERE spot > 0)""",
    "inclusion_screen": r"""SELECT CASE WHEN NOT regexp_matches(text, '(?i)\b(licensed|license|copyright|terms)\b') THEN 'no_signal' WHEN NOT regexp_matches(text, '(?i)\b(under|rights|use)\b') THEN 'no_topic'
        WHEN n_chars < 200 THEN 'too_short' ELSE 'included' END AS reason, count(*) AS n FROM record GROUP BY 1""",
    "dedupe_citation": "SELECT regexp_replace(lower(citation2), '[^a-z0-9]+', '', 'g') AS key, min(doc_id) AS doc_id, count(*) AS n FROM record GROUP BY 1",
    "insert_if_absent": "SELECT level, count(*) AS added FROM record WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "label_agreement": """SELECT CASE WHEN s = u THEN 'full' WHEN s > 0 THEN 'partial' ELSE 'none' END AS agreement, count(*) AS n, CAST(sum(s) AS BIGINT) AS shared FROM (
        SELECT len(list_intersect(a, b)) AS s, len(list_distinct(list_concat(a, b))) AS u FROM (SELECT list_distinct([lang, level]) AS a,
        list_distinct([CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'xx' END, CASE WHEN doc_id % 3 = 0 THEN level ELSE 'other' END]) AS b FROM record)) GROUP BY 1""",
    "reassembled": "SELECT conv_id, count(*) AS turns, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY 1",
}.items()}
