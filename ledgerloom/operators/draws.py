"""Seeded draws that tell what they passed over: one target paragraph a case, with counts of the rejections.

A draw looks at cases in a seeded order and stops at the case that fills it, so its counts speak of that prefix alone; how many
cases the prefix has is told with them. The prefix ends at a distributed top-k; its end is one row, and the counts are one
aggregation of cases up to there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.views import table

LEAST_CHARS, LEAST_LINE = 300, 200  # fixed values: characters of a target, characters a line of prose


def prose_shaped(text: Column, least: int = LEAST_LINE) -> Column:
    """Long lines on average: captions, party lists and tables of contents have short ones. Empty lines don't count."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: x != ""))
    return (lines > 0) & (F.length(text) >= least * lines)


def _turn(*of: object) -> Column:
    """A seeded place in the order of a draw; what is null has a place as well."""
    return F.md5(F.concat_ws(":", *[F.lit(str(x)) if isinstance(x, int) else F.coalesce(x.cast("string"), F.lit("")) for x in of]))


def drawn(paragraphs: DataFrame, seed: int, count: int, least_chars: int = LEAST_CHARS, least_line: int = LEAST_LINE) -> tuple[DataFrame, DataFrame]:
    """paragraphs (case_id, para, text) -> (targets, counts).

    targets: case_id, para, text of up to count cases, one paragraph each. counts, one row: examined (cases up to the one that
    fills the draw, or all), no_long (cases without a long paragraph), no_prose (with long ones, none of them prose),
    paragraphs_rejected (long ones of any examined case that aren't prose). A null text is empty; null ids are one case; a
    case without a target isn't replaced by another paragraph or by a case that has had its turn.
    """
    rows = paragraphs.select("case_id", "para", F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") >= least_chars
    fits = long & prose_shaped(F.col("text"), least_line)
    pick = F.min(F.when(fits, F.struct(_turn(seed, F.col("case_id"), F.col("para")).alias("turn"), "para"))).alias("pick")
    cases = rows.groupBy("case_id").agg(F.count_if(long).alias("long"), F.count_if(fits).alias("fits"), pick)
    cases = cases.withColumn("turn", F.struct(_turn(seed, F.col("case_id")).alias("hash"), "case_id"))
    first = cases.where("fits > 0").orderBy("turn").limit(count)
    end = first.agg(F.max("turn").alias("last"), F.count("*").alias("n"))
    examined = cases.join(F.broadcast(end), (F.col("n") < count) | (cases["turn"] <= F.col("last")))  # one row
    counts = examined.agg(
        F.count("*").alias("examined"),
        F.count_if(F.col("long") == 0).alias("no_long"),
        F.count_if((F.col("long") > 0) & (F.col("fits") == 0)).alias("no_prose"),
        F.coalesce(F.sum(F.col("long") - F.col("fits")), F.lit(0)).alias("paragraphs_rejected"),
    )
    chosen = F.broadcast(first.select("case_id", F.col("pick.para").alias("para")))  # count rows at most
    same = rows["case_id"].eqNullSafe(chosen["case_id"]) & rows["para"].eqNullSafe(chosen["para"])
    targets = rows.join(chosen, same, "left_semi").groupBy("case_id", "para").agg(F.min("text").alias("text"))
    return targets, counts


def by_lines(texts: DataFrame, lines: int = 3) -> DataFrame:
    """texts (case_id, text) -> (case_id, para, text): paragraphs of so many lines, made without a shuffle."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / lines).cast("int"))
    paras = F.transform(starts, lambda i: F.array_join(F.slice(parts, i * lines + 1, F.lit(lines)), "\n"))
    return texts.select("case_id", F.posexplode(paras).alias("para", "text")).withColumn("para", F.col("para").cast("long"))


def target_draw(spark: SparkSession, sf_dir: str, seed: int = 11, count: int = 40) -> DataFrame:
    """Target paragraphs of documents, with the counts of the draw."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text")
    targets, counts = drawn(by_lines(texts), seed, count)
    return targets.select("case_id", "para", F.md5("text").alias("digest")).join(F.broadcast(counts))


def draw_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a draw of all cases passes over, source by source, with the share of cases that give a target."""
    rows = by_lines(table(spark, sf_dir, "documents").select(F.struct("source", "doc_id").alias("case_id"), "text"))
    long = F.length("text") >= LEAST_CHARS
    fits = F.count_if(long & prose_shaped(F.col("text"))).alias("fits")
    cases = rows.groupBy("case_id").agg(F.count_if(long).alias("long"), fits)
    found = F.count_if(F.col("fits") > 0)
    return cases.groupBy(F.col("case_id.source").alias("source")).agg(
        F.count("*").alias("cases"), F.count_if(F.col("long") == 0).alias("no_long"), F.count_if((F.col("long") > 0) & (F.col("fits") == 0)).alias("no_prose"),
        F.sum(F.col("long") - F.col("fits")).alias("paragraphs_rejected"), F.round(found / F.count("*"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (target_draw, draw_yield)}
_CASES = f"""lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
    paras AS (SELECT doc_id, any_value(source) AS source, i // 3 AS para, string_agg(line, chr(10) ORDER BY i) AS text, count(*) FILTER (line <> '') AS lines FROM lines GROUP BY doc_id, i // 3),
    judged AS (SELECT *, length(text) >= {LEAST_CHARS} AS long, length(text) >= {LEAST_CHARS} AND lines > 0 AND length(text) >= {LEAST_LINE} * lines AS fits FROM paras),
    cases AS (SELECT doc_id, any_value(source) AS source, md5(concat('11:', doc_id)) AS turn, count(*) FILTER (long) AS n_long, count(*) FILTER (fits) AS n_fits FROM judged GROUP BY doc_id)"""
ORACLE_SQL = {
    "target_draw": f"""WITH {_CASES},
        placed AS (SELECT *, coalesce(sum(CAST(n_fits > 0 AS INT)) OVER (ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cases),
        counts AS (SELECT count(*) AS examined, count(*) FILTER (n_long = 0) AS no_long, count(*) FILTER (n_long > 0 AND n_fits = 0) AS no_prose, CAST(sum(n_long - n_fits) AS BIGINT) AS paragraphs_rejected FROM placed WHERE before < 40)
        SELECT j.doc_id AS case_id, j.para, md5(j.text) AS digest, counts.* FROM judged j JOIN placed p ON p.doc_id = j.doc_id AND p.before < 40 CROSS JOIN counts
        WHERE j.fits QUALIFY row_number() OVER (PARTITION BY j.doc_id ORDER BY md5(concat('11:', j.doc_id, ':', j.para))) = 1""",
    "draw_yield": f"""WITH {_CASES} SELECT source, count(*) AS cases, count(*) FILTER (n_long = 0) AS no_long, count(*) FILTER (n_long > 0 AND n_fits = 0) AS no_prose,
        CAST(sum(n_long - n_fits) AS BIGINT) AS paragraphs_rejected, round(count(*) FILTER (n_fits > 0) / count(*), 6) AS share FROM cases GROUP BY source""",
}
