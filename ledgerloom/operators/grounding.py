"""Grounding of extracted values: why a quote fails, elisions, label and entity parsing, confidence, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import alnum
from ledgerloom.operators.passages import _QUOTES, quotes
from ledgerloom.sources.views import oracle, table

LABELS = ("building", "household", "machinery")


def elision(quote: Column, text: Column) -> Column:
    """How a quote with ellipses stands in a text: whole, in_order, out_of_order or missing fragments (alnum forms)."""
    fragments = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), alnum), lambda f: f != "")
    hay = alnum(text)
    start = F.struct(F.lit(True).alias("ok"), F.lit(1).alias("at"))
    walked = F.aggregate(fragments, start, lambda s, f: _step(s, f, hay))
    present = F.forall(fragments, lambda f: F.contains(hay, f))
    return F.when(F.size(fragments) <= 1, F.when(present, "whole").otherwise("missing")).when(walked["ok"], "in_order").when(present, "out_of_order").otherwise("missing")


def _step(state: Column, fragment: Column, hay: Column) -> Column:
    """Moves the cursor past the fragment's next place, if there is one after it."""
    found = F.instr(F.substr(hay, state["at"]), fragment)
    return F.struct((state["ok"] & (found > 0)).alias("ok"), (state["at"] + F.when(found > 0, found - 1 + F.length(fragment)).otherwise(0)).cast("int").alias("at"))


def elision_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's quote as it is, and with its fragments swapped, against the turn."""
    rows = quotes(spark, sf_dir).select("role", "text", F.explode(F.array("quote", F.array_join(F.reverse(F.split("quote", r" \.\.\. ")), " ... "))).alias("quote"))
    return rows.groupBy("role", elision(F.col("quote"), F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def drop_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First cause that holds, for a claim that was dropped: too short, unseen text, other case, other spacing, none."""
    n = F.col("turn") % 4
    claim = F.when(n == 0, F.substring("text", 1, 8)).when(n == 1, F.translate("text", "abcdefghijklm", "ABCDEFGHIJKLM")).when(n == 2, F.regexp_replace("text", " ", "  ")).otherwise(F.concat("text", F.lit(" and more")))
    cause = (
        F.when(F.length(claim) < 15, "too_short").when(F.contains(F.col("text"), claim), "none").when(F.contains(F.lower("text"), F.lower(claim)), "other_case")
        .when(F.contains(alnum(F.col("text")), alnum(claim)), "other_spacing").otherwise("unseen")
    )
    return table(spark, sf_dir, "conversations").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a closed vocabulary out of a JSON array in a reply; others are dropped."""
    reply = F.concat(F.lit('labels: ["'), F.lower("c_mktsegment"), F.lit('", "nonsense", "building"]'))
    found = F.array_distinct(F.filter(F.from_json(F.regexp_extract(reply, r"\[.*\]", 0), "array<string>"), lambda x: x.isin(*LABELS)))
    return table(spark, sf_dir, "customer").groupBy(F.array_join(F.array_sort(found), ",").alias("labels")).agg(F.count("*").alias("n"))


def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of both citations, and the year and number they carry."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")
    number = F.regexp_extract("citation", r" ([0-9]+)$", 1).cast("long")
    return table(spark, sf_dir, "record").select("doc_id", plain("citation").alias("key"), plain("citation2").alias("key2"), F.regexp_extract("citation", "^([0-9]{4})", 1).cast("long").alias("year"), number.alias("number"))


def registry_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity out of a registry's JSON: the current name first, the office as city, province."""
    blob = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("old "), "s_name").alias("name"), F.lit(False).alias("current")), F.struct(F.col("s_name").alias("name"), F.lit(True).alias("current"))).alias("names"), F.struct(F.lit("City").alias("city"), F.col("n_name").alias("province")).alias("office")))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.from_json(blob, "names array<struct<name:string,current:boolean>>, office struct<city:string,province:string>").alias("e"))
    return rows.select("s_suppkey", F.filter("e.names", lambda x: x["current"])[0]["name"].alias("name"), F.concat_ws(", ", "e.office.city", "e.office.province").alias("office"))


def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between successive events of a user, as told to people, tallied by unit."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = F.floor((us - F.lag(us).over(w)) / 1_000_000)
    rows = table(spark, sf_dir, "events").select(s.alias("s")).where("s IS NOT NULL")
    told = F.when(F.col("s") < 60, "seconds").when(F.col("s") < 3600, "minutes").when(F.col("s") < 86400, "hours").otherwise("days")
    return rows.groupBy(told.alias("unit")).agg(F.count("*").alias("n"))


def least_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least confidence over a record's fields, nulls left out, by whether it clears the bar."""
    n = F.col("o_orderkey")
    fields = [F.when(n % 3 != 0, (n % 17) / 16.0), (n % 13) / 12.0 + 0.5, F.when(n % 5 == 0, (n % 7) / 6.0)]
    least = F.round(F.least(*fields), 6)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", (least >= 0.5).alias("clears")).agg(F.count("*").alias("n"), F.min(least).alias("lowest"))


def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a conversation merged: the first text of each role in turn order, distinct texts counted."""
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(first("user"), 256).alias("asked"), F.sha2(first("assistant"), 256).alias("answered"), F.countDistinct(alnum(F.col("text"))).alias("distinct_texts"))


def worklist(spark: SparkSession, sf_dir: str, most: int = 25) -> DataFrame:
    """The first records on which two raters disagree (a work list)."""
    rows = table(spark, sf_dir, "labels").where("quality = toxic").select("doc_id", "quality", "toxic")
    return rows.orderBy("doc_id").limit(most)


def measured_something(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards of an evaluation: an empty index, only empty lists, or only zero metrics must fail it."""
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 0).alias("filled"), F.max("n_chars").alias("most"))
    return docs.select((F.col("n") > 0).alias("has_index"), (F.col("filled") > 0).alias("has_lists"), (F.coalesce("most", F.lit(0)) > 0).alias("has_metrics"))


_ALNUM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
QUERIES = {f.__name__: f for f in (elision_kinds, drop_cause, label_parse, citation_forms, registry_entity, elapsed, least_confidence, merge_parts, worklist, measured_something)}
ORACLE_SQL = {
    "elision_kinds": rf"""WITH {_QUOTES}, q AS (SELECT role, text, unnest([quote, array_to_string(list_reverse(string_split(quote, ' ... ')), ' ... ')]) AS quote FROM quoted),
        f AS (SELECT role, list_filter(list_transform(string_split_regex(quote, '\.\.\.|…'), lambda x: {_ALNUM.format("x")}), lambda x: x <> '') AS fr, {_ALNUM.format("text")} AS t FROM q),
        a AS (SELECT *, len(list_filter(fr, lambda x: NOT contains(t, x))) = 0 AS present FROM f)
        SELECT role, CASE WHEN len(fr) <= 1 THEN CASE WHEN present THEN 'whole' ELSE 'missing' END WHEN present AND contains(substr(t, instr(t, fr[1]) + length(fr[1])), fr[2]) THEN 'in_order' WHEN present THEN 'out_of_order' ELSE 'missing' END AS kind, count(*) AS n FROM a GROUP BY 1, 2""",
    "drop_cause": f"""SELECT CASE WHEN length(c) < 15 THEN 'too_short' WHEN contains(text, c) THEN 'none' WHEN contains(lower(text), lower(c)) THEN 'other_case' WHEN contains({_ALNUM.format('text')}, {_ALNUM.format('c')}) THEN 'other_spacing' ELSE 'unseen' END AS cause, count(*) AS n
        FROM (SELECT text, CASE turn % 4 WHEN 0 THEN substr(text, 1, 8) WHEN 1 THEN translate(text, 'abcdefghijklm', 'ABCDEFGHIJKLM') WHEN 2 THEN replace(text, ' ', '  ') ELSE concat(text, ' and more') END AS c FROM conversations) GROUP BY 1""",
    "label_parse": "SELECT CASE WHEN lower(c_mktsegment) IN ('household', 'machinery') THEN concat('building,', lower(c_mktsegment)) ELSE 'building' END AS labels, count(*) AS n FROM customer GROUP BY 1",
    "citation_forms": oracle("SELECT doc_id, regexp_replace(lower(citation), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(lower(citation2), '[^a-z0-9]+', '', 'g') AS key2, year, doc_id AS number FROM record", "record"),
    "registry_entity": "SELECT s_suppkey, s_name AS name, concat('City, ', n_name) AS office FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "elapsed": """SELECT CASE WHEN s < 60 THEN 'seconds' WHEN s < 3600 THEN 'minutes' WHEN s < 86400 THEN 'hours' ELSE 'days' END AS unit, count(*) AS n
        FROM (SELECT floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000) AS s FROM events) WHERE s IS NOT NULL GROUP BY 1""",
    "least_confidence": """SELECT o_orderstatus, c >= 0.5 AS clears, count(*) AS n, min(c) AS lowest FROM (SELECT o_orderstatus, round(least(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 17 / CAST(16 AS DOUBLE) END,
        o_orderkey % 13 / CAST(12 AS DOUBLE) + CAST(0.5 AS DOUBLE), CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 7 / CAST(6 AS DOUBLE) END), 6) AS c FROM orders) GROUP BY 1, 2""",
    "merge_parts": f"""SELECT conv_id, sha256(arg_min(text, (turn, text)) FILTER (role = 'user')) AS asked, sha256(arg_min(text, (turn, text)) FILTER (role = 'assistant')) AS answered, count(DISTINCT {_ALNUM.format('text')}) AS distinct_texts
        FROM conversations GROUP BY 1""",
    "worklist": "SELECT doc_id, quality, toxic FROM labels WHERE quality = toxic ORDER BY doc_id LIMIT 25",
    "measured_something": "SELECT count(*) > 0 AS has_index, count(*) FILTER (length(text) > 0) > 0 AS has_lists, coalesce(max(n_chars), 0) > 0 AS has_metrics FROM documents",
}
