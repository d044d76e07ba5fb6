"""URL block and allow rules by a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot (www.example.com: ``com.example.www.``). A rule's host
and all its subdomains are then the interval [key, key + a character above every other), and so are all paths that
begin with a rule's path. Intervals of one kind nest or are disjoint, so a sweep over urls and interval bounds in the
order of their keys needs no more than the stack of the active rules. Two sweeps: by host key, which gives a url the
rule hosts above it, and, for each of those, by rule host and path, which gives the longest fitting path. Of a url's
finds the longest rule wins.

The stack between two bounds is the chain from its innermost rule outwards, and that chain hangs on the rule alone: a
rule's outer rules are those that equal a prefix of it, found by an equi-join of its prefixes (labels of a host,
characters of a path) with the rules. So bounds are one row for each start and each end, however many rules there are.

Spark's part: the urls are dealt evenly by hash into ``sweeps`` groups, each group gets all bounds (two a rule), and
each is sorted and swept by itself with the last bound carried forward. No host, however frequent, makes a group larger
than another, and only narrow columns are sorted. Rules go to every sweep, so they may be ``MOST_RULES`` at most
(checked).

Defined cases: a null url, or one without ``://``, has empty host and path and gets the default verdict; of equal rules
of both verdicts allow wins; a rule with an empty host fits nothing; repeated pages are kept as they are; an empty table
gives an empty result, and without rules every page gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, partitions

#: Fixed values of the contract: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ABOVE_ALL = "\U0010ffff"
MOST_RULES = 1_000_000


def host_key(host: Column) -> Column:
    """com.example.www. for www.example.com; an empty host has an empty key, before every boundary."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def url_parts(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.substring_index(F.substring_index(F.coalesce(after, F.lit("")), "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, "/"))).otherwise(F.lit(""))
    return ascii_lower(host), path


def _host_bounds(rules: DataFrame) -> DataFrame:
    """(key, stack): at each bound of a rule host's interval, the rule hosts active from there on."""
    hosts = rules.select("begin").distinct()
    labels = F.split(F.expr("left(begin, length(begin) - 1)"), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    chain = hosts.select("begin", F.explode(ends).alias("outer")).join(hosts.select(F.col("begin").alias("outer")), "outer").groupBy("begin").agg(F.sort_array(F.collect_set("outer")).alias("stack"))  # as many as labels
    return _bounds(chain, F.col("begin"), F.col("stack"), F.slice("stack", 1, F.size("stack") - 1))


def _path_bounds(rules: DataFrame) -> DataFrame:
    """(key, stack): at each bound of a rule's interval of paths under its host, the innermost active rule, in an array."""
    row = F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict")
    own = rules.groupBy("begin", "path").agg(F.min_by(row, "verdict").alias("own"))  # allow before block
    outer = own.select("begin", F.col("path").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n")).where("n >= 0 AND n < length(inner)").select("begin", "inner", F.expr("left(inner, n)").alias("path"))
    parent = outer.join(own, ["begin", "path"]).groupBy("begin", "inner").agg(F.max_by("own", F.length("path")).alias("outer")).withColumnRenamed("inner", "path")
    nested = own.join(parent, ["begin", "path"], "left")
    none = F.filter(F.array("own"), lambda x: F.lit(False))
    return _bounds(nested, F.concat("begin", F.lit("\0"), "path"), F.array("own"), F.when(F.col("outer").isNull(), none).otherwise(F.array("outer")))


def _bounds(rows: DataFrame, key: Column, inside: Column, after: Column) -> DataFrame:
    """Two rows an interval; where one ends and another ends or starts, the outermost end and then the start count last."""
    return rows.select(F.inline(F.array(
        F.struct(key.alias("key"), inside.alias("stack"), F.lit(1).alias("starts"), F.length(key).alias("size")), F.struct(F.concat(key, F.lit(ABOVE_ALL)).alias("key"), after.alias("stack"), F.lit(0).alias("starts"), (F.lit(0) - F.length(key)).alias("size"))
    )))


def _swept(rows: DataFrame, bounds: DataFrame, sweeps: int) -> DataFrame:
    """rows (sweep, key, ...) with the stack of the last bound at or before their key, within their sweep."""
    dealt = bounds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long"))).alias("sweep"), "key", F.lit(0).alias("is_url"), "starts", "size", "stack")
    both = rows.withColumn("is_url", F.lit(1)).unionByName(dealt, allowMissingColumns=True)
    carried = F.last("stack", ignorenulls=True).over(Window.partitionBy("sweep").orderBy("key", "is_url", "starts", "size").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("stack", carried).where("is_url = 1").drop("is_url", "starts", "size")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sweeps: int | None = None) -> DataFrame:
    """page_id, host, path, rule (of the longest fitting rule, else null) and verdict of every page.

    rules: verdict, host, path.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"every sweep holds all rules, at most {MOST_RULES}")
    sweeps = sweeps or 8 * partitions(pages.sparkSession)
    rules = rules.where("host <> ''").select("verdict", ascii_lower(F.col("host")).alias("host"), "path").withColumn("begin", host_key(F.col("host")))
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(sweeps)).alias("sweep"))
    urls = urls.select("sweep", host_key(F.col("host")).alias("key"), F.monotonically_increasing_id().alias("row"), "page_id", "host", "path")
    above = _swept(urls, _host_bounds(rules), sweeps)
    hits = above.select("sweep", "row", "page_id", "host", "path", F.explode_outer("stack").alias("begin"))
    found = _swept(hits.select("sweep", F.coalesce(F.concat("begin", F.lit("\0"), "path"), F.lit("")).alias("key"), "row", "page_id", "host", "path"), _path_bounds(rules), sweeps)
    best = F.max(F.col("stack")[0])
    return (
        found.withColumn("stack", F.when(F.size("stack") > 0, F.col("stack")))
        .groupBy("sweep", "row", "page_id", "host", "path").agg(best.alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS rules(verdict, host, path)")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP8_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (
  SELECT page_id, coalesce(regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^([^/?#]*)([^?#]*)', ['h', 'p']), {'h': '', 'p': ''}) AS u
  FROM pages),
urls AS (SELECT page_id, translate(u.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.p AS path, row_number() OVER () AS n FROM parts),
fits AS (
  SELECT n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, r.verdict) AS k
  FROM urls u JOIN rules r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND prefix(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.n = f.n AND f.k = 1
"""
