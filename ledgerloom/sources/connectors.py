"""Readers, writers and link extraction: CSV, JSON lines, versioned artifacts, verified copies, windows and harvests.

Whatever is written goes to the folder that the cluster shares.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.views import oracle, table
from ledgerloom.streaming.flows import shared_folder


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_csv(rows: DataFrame, path: str) -> None:
    """Header, double quotes doubled inside quoted fields."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A line that isn't JSON of this schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """More lines of a manifest; what it holds is never rewritten."""
    rows.write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All lines of a manifest by this schema. One that isn't there is empty; a blank line is none; a line that isn't a JSON
    object fails the read by the name of its file, however the rows are used: what is damaged must not pass for empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _damaged string", {"columnNameOfCorruptRecord": "_damaged"}))
    told = F.concat(F.col("file"), F.lit(": the manifest is damaged, not empty; this line is not a JSON object: "), F.substring("value", 1, 80))
    damaged = F.col("row").isNull() | F.col("row._damaged").isNotNull()
    return parsed.where(F.when(damaged, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).select("row.*").drop("_damaged")


def write_artifact(tables: dict[str, DataFrame], path: str, build_id: str) -> None:
    """Tables of one build; the row of _meta is written last, so an unfinished build can't be read."""
    for name, rows in tables.items():
        rows.withColumn("build_id", F.lit(build_id)).write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(build_id).alias("build_id"), F.lit(",".join(sorted(tables))).alias("tables")).write.parquet(f"{path}/_meta")


def read_artifact(spark: SparkSession, path: str, name: str, build_id: str | None = None) -> DataFrame:
    """A table of the artifact, without rows if it is of another build than asked for."""
    found = spark.read.parquet(f"{path}/_meta").first()["build_id"]  # one row
    rows = spark.read.parquet(f"{path}/{name}").drop("build_id")
    return rows if build_id in (None, found) else rows.limit(0)


def copy_report(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Counts of both and how many keys of the source the target lacks."""
    missing = source.select(key).join(target.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    counts = source.agg(F.count("*").alias("source_rows")).join(target.agg(F.count("*").alias("target_rows")))
    return counts.join(missing).withColumn("equal", (F.col("source_rows") == F.col("target_rows")) & (F.col("missing") == 0))


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "export")
    rows = table(spark, sf_dir, "commitment").where("sector = 'building'").select("id", F.concat(F.lit('say "'), "title", F.lit('", ok')).alias("title"), "target_year")
    write_csv(rows, path)
    return read_csv(spark, path, "id long, title string, target_year long")


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "lines")
    table(spark, sf_dir, "benchmark").write.json(path)
    return read_jsonl(spark, path, "item_id long, text string")


def manifest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a manifest in two runs, read back and counted by run and kind."""
    path = place(spark, "manifest")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("run"))
    for run in ("even", "odd"):
        append_manifest(rows.where(F.col("run") == run), path)
    return read_manifest(spark, path, "event_id long, event_type string, run string").groupBy("run", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def artifact_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and labels written as one build, read back: by the right build id whole, by a wrong one not at all."""
    path = place(spark, "artifact")
    rows = table(spark, sf_dir, "embeddings")
    write_artifact({"labels": rows.select("vec_id", "label"), "vectors": rows.select("vec_id", "embedding")}, path, "b1")
    right, wrong = read_artifact(spark, path, "labels", "b1"), read_artifact(spark, path, "labels", "b2")
    return right.agg(F.count("*").alias("right_build")).join(wrong.agg(F.count("*").alias("wrong_build")))


def copy_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "copy")
    source = table(spark, sf_dir, "customer")
    source.write.parquet(path)
    return copy_report(source, spark.read.parquet(path), "c_custkey")


def date_windows(spark: SparkSession, sf_dir: str, years: int = 2) -> DataFrame:
    """The span of order dates in windows of some years."""
    span = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    start = F.explode(F.sequence("a", "b", F.lit(years)))
    return span.select(start.alias("first"), "b").select(F.col("first").cast("long").alias("first"), F.least(F.col("first") + years - 1, F.col("b")).cast("long").alias("last"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page, each target once per page."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('(?i)href="([^"#]+)'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("target"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def open_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by whether their host ends in an allowed one, with the outcome of a fetch by size."""
    host, size = host_of(F.col("url")), F.length("html")
    outcome = F.when(~host.endswith(".com") & ~host.endswith(".org"), "not_open").when(size == 0, "missing").when(size < 400, "blocked").otherwise("ok")
    return table(spark, sf_dir, "pages").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def snowball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that the corpus doesn't hold yet: explode, distinct, anti join."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    cited = docs.select(F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 3)).alias("doc_id")).distinct()
    return cited.join(docs, "doc_id", "left_anti")


def packed_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed to hexadecimal (8-bit values) and read again: largest error of each."""
    q = F.transform("embedding", lambda x: F.floor(x * 127 + 0.5).cast("int"))
    hex_ = F.array_join(F.transform(q, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), "")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", hex_.alias("packed"))
    back = F.transform("embedding", lambda x, i: F.abs(x - (F.pmod(F.conv(F.substring("packed", i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 128, F.lit(256)) - 128) / 127.0))
    return rows.select("vec_id", "packed", (F.array_max(back) <= 0.5 / 127 + 1e-6).alias("close"))


QUERIES = {f.__name__: f for f in (csv_export, jsonl_roundtrip, manifest_runs, artifact_vectors, copy_parity, date_windows, page_links, open_hosts, snowball, packed_floats)}
ORACLE_SQL = {
    "csv_export": oracle("""SELECT id, concat('say "', title, '", ok') AS title, target_year FROM commitment WHERE sector = 'building'""", "commitment"),
    "jsonl_roundtrip": "SELECT item_id, text FROM benchmark",
    "manifest_runs": "SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2",
    "artifact_vectors": "SELECT count(*) AS right_build, CAST(0 AS BIGINT) AS wrong_build FROM embeddings",
    "copy_parity": "SELECT count(*) AS source_rows, count(*) AS target_rows, CAST(0 AS BIGINT) AS missing, true AS equal FROM customer",
    "date_windows": "SELECT CAST(y AS BIGINT) AS first, CAST(least(y + 1, b) AS BIGINT) AS last FROM (SELECT b, unnest(range(a, b + 1, 2)) AS y FROM (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders))",
    "page_links": """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)href="([^"#]+)', 1))) AS target FROM pages""",
    "open_hosts": r"""SELECT CASE WHEN NOT (suffix(h, '.com') OR suffix(h, '.org')) THEN 'not_open' WHEN length(html) = 0 THEN 'missing' WHEN length(html) < 400 THEN 'blocked' ELSE 'ok' END AS outcome, count(*) AS n
        FROM (SELECT html, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS h FROM pages) GROUP BY 1""",
    "snowball": "SELECT DISTINCT d AS doc_id FROM (SELECT unnest([doc_id * 2, doc_id * 3]) AS d FROM documents) WHERE d NOT IN (SELECT doc_id FROM documents)",
    "packed_floats": """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: lpad(printf('%X', (CAST(floor(CAST(x AS DOUBLE) * 127 + 0.5) AS INT) + 256) % 256), 2, '0')), '') AS packed, true AS close FROM embeddings""",
}
