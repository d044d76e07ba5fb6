"""Streams over events, each with the batch that gives the same rows.

The functions that take a frame work on a streaming one and on a batch alike. ``upserted`` drives a real stream over
files with the trigger AvailableNow in update mode: a micro-batch writes the rows that it has changed under its own
number, so a batch replayed after a failure writes the same again, and the latest row of a key counts. State older than
the watermark is dropped, and so are rows that come later than it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ledgerloom.operators import alignment
from ledgerloom.sources.views import table

LATE = "1 day"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a session on one machine without the setting gets one of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return folder or tempfile.mkdtemp(prefix="streams-")


def file_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    return file_stream(spark, sf_dir, "events", files).withColumn("ts", F.col("ts").cast("timestamp"))  # what watermarks take


def upserted(rows: DataFrame, keys: list[str], change=None, schema=None, mode: str = "update") -> DataFrame:
    """Run a stream to the end of its input and read the latest rows of each key.

    change(batch) may make the rows to write of a micro-batch (schema tells theirs); all rows of a key that one batch
    writes count together, so a key's set of rows is replaced as a whole and a row of nulls leaves none.
    """
    spark = rows.sparkSession
    base, schema = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", schema or rows.schema

    def keep(batch: DataFrame, number: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    written = spark.read.schema(schema if isinstance(schema, str) else schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(f"{base}/out")
    last = written.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return written.join(last, [*keys, "batch"]).drop("batch")


def tumbling(rows: DataFrame) -> DataFrame:
    out = rows.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 4).alias("total"))
    return out.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def sliding(rows: DataFrame) -> DataFrame:
    out = rows.withWatermark("ts", LATE).groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("day"), "event_type", "n")


def sessions(rows: DataFrame) -> DataFrame:
    out = rows.withWatermark("ts", LATE).groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("started"), "n")


def rollup(rows: DataFrame) -> DataFrame:
    """Observations of each commitment: count, latest time and status."""
    return rows.groupBy("user_id").agg(F.count("*").alias("observations"), F.max("ts").alias("last_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(tumbling(event_stream(spark, sf_dir)), ["day", "event_type"]).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(rollup(event_stream(spark, sf_dir)), ["user_id"]).select("user_id", "observations", F.col("last_at").cast("timestamp_ntz").alias("last_at"), "status")


def kept_pool(spark: SparkSession, sf_dir: str, folder: str) -> alignment.Pool:
    """The suppliers' tables, written once in the shared folder and read by every micro-batch."""
    tables = alignment.pooled(alignment.suppliers(spark, sf_dir))
    for name, rows in tables._asdict().items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    return alignment.Pool(*[spark.read.parquet(f"{folder}/{name}") for name in tables._fields])


def matches_of(batch: DataFrame, pool: alignment.Pool, sf_dir: str) -> DataFrame:
    """A batch of orders -> the best matches of its commitments: only theirs are made. One without matches has a row of nulls."""
    commitments = table(batch.sparkSession, sf_dir, "commitment", orders=batch)
    rows, candidates = alignment.matched(alignment.procurement(commitments), pool)
    found = rows.select("id", "demand").join(alignment.best_matches(candidates), "demand").select("id", "supplier_id", "score", "rank")
    return batch.select(F.col("o_orderkey").alias("id")).distinct().join(found, "id", "left")


def stream_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of commitments as they are written: each one's set is computed anew and takes the place of the one before."""
    names = "id long, supplier_id long, score double, rank long"
    pool = kept_pool(spark, sf_dir, f"{shared_folder(spark)}/pool-{uuid.uuid4().hex}")
    return upserted(file_stream(spark, sf_dir, "orders"), ["id"], lambda batch: matches_of(batch, pool, sf_dir), f"{names}, batch long", "append").where("supplier_id IS NOT NULL")


def refusals(rows: DataFrame, most: int = 3, seconds: int = 86_400) -> DataFrame:
    """The limiter on a stream: per key, the events that are refused, by state of two numbers. A window opens at a key's first
    event and lasts ``seconds``; events of one micro-batch are taken in time order."""

    def scan(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        times = sorted(us for pdf in batches for us in pdf["us"].tolist())  # a key's events of one micro-batch
        out = []
        for at in times:
            if start is None or at - start >= seconds * 1_000_000:
                start, n = at, 0
            n += 1
            if n > most:
                out.append(at)
        state.update((start, n))
        yield pd.DataFrame({"user_id": key[0], "us": out})

    times = rows.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.unix_micros("ts").alias("us"))
    return times.groupBy("user_id").applyInPandasWithState(scan, "user_id long, us long", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def stream_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused events of each user, counted over the stream's output."""
    return upserted(refusals(event_stream(spark, sf_dir)), ["user_id", "us"], mode="append").groupBy("user_id").agg(F.count("*").alias("refused"))


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(_events(spark, sf_dir))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(_events(spark, sf_dir))


def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_events(spark, sf_dir))


def daily_quota(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """Requests of each user and day, and how many were over the quota."""
    out = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return out.select("user_id", "day", "n", F.greatest(F.lit(0).cast("long"), F.col("n") - most).alias("refused"))


def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each hashed question (type and payload), the last generation of it."""
    key = F.sha2(F.concat_ws("|", F.lower(F.trim("event_type")), "props"), 256)
    return _events(spark, sf_dir).groupBy(key.alias("hash")).agg(F.max("event_id").alias("event_id"), F.count("*").alias("asked"))


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each job from its log: the latest event; attempts grow by each requeue."""
    requeued = F.count_if(F.col("event_type") == "login")
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), (requeued + 1).alias("attempts"))


def stuck_jobs(spark: SparkSession, sf_dir: str, as_of: str = "2024-01-30 00:00:00", minutes: int = 1440) -> DataFrame:
    """Jobs whose latest event is older than the bound at a given time, and the oldest age in seconds."""
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last_at"))
    age = F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col("last_at").cast("timestamp"))
    return last.select(age.alias("age")).where(F.col("age") > minutes * 60 * 1_000_000).agg(F.count("*").alias("stuck"), F.coalesce(F.floor(F.max("age") / 1_000_000), F.lit(0)).cast("long").alias("oldest"))


def failures_allowed(rows: DataFrame, most: int = 3, seconds: int = 86_400) -> DataFrame:
    """Per key, which events are refused: a window opens at its first event, allows ``most`` and lasts ``seconds``.

    The rule looks at a key's events in time order, so they are dealt by key and sorted (spilling if need be); the scan
    holds two numbers of the key that it is at, however many events that key has.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, n, refused, windows = None, 0, 0, 0, 0
        for pdf in batches:
            out = []
            for key, at in zip(pdf["user_id"].tolist(), pdf["us"].tolist(), strict=True):
                if key != user:
                    if user is not None:
                        out.append((user, refused, windows))
                    user, start, n, refused, windows = key, None, 0, 0, 0
                if start is None or at - start >= seconds * 1_000_000:
                    start, n, windows = at, 0, windows + 1
                n += 1
                refused += n > most
            yield pd.DataFrame(out, columns=["user_id", "refused", "windows"])
        if user is not None:
            yield pd.DataFrame([(user, refused, windows)], columns=["user_id", "refused", "windows"])

    times = rows.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return times.repartition("user_id").sortWithinPartitions("user_id", "us").mapInPandas(scan, "user_id long, refused long, windows long")


def failure_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures_allowed(_events(spark, sf_dir))


def as_of_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase, the user's latest earlier event of another kind: an as-of join as one union and window."""
    rows = _events(spark, sf_dir).withColumn("asks", (F.col("event_id") % 10 == 0).cast("int"))
    seen: Column = F.when(F.col("asks") == 0, F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("last", F.last(seen, ignorenulls=True).over(w)).where("asks = 1").select("event_id", F.col("last.event_id").alias("as_of"))


_DAY = "date_trunc('day', ts)"
_TUMBLING = f"SELECT {_DAY} AS day, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2"
_ROLLUP = "SELECT user_id, count(*) AS observations, max(ts) AS last_at, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY 1"
QUERIES = {f.__name__: f for f in (stream_tumbling, stream_rollup, stream_opportunities, stream_refusals, tumbling_counts, sliding_counts, session_users, daily_quota, dedupe_keys, job_state, stuck_jobs, failure_limiter, as_of_status)}
ORACLE_SQL = {
    "stream_tumbling": _TUMBLING,
    "stream_opportunities": alignment.ORACLE_SQL["opportunity_top5"].replace("SELECT concat_ws('::', id, supplier_id) AS key, id,", "SELECT id,"),
    "tumbling_counts": _TUMBLING,
    "stream_rollup": _ROLLUP,
    "sliding_counts": f"SELECT day, event_type, count(*) AS n FROM (SELECT event_type, unnest([{_DAY}, {_DAY} - INTERVAL 1 DAY]) AS day FROM events) GROUP BY 1, 2",
    "session_users": """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS fresh FROM events)) GROUP BY user_id, s""",
    "daily_quota": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, greatest(0, count(*) - 5) AS refused FROM events GROUP BY 1, 2",
    "dedupe_keys": "SELECT sha256(concat_ws('|', lower(trim(event_type)), props)) AS hash, max(event_id) AS event_id, count(*) AS asked FROM events GROUP BY 1",
    "job_state": "SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type = 'login') + 1 AS attempts FROM events GROUP BY 1",
    "stuck_jobs": """SELECT count(*) AS stuck, CAST(coalesce(floor(max(age) / 1000000), 0) AS BIGINT) AS oldest FROM (SELECT epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(max(ts)) AS age FROM events GROUP BY user_id) WHERE age > 86400000000""",
    "as_of_status": """SELECT p.event_id, max_by(e.event_id, (e.ts, e.event_id)) AS as_of FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.event_id % 10 <> 0 AND (e.ts, e.event_id) < (p.ts, p.event_id)
        WHERE p.event_id % 10 = 0 GROUP BY 1""",
}
