"""Late rows, replaced sets and state across micro-batches of real streams."""

import time

from pyspark.sql import functions as F

from ledgerloom.streaming import flows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def written(spark, folder, name, *batches, schema=EVENTS):
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string"))
        if "ts" in frame.columns:
            frame = frame.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        frame.coalesce(1).write.parquet(f"{folder}/tmp{n}")
        next((folder / f"tmp{n}").glob("*.parquet")).rename(folder / f"{name}{'' if n == 0 else n}.parquet")
        time.sleep(1.1)  # the stream takes files by their time
    return str(folder)


def test_late_rows_are_dropped_and_windows_updated(spark, tmp_path):
    on = lambda i, day: (i, f"2024-01-{day:02d} 01:00:00", 1, "view", 1.0, "{}")
    folder = written(spark, tmp_path, "events", [on(1, 1), on(2, 20)], [on(3, 20), on(4, 19)], [on(5, 2), on(6, 20)])
    found = {r["day"].day: r["n"] for r in flows.stream_tumbling(spark, folder).collect()}
    assert found == {1: 1, 20: 3, 19: 1}  # the row of January 2 came after the watermark had passed it


def test_limiter_keeps_its_state_across_batches(spark, tmp_path):
    at = lambda i, s: (i, f"2024-01-01 00:00:{s:02d}", 1, "error", 1.0, "{}")
    folder = written(spark, tmp_path, "events", [at(1, 0), at(2, 1)], [at(3, 2), at(4, 3)], [at(5, 4)])
    assert [tuple(r) for r in flows.stream_refusals(spark, folder).collect()] == [(1, 2)]


def test_stream_limiter_equals_the_batch(spark, sf_dir):
    batch = {r["user_id"]: r["refused"] for r in flows.failure_limiter(spark, sf_dir).collect() if r["refused"]}
    assert {r["user_id"]: r["refused"] for r in flows.stream_refusals(spark, sf_dir).collect()} == batch


def test_a_set_is_replaced_as_a_whole(spark, tmp_path):
    folder = written(spark, tmp_path, "orders", [(1, 5), (2, 6)], [(1, 7)], schema="o_orderkey long, v long")
    rows = flows.file_stream(spark, folder, "orders")
    some = lambda batch: batch.select("o_orderkey", F.explode(F.when(F.col("v") == 7, F.array(F.lit(None).cast("long"))).otherwise(F.array("v", F.col("v") + 1))).alias("v"))
    found = flows.upserted(rows, ["o_orderkey"], some, "o_orderkey long, v long, batch long", "append").where("v IS NOT NULL")
    assert sorted(map(tuple, found.collect())) == [(2, 6), (2, 7)]
