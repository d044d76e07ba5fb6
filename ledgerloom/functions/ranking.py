"""Row numbers within large groups without one task a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_by_buckets(rows: DataFrame, group: list[str], bucket: list[tuple[Column, bool]], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their number within the group. The order begins with the bucket's columns (each with whether it falls), then
    goes on with ``order``.

    Rows are numbered within (group, bucket) and shifted by the sizes of the buckets before: a count per bucket, prefix
    sums over those counts and a join by bucket. No task holds more than a bucket, so buckets should be fine.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    held = rows.select("*", *[c.alias(n) for (c, _), n in zip(bucket, names, strict=True)])
    sizes = held.groupBy(*group, *names).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(*[F.desc(n) if falls else F.asc(n) for (_, falls), n in zip(bucket, names, strict=True)]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    held = held.withColumn("_inside", F.row_number().over(Window.partitionBy(*group, *names).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [held[c].eqNullSafe(sizes[c]) for c in (*group, *names)])
    return held.join(sizes, same).select(*[held[c] for c in rows.columns], (F.col("_inside") + F.col("_before")).cast("long").alias(name))
