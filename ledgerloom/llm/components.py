"""Connected components of a sparse link table, by alternating large-star and small-star rounds.

Each round is two aggregations and joins over the links alone; nothing is gathered on the driver but a count and a
checksum, and every round is checkpointed, so a lost executor costs no more than its part of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import settle


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v: long) -> (node, root) for every node with a link but the roots; root is the least node reachable."""
    now, last = settle(_small_star(links)), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, last = settle(_small_star(_large_star(now))), sign
