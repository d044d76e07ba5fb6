"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow served at a rate in proportion to its weight. Its documents stand in a shuffled order (md5 of
seed, doc_id and text); the virtual finish time of a copy of a document is the source's cumulative words up to and with
it, divided by the source's weight; a flow may be served ``max_epochs`` times over, so a copy of a later round finishes
a whole source later. All copies, in order of virtual finish time (ties: by source), are taken until the words taken
reach the budget; the copy at the cut is cut at a word. A long document is served in pieces of ``PIECE`` words, each with
its own finish time, so a source's words come within a piece or two of its target however long its documents are.

Spark's part: one aggregation per (source, bucket of the shuffled order), prefix sums over those few rows, then one
shuffle of the documents by (source, bucket) for the running sum inside a bucket. A hot source is as many buckets as
its rows ask for, so nothing depends on the size of the largest source. The cut: finish times and sizes of all pieces
(narrow rows) are range-sorted, the ranges' totals are added up (a row a range), and a running sum inside the one range
that the budget falls into finds the copy. The windows over sources hold a narrow row a source.

Defined cases: null text is empty (size 0, never taken); a null source is a source of its own, after all others; null
doc_id has the key of the empty string; repeated rows are separate documents; an empty table gives an empty mix; a
source of blank documents has target 0; with max_epochs too few for the budget all copies are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, WORD, documents, settle, whole_text

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_ROWS = 512
PIECE = 256
SEED = "mix"


def shuffle_key(seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(whole_text())))


def source_targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_rank, source_size, weight, target; one row a source.

    The windows here run over one row a source, never over documents.
    """
    ranked = totals.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        ranked.withColumn("weight", F.element_at(cyc, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size").cast("double") * max_epochs)
        .withColumn("all_words", F.sum("source_size").over(Window.partitionBy()).cast("double") * share)
    )
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "source_rank")
    ranked = ranked.withColumn("before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn(
        "weight_left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    left = F.col("all_words") - F.col("before")
    ranked = ranked.withColumn("full", F.col("most") * F.col("weight_left") <= F.col("weight") * left)
    level = F.max(F.when(~F.col("full"), left / F.col("weight_left"))).over(Window.partitionBy())
    return ranked.withColumn("level", level).select(
        "source", "source_rank", "source_size", "weight", F.when(F.col("full"), F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def the_cut(copies: DataFrame, budget: int):
    """(finish, source_rank, words) of the copy (finish, source_rank, size) at which the words taken reach the budget, or None."""
    ranges = settle(copies.where("size > 0").repartitionByRange("finish", "source_rank").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    found = totals.where(F.col("before") + F.col("words") >= budget).orderBy("part").first()
    if found is None:
        return None
    served = F.lit(found["before"]) + F.sum("size").over(Window.partitionBy("part").orderBy("finish", "source_rank").rowsBetween(Window.unboundedPreceding, 0))
    inside = ranges.where(F.col("part") == found["part"]).withColumn("served", served)
    return inside.where(F.col("served") >= budget).orderBy("finish", "source_rank").select("finish", "source_rank", (F.lit(budget) - F.col("served") + F.col("size")).alias("words")).first()


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS, keep: tuple = ()) -> DataFrame:
    """Every document with size, source_size, target, virtual_finish (of its first copy) and the words taken of each copy.

    ``keep`` names further input columns to carry along; copies is an array of ``max_epochs`` longs.
    """
    n_buckets = max(1, -(-docs.count() // bucket_rows))
    rows = docs.select("doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"), shuffle_key(seed).alias("_key"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * n_buckets / 2.0**32).cast("long"))
    parts = settle(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("words")))
    sources = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    known = F.broadcast(sources) if sources.count() <= 10_000 else sources  # the size is checked
    before = Window.partitionBy("source_rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.join(known, parts["source"].eqNullSafe(known["source"]))
        .select("source_rank", "source_size", "weight", "target", "_bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_before"), parts["source"].alias("_source"))
        .withColumn("_has_source", F.col("_source").isNotNull())
        .withColumn("_source", F.coalesce("_source", F.lit("")))
    )
    placed = (
        rows.withColumn("_has_source", F.col("source").isNotNull())
        .withColumn("_source", F.coalesce("source", F.lit("")))
        .drop("source")
        .join(offsets, ["_has_source", "_source", "_bucket"])
    )
    so_far = Window.partitionBy("_has_source", "_source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.col("_before") + F.sum("size").over(so_far))
    rank, size, weight = F.col("source_rank"), F.col("size"), F.col("weight")
    begin = [F.col("_end") - size + F.col("source_size") * e for e in range(max_epochs)]
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), F.lit(PIECE).cast("long"))  # first words
    stop = lambda at: F.least(size, at + PIECE)

    def in_pieces(b: Column) -> Column:
        return F.transform(pieces, lambda at: F.struct(((b + stop(at)) / weight).alias("finish"), (stop(at) - at).alias("size")))

    served = [in_pieces(b) for b in begin]
    budget = int((parts.agg(F.sum("words")).first()[0] or 0) * share)
    cut = the_cut(placed.where("size > 0").select("source_rank", F.inline(F.flatten(F.array(*served)))), budget) if budget else None

    def taken(b: Column, own: Column) -> Column:
        if cut is None:
            return size if budget else F.lit(0).cast("long")
        words = lambda x: F.when((x["finish"] < cut["finish"]) | ((x["finish"] == cut["finish"]) & (rank < cut["source_rank"])), x["size"]).when(
            (x["finish"] == cut["finish"]) & (rank == cut["source_rank"]), F.lit(cut["words"]).cast("long")
        ).otherwise(F.lit(0).cast("long"))
        in_service = F.aggregate(own, F.lit(0).cast("long"), lambda so_far, x: so_far + words(x))
        return F.when((b + size) / weight < cut["finish"], size).when(b / weight > cut["finish"], F.lit(0).cast("long")).when(size > 0, in_service).otherwise(F.lit(0).cast("long"))

    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("_end") / weight).alias("virtual_finish"),
        (F.col("source_size") / F.col("weight")).alias("virtual_epoch"),
        F.array(*map(taken, begin, served)).alias("copies"),
        *[F.col(f"_keep_{c}").alias(f"kept_{c}") for c in keep],
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows, one a copy, with the columns of documents, range-sorted by virtual finish time.

    A copy cut by the budget has its first words only, joined by one blank; n_chars follows the text.
    """
    names = docs.columns
    rows = mix(docs, keep=tuple(names), **options)
    rows = rows.select("*", F.posexplode("copies").alias("epoch", "taken")).where(F.col("taken") > 0)
    rows = rows.withColumn("finish", F.col("virtual_finish") + F.col("epoch") * F.col("virtual_epoch"))
    text = F.when(F.col("taken") == F.col("size"), F.col("kept_text")).otherwise(F.array_join(F.slice(F.filter(F.split("kept_text", rf"[{BLANKS}]+"), lambda w: w != ""), 1, F.col("taken").cast("int")), " "))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id").select(*[new.get(c, F.col(f"kept_{c}")).alias(c) for c in names])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "virtual_finish")
    return rows.repartitionByRange("virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id")


OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS k
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM totals),
weighed AS (
  SELECT *, CAST([5, 2, 1][(r - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS most,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.0 AS all_words
  FROM ranked),
filled AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
         sum(weight) OVER (ORDER BY most / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed),
levels AS (SELECT *, most * weight_left <= weight * (all_words - before) AS is_full FROM filled),
targets AS (
  SELECT source, source_size, weight, r,
         CASE WHEN is_full THEN most ELSE weight * max(CASE WHEN NOT is_full THEN (all_words - before) / weight_left END) OVER () END AS target
  FROM levels),
placed AS (
  SELECT rows.doc_id, rows.size, t.source_size, t.target, t.weight, t.r, row_number() OVER () AS n,
         CAST(sum(rows.size) OVER (PARTITION BY rows.source ORDER BY rows.k, rows.doc_id, rows.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM rows JOIN targets t ON rows.source IS NOT DISTINCT FROM t.source),
pieces AS (SELECT *, unnest(range(0, size, 256)) AS first_word FROM placed WHERE size > 0),
copies AS (
  SELECT n, least(256, size - first_word) AS size, r, (stop - size + source_size * e + least(size, first_word + 256)) / weight AS finish
  FROM pieces, range(3) AS epochs(e)),
served AS (
  SELECT n, size, CAST(sum(size) OVER (ORDER BY finish, r ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS earlier FROM copies),
taken AS (
  SELECT n, CAST(sum(greatest(0, least(size, (SELECT sum(size) FROM rows) - earlier))) AS BIGINT) AS taken FROM served GROUP BY n)
SELECT doc_id, size, source_size, target, stop / weight AS virtual_finish, coalesce(taken, 0) AS taken
FROM placed LEFT JOIN taken USING (n)
"""
