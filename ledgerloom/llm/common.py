"""Small helpers shared by the training-data operators.

Every operator selects the columns it needs by name before it adds any of its own, so extra input columns
(clashing names included) are ignored unless its docstring says that they are carried through.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six blanks.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster shares (spark.checkpoint.dir).

    A session on one machine (a test) without that setting gets a folder of its own; on a cluster it is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def whole_text() -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, though body names it often."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, rf"[{BLANKS}]+"), lambda w: w != "")


def slices(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so much text each."""
    a = total = 0
    for b, size in enumerate(sizes):
        if total and total + size > most:
            yield a, b
            a, total = b, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def groups(batches: Iterator, by: list[str]) -> Iterator:
    """Whole groups (pandas frames) of a stream of frames whose rows are sorted by these columns; one is held at a time."""
    import pandas as pd

    parts, last = [], None
    for pdf in batches:
        for name, part in pdf.groupby(by, sort=False):
            if parts and name != last:
                yield pd.concat(parts)
                parts = []
            parts.append(part)
            last = name
    if parts:
        yield pd.concat(parts)


def given_back(rows: Iterator) -> Iterator:
    """The rows of a task; at their end, memory that the worker no longer uses goes back to the system, since workers are reused."""
    import ctypes
    import ctypes.util

    import pyarrow as pa

    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim"):
            libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
