"""Pages as bytes: the charset that they declare, their text, and how much of it didn't decode.

``binaryFile`` gives files as bytes; what follows are column functions over any column of bytes. The charset is that of the
content type, else that of a <meta> in the first two kilobytes, else windows-1252, which also stands for what calls itself
Latin-1 and for names that are no charset.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.views import table

#: The charset for pages that declare none or Latin-1, and how far a declaration is looked for.
USUAL, LATIN, LOOKED_AT = "windows-1252", ("iso-8859-1", "latin1"), 2048


def declared_charset(content_type: Column, data: Column) -> Column:
    head = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([^;\s]+)", 1)
    meta = F.regexp_extract(F.decode(F.substring(data, 1, LOOKED_AT), "ISO-8859-1"), r"""(?i)<meta[^>]+charset=["']?([\w-]+)""", 1)
    name = F.lower(F.when(head != "", head).when(meta != "", meta).otherwise(USUAL))
    return F.when(name.isin(*LATIN), USUAL).otherwise(name)


def _decoded(data: pd.Series, charset: pd.Series) -> pd.DataFrame:
    known: dict[str, str] = {}
    rows = []
    for b, name in zip(data, charset, strict=True):
        if b is None:
            rows.append((None, None, 0))
            continue
        if name not in known:
            try:
                known[name] = name if codecs.lookup(name)._is_text_encoding else USUAL
            except LookupError:
                known[name] = USUAL
        text = bytes(b).decode(known[name], "replace")
        rows.append((text.removeprefix("﻿"), known[name], text.count("�")))
    return pd.DataFrame(rows, columns=["text", "charset", "damaged"])


def decoded(data: Column, content_type: Column | None = None) -> Column:
    """Struct of text, the charset used, and the number of characters that didn't decode; null bytes are a null text."""
    charset = declared_charset(F.lit(None).cast("string") if content_type is None else content_type, data)
    return F.pandas_udf(_decoded, "struct<text: string, charset: string, damaged: long>")(data, charset)


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and decoded page of each file of a folder."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", decoded(F.col("content")).alias("d")).select("path", "d.*")


def page_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages sent in four charsets, declared in the content type, in the page, wrongly or not at all, and decoded again."""
    n = F.col("page_id") % 5
    html = F.regexp_replace("html", "[^\\x00-\\xff]", "?")
    meta = F.concat(F.when(n == 1, "<meta charset='utf-8'>").when(n == 3, '<META http-equiv="x" content="text/html; charset=ISO-8859-1">').otherwise(""), html, F.lit(" é è"))
    data = F.when(n == 0, F.encode(meta, "UTF-16LE")).when(n == 1, F.encode(meta, "UTF-8")).when(n == 4, F.encode(meta, "UTF-8")).otherwise(F.encode(meta, "ISO-8859-1"))
    told = F.when(n == 0, "text/html; charset=utf-16le").when(n == 2, "text/html; charset=no-such").when(n == 4, "text/html;charset=UTF-8; x=1")
    rows = table(spark, sf_dir, "pages").select("page_id", decoded(data, told).alias("d"), meta.alias("sent"))
    return rows.select("page_id", "d.charset", "d.damaged", (F.col("d.text") == F.col("sent")).alias("same"), F.md5("d.text").alias("digest"))


QUERIES = {"page_charsets": page_charsets}
ORACLE_SQL = {
    "page_charsets": r"""WITH p AS (SELECT page_id, page_id % 5 AS n, concat(CASE page_id % 5 WHEN 1 THEN '<meta charset=''utf-8''>' WHEN 3 THEN '<META http-equiv="x" content="text/html; charset=ISO-8859-1">' ELSE '' END, regexp_replace(html, '[^\x00-\x{ff}]', '?', 'g'), ' é è') AS sent FROM pages)
        SELECT page_id, ['utf-16le', 'utf-8', 'windows-1252', 'windows-1252', 'utf-8'][n + 1] AS charset, 0 AS damaged, true AS same, md5(sent) AS digest FROM p""",
}
