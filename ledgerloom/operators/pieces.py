"""Texts in pieces that carry their text: retrieval pieces, extraction pieces, page-marked pieces; sentence units and the order
in which two readings have them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import splitting as S
from ledgerloom.functions.text import alnum
from ledgerloom.sources.views import table

LEAST_WORDS = 8


def case_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval pieces of every text, numbered, with their digests."""
    return _told(S.pieces(_paragraphed(spark, sf_dir), S.case_pieces))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction pieces of every text."""
    return _told(S.pieces(_paragraphed(spark, sf_dir), S.document_pieces))


def _paragraphed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose every seventh line ends a paragraph."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 7 == 6, F.lit("\n \n")).when(i > 0, F.lit("\n")).otherwise(""), x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "").alias("text"))


def _told(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "i", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def page_marked(paragraphs: DataFrame, limit: int = 6000) -> DataFrame:
    """paragraphs (doc_id, page, para, text) -> (doc_id, page, para, i, text): each piece under its page's mark, in any order of
    rows; a document's text is its pieces in order of page, para and i, a blank line between them."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, page, para, i, piece) for d, page, para, text in zip(pdf["doc_id"], pdf["page"], pdf["para"], pdf["text"], strict=True) for i, piece in enumerate(S.marked_pieces([(page, text)], limit))]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "page", "para", "i", "text"])

    rows = paragraphs.select("doc_id", "page", "para", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(split, "doc_id long, page long, para long, i long, text string")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs of pages of ten, under a limit that long ones pass."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "text"))
    rows = lines.select("doc_id", (F.floor(F.col("para") / 10) + 1).alias("page"), F.col("para").cast("long").alias("para"), "text")
    return page_marked(rows, 300).select("doc_id", "page", "para", "i", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def reference_units(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """rows (doc_id, text with [p.N] marks) -> (doc_id, unit, page, key): sentences of enough words, normalised, as the first 16
    hex digits of their SHA-256, numbered in order of the text; a block without a mark is of the page before it."""
    blocks = rows.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("block", "text"))
    mark = F.regexp_extract("text", r"^\s*\[p\.(\d+)\]", 1)
    seen = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paged = blocks.withColumn("page", F.coalesce(F.last(F.when(mark != "", mark.cast("long")), ignorenulls=True).over(seen), F.lit(0).cast("long")))
    units = paged.select("doc_id", "block", "page", F.posexplode(F.split(F.regexp_replace("text", r"\[p\.\d+\]", " "), r"(?<=[.!?])\s+")).alias("place", "text"))
    units = units.withColumn("key", alnum(F.col("text"))).where(F.size(F.split("key", " ")) >= least)
    order = Window.partitionBy("doc_id").orderBy("block", "place")
    return units.select("doc_id", F.row_number().over(order).cast("long").alias("unit"), "page", F.substring(F.sha2("key", 256), 1, 16).alias("key"))


def inversions_of(places: list[int]) -> int:
    """Pairs that stand in falling order, by a tree of counts over the places' ranks: n log n."""
    rank = {p: i + 1 for i, p in enumerate(sorted(set(places)))}
    tree, total = [0] * (len(rank) + 1), 0
    for seen, place in enumerate(places):
        at, before = rank[place], 0
        while at:
            before += tree[at]
            at &= at - 1
        total += seen - before
        at = rank[place]
        while at < len(tree):
            tree[at] += 1
            at += at & -at
    return total


def order_inversions(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, unit, place) -> (key, units, inversions): pairs of units that the two readings order differently. A group is one
    document's units, read in order from a sorted partition."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, places = None, []
        for pdf in batches:
            out = []
            for k, place in zip(pdf[key].tolist(), pdf["place"].tolist(), strict=True):
                if places and k != last:
                    out.append((last, len(places), inversions_of(places)))
                    places = []
                last = k
                places.append(place)
            yield pd.DataFrame(out, columns=[key, "units", "inversions"])
        if places:
            yield pd.DataFrame([(last, len(places), inversions_of(places))], columns=[key, "units", "inversions"])

    rows = rows.select(F.col(key).cast("long").alias(key), F.col("unit").cast("long").alias("unit"), F.col("place").cast("long").alias("place"))
    return rows.repartition(key).sortWithinPartitions(key, "unit", "place").mapInPandas(count, f"{key} long, units long, inversions long")


def _marked(spark: SparkSession, sf_dir: str, turned: bool) -> DataFrame:
    """Documents with a page mark at every fourth line; turned: each page's two halves the other way round."""
    n = F.posexplode(F.split("text", "\n")).alias("i", "line")
    lines = table(spark, sf_dir, "documents").select("doc_id", n).select("doc_id", "i", F.floor(F.col("i") / 4).alias("page"), "line")
    at = F.col("page") * 4 + (F.col("i") + 2) % 4 if turned else F.col("i")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "page", "line"))), lambda r: F.concat(F.lit("[p."), (r["page"] + 1).cast("string"), F.lit("]\n"), r["line"])), "\n\n")
    return lines.groupBy("doc_id").agg(text.alias("text"))


def unit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that two readings share once each, and how many pairs of them stand the other way round."""
    once = lambda rows: rows.groupBy("doc_id", "key").agg(F.min("unit").alias("unit"), F.count("*").alias("n")).where("n = 1").drop("n")
    a, b = (once(reference_units(_marked(spark, sf_dir, t))) for t in (False, True))
    return order_inversions(a.join(b.withColumnRenamed("unit", "place"), ["doc_id", "key"]), "doc_id")


def units_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_units(_marked(spark, sf_dir, False)).groupBy("doc_id", "page").agg(F.count("*").alias("units"), F.min("key").alias("least"))


QUERIES = {f.__name__: f for f in (case_chunks, document_chunks, marked_pages, unit_order, units_by_page)}

_SPACE = r"[\t\n\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_EDGES = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ', chr(160), chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201), chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288), chr(65279))"
_LINED = "lined AS (SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 7 = 0 THEN chr(10) || ' ' || chr(10) WHEN i > 1 THEN chr(10) ELSE '' END || x), lambda a, b: a || b) AS text FROM documents)"


def _folded(table_: str, ends: str, size: str, limit: str) -> str:
    """Paragraphs (doc_id, p, text) -> packed (doc_id, p, piece, text): sentences put together up to the limit."""
    return rf"""units AS (SELECT doc_id, p, i, s[i] AS text, {size.format("s[i]")} AS n, CASE WHEN {size.format("text")} <= {limit} THEN 1 ELSE len(s) END AS last FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (
        SELECT *, CASE WHEN {size.format("text")} <= {limit} THEN [text] ELSE list_filter(string_split(regexp_replace(text, '({ends}){_SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') END AS s FROM {table_}))),
        fold AS (SELECT doc_id, p, i, n AS held, 0 AS piece FROM units WHERE i = 1 UNION ALL SELECT u.doc_id, u.p, u.i, CASE WHEN f.held + 1 + u.n > {limit} THEN u.n ELSE f.held + 1 + u.n END, f.piece + CAST(f.held + 1 + u.n > {limit} AS INT)
        FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.p = f.p AND u.i = f.i + 1),
        packed AS (SELECT f.doc_id, f.p, f.piece, string_agg(u.text, ' ' ORDER BY u.i) AS text FROM fold f JOIN units u USING (doc_id, p, i) GROUP BY ALL)"""


_PARAGRAPHS = rf"""{_LINED}, split AS (SELECT doc_id, string_split_regex(text, '\n{_SPACE}*\n') AS l FROM lined),
paras AS (SELECT doc_id, p, trim(l[p], {_EDGES}) AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM split) WHERE trim(l[p], {_EDGES}) <> '')"""
_MARKED = r"""lines AS (SELECT doc_id, i - 1 AS i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
sides AS (SELECT doc_id, false AS turned, i AS spot, i // 4 AS page, line FROM lines UNION ALL SELECT doc_id, true, i // 4 * 4 + (i + 2) % 4, i // 4, line FROM lines),
texts AS (SELECT doc_id, turned, string_agg('[p.' || (page + 1) || ']' || chr(10) || line, chr(10) || chr(10) ORDER BY spot, page, line) AS text FROM sides GROUP BY 1, 2),
blocks AS (SELECT doc_id, turned, b, l[b] AS text FROM (SELECT doc_id, turned, l, unnest(range(1, len(l) + 1)) AS b FROM (SELECT doc_id, turned, string_split_regex(text, '\n[ \t\n\v\f\r]*\n') AS l FROM texts))),
paged AS (SELECT *, coalesce(last_value(CAST(nullif(regexp_extract(text, '^[ \t\n\v\f\r]*\[p\.([0-9]+)\]', 1), '') AS BIGINT) IGNORE NULLS) OVER (PARTITION BY doc_id, turned ORDER BY b), 0) AS page FROM blocks),
sentences AS (SELECT doc_id, turned, b, page, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(regexp_replace(regexp_replace(text, '\[p\.[0-9]+\]', ' ', 'g'), '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM paged)),
units AS (SELECT doc_id, turned, page, row_number() OVER (PARTITION BY doc_id, turned ORDER BY b, i) AS unit, substr(sha256(key), 1, 16) AS key FROM (SELECT *, trim(regexp_replace(lower(s[i]), '[^a-z0-9]+', ' ', 'g')) AS key FROM sentences) WHERE len(string_split(key, ' ')) >= 8)"""
ORACLE_SQL = {
    "case_chunks": f"WITH RECURSIVE {_PARAGRAPHS}, {_folded('paras', '[.!?]', 'strlen({})', '2048')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, piece) - 1 AS i, length(text) AS chars, md5(text) AS digest FROM packed",
    "document_chunks": f"""WITH RECURSIVE {_PARAGRAPHS}, {_folded('paras', '[.]', 'length({})', '6000')}, ordered AS (SELECT doc_id, text, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY p, piece) AS i FROM packed),
        chunks AS (SELECT doc_id, i, n AS held, 0 AS chunk FROM ordered WHERE i = 1 UNION ALL SELECT o.doc_id, o.i, CASE WHEN c.held + 2 + o.n > 6000 THEN o.n ELSE c.held + 2 + o.n END, c.chunk + CAST(c.held + 2 + o.n > 6000 AS INT) FROM chunks c JOIN ordered o ON o.doc_id = c.doc_id AND o.i = c.i + 1),
        whole AS (SELECT doc_id, CAST(chunk AS BIGINT) AS i, string_agg(text, chr(10) || chr(10) ORDER BY o.i) AS text FROM chunks c JOIN ordered o USING (doc_id, i) GROUP BY ALL) SELECT doc_id, i, length(text) AS chars, md5(text) AS digest FROM whole""",
    "marked_pages": f"""WITH RECURSIVE lines AS (SELECT doc_id, p - 1 AS p, (p - 1) // 10 + 1 AS page, trim(l[p], {_EDGES}) AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(l[p], {_EDGES}) <> ''),
        {_folded('lines', '[.]', 'length({})', "(300 - length('[p.' || (p // 10 + 1) || ']') - 1)").replace("f.held + 1 + u.n > (300 - length('[p.' || (p", "f.held + 1 + u.n > (300 - length('[p.' || (u.p")}
        SELECT doc_id, p // 10 + 1 AS page, p AS para, CAST(piece AS BIGINT) AS i, length(text) + length('[p.' || (p // 10 + 1) || ']') + 1 AS chars, md5('[p.' || (p // 10 + 1) || ']' || chr(10) || text) AS digest FROM packed""",
    "unit_order": f"""WITH {_MARKED}, once AS (SELECT doc_id, turned, key, min(unit) AS unit FROM units GROUP BY 1, 2, 3 HAVING count(*) = 1), shared AS (SELECT a.doc_id, a.unit, b.unit AS place FROM once a JOIN once b ON a.doc_id = b.doc_id AND a.key = b.key AND NOT a.turned AND b.turned)
        SELECT a.doc_id, count(DISTINCT a.unit) AS units, count(b.unit) AS inversions FROM shared a LEFT JOIN shared b ON a.doc_id = b.doc_id AND a.unit < b.unit AND a.place > b.place GROUP BY 1""",
    "units_by_page": f"WITH {_MARKED} SELECT doc_id, page, count(*) AS units, min(key) AS least FROM units WHERE NOT turned GROUP BY 1, 2",
}
