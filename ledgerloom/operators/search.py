"""Hybrid search: ranked lists by words and by vectors, fused whole, best passage a case, behind one protocol with two backends.

A searcher ranks passages by BM25 and by the dot product with a query's vector, and knows each passage's case.
``Passages`` makes its lists from frames at hand; ``Built`` reads an index that ``build`` wrote as tables: postings dealt by
term (a query's terms are looked up before anything is scored), passages, vectors, and a manifest with the embedder's name
and dimension. A vector list is only used if the query's embedder and dimension are the index's; else the search is by words
alone and says so.

Lists are fused whole: ranks come from ``ranked_by_buckets``, so no task sorts a query's list and no list is cut. The query
set is stated; its vectors meet all passages' vectors once.

Where only the best are asked for, no row is made for each query and passage (heads.py). The best ``depth`` of either list are
given their places in both whole lists; what is in neither head has at most 1 / (k + depth) from each list that goes on. If a
query's last wanted score isn't above that, the depth grows, so the answer is that of the whole lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.ranking import ranked_by_buckets
from ledgerloom.operators.heads import Listed, by_vectors, by_words, placed_together
from ledgerloom.operators.retrieval import B, K1, RRF_K, TOP, index, questions, tokens, units, weighed
from ledgerloom.sources.views import table

#: Courts that citations name, and words that on their own name no case.
COURTS = "SCC SCR FCA FC BCCA BCSC ONCA ONSC NSCA NSSC ABCA ABQB SKCA MBCA QCCA QCCS YKCA NLCA PECA TCC CHRT".split()
GENERIC = "canada british columbia ontario quebec alberta saskatchewan manitoba yukon nova scotia brunswick the queen king r v c attorney general minister first nation nations band indian canadian her his majesty of and re".split()
MOST_NAME_WORDS = 5
#: Forms of a citation, from parts: a year, a court and a number; a year in brackets, a volume, a reporter and a page; a slug.
YEAR, GAP, NUMBER = "[0-9]{4}", "[ \\t\\n\\x0B\\f\\r]+", "[0-9]+"
REPORTER = "[.]?[ \\t\\n\\x0B\\f\\r]?".join("scr") + "[.]?"
CITATIONS = (rf"\b{YEAR}{GAP}(?:{'|'.join(COURTS)}){GAP}{NUMBER}\b", rf"\[{YEAR}\]{GAP}{NUMBER}{GAP}{REPORTER}{GAP}{NUMBER}", rf"\b{YEAR}-[a-z]{{2,6}}-{NUMBER}\b")
POSTING_PARTS = 64
MOST_SENT = 4096  # queries whose vectors go to every task
MOST_PLACED = 1 << 20  # passages, over all queries, that are looked up in the other list


class Searcher(Protocol):
    """What a search needs of an index. Lists are (query_id, unit_id, score), higher is better."""

    embedder: tuple[str, int] | None

    def bm25_rank(self, asked: DataFrame) -> DataFrame:
        """asked (query_id, text)."""

    def dense_rank(self, asked: DataFrame) -> DataFrame:
        """asked (query_id, vector)."""

    def case_of(self) -> DataFrame:
        """unit_id, case_id."""

    def in_blocks(self, asked: DataFrame, wanted: DataFrame | None) -> list[Listed] | None:
        """The lists by words (asked) and by vectors (wanted, if there are) that tasks can score by themselves, else None."""


def _weighed(asked: DataFrame, postings: DataFrame, frequency: DataFrame, lengths: DataFrame) -> DataFrame:
    """Terms of the questions first; only their postings are read on."""
    terms = asked.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(frequency, "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    terms = terms.join(F.broadcast(lengths)).select("query_id", "term", idf.alias("idf"), "avgdl")  # lengths is one row
    return postings.join(terms, "term").groupBy("query_id", "unit_id").agg(F.round(F.sum(part), 6).alias("score"))


def _dotted(asked: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Dot products of vectors of the index's dimension; others, and null ones, are left out.

    The stated queries go to every task as one matrix if they are few enough (counted up to the bound only); a larger set
    meets the vectors in a join of blocks.
    """
    sound = lambda c: F.col(c).isNotNull() & (F.size(c) == dim)
    rows, queries = vectors.where(sound("vector")).select("unit_id", "vector"), asked.where(sound("vector")).select("query_id", "vector")
    first = queries.limit(MOST_SENT + 1).collect()
    if len(first) > MOST_SENT:
        dot = F.aggregate(F.zip_with("vector", "q", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
        return rows.join(queries.withColumnRenamed("vector", "q"), F.lit(True)).select("query_id", "unit_id", F.round(dot, 6).alias("score"))
    ids, matrix = np.array([r["query_id"] for r in first], np.int64), np.array([r["vector"] for r in first], float).reshape(len(first), dim)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, (1 << 18) // max(1, len(ids)))
        for pdf in batches:
            for at in range(0, len(pdf) if len(ids) else 0, step):
                part = pdf.iloc[at : at + step]
                scores = np.stack(part["vector"].to_list()).astype(float) @ matrix.T
                yield pd.DataFrame({"query_id": np.tile(ids, len(part)), "unit_id": np.repeat(part["unit_id"].to_numpy(), len(ids)), "score": scores.round(6).ravel() + 0.0})

    return rows.mapInPandas(scored, "query_id long, unit_id string, score double")


def _dealt(rows: DataFrame) -> DataFrame:
    """Passages dealt over tasks by their ids, however the input is cut; the number stands, as scoring them is the work, not their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit_id")


class Passages:
    """Searcher over frames: units (unit_id, case_id, text) and vectors (unit_id, vector)."""

    def __init__(self, units: DataFrame, vectors: DataFrame | None = None, embedder: tuple[str, int] | None = None) -> None:
        self.units, self.vectors, self.embedder = units, vectors, embedder if vectors is not None else None

    def bm25_rank(self, asked: DataFrame) -> DataFrame:
        postings = index(self.units)
        lengths = postings.select("unit_id", "dl").distinct().agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
        return _weighed(asked, postings, postings.groupBy("term").agg(F.count("*").alias("df")), lengths)

    def dense_rank(self, asked: DataFrame) -> DataFrame:
        return _dotted(asked, self.vectors, self.embedder[1])

    def case_of(self) -> DataFrame:
        return self.units.select("unit_id", "case_id")

    def in_blocks(self, asked: DataFrame, wanted: DataFrame | None) -> list[Listed] | None:
        known = weighed(_dealt(self.units), asked)
        if known is None or len(np.unique(known[1]["query_id"])) > MOST_SENT:
            return None
        lists = [by_words(*known, ("score",), K1, B)]
        if wanted is not None:
            sound, dim = lambda c: F.col(c).isNotNull() & (F.size(c) == self.embedder[1]), self.embedder[1]
            first = wanted.where(sound("vector")).select("query_id", "vector").orderBy("query_id").limit(MOST_SENT + 1).collect()
            if len(first) > MOST_SENT:
                return None
            matrix = np.array([[x or 0.0 for x in r["vector"]] for r in first], float).reshape(len(first), dim)
            lists.append(by_vectors(self.vectors.where(sound("vector")), np.array([r["query_id"] for r in first], np.int64), matrix))
        return lists


def build(passages: Passages, folder: str, parts: int = POSTING_PARTS) -> None:
    """Write the index as tables in a folder that the cluster shares: postings by part of term, so that a lookup reads the parts
    of its terms; document frequencies, lengths, passages, vectors, and the manifest last."""
    spark = passages.units.sparkSession
    write = lambda rows, name: rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    postings = index(passages.units).withColumn("part", F.pmod(F.hash("term"), F.lit(parts)))
    postings.repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
    kept = spark.read.parquet(f"{folder}/postings")
    write(kept.groupBy("term").agg(F.count("*").alias("df")), "terms")
    write(kept.select("unit_id", "dl").distinct().agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")), "lengths")
    write(passages.case_of(), "units")
    if passages.embedder:
        write(passages.vectors.select("unit_id", "vector"), "vectors")
    told = json.dumps({"format": 1, "parts": parts, "embedder": passages.embedder and passages.embedder[0], "dim": passages.embedder and passages.embedder[1]})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


class Built:
    """Searcher over the tables that ``build`` wrote."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        told = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
        if told.get("format") != 1:
            raise ValueError(f"unknown index format {told.get('format')}")
        self.spark, self.folder, self.parts = spark, folder, told["parts"]
        self.embedder = (told["embedder"], told["dim"]) if told["embedder"] else None

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def bm25_rank(self, asked: DataFrame) -> DataFrame:
        terms = asked.select(F.explode(tokens(F.col("text"))).alias("term")).distinct().withColumn("part", F.pmod(F.hash("term"), F.lit(self.parts)))
        postings = self._read("postings").join(terms, ["part", "term"], "left_semi")
        return _weighed(asked, postings, self._read("terms"), self._read("lengths"))

    def dense_rank(self, asked: DataFrame) -> DataFrame:
        return _dotted(asked, self._read("vectors"), self.embedder[1])

    def case_of(self) -> DataFrame:
        return self._read("units")

    def in_blocks(self, asked: DataFrame, wanted: DataFrame | None) -> None:
        """Its postings are looked up, not read through."""


def fused(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Whole lists (query_id, unit_id, score) -> (query_id, unit_id, score): the sum of 1 / (k + rank), ranks from zero, over the
    lists that hold the passage. Equal scores are in order of unit_id."""
    out = None
    for rows in lists:
        placed = ranked_by_buckets(rows, ["query_id"], [(F.floor(F.col("score") * 64), True)], [F.desc("score"), F.col("unit_id")])
        out = placed if out is None else out.unionByName(placed)
    return out.groupBy("query_id", "unit_id").agg(F.round(F.sum(1 / (k + F.col("rank") - 1)), 9).alias("score"))


def _by_case(rows: DataFrame, case_of: DataFrame) -> DataFrame:
    """A case has the score of its best passage."""
    return rows.join(case_of, "unit_id").where("case_id IS NOT NULL").groupBy("query_id", "case_id").agg(F.max("score").alias("score"))


def best_fused(lists: list[Listed], top: int, k: int = RRF_K, case_of: DataFrame | None = None, depth: int | None = None) -> DataFrame | None:
    """(query_id, unit_id or case_id, score, rank): the best ``top`` of each query by the fused whole lists; None where so many
    passages would have to be looked up that whole lists are the better way."""
    spark, key = lists[0].rows.sparkSession, "unit_id" if case_of is None else "case_id"
    depth = depth or len(lists) * (k + top) * (1 if case_of is None else 2)  # enough for passages: the last one wanted has 1 / (k + top - 1) or more
    queries = len(np.unique(np.concatenate([x.queries for x in lists])))
    while queries * depth * len(lists) <= MOST_PLACED:
        found, beyond = placed_together(lists, depth)
        ranks = spark.createDataFrame(pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "unit_id": pa.array(found["unit_id"], pa.string()), "rank": pa.array(found["rank"], pa.int64())}))
        rows = ranks.groupBy("query_id", "unit_id").agg(F.round(F.sum(1 / (k + F.col("rank") - 1)), 9).alias("score"))
        if case_of is not None:
            held = case_of.join(F.broadcast(ranks.select("unit_id").distinct()), "unit_id", "left_semi")  # passages that are held here
            rows = _by_case(rows, held)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)  # the best of each list only
        told = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        first = told.collect()
        last = pd.Series({r["query_id"]: r["score"] for r in first if r["rank"] == top}, dtype=float).reindex(beyond.index).fillna(0.0)
        if (last > (beyond / (k + depth)).round(9) + 1e-9).all():
            return spark.createDataFrame(first, told.schema)
        depth *= 4
    return None


def routed(queries: DataFrame, names: DataFrame) -> DataFrame:
    """queries (query_id, text) with reason and use_dense. Citations, and up to five words (not all of them generic) that stand in a
    row in a case's name (names: text), are known items and need no vectors.

    A query is looked up by its rarest word among the names', so a common word is no hot key of the join.
    """
    cited = F.col("text").rlike("(?i)" + "|".join(CITATIONS))
    w = tokens(F.col("text"))
    padded = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    asked = queries.select("query_id", cited.alias("cited"), padded.alias("q"), F.array_distinct(w).alias("words"), (F.size(w).between(1, MOST_NAME_WORDS) & F.exists(w, lambda t: ~t.isin(GENERIC))).alias("short"))
    known = names.select(padded.alias("name"), F.explode(F.array_distinct(w)).alias("word"))
    words = asked.where("short AND NOT cited").select("query_id", "q", F.size("words").alias("all"), F.explode("words").alias("word"))
    rarity = known.join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("names"))
    rarest = words.join(rarity, "word").groupBy("query_id", "q", "all").agg(F.count("*").alias("known"), F.min(F.struct("names", "word")).alias("least")).where("known = all").select("query_id", "q", F.col("least.word").alias("word"))
    hits = rarest.join(known, "word").where(F.contains("name", "q")).select("query_id", F.lit(True).alias("named")).distinct()
    rows = asked.select("query_id", "cited").join(hits, "query_id", "left")
    reason = F.when(F.col("cited"), "citation").when(F.col("named"), "case_name").otherwise("semantic")
    return rows.select("query_id", reason.alias("reason"), (reason == "semantic").alias("use_dense"))


def hybrid_search(searcher: Searcher, asked: DataFrame, names: DataFrame, embedder: tuple[str, int] | None, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """asked (query_id, text, vector or null) -> (query_id, case_id, score, rank, reason, way).

    way tells how a query was searched: 'hybrid'; 'words' for a known item; 'no vectors', 'other embedder' or 'no query vector'
    where vectors were wanted and couldn't be used. A case has the score of its best passage; passages without a case are
    dropped; equal scores are in order of case_id. With top, the best so many cases of each query only.
    """
    lacking = "no vectors" if not searcher.embedder else "other embedder" if embedder != searcher.embedder else None
    routes = asked.join(routed(asked.select("query_id", "text"), names), "query_id")
    usable = F.col("vector").isNotNull() & (F.size("vector") == F.lit(searcher.embedder[1] if searcher.embedder else -1))
    way = F.when(~F.col("use_dense"), "words").when(F.lit(lacking is not None), F.lit(lacking)).when(~usable, "no query vector").otherwise("hybrid")
    routes = routes.withColumn("way", way)
    if top:
        first = routes.limit(MOST_SENT + 1).collect()
        if len(first) <= MOST_SENT:  # held here, so that routes are found once
            routes = routes.sparkSession.createDataFrame(first, routes.schema)
    words, wanted = routes.select("query_id", "text"), None if lacking else routes.where("way = 'hybrid'").select("query_id", "vector")
    lists = searcher.in_blocks(words, wanted) if top else None
    placed = lists and best_fused(lists, top, k, searcher.case_of())
    if placed is None:
        lists = [searcher.bm25_rank(words)] + ([] if lacking else [searcher.dense_rank(wanted)])
        cases = _by_case(fused(lists, k), searcher.case_of())
        placed = ranked_by_buckets(cases, ["query_id"], [(F.floor(F.col("score") * 1_000_000), True)], [F.desc("score"), F.col("case_id")])
        placed = placed.where(F.col("rank") <= top) if top else placed
    return placed.join(routes.select("query_id", "reason", "way"), "query_id")


EMBEDDER = ("stored-64", 64)


THEMES = 500


def _vector_of(key: Column, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Vectors of the themes, and a key's theme: a table with a bound, whatever else is stored."""
    stored = table(spark, sf_dir, "embeddings").where(F.col("vec_id").between(0, THEMES - 1)).select("vec_id", F.col("embedding").alias("vector"))
    return F.broadcast(stored), F.pmod(key, F.lit(THEMES))


def _passages(spark: SparkSession, sf_dir: str) -> Passages:
    """Passages of documents; four of five have a stored vector, as passages of one theme share it."""
    rows = units(spark, sf_dir)
    stored, key = _vector_of(F.col("case_id") * 31 + F.col("i"), spark, sf_dir)
    chunk = rows.where(F.contains("unit_id", F.lit("#chunk#"))).withColumn("i", F.substring_index("unit_id", "#", -1).cast("long")).where("i % 5 <> 4")
    return Passages(rows, _dealt(chunk.select("unit_id", key.alias("vec_id"))).join(stored, "vec_id").select("unit_id", "vector"), EMBEDDER)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated queries of every kind: a citation, a case's opening words, generic words, whole sentences; some without a vector."""
    q = questions(spark, sf_dir)
    first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    text = F.when(F.col("query_id") % 8 == 0, F.concat(F.lit("see 2014 scc "), F.col("query_id").cast("string"))).when(F.col("query_id") % 8 == 1, first).when(F.col("query_id") % 8 == 2, "the British Columbia of and").otherwise(F.col("text"))
    stored, key = _vector_of(F.col("query_id") * 7, spark, sf_dir)
    asked = q.select("query_id", text.alias("text"), F.when(F.col("query_id") % 8 != 7, key).alias("vec_id"))
    return asked.join(stored, "vec_id", "left").select("query_id", "text", "vector")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split("text", "\n")[0].alias("text")
    return table(spark, sf_dir, "benchmark").select(first).unionByName(table(spark, sf_dir, "documents").select(first))


def hybrid_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best cases of each query, with how it was searched."""
    return hybrid_search(_passages(spark, sf_dir), _asked(spark, sf_dir), _names(spark, sf_dir), EMBEDDER, top=TOP)


def rrf_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best passages of each query by both whole lists."""
    passages, asked = _passages(spark, sf_dir), _asked(spark, sf_dir)
    words, wanted = asked.select("query_id", "text"), asked.select("query_id", "vector")
    lists = passages.in_blocks(words, wanted)
    rows = lists and best_fused(lists, TOP)
    if rows is None:
        rows = ranked_by_buckets(fused([passages.bm25_rank(words), passages.dense_rank(wanted)]), ["query_id"], [(F.floor(F.col("score") * 1_000_000), True)], [F.desc("score"), F.col("unit_id")])
    return rows.where(F.col("rank") <= TOP)


def query_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(_asked(spark, sf_dir).select("query_id", "text"), _names(spark, sf_dir))


QUERIES = {f.__name__: f for f in (hybrid_cases, rrf_whole, query_routing)}

_W = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
_SQL = f"""WITH units AS (SELECT concat(doc_id, '#chunk#', i - 1) AS unit_id, doc_id AS case_id, i - 1 AS i, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
UNION ALL SELECT concat(doc_id, '#meta'), doc_id, NULL, concat_ws(' ', lang, source) FROM documents),
words AS (SELECT unit_id, case_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM units),
postings AS (SELECT unit_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT unit_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY 1, 2),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM words WHERE len(w) > 0), freq AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 8 = 0 THEN 'see 2014 scc ' || item_id WHEN item_id % 8 = 1 THEN array_to_string(string_split(text, ' ')[:3], ' ') WHEN item_id % 8 = 2 THEN 'the British Columbia of and' ELSE text END AS text, CASE WHEN item_id % 8 <> 7 THEN item_id * 7 % 500 END AS vec_id FROM benchmark),
terms AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM asked),
bm AS (SELECT query_id, unit_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM terms JOIN freq USING (term) JOIN postings USING (term), stats GROUP BY 1, 2),
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id < 500),
dots AS (SELECT query_id, p.vec_id, round(list_sum(list_transform(list_zip(p.v, q.v), lambda z: z[1] * z[2])), 6) AS score FROM asked a JOIN vecs q ON q.vec_id = a.vec_id, vecs p),
dense AS (SELECT query_id, unit_id, score FROM units u JOIN dots d ON d.vec_id = (case_id * 31 + i) % 500 WHERE i % 5 <> 4),
names AS (SELECT ' ' || {_W.format("string_split(text, chr(10))[1]")} || ' ' AS name FROM benchmark UNION ALL SELECT ' ' || {_W.format("string_split(text, chr(10))[1]")} || ' ' FROM documents),
route AS (SELECT query_id, vec_id, CASE WHEN query_id % 8 = 0 THEN 'citation' WHEN w <> '' AND len(string_split(w, ' ')) <= 5 AND len(list_filter(string_split(w, ' '), lambda x: x NOT IN ({", ".join(f"'{g}'" for g in GENERIC)}))) > 0 AND EXISTS (SELECT 1 FROM names WHERE contains(name, ' ' || w || ' ')) THEN 'case_name' ELSE 'semantic' END AS reason
FROM (SELECT query_id, vec_id, {_W.format("text")} AS w FROM asked)),
ways AS (SELECT query_id, reason, CASE WHEN reason <> 'semantic' THEN 'words' WHEN vec_id IS NULL THEN 'no query vector' ELSE 'hybrid' END AS way FROM route) """


def _fused_sql(dense: str) -> str:
    return f"""(SELECT query_id, unit_id, round(sum(1 / CAST(59 + rank AS DOUBLE)), 9) AS score FROM (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM bm
        UNION ALL SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM {dense}) GROUP BY 1, 2)"""


ORACLE_SQL = {
    "hybrid_cases": _SQL + f"""SELECT query_id, case_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank, reason, way FROM (SELECT query_id, case_id, max(score) AS score FROM {_fused_sql("(SELECT dense.* FROM dense JOIN ways USING (query_id) WHERE way = 'hybrid')")} JOIN units USING (unit_id) GROUP BY 1, 2) JOIN ways USING (query_id) QUALIFY rank <= 10""",
    "rrf_whole": _SQL + f"SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM {_fused_sql('dense')} QUALIFY rank <= 10",
    "query_routing": _SQL + "SELECT query_id, reason, reason = 'semantic' AS use_dense FROM route",
}
