"""Matching commitments with verified suppliers: weighted fit of sector, capability terms, tier and ownership; best matches.

Every verified supplier is a candidate for every procurement commitment, but few pairs are made. Commitments with the same
sector and terms are one demand. Terms are told apart by how many suppliers have them. Rare ones (MOST_RARE suppliers at
most) are looked up: few pairs each. Frequent ones make classes: suppliers with the same sector, length and frequent terms
have the same relevance to all demands with the same sector and frequent terms (a signature), so signatures meet classes, of
which only the best few members by tier and ownership can matter. Of these a signature keeps the suppliers that fewer than
``top`` others beat in both relevance and the rest of the fit; whatever a demand's rare terms do to the scale of relevance,
its best matches are among those and the suppliers with a rare term in common. So the pairs of a demand don't grow with the
pool, and a stream can match new commitments against the pool's kept tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import B, K1, tokens
from ledgerloom.sources.views import oracle, table

#: Weights of sector, relevance, tier and ownership; weight of each tier.
WEIGHTS = (0.45, 0.25, 0.2, 0.1)
TIERS = {"nation_certified": 1.0, "ccib_certified": 0.9, "self_declared": 0.4}
LEAST, TOP = 0.5, 5
MOST_RARE = 16  # suppliers with a term that is looked up
#: Keyword to sector, the first hit wins.
SECTORS = (("auto", "transport"), ("build", "construction"), ("furni", "retail"), ("machin", "manufacturing"), ("house", "services"))


def sector_of(c: Column) -> Column:
    out = F.when(F.lower(c).contains(SECTORS[0][0]), SECTORS[0][1])
    for word, sector in SECTORS[1:]:
        out = out.when(F.lower(c).contains(word), sector)
    return out.otherwise("other")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier_id, sector, text (what it can do), fixed (the part of its fit that hangs on itself), tier, ownership_pct."""
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.col("tier"))
    own = F.least(F.lit(1.0), F.coalesce("ownership_pct", F.lit(51)) / 100.0)
    rows = table(spark, sf_dir, "party").where("verification = 'verified'")
    return rows.select("supplier_id", "sector", F.concat_ws(" ", "supplier_name", "sector", "region", F.replace("tier", F.lit("_"), F.lit(" "))).alias("text"), (WEIGHTS[2] * tier + WEIGHTS[3] * own).alias("fixed"), "tier", "ownership_pct")


def once(rows: DataFrame) -> DataFrame:
    """Small tables that a plan reads several times: held (on disk where memory is short) once computed, made again if lost."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


class Pool(NamedTuple):
    """Tables of verified suppliers that demands are matched with."""

    terms: DataFrame  # term, rare
    rare: DataFrame  # term, supplier_id, part: the term's share of BM25
    class_terms: DataFrame  # class, term, part
    members: DataFrame  # supplier_id, class, sector, fixed
    tops: DataFrame  # class, supplier_id, sector, fixed: the best few members
    anyone: DataFrame  # supplier_id, sector, fixed: the best few of each sector and of all


def pooled(pool: DataFrame, top: int = TOP, most_rare: int = MOST_RARE) -> Pool:
    """pool (supplier_id, sector, text, fixed) -> its tables."""
    words = pool.select("supplier_id", "sector", "fixed", tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    sizes = words.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    postings = words.select("supplier_id", "dl", F.explode("w").alias("term")).groupBy("supplier_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(sizes)).select("term", (F.col("df") <= most_rare).alias("rare"), idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = once(postings.join(terms, "term").select("supplier_id", "term", "tf", "dl", "rare", part.alias("part")))
    common = F.array_sort(F.collect_list(F.when(~F.col("rare"), F.concat_ws(":", "term", "tf"))))  # a supplier's own words
    shape = words.select("supplier_id", "sector", "fixed", "dl").join(weighed.groupBy("supplier_id").agg(common.alias("common")), "supplier_id", "left")
    members = once(shape.select("supplier_id", F.xxhash64("sector", "dl", "common").alias("class"), "sector", "fixed"))
    class_terms = weighed.where("NOT rare").join(members.select("supplier_id", "class"), "supplier_id").groupBy("class", "term").agg(F.max("part").alias("part"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fixed"), "supplier_id"))
    tops = members.withColumn("r", first("class")).where(F.col("r") <= top).drop("r")
    own = members.withColumn("r", first("sector")).where(F.col("r") <= top).drop("r", "class")
    overall = members.drop("class").orderBy(F.desc("fixed"), "supplier_id").limit(top)
    return Pool(weighed.select("term", "rare").distinct(), weighed.where("rare").select("term", "supplier_id", "part"), class_terms, members, tops, own.unionByName(overall).distinct())


def demands(rows: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commitments (id, sector, text, ...) with the hash of their demand, and the demands (demand, sector, terms).

    Terms that no supplier has don't tell demands apart.
    """
    known = rows.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(terms.select("term"), "term")
    known = known.groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))  # a commitment's own words
    rows = once(rows.join(known, "id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).withColumn("demand", F.xxhash64("sector", "terms")))
    return rows.drop("terms"), rows.groupBy("demand").agg(F.min("sector").alias("sector"), F.min("terms").alias("terms"))


def unbeaten(rows: DataFrame, top: int = TOP) -> DataFrame:
    """rows (sig, supplier_id, rest, part) -> those that fewer than top others beat in both; rests closer than what rounding may
    turn round don't beat each other."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("less"), (-F.col("rest")).alias("lower"), "supplier_id", "rest", "part")))
    start = F.struct(F.array().cast("array<double>").alias("best"), F.array().cast("array<struct<supplier_id:bigint,part:double>>").alias("kept"))

    def step(acc, r):
        held = (F.size(acc["best"]) < top) | (r["rest"] > F.element_at(acc["best"], -1) - 2e-6)
        best = F.slice(F.sort_array(F.concat(acc["best"], F.array(r["rest"])), asc=False), 1, top)
        kept = F.concat(acc["kept"], F.array(F.struct(r["supplier_id"].alias("supplier_id"), r["part"].alias("part"))))
        return F.when(held, F.struct(best.alias("best"), kept.alias("kept"))).otherwise(acc)

    kept = rows.groupBy("sig").agg(F.aggregate(ordered, start, step)["kept"].alias("kept"))  # a few members of each class
    return kept.select("sig", F.explode("kept").alias("k")).select("sig", "k.supplier_id", "k.part")


def scored(wanted: DataFrame, pool: Pool, top: int = TOP) -> DataFrame:
    """demands -> (demand, supplier_id, sector_match, relevance, score) of the suppliers that can be among the best ``top``."""
    asked = once(wanted.select("demand", "sector", F.explode_outer("terms").alias("term")).join(pool.terms, "term", "left"))
    signed = asked.groupBy("demand", "sector").agg(F.array_sort(F.collect_list(F.when(~F.col("rare"), F.col("term")))).alias("frequent")).withColumn("sig", F.xxhash64("sector", "frequent"))
    signed = once(signed)
    sigs = signed.groupBy("sig").agg(F.min("sector").alias("wants"), F.min("frequent").alias("frequent"))
    common = sigs.select("sig", F.explode("frequent").alias("term")).join(pool.class_terms, "term").groupBy("sig", "class").agg(F.sum("part").alias("part"))
    common = once(common)
    members = common.join(pool.tops.select("class", "supplier_id"), "class").select("sig", "supplier_id", "part")
    others = sigs.join(F.broadcast(pool.anyone), F.lit(True)).select("sig", "supplier_id", F.lit(0.0).alias("part"))  # top rows of each sector
    able = members.unionByName(others).groupBy("sig", "supplier_id").agg(F.max("part").alias("part"))
    facts = pool.members.select("supplier_id", F.col("sector").alias("has"), "fixed")
    rest = WEIGHTS[0] * (F.col("has") == F.col("wants")).cast("double") + F.col("fixed")
    kept = unbeaten(able.join(facts, "supplier_id").join(sigs.select("sig", "wants"), "sig").select("sig", "supplier_id", rest.alias("rest"), "part"), top)
    of_sig = signed.select("demand", "sig").join(kept, "sig").select("demand", "supplier_id", "part", F.lit(0.0).alias("rare_part"))
    looked_up = asked.where("rare").select("demand", "term").join(pool.rare, "term").groupBy("demand", "supplier_id").agg(F.sum("part").alias("rare_part"))
    looked_up = looked_up.join(signed.select("demand", "sig"), "demand").join(pool.members.select("supplier_id", "class"), "supplier_id").join(common, ["sig", "class"], "left")
    pairs = of_sig.unionByName(looked_up.select("demand", "supplier_id", F.coalesce("part", F.lit(0.0)).alias("part"), "rare_part"))
    pairs = once(pairs.groupBy("demand", "supplier_id").agg((F.max("part") + F.max("rare_part")).alias("bm25")))
    most = signed.select("demand", "sig", F.col("sector").alias("wants")).join(common.groupBy("sig").agg(F.max("part").alias("common")), "sig", "left").join(pairs.groupBy("demand").agg(F.max("bm25").alias("best")), "demand", "left")
    most = most.select("demand", "wants", F.greatest(F.coalesce("common", F.lit(0.0)), F.coalesce("best", F.lit(0.0))).alias("most"))
    rows = pairs.join(most, "demand").join(facts, "supplier_id")
    match, found = F.col("has") == F.col("wants"), F.when(F.col("most") > 0, F.round(F.col("bm25") / F.col("most"), 9)).otherwise(0.0)
    score = WEIGHTS[0] * match.cast("double") + WEIGHTS[1] * found + F.col("fixed")
    return rows.select("demand", "supplier_id", match.alias("sector_match"), found.alias("relevance"), F.round(score, 6).alias("score"))


def procurement(rows: DataFrame) -> DataFrame:
    """Commitments that suppliers can answer, with the text that says what is asked."""
    return rows.where("type = 'procurement'").select("id", "org_name", "sector", F.concat_ws(" ", "title", "sector", "region").alias("text"))


def matched(rows: DataFrame, pool: Pool) -> tuple[DataFrame, DataFrame]:
    """Commitments by demand, and scored candidates."""
    rows, wanted = demands(rows, pool.terms)
    return rows, scored(wanted, pool)


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commitments by demand, scored candidates, suppliers."""
    pool = suppliers(spark, sf_dir)
    return *matched(procurement(table(spark, sf_dir, "commitment")), pooled(pool)), pool


def best_matches(candidates: DataFrame, least: float = LEAST, top: int = TOP) -> DataFrame:
    w = Window.partitionBy("demand").orderBy(F.desc("score"), "supplier_id")
    return candidates.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, candidates, _ = _matched(spark, sf_dir)
    return rows.select("id", "org_name", "demand").join(best_matches(candidates), "demand")


def fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the candidates' fits lie, by tier and by whether the sector is the demand's: of the best five per demand."""
    _, candidates, pool = _matched(spark, sf_dir)
    return best_matches(candidates).join(pool.select("supplier_id", "tier"), "supplier_id").groupBy("tier", "sector_match").agg(F.count("*").alias("links"), F.min("score").alias("low"), F.max("score").alias("high"))


def opportunity_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities(spark, sf_dir).select(F.concat_ws("::", "id", "supplier_id").alias("key"), "id", "supplier_id", "score", "rank")


def alignment_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each commitment: its best score, number of matches, and matches in order."""
    cards = opportunities(spark, sf_dir).groupBy("id", "org_name").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "supplier_id"))).alias("m"))  # TOP rows
    return cards.select("id", "org_name", "best", "n", F.array_join(F.transform("m", lambda x: x["supplier_id"].cast("string")), ",").alias("suppliers"))


def rationale(tier: Column, sector: Column, ownership: Column, sector_match: Column, relevance: Column) -> Column:
    """One sentence from the facts of a match, and what to do next."""
    own = F.when(ownership.isNotNull(), F.concat(F.lit(" "), ownership.cast("string"), F.lit("% owned."))).otherwise("")
    fits = F.when(sector_match, F.concat(tier, F.lit(" supplier in "), sector, F.lit(": matches this target's sector."), own, F.lit(" Next: introduce them."))).when(
        relevance >= 0.5, F.concat(tier, F.lit(" supplier whose capabilities overlap this target, across sectors."), own, F.lit(" Next: assess the fit."))
    )
    return fits.otherwise(F.concat(tier, F.lit(" supplier available for this commitment."), own, F.lit(" Next: assess the fit.")))


def match_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each commitment's best match."""
    rows, candidates, pool = _matched(spark, sf_dir)
    best = best_matches(candidates, top=1).join(pool.select("supplier_id", "tier", "sector", "ownership_pct"), "supplier_id")
    text = rationale(F.col("tier"), F.col("sector"), F.col("ownership_pct"), F.col("sector_match"), F.col("relevance"))
    return rows.select("id", "demand").join(best.select("demand", text.alias("rationale")), "demand").select("id", "rationale")


def sector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(sector_of(F.col("c_mktsegment")).alias("sector")).agg(F.count("*").alias("n"))


_ALL = """WITH pool AS (SELECT supplier_id, sector, tier, ownership_pct, concat_ws(' ', supplier_name, sector, region, replace(tier, '_', ' ')) AS text FROM party WHERE verification = 'verified'),
words AS (SELECT supplier_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM pool),
postings AS (SELECT supplier_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT supplier_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY 1, 2),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY 1), stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM words),
wanted AS (SELECT id, org_name, sector, concat_ws(' ', title, sector, region) AS text FROM commitment WHERE type = 'procurement'),
asked AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM wanted),
hits AS (SELECT id, supplier_id, sum(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS score
FROM asked JOIN freq USING (term) JOIN postings USING (term), stats GROUP BY 1, 2),
near AS (SELECT id, supplier_id, round(score / max(score) OVER (PARTITION BY id), 9) AS relevance FROM hits),
pairs AS (SELECT w.id, org_name, p.supplier_id, p.tier, p.sector, ownership_pct, p.sector = w.sector AS sector_match, coalesce(relevance, 0) AS relevance, round(CAST(0.45 AS DOUBLE) * CAST(p.sector = w.sector AS INT) + CAST(0.25 AS DOUBLE) * coalesce(relevance, 0)
+ (CAST(0.2 AS DOUBLE) * CAST(CASE tier WHEN 'nation_certified' THEN 1.0 WHEN 'ccib_certified' THEN 0.9 ELSE 0.4 END AS DOUBLE) + CAST(0.1 AS DOUBLE) * least(CAST(1 AS DOUBLE), ownership_pct / CAST(100 AS DOUBLE))), 6) AS score
FROM wanted w CROSS JOIN pool p LEFT JOIN near n ON n.id = w.id AND n.supplier_id = p.supplier_id),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, supplier_id) AS rank FROM pairs WHERE score >= 0.5 QUALIFY rank <= 5) """
QUERIES = {f.__name__: f for f in (fit_score, opportunity_top5, alignment_cards, match_rationales, sector_normalize)}
ORACLE_SQL = {name: oracle(_ALL + sql, "commitment", "party") for name, sql in {
    "fit_score": """, demand AS (SELECT id, row_number() OVER (PARTITION BY sector, terms ORDER BY id) AS i FROM (SELECT w.id, any_value(w.sector) AS sector, list_sort(list(term) FILTER (term IS NOT NULL)) AS terms
        FROM wanted w LEFT JOIN (SELECT id, term FROM asked JOIN freq USING (term)) a ON a.id = w.id GROUP BY w.id))
        SELECT tier, sector_match, count(*) AS links, min(score) AS low, max(score) AS high FROM best JOIN demand USING (id) WHERE i = 1 GROUP BY 1, 2""",
    "opportunity_top5": "SELECT concat_ws('::', id, supplier_id) AS key, id, supplier_id, score, rank FROM best",
    "alignment_cards": "SELECT id, org_name, max(score) AS best, count(*) AS n, string_agg(supplier_id, ',' ORDER BY rank) AS suppliers FROM best GROUP BY 1, 2",
    "match_rationales": """SELECT id, CASE WHEN sector_match THEN tier || ' supplier in ' || sector || ': matches this target''s sector. ' || ownership_pct || '% owned. Next: introduce them.' WHEN relevance >= 0.5
        THEN tier || ' supplier whose capabilities overlap this target, across sectors. ' || ownership_pct || '% owned. Next: assess the fit.' ELSE tier || ' supplier available for this commitment. ' || ownership_pct || '% owned. Next: assess the fit.' END AS rationale FROM best WHERE rank = 1""",
}.items()} | {
    "sector_normalize": "SELECT CASE " + " ".join(f"WHEN contains(lower(c_mktsegment), '{w}') THEN '{s}'" for w, s in SECTORS) + " ELSE 'other' END AS sector, count(*) AS n FROM customer GROUP BY 1",
}
