"""Passages: cleaning, chunking, grounding of quotes, field validation and text quality, over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.rules import money
from ledgerloom.functions.scalars import ratio
from ledgerloom.operators.nearness import shared_run
from ledgerloom.sources.views import table

#: Function words that tell languages apart.
FUNCTION_WORDS = {"en": ("the", "of", "and", "that"), "fr": ("le", "les", "des", "est"), "de": ("der", "die", "und", "ist"), "es": ("el", "los", "que", "una")}
MAX_CHUNK = 2048


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the three normal forms of every text."""
    return _docs(spark, sf_dir).select("doc_id", *[F.sha2(f(F.col("text")), 256).alias(n) for n, f in (("ws", T.norm_ws), ("fold", T.folded), ("alnum", T.alnum))])


def lang_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language with most function words; under eight of all, or without a lead of 1.3 times over the next, unknown."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "  "), F.lit(" "))
    counts = {k: F.regexp_count("t", F.lit(" (?:" + "|".join(ws) + ") ")) for k, ws in FUNCTION_WORDS.items()}
    rows = _docs(spark, sf_dir).select("doc_id", words.alias("t")).select("doc_id", *[c.alias(k) for k, c in counts.items()])
    scores = F.sort_array(F.array(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("lang")) for k in counts]), asc=False)
    rows = rows.select("doc_id", scores.alias("s"))
    best, next_ = F.col("s")[0], F.col("s")[1]
    return rows.select("doc_id", F.when((F.aggregate("s", F.lit(0), lambda a, x: a + x["n"]) >= 8) & (best["n"] > 1.3 * next_["n"]), best["lang"]).otherwise("unknown").alias("lang"), best["n"].cast("long").alias("evidence"))


def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks; a line above MAX_CHUNK bytes is cut at sentence ends. Numbered per document."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "line")).where("trim(line) <> ''")
    parts = F.when(F.octet_length("line") > MAX_CHUNK, F.split("line", r"(?<=[.!?]) +")).otherwise(F.array("line"))
    return lines.select("doc_id", F.col("para").cast("long").alias("para"), F.posexplode(parts).alias("part", "chunk")).select("doc_id", "para", F.col("part").cast("long").alias("part"), F.length("chunk").cast("long").alias("chars"))


def packed_chunks(rows: DataFrame, limit: int = 6000) -> DataFrame:
    """Greedy packing of a document's paragraphs in order (doc_id, text) -> (doc_id, chunk, paragraphs, chars)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                n, held, size = 0, 0, 0
                for part in text.split("\n"):
                    if held and size + 1 + len(part) > limit:
                        out.append((doc_id, n, held, size))
                        n, held, size = n + 1, 0, 0
                    size += len(part) + (held > 0)
                    held += 1
                out.append((doc_id, n, held, size))
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "paragraphs", "chars"])

    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(pack, "doc_id long, chunk long, paragraphs long, chars long")


def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A greedy fold over each text's paragraphs, text by text in Arrow batches: no grouping, so no large group."""
    return packed_chunks(_docs(spark, sf_dir))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote from each turn (its first and last sentence around an ellipsis) beside the whole turn."""
    cut = F.filter(F.split("text", r"[.!?]\s*"), lambda s: s != "")
    quote = F.concat_ws(" ... ", F.element_at("cut", 1), F.element_at("cut", -1))
    return table(spark, sf_dir, "conversations").withColumn("cut", cut).where(F.size("cut") > 0).withColumn("quote", quote).drop("cut")


def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn's quote is found: in that turn, in the next turn of the conversation, or nowhere."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = quotes(spark, sf_dir).withColumn("next_text", F.lead("text").over(w))
    found = F.when(T.quote_occurs(F.col("quote"), F.col("text")), "own").when(F.coalesce(T.quote_occurs(F.col("quote"), F.col("next_text")), F.lit(False)), "next").otherwise("none")
    return rows.groupBy("role", found.alias("found")).agg(F.count("*").alias("n"))


def near_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common substring of successive turns of a role, as a share of the shorter; exact containment never gets there."""

    w = Window.partitionBy("conv_id", "role").orderBy("turn", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    exact = rows.where(F.contains(F.col("text"), F.col("before"))).select("conv_id", "turn", F.length("before").cast("long").alias("shared"), F.lit(True).alias("contained"))
    missed = rows.where(~F.contains(F.col("text"), F.col("before")))
    return exact.unionByName(missed.select("conv_id", "turn", shared_run(F.col("before"), F.col("text"))["length"].alias("shared"), F.lit(False).alias("contained")))


def _phrase() -> Column:
    n = F.col("o_orderkey")
    return (
        F.when(n % 6 == 0, F.format_string("Spend $%d,%03d million by Q%d %d", n % 9 + 1, n % 1000, n % 4 + 1, n % 20 + 2010)).when(n % 6 == 1, F.format_string("%d%% of staff annually", n % 100))
        .when(n % 6 == 2, F.format_string("$%d.5k before 20%d-0%d-15", n % 90 + 1, n % 20 + 10, n % 9 + 1)).when(n % 6 == 3, F.format_string("hire %d people", n % 50)).when(n % 6 == 4, F.format_string("$ %d billion, year %d", n % 7 + 1, n % 30 + 1990)).otherwise("as soon as possible")
    )


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _phrase().alias("phrase"))


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency target, the recorded figure (a percentage too) and the unit of every phrase."""
    return _phrases(spark, sf_dir).select("id", T.amount(F.col("phrase")).alias("amount"), money(F.col("phrase"))["amount"].alias("figure"), T.unit_of(F.col("phrase")).alias("unit"))


def due_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).select("id", T.due_date(F.col("phrase")).alias("due"), T.recurring(F.col("phrase")).alias("recurring"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation issues of extracted fields (id, rule), all rules from one pass."""
    id_ = F.col("id")
    due, confidence = T.due_date(F.col("phrase")), (id_ * 37 % 100) / 100.0
    rules = F.array(
        F.when(confidence < 0.85, "low_confidence"), F.when(id_ % 11 == 0, "missing_quote"), F.when(due.isNull() & ~T.recurring(F.col("phrase")), "no_date"), F.when(F.substring(due, 1, 4) > "2020", "after_period")
    )
    return _phrases(spark, sf_dir).select("id", F.explode(F.array_compact(rules)).alias("rule"))


def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in order of first appearance, with their counts."""
    stat = issues(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return stat.withColumn("place", F.row_number().over(Window.orderBy("first_id", "rule")).cast("long"))  # a row a rule


def is_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records have no issue at all (anti join)."""
    rows = _phrases(spark, sf_dir).select("id")
    return rows.join(issues(spark, sf_dir).select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("clean"))


def text_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control and replacement characters, non-ASCII share and mean characters a line of every text."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
    odd = F.regexp_count("text", F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f�]")).cast("long")
    return _docs(spark, sf_dir).select("doc_id", odd.alias("damaged"), F.round(ratio(F.regexp_count("text", F.lit(r"[^\x00-\x7f]")), F.length("text")), 6).alias("beyond"), F.round(ratio(F.length("text"), lines), 6).alias("per_line"))


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's pages (lines here) with 50 characters and more; low where they are under 0.6 of all."""
    pages = F.split("text", "\n")
    rows = _docs(spark, sf_dir).select("doc_id", F.size(pages).cast("long").alias("pages"), F.size(F.filter(pages, lambda p: F.length(F.trim(p)) >= 50)).cast("long").alias("covered"))
    return rows.withColumn("low", ratio(F.col("covered"), F.col("pages")) < 0.6)


def disposition_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole paragraphs from the head (up to 2,000 characters) and the tail (up to 4,000) of each text, and what is left out."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("size", F.length("line"))
    w = Window.partitionBy("doc_id")
    ahead, behind = F.sum("size").over(w.orderBy("i")), F.sum("size").over(w.orderBy(F.desc("i")))
    kept = (F.col("ahead") <= 2000) | (F.col("behind") <= 4000)
    return lines.select("doc_id", "size", ahead.alias("ahead"), behind.alias("behind")).groupBy("doc_id").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("omitted"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).cast("long").alias("chars"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug, base-36 rolling hash and content digest of every organisation's name."""
    codes = F.transform(F.split(F.lower("c_name"), ""), lambda ch: F.ascii(ch))
    rolled = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296)
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"), rolled.alias("hash"), F.lower(F.conv(rolled.cast("string"), 10, 36)).alias("short"), F.sha2("c_name", 256).alias("digest"))


def business_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine digits that pass the Luhn sum."""
    number = F.lpad((F.col("o_orderkey") * 7919 % 1000000000).cast("string"), 9, "0")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), number.alias("bn"))
    return rows.select("id", F.expr("luhn_check(bn)").alias("valid"))


def vocab_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard index of successive turns' vocabularies."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("v"))
    rows = rows.withColumn("u", F.lag("v").over(w)).where("u IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(ratio(F.size(F.array_intersect("u", "v")), F.size(F.array_union("u", "v"))), 6).alias("jaccard"))


_PHRASES = """phrases AS (SELECT n AS id, CASE n % 6 WHEN 0 THEN printf('Spend $%d,%03d million by Q%d %d', n % 9 + 1, n % 1000, n % 4 + 1, n % 20 + 2010) WHEN 1 THEN printf('%d%% of staff annually', n % 100)
WHEN 2 THEN printf('$%d.5k before 20%d-0%d-15', n % 90 + 1, n % 20 + 10, n % 9 + 1) WHEN 3 THEN printf('hire %d people', n % 50) WHEN 4 THEN printf('$ %d billion, year %d', n % 7 + 1, n % 30 + 1990) ELSE 'as soon as possible' END AS phrase FROM (SELECT o_orderkey AS n FROM orders)),
dated AS (SELECT *, CASE WHEN iso <> '' THEN iso WHEN y <> '' AND q <> '' THEN concat(y, '-', lpad(CAST(CAST(q AS INT) * 3 AS VARCHAR), 2, '0'), '-30') WHEN y <> '' THEN concat(y, '-12-31') END AS due,
regexp_matches(phrase, '(?i)\\b(annual|annually|yearly|quarterly|monthly|ongoing|each year|every year)\\b') AS recurring FROM (SELECT *, regexp_extract(phrase, '\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b', 1) AS iso,
regexp_extract(phrase, '\\b[qQ]([1-4])\\b', 1) AS q, regexp_extract(phrase, '\\b((?:19|20)[0-9]{2})\\b', 1) AS y FROM phrases)),
issues AS (SELECT id, unnest(list_filter([CASE WHEN (id * 37 % 100) / CAST(100 AS DOUBLE) < CAST(0.85 AS DOUBLE) THEN 'low_confidence' END, CASE WHEN id % 11 = 0 THEN 'missing_quote' END, CASE WHEN due IS NULL AND NOT recurring THEN 'no_date' END,
CASE WHEN substr(due, 1, 4) > '2020' THEN 'after_period' END], lambda x: x IS NOT NULL)) AS rule FROM dated)""".replace("\\\\", "\\")
_ALNUM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_QUOTES = r"""cuts AS (SELECT *, list_filter(string_split_regex(text, '[.!?]\s*'), lambda x: x <> '') AS cut FROM conversations), quoted AS (SELECT *, concat_ws(' ... ', cut[1], cut[-1]) AS quote FROM cuts WHERE len(cut) > 0)"""
_BLOCK = "(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article)"


def _html_sql() -> str:
    c = "html"
    for tag in ("script", "style", "head", "nav", "header", "footer"):
        c = rf"regexp_replace({c}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '(?i)</?{_BLOCK}\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{sign}')"
    return rf"trim(regexp_replace(regexp_replace({c}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), concat(' ', chr(10)))"


_WS = "trim(regexp_replace(translate({}, concat('‘’“”–—', chr(160)), '''''\"\"-- '), '\\s+', ' ', 'g'))"
_FOLD = "replace(replace(text, chr(173), ''), '…', '...')"
for _sign, _letters in T.LIGATURES.items():
    _FOLD = f"replace({_FOLD}, '{_sign}', '{_letters}')"
_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
QUERIES = {f.__name__: f for f in (
    page_text, norm_text, lang_classify, chunk_paragraphs, pack_chunks, quote_grounding, near_match, amount_parse, due_date_parse, issue_summary, is_clean, text_damage, page_coverage, disposition_window, stable_ids, business_numbers, vocab_overlap,
)}
ORACLE_SQL = {
    "page_text": f"SELECT page_id, {_html_sql()} AS text FROM pages",
    "norm_text": f"""SELECT doc_id, sha256({_WS.format('text')}) AS ws, sha256(regexp_replace({_WS.format(_FOLD)}, ' ([,.;:!?])', '\\1', 'g')) AS fold, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS alnum FROM documents""",
    "lang_classify": "WITH c AS (SELECT doc_id, list_reverse_sort(["
    + ", ".join(f"{{'n': len(regexp_extract_all(t, ' (?:{'|'.join(ws)}) ')), 'lang': '{k}'}}" for k, ws in FUNCTION_WORDS.items())
    + r"]) AS s FROM (SELECT doc_id, concat(' ', regexp_replace(lower(text), '[^\p{L}]+', '  ', 'g'), ' ') AS t FROM documents)) SELECT doc_id, CASE WHEN list_sum(list_transform(s, lambda x: x.n)) >= 8 AND s[1].n > CAST(1.3 AS DOUBLE) * s[2].n THEN s[1].lang ELSE 'unknown' END AS lang, s[1].n AS evidence FROM c",
    "chunk_paragraphs": r"""WITH lines AS (SELECT doc_id, i - 1 AS para, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(l[i]) <> ''),
        parts AS (SELECT doc_id, para, CASE WHEN strlen(line) > 2048 THEN string_split(regexp_replace(line, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)) ELSE [line] END AS p FROM lines)
        SELECT doc_id, para, j - 1 AS part, CAST(length(p[j]) AS BIGINT) AS chars FROM (SELECT *, unnest(range(1, len(p) + 1)) AS j FROM parts)""",
    "amount_parse": r"WITH " + _PHRASES + r""" SELECT id, CAST(replace(n, ',', '') AS DOUBLE) * CASE s WHEN 'k' THEN 1000 WHEN 'thousand' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'million' THEN 1000000 WHEN '' THEN 1 ELSE 1000000000 END AS amount,
        CASE WHEN contains(phrase, '%') THEN CAST(regexp_extract(phrase, '([0-9]+)%', 1) AS DOUBLE) ELSE CAST(replace(n, ',', '') AS DOUBLE) * CASE s WHEN 'k' THEN 1000 WHEN 'million' THEN 1000000 WHEN '' THEN 1 ELSE 1000000000 END END AS figure,
        CASE WHEN contains(phrase, '$') THEN 'currency' WHEN contains(phrase, '%') THEN 'percent' WHEN regexp_matches(phrase, '[0-9]') THEN 'count' ELSE 'none' END AS unit
        FROM (SELECT *, nullif(regexp_extract(phrase, '\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)', 1), '') AS n, regexp_extract(lower(phrase), '\$\s?[0-9][0-9,.]*\s?(thousand|million|billion|bn|k|m|b)\b', 1) AS s FROM phrases)""",
    "due_date_parse": f"WITH {_PHRASES} SELECT id, due, recurring FROM dated",
    "issue_summary": f"WITH {_PHRASES} SELECT rule, count(*) AS n, min(id) AS first_id, row_number() OVER (ORDER BY min(id), rule) AS place FROM issues GROUP BY rule",
    "is_clean": f"WITH {_PHRASES} SELECT count(*) AS clean FROM phrases WHERE id NOT IN (SELECT id FROM issues)",
    "text_damage": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]')) AS BIGINT) AS damaged, round(coalesce(len(regexp_extract_all(text, '[^\x00-\x7f]')) / CAST(nullif(length(text), 0) AS DOUBLE), 0), 6) AS beyond,
        round(coalesce(length(text) / CAST(nullif(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')), 0) AS DOUBLE), 0), 6) AS per_line FROM documents""",
    "quote_grounding": rf"""WITH {_QUOTES}, w AS (SELECT role, quote, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS nxt FROM quoted),
        f AS (SELECT role, list_filter(list_transform(string_split_regex(quote, '\.\.\.|…'), lambda x: {_ALNUM.format("x")}), lambda x: x <> '') AS fr, {_ALNUM.format("text")} AS t, {_ALNUM.format("nxt")} AS n FROM w)
        SELECT role, CASE WHEN len(list_filter(fr, lambda x: NOT contains(t, x))) = 0 THEN 'own' WHEN n IS NOT NULL AND len(list_filter(fr, lambda x: NOT contains(n, x))) = 0 THEN 'next' ELSE 'none' END AS found, count(*) AS n FROM f GROUP BY 1, 2""",
    "stable_ids": """SELECT c_custkey, lower(replace(c_name, '#', '-')) AS slug, h AS hash, lower(to_base(h, 36)) AS short, sha256(c_name) AS digest FROM (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(lower(c_name), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM customer)""",
    "page_coverage": "SELECT doc_id, len(p) AS pages, len(c) AS covered, len(c) < CAST(0.6 AS DOUBLE) * len(p) AS low FROM (SELECT doc_id, p, list_filter(p, lambda x: length(trim(x)) >= 50) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))",
    "disposition_window": """WITH lines AS (SELECT doc_id, i, length(l[i]) AS size FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
        run AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY i) <= 2000 OR sum(size) OVER (PARTITION BY doc_id ORDER BY i DESC) <= 4000 AS kept FROM lines)
        SELECT doc_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS omitted, CAST(coalesce(sum(size) FILTER (kept), 0) AS BIGINT) AS chars FROM run GROUP BY 1""",
    "business_numbers": """SELECT id, list_sum([CASE WHEN i % 2 = 1 THEN d ELSE CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END END FOR d, i IN l]) % 10 = 0 AS valid FROM (SELECT o_orderkey AS id,
        list_transform(string_split(lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0'), ''), lambda x: CAST(x AS INT)) AS l FROM orders)""",
    "vocab_overlap": f"""WITH v AS (SELECT conv_id, turn, {_TOKENS} AS v, lag({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn, text) AS u FROM conversations)
        SELECT conv_id, turn, round(coalesce(len(list_intersect(u, v)) / CAST(nullif(len(list_distinct(list_concat(u, v))), 0) AS DOUBLE), 0), 6) AS jaccard FROM v WHERE u IS NOT NULL""",
}
