"""Columns of a page: gutters by votes of its lines, a guard that tells prose from tables, and lines in reading order.

All of it works on runs (page, line, x, width, text) by windows within a line, a page or a gutter; a page's runs are the
largest group. A gutter is found in three steps. Every gap of a line that is wider than a share of the page votes; a sweep
over the ends of the gaps counts the votes for each gap's middle; the best middles, apart from one another, are guesses.
A guess becomes a band: its right edge is the leftmost place right of it where runs of several lines begin, its left edge
the furthest end of a run before that. A page keeps its bands only if all are found, apart and far enough from the edges.

Defined cases: a page with a run of no, negative or not finite width has no gutters; blank runs are left out; equal runs
count each; pages without runs have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.views import table

#: Share of the page's width that a gap must pass, rows that must agree, most columns, least share of the
#: page in a column, least width of a gutter, how far edges may be apart to be aligned, share of a column that its runs
#: must fill and word characters that its lines must have on average.
GUTTER_SHARE, LEAST_ROWS, MOST_COLUMNS, COLUMN_SHARE, LEAST_BAND, ALIGNED = 0.12, 3, 3, 0.15, 1.0, 1
FILL_SHARE, LINE_CHARS = 0.57, 10
DEALT = 1 << 11  # documents a part


def _right() -> Column:
    return F.col("x") + F.col("width")


def measured(runs: DataFrame) -> DataFrame:
    """Printable runs of pages whose geometry is known, with the page's left edge and width of text."""
    sound = (F.col("width") >= 0) & (F.col("width") < float("inf")) & F.col("x").isNotNull()
    rows = runs.where("trim(text) <> ''")
    pages = rows.groupBy("page").agg(F.min(F.coalesce(sound, F.lit(False))).alias("sound"), F.min("x").alias("left"), F.max(_right()).alias("end"))
    pages = pages.where("sound").select("page", "left", (F.col("end") - F.col("left")).alias("span")).where("span > 0")
    return rows.join(pages, "page")


def guesses(rows: DataFrame) -> DataFrame:
    """measured runs -> (page, g, of, guess, until, left, span): of a page's guesses, places that enough gaps straddle, from left to right."""
    line = Window.partitionBy("page", "line").orderBy("x", "width", "text")
    reach = F.max(_right()).over(line.rowsBetween(Window.unboundedPreceding, -1))
    gaps = rows.withColumn("lo", reach).where(F.col("x") - F.col("lo") > GUTTER_SHARE * F.col("span")).select("page", "left", "span", "lo", F.col("x").alias("hi"))
    gaps = gaps.groupBy("page", "left", "span", "lo", "hi").agg(F.count("*").alias("n"))  # lines of a page have few different gaps
    # A sweep along the page: a gap counts from its start to its end; at equal places ends come first and starts last.
    events = gaps.select("page", "left", "span", "n", ((F.col("lo") + F.col("hi")) / 2).alias("mid"), F.explode(F.array(F.struct(F.col("hi").alias("at"), F.lit(0).alias("kind")), F.struct(((F.col("lo") + F.col("hi")) / 2).alias("at"), F.lit(1).alias("kind")), F.struct(F.col("lo").alias("at"), F.lit(2).alias("kind")))).alias("e"))
    along = Window.partitionBy("page").orderBy("e.at", "e.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    votes = events.withColumn("votes", F.sum(F.when(F.col("e.kind") == 2, F.col("n")).when(F.col("e.kind") == 0, -F.col("n")).otherwise(0)).over(along)).where((F.col("e.kind") == 1) & (F.col("votes") >= LEAST_ROWS))
    pages = votes.groupBy("page", "left", "span").agg(F.array_sort(F.collect_set(F.struct((-F.col("votes")).alias("less"), "mid"))).alias("best"))
    apart = lambda kept, m: F.forall(kept, lambda k: F.abs(k - m["mid"]) >= GUTTER_SHARE * F.col("span"))
    chosen = F.aggregate("best", F.array().cast("array<double>"), lambda kept, m: F.when((F.size(kept) < MOST_COLUMNS) & apart(kept, m), F.concat(kept, F.array(m["mid"]))).otherwise(kept))
    pages = pages.select("page", "left", "span", F.array_sort(chosen).alias("c")).where(F.size("c") < MOST_COLUMNS)
    return pages.select("page", "left", "span", F.posexplode("c").alias("g", "guess"), "c").select("page", "left", "span", "g", F.size("c").alias("of"), "guess", F.coalesce(F.get("c", F.col("g") + 1), F.col("left") + F.col("span")).alias("until"))


def column_gutters(runs: DataFrame) -> DataFrame:
    """runs (page, line, x, width, text) -> (page, g, lo, hi): the bands between columns, by geometry alone."""
    rows = measured(runs)
    rough = guesses(rows)
    edges = rows.groupBy("page", "x").agg(F.count("*").alias("n")).join(rough, "page").where((F.col("x") > F.col("guess")) & (F.col("x") < F.col("until")))
    near = Window.partitionBy("page", "g").orderBy("x").rangeBetween(-ALIGNED, ALIGNED)
    keys = ["page", "g", "of", "left", "span"]
    right = edges.withColumn("same", F.sum("n").over(near)).where(F.col("same") >= LEAST_ROWS).groupBy(*keys).agg(F.min("x").alias("hi"))
    bands = rows.select("page", _right().alias("end")).distinct().join(right, "page").where("end <= hi").groupBy(*keys, "hi").agg(F.max("end").alias("lo"))
    page = Window.partitionBy("page")
    order = page.orderBy("g")
    middle = (F.col("lo") + F.col("hi")) / 2
    before = F.coalesce(F.lag(middle).over(order), F.col("left"))
    after = F.coalesce(F.lead(middle).over(order), F.col("left") + F.col("span"))
    least = COLUMN_SHARE * F.col("span")
    fits = F.coalesce((F.col("hi") - F.col("lo") >= LEAST_BAND) & (F.col("lo") > F.coalesce(F.lag("hi").over(order), F.lit(float("-inf")))) & (middle - before >= least) & (after - middle >= least), F.lit(False))
    return bands.withColumn("fits", fits).withColumn("good", F.count_if("fits").over(page)).where("good = of").select("page", "g", "lo", "hi")


def _bands(gutters: DataFrame) -> DataFrame:
    return gutters.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("g", "lo", "hi"))).alias("bands"))


def _placed(rows: DataFrame) -> DataFrame:
    """runs with their page's bands (null: none): their column, and whether their line spans a gutter."""
    crosses = F.coalesce(F.exists("bands", lambda b: (F.col("x") < b["hi"]) & (_right() > b["lo"])), F.lit(False))
    column = F.when(F.col("bands").isNull(), 0).otherwise(F.size(F.filter("bands", lambda b: F.col("x") >= b["hi"])))
    return rows.withColumn("spans", F.max(crosses).over(Window.partitionBy("page", "line"))).withColumn("column", column)


def prose_columns(runs: DataFrame, gutters: DataFrame) -> DataFrame:
    """The gutters with prose: whether every column of the page fills its place and has lines of words; lines across a gutter
    don't count."""
    rows = _placed(measured(runs).join(_bands(gutters), "page"))
    middle = lambda i: (F.get("bands", i)["lo"] + F.get("bands", i)["hi"]) / 2
    start, end = F.coalesce(F.when(F.col("column") > 0, middle(F.col("column") - 1)), F.col("left")), F.coalesce(middle(F.col("column")), F.col("left") + F.col("span"))
    rows = rows.withColumn("room", end - start)
    lines = rows.groupBy("page", "bands", "column", "room", "line", "spans").agg(F.min("x").alias("from"), F.max(_right()).alias("to"), F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))).alias("chars"))
    inside = lambda c: F.when(~F.col("spans"), F.col(c))
    columns = lines.groupBy("page", "bands", "column", "room").agg((F.max(inside("to")) - F.min(inside("from"))).alias("filled"), F.avg(inside("chars")).alias("chars"))
    good = F.count_if((F.col("room") > 0) & (F.col("filled") >= FILL_SHARE * F.col("room")) & (F.col("chars") >= LINE_CHARS))
    judged = columns.groupBy("page", "bands").agg((good == F.size("bands") + 1).alias("prose"))
    return judged.select("page", F.inline("bands"), "prose")


def reading_lines(runs: DataFrame) -> DataFrame:
    """runs -> (page, section, column, line, text): lines in reading order. A line across a gutter is a section of its own kind;
    between such lines each column is read to its end before the next. Pages without columns are one section."""
    runs = runs.where("trim(text) <> ''")
    bands = _bands(prose_columns(runs, column_gutters(runs)).where("prose"))
    rows = _placed(runs.join(bands, "page", "left")).withColumn("column", F.when(F.col("spans"), 0).otherwise(F.col("column")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "width", "text"))), lambda r: r["text"]), " ")
    told = rows.groupBy("page", "line", "spans", "column").agg(text.alias("text"))
    turn = Window.partitionBy("page").orderBy("line", "column")  # the rows of a line are all of one kind
    new = (F.col("spans") != F.coalesce(F.lag("spans").over(turn), ~F.col("spans"))).cast("int")
    lines = told.withColumn("new", new).withColumn("section", F.sum("new").over(turn).cast("long"))
    return lines.select("page", "section", F.col("column").cast("long").alias("column"), "line", "text")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of documents' words: a page a document, seven words a line in two columns of uneven ends (three on some pages,
    narrow cells on others), every ninth line straight across. Texts are dealt by page before their words are rows: all that groups
    by page stays there, so texts move, once, and words don't."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DEALT))
    words = docs.repartition(parts, "doc_id").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", r"\s+")).alias("i", "text")).where("text <> ''")
    at, n = F.col("i") % 7, F.col("page") % 4
    line = F.floor(F.col("i") / 7).cast("long")
    across = line % 9 == 8
    column = F.when(n == 0, 0).when(n == 3, F.when(at < 2, 0).when(at < 4, 1).otherwise(2)).otherwise(F.when(at < 3, 0).otherwise(1))
    start = F.when(n == 3, F.when(at < 2, 0).when(at < 4, 2).otherwise(4)).otherwise(F.when(at < 3, 0).otherwise(3))
    x = F.when(across | (n == 0), at * 60.0).otherwise(column * F.when(n == 3, 190.0).otherwise(260.0) + (at - start) * F.when(n == 2, 8.0).otherwise(60.0))
    width = F.when(n == 2, F.lit(6.0)).otherwise(40.0 + (line * 7 + at * 5) % 15)
    return words.select("page", line.alias("line"), x.cast("double").alias("x"), F.when(across, F.lit(59.5)).otherwise(width).cast("double").alias("width"), F.when(n == 2, F.substring("text", 1, 2)).otherwise(F.col("text")).alias("text"))


def page_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gutters of every page, and whether its columns read like prose."""
    runs = _runs(spark, sf_dir)
    return prose_columns(runs, column_gutters(runs)).select("page", F.col("g").cast("long").alias("g"), "lo", "hi", "prose")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each page's lines in reading order."""
    lines = reading_lines(_runs(spark, sf_dir))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "column", "line", "text"))), lambda r: r["text"]), "\n")
    return lines.groupBy("page").agg(F.max("section").alias("sections"), (F.max("column") + 1).alias("columns"), F.md5(text).alias("digest"))


QUERIES = {f.__name__: f for f in (page_gutters, reading_order)}

_RUNS = r"""words AS (SELECT page, i - 1 AS i, w[i] AS text FROM (SELECT doc_id AS page, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '[ \t\n\v\f\r]+') AS w FROM documents)) WHERE w[i] <> ''),
placed AS (SELECT page, text, i // 7 AS line, i % 7 AS spot, page % 4 AS n FROM words),
shaped AS (SELECT *, line % 9 = 8 AS across, CASE WHEN n = 0 THEN 0 WHEN n = 3 THEN CASE WHEN spot < 2 THEN 0 WHEN spot < 4 THEN 1 ELSE 2 END ELSE CASE WHEN spot < 3 THEN 0 ELSE 1 END END AS col,
CASE WHEN n = 3 THEN CASE WHEN spot < 2 THEN 0 WHEN spot < 4 THEN 2 ELSE 4 END ELSE CASE WHEN spot < 3 THEN 0 ELSE 3 END END AS start FROM placed),
runs AS (SELECT page, line, CAST(CASE WHEN across OR n = 0 THEN spot * 60 ELSE col * CASE n WHEN 3 THEN 190 ELSE 260 END + (spot - start) * CASE n WHEN 2 THEN 8 ELSE 60 END END AS DOUBLE) AS x,
CASE WHEN across THEN 59.5::DOUBLE WHEN n = 2 THEN 6::DOUBLE ELSE 40::DOUBLE + (line * 7 + spot * 5) % 15 END AS width, CASE n WHEN 2 THEN substr(text, 1, 2) ELSE text END AS text FROM shaped),
sized AS (SELECT *, x + width AS r, min(x) OVER (PARTITION BY page) AS l, max(x + width) OVER (PARTITION BY page) - min(x) OVER (PARTITION BY page) AS span FROM runs),
gaps AS (SELECT page, l, span, lo, x AS hi, (lo + x) / 2 AS mid FROM (SELECT *, max(r) OVER (PARTITION BY page, line ORDER BY x, width, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM sized) WHERE x - lo > 0.12::DOUBLE * span),
votes AS (SELECT a.page, a.l, a.span, a.mid, count(*) AS votes FROM (SELECT DISTINCT page, l, span, mid FROM gaps) a JOIN gaps b ON a.page = b.page AND b.lo < a.mid AND a.mid < b.hi GROUP BY ALL HAVING count(*) >= 3),
first AS (SELECT page, l, span, mid FROM votes QUALIFY row_number() OVER (PARTITION BY page ORDER BY votes DESC, mid) = 1),
second AS (SELECT v.page, v.l, v.span, v.mid FROM votes v JOIN first f ON f.page = v.page AND abs(v.mid - f.mid) >= 0.12::DOUBLE * v.span QUALIFY row_number() OVER (PARTITION BY v.page ORDER BY votes DESC, v.mid) = 1),
third AS (SELECT DISTINCT v.page FROM votes v JOIN first f ON f.page = v.page AND abs(v.mid - f.mid) >= 0.12::DOUBLE * v.span JOIN second s ON s.page = v.page AND abs(v.mid - s.mid) >= 0.12::DOUBLE * v.span),
rough AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY mid) - 1 AS g, coalesce(lead(mid) OVER (PARTITION BY page ORDER BY mid), l + span) AS until FROM (SELECT * FROM first UNION ALL SELECT * FROM second) WHERE page NOT IN (SELECT page FROM third)),
edges AS (SELECT e.page, g, x FROM sized e JOIN rough USING (page) WHERE x > mid AND x < until),
hi AS (SELECT page, g, min(x) AS hi FROM (SELECT *, count(*) OVER (PARTITION BY page, g ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS same FROM edges) WHERE same >= 3 GROUP BY 1, 2),
lo AS (SELECT s.page, g, hi, max(r) AS lo FROM sized s JOIN hi USING (page) WHERE r <= hi GROUP BY 1, 2, 3),
bands AS (SELECT r.page, r.g, l, span, lo, hi, (lo + hi) / 2 AS mid FROM rough r LEFT JOIN lo USING (page, g)),
judged AS (SELECT *, coalesce(hi - lo >= 1 AND lo > coalesce(lag(hi) OVER w, -1e300) AND mid - coalesce(lag(mid) OVER w, l) >= 0.15::DOUBLE * span AND coalesce(lead(mid) OVER w, l + span) - mid >= 0.15::DOUBLE * span, false) AS fits FROM bands WINDOW w AS (PARTITION BY page ORDER BY g)),
gutters AS (SELECT page, g, lo, hi FROM judged QUALIFY bool_and(fits) OVER (PARTITION BY page)),
paged AS (SELECT page, list(struct_pack(lo := lo, hi := hi) ORDER BY g) AS b FROM gutters GROUP BY 1),
inside AS (SELECT s.*, b, len(b) + 1 AS columns, len(list_filter(b, lambda z: x >= z.hi)) AS col, bool_or(len(list_filter(b, lambda z: x < z.hi AND r > z.lo)) > 0) OVER (PARTITION BY s.page, line) AS spans FROM sized s JOIN paged USING (page)),
roomy AS (SELECT *, coalesce((b[col + 1].lo + b[col + 1].hi) / 2, l + span) - CASE WHEN col > 0 THEN (b[col].lo + b[col].hi) / 2 ELSE l END AS room FROM inside),
filled AS (SELECT page, columns, col, room, max(t) - min(f) AS filled, avg(chars) AS chars FROM (SELECT page, columns, col, room, line, min(x) AS f, max(r) AS t, sum(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS chars FROM roomy WHERE NOT spans GROUP BY ALL) GROUP BY ALL),
prose AS (SELECT page FROM filled GROUP BY page, columns HAVING count(*) FILTER (room > 0 AND filled >= 0.57::DOUBLE * room AND chars >= 10) = columns)"""
ORACLE_SQL = {
    "page_gutters": f"WITH {_RUNS} SELECT page, g, lo, hi, page IN (SELECT page FROM prose) AS prose FROM gutters",
    "reading_order": f"""WITH {_RUNS}, kept AS (SELECT page, line, x, width, text, spans, CASE WHEN spans THEN 0 ELSE col END AS col FROM inside WHERE page IN (SELECT page FROM prose) UNION ALL SELECT page, line, x, width, text, false, 0 FROM runs WHERE page NOT IN (SELECT page FROM prose)),
        turns AS (SELECT page, line, sum(CAST(fresh AS INT)) OVER (PARTITION BY page ORDER BY line) AS section FROM (SELECT *, spans <> coalesce(lag(spans) OVER (PARTITION BY page ORDER BY line), NOT spans) AS fresh FROM (SELECT DISTINCT page, line, spans FROM kept))),
        told AS (SELECT page, line, col, string_agg(text, ' ' ORDER BY x, width, text) AS text FROM kept GROUP BY 1, 2, 3)
        SELECT page, CAST(max(section) AS BIGINT) AS sections, CAST(max(col) + 1 AS BIGINT) AS columns, md5(string_agg(text, chr(10) ORDER BY section, col, line)) AS digest FROM told JOIN turns USING (page, line) GROUP BY 1""",
}
