"""Quality rules by distribution divergence.

A document's histogram over character classes, and its histogram over the common words of four languages (all other
words are one more bin), are compared with reference histograms by Jensen-Shannon divergence (base 2, so 0 to 1). The
reference of a language is the sum of the histograms of all documents that carry that language and pass the base
rules. A document is held against every language and the smallest divergence counts, so a wrong or missing language
label does no harm. Documents under ``MIN_WORDS`` words are too short for a histogram and get no verdict from it.

Spark's part: one pass makes narrow rows (counts only) in built-in functions, written to the shared checkpoint folder;
the references are one small aggregate over them (four languages), put into the second expression as literals. No
document is compared with another and nothing is shuffled but the partial sums.

Defined cases: null text has no words and fails the base rules; a null or unknown lang gives no reference but is judged
like any other; repeated rows are judged each; with no reference at all (empty table) the base rules alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, documents, let, settle, whole_text, words_of

#: Frequent words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not are this from".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
#: Character classes as the regex of what is not in them; the last bin has all other signs, blanks are left out.
CLASSES = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": r"[^#*$%&|<>]+", "beyond": r"[\x00-\x7F]+"}
MIN_WORDS = 50
#: A divergence may be at most the first figure plus the second divided by the number of words: short texts stray more.
MAX_CLASS_DIVERGENCE = (0.04, 3.0)
MAX_WORD_DIVERGENCE = (0.05, 3.5)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by their chained 64-bit hash. A text whose windows all differ is done after a hash set;
    otherwise the windows are sorted, equal neighbours marked, and the positions they cover united.
    """

    def repeated(t):
        def covered(s):
            after, n = F.slice(s, 2, F.size(s)), F.size(s)
            same_next = F.zip_with(s, after, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))

            def starts(same):
                before = F.concat(F.array(F.lit(False)), F.slice(same, 1, F.greatest(n - 1, F.lit(0))))
                hit = F.zip_with(F.zip_with(same, before, lambda x, y: x | y), s, lambda k, x: F.when(k, x["i"]))
                return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))

            steps = lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
            return let(let(same_next, starts), steps)

        return F.when(F.size(F.array_distinct(t)) < F.size(t), let(F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)).otherwise(F.lit(0))

    def windows(w):
        n = F.size(w)
        chained = let(F.transform(w, lambda x: F.xxhash64(x)), lambda a: F.zip_with(F.zip_with(a, F.slice(a, 2, n), lambda x, y: F.xxhash64(x, y)), F.slice(a, 3, n), lambda x, y: F.xxhash64(x, y)))
        return let(F.slice(chained, 1, n - 2), repeated)

    return F.when(F.size(words) >= 4, let(words, windows)).otherwise(F.lit(0)).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, and the two histograms (arrays of long) of every document."""
    text, n = F.col("text"), F.col("n_words")
    long = lambda c: c.cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{BLANKS}]"))
    spelled = [x for w in WORDS for x in {w, w.upper(), w.capitalize()}]
    common = F.transform(F.filter("words", lambda w: w.isin(spelled)), lambda w: F.lower(w))
    word_hist = let(common, lambda cw: F.transform(F.array(*map(F.lit, WORDS)), lambda c: long(F.size(cw) - F.size(F.array_remove(cw, c)))))
    rows = docs.select("doc_id", "lang", whole_text().alias("text")).select("*", words_of(text).alias("words"))
    rows = rows.select(
        "doc_id",
        "lang",
        long(F.size("words")).alias("n_words"),
        long(F.length(text) - F.length(F.regexp_replace(text, rf"[^{BLANKS}]+", ""))).alias("word_chars"),
        long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.array(*[long(F.length(F.regexp_replace(text, c, ""))) for c in CLASSES.values()]).alias("class_hist"),
        word_hist.alias("word_hist"),
    )
    rest = lambda whole, part: F.array(F.greatest(F.lit(0).cast("long"), whole - F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)))
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        F.col("class_hist")[list(CLASSES).index("symbol")].alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        F.concat("class_hist", rest(F.col("word_chars"), "class_hist")).alias("class_hist"),
        F.concat("word_hist", rest(n, "word_hist")).alias("word_hist"),
    )


def references(rows: DataFrame, languages: tuple = tuple(COMMON)) -> list[tuple[list[int], list[int]]]:
    """The class and word histogram of each language; a handful of sums, fit for the driver."""
    sums = [F.sum(F.col("class_hist")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.col("word_hist")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    found = rows.where(F.col("lang").isin(*languages) & ~F.col("base_failed")).groupBy("lang").agg(*sums).collect()
    return [([int(r[f"c{i}"]) for i in range(len(CLASSES) + 1)], [int(r[f"w{i}"]) for i in range(len(WORDS) + 1)]) for r in sorted(found, key=lambda r: r["lang"])]


def divergence(hist: Column, reference: list[int]) -> Column:
    """Jensen-Shannon divergence of a histogram column from fixed counts; 1 for an empty histogram."""
    total = float(sum(reference)) or 1.0
    ref = F.array(*[F.lit(x / total) for x in reference])
    n = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(p, q):
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = let(n.cast("double"), lambda k: F.zip_with(hist, ref, lambda h, q: part(h / F.greatest(k, F.lit(1.0)), q)))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2).otherwise(1.0)


def judge(docs: DataFrame, max_class: tuple = MAX_CLASS_DIVERGENCE, max_word: tuple = MAX_WORD_DIVERGENCE) -> DataFrame:
    """The base counts, both divergences and the verdict of every document."""
    rows = settle(counts(docs))
    known = references(rows)
    least = lambda hist, k: F.round(F.array_min(F.array(*[divergence(F.col(hist), r[k]) for r in known])), 6) if known else F.lit(None).cast("double")
    rows = rows.withColumn("class_divergence", least("class_hist", 0)).withColumn("word_divergence", least("word_hist", 1))
    most = lambda limit: limit[0] + limit[1] / F.greatest(F.col("n_words"), F.lit(1))
    fits = F.coalesce((F.col("class_divergence") <= most(max_class)) & (F.col("word_divergence") <= most(max_word)), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") < MIN_WORDS) | fits)).drop("lang", "class_hist", "word_hist")


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
