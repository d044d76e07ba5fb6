"""Rules on values as column functions: target values, classes, costs, polarity, paging, merging, verifying."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import held, ratio
from ledgerloom.functions.text import BLANKS, lowered, norm_ws, plain_signs

#: Dollars a page and a token.
PAGE_COST = {"forms": 0.04, "ocr": 0.004}
TOKEN_COST = (3e-6, 15e-6)
PROGRAMMES = ("RC", "RT", "RP", "RM", "RR", "RZ")


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


#: What the word after a number begins with, and its factor, in targets and in recorded figures.
TARGET_SCALES = {"b": 1e9, "m": 1e6, "k": 1e3, "thousand": 1e3}
FIGURE_SCALES = {"billion": 1e9, "bn": 1e9, "m": 1e6, "thousand": 1e3, "k": 1e3}
CURRENCY = ("\\$", "\\bCAD\\b", "\\bUSD\\b", "dollar")
_NUMBER = "[0-9][0-9,]*(?:[.][0-9]+)?"


def amounts(c: Column) -> Column:
    """Every number of a text in order, as (value, word): its digits without commas, and the sign or letters that come after it."""
    said = F.regexp_extract_all(c, F.lit(f"{_NUMBER}\\s*(?:%|[A-Za-z]*)"), F.lit(0))
    digits = lambda x: F.replace(F.regexp_extract(x, f"^{_NUMBER}", 0), F.lit(","), F.lit(""))
    return F.transform(said, lambda x: F.struct(digits(x).cast("double").alias("value"), F.lower(F.regexp_extract(x, "(%|[A-Za-z]*)$", 1)).alias("word")))


def scaled(amount: Column, scales: dict[str, float]) -> Column:
    """An amount's value times the factor that its word begins with."""
    factor = F.lit(1.0)
    for beginning, times in scales.items():
        factor = F.when(amount["word"].startswith(beginning), times).otherwise(factor)
    return amount["value"] * factor


def target_value(c: Column) -> Column:
    """The first number of a target in full; a percentage is its number; null without a number."""
    return scaled(F.try_element_at(amounts(F.replace(c, F.lit(","), F.lit(""))), F.lit(1)), TARGET_SCALES)


def money(c: Column) -> Column:
    """(amount, unit) of a recorded figure: its first percentage, else its first number if a currency is named; else nulls."""
    all_ = amounts(c)
    percent = F.try_element_at(F.filter(all_, lambda a: a["word"] == "%"), F.lit(1))["value"]
    named = F.lit(False)
    for sign in CURRENCY:
        named = named | c.rlike(f"(?i){sign}")
    value = F.when(named, scaled(F.try_element_at(all_, F.lit(1)), FIGURE_SCALES))
    return F.struct(F.coalesce(percent, value).alias("amount"), F.when(percent.isNotNull(), "percent").when(value.isNotNull(), "money").alias("unit"))


def business_number(c: Column) -> Column:
    """The nine digits of a valid number, alone or with a known programme's code; else null."""
    plain = F.regexp_replace(F.upper(c), r"\s+", "")
    nine = F.regexp_extract(plain, rf"^(\d{{9}})(?:(?:{'|'.join(PROGRAMMES)})\d{{4}})?$", 1)
    return F.when((nine != "") & F.call_function("luhn_check", nine), nine)


def upload_class(kind: Column, declared_public: Column, staff: str = "staff") -> Column:
    """public only where staff declare it so; everything else, nulls too, is closed."""
    return F.when((kind == staff) & declared_public, "public").otherwise("submitted")


def backfilled_class(entity: Column, held: Column, in_scope: tuple[str, ...]) -> Column:
    """The class that a row of an entity in scope without a valid class should get; null to leave it alone."""
    return F.when(entity.isin(*in_scope) & ~F.coalesce(held.isin("public", "submitted"), F.lit(False)), "submitted")


def remapped_key(c: Column, moved: dict[str, str], prefix: str = "COMMIT") -> Column:
    """PREFIX#type#rest with the type mapped; other keys as they are."""
    parts = F.split(c, "#")
    table = F.create_map(*[F.lit(x) for pair in moved.items() for x in pair])
    kind = F.coalesce(F.try_element_at(table, parts[1]), parts[1])
    return F.when(c.startswith(f"{prefix}#") & (F.size(parts) >= 3), F.concat_ws("#", parts[0], kind, F.array_join(F.slice(parts, 3, F.size(parts)), "#"))).otherwise(c)


def cost(engine: Column, pages: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of reading a document: forms by the page, others by tokens, ocr by page as well."""
    return F.when(engine == "forms", pages * PAGE_COST["forms"]).otherwise(tokens_in * TOKEN_COST[0] + tokens_out * TOKEN_COST[1] + F.when(engine == "ocr", pages * PAGE_COST["ocr"]).otherwise(0.0))


def implied_direction(granted: Column, mover_is_ours: Column) -> Column:
    """What a ruling means for our side: the mover prevails if it was granted, and the other side if the mover isn't ours."""
    return F.when(granted == "partly", "partly").when((granted == "granted") == mover_is_ours, "prevailed").otherwise("did_not_prevail")


def contradicts(label: Column, direction: Column) -> Column:
    """A label that can't go with the reasoning: a loss that prevailed, a win that did not."""
    return ((direction == "prevailed") & (label == "loss")) | ((direction == "did_not_prevail") & (label == "party_win"))


def polarity(gold: Column, answer: Column, wanted: Column) -> Column:
    """How an answer counts: abstained, doctrine by its label, unscoreable, else right or inverted."""
    doctrine = (gold == "doctrine_win") | (answer == "doctrine_win")
    return (
        F.when(answer == "unclassified", "abstained").when(doctrine, F.when(gold == answer, "doctrine_matched").otherwise("doctrine_missed"))
        .when((wanted == "partly") | (answer == "mixed"), "unscoreable").when((wanted == "prevailed") == (answer == "party_win"), "right").otherwise("inverted")
    )


def clamped_page(raw: Column, total: Column) -> Column:
    """A page number from text, within 1 and total; anything else is the first."""
    n = F.floor(F.try_to_number(raw, F.lit("S999999999.99")))
    return F.when(n.isNull() | (n < 1), F.lit(1).cast("long")).otherwise(F.least(n.cast("long"), total))


def page_window(page: Column, total: Column) -> Column:
    """The first, the last and the pages around the current one, with an ellipsis where some are left out."""
    shown = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1).cast("long"), total), F.filter(F.sequence(page - 2, page + 2), lambda p: (p >= 1) & (p <= total)))))
    gaps = F.transform(shown, lambda p, i: F.when((i > 0) & (p - shown[i - 1] > 1), F.array(F.lit("..."), p.cast("string"))).otherwise(F.array(p.cast("string"))))
    return F.flatten(gaps)


def sliding_pages(page: Column, total: Column, size: int = 5) -> Column:
    """At most size pages in a row around the current one."""
    last = F.least(total, F.greatest(page + size // 2, F.lit(size)))
    return F.sequence(F.greatest(F.lit(1).cast("long"), last - size + 1), F.greatest(F.lit(1).cast("long"), last))


def halves(text: Column) -> Column:
    """A text as two, cut at the middle one of its paragraphs; null without a paragraph's end inside."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p, F.lit(" \n\t\r")) != "")
    n = F.size(parts)
    cut = F.ceil(n / 2).cast("int")
    return F.when(n >= 2, F.struct(F.array_join(F.slice(parts, 1, cut), "\n\n").alias("first"), F.array_join(F.slice(parts, cut + 1, n), "\n\n").alias("second")))


def verified_names(names: Column, *record: Column, most: int = 5, least: int = 3) -> Column:
    """Names that stand in the record as written, case aside; of those that differ by case the first, most of them at most.
    Case and blanks are SQL's: letters change one for one, and a vertical tab is no blank."""
    trimmed = lambda c: F.btrim(c, F.lit(BLANKS))
    spelled = lambda c: lowered(trimmed(F.regexp_replace(plain_signs(c), r"[ \t\n\f\r]+", " ")))
    there = lambda h: F.filter(F.transform(names, trimmed), lambda n: (F.length(n) >= least) & F.contains(h, spelled(n)))
    first = lambda kept: held(F.transform(kept, lowered), lambda low: F.filter(kept, lambda n, i: F.array_position(low, lowered(n)) == i + 1))
    return F.slice(held(held(spelled(F.concat_ws(" ", *record)), there), first), 1, most)


def verified_briefing(precedents: Column, principles: Column, retrieved: Column) -> Column:
    """Precedents (case_id, establishes, relevance) that were retrieved and say something, each case once, six at most; then
    principles (text, case_ids) that cite one of those, four at most. Null under two precedents."""

    def briefing(got: Column) -> Column:
        told = F.filter(precedents, lambda p: F.array_contains(got, p["case_id"]) & (F.trim(p["establishes"]) != "") & (F.trim(p["relevance"]) != ""))
        once = lambda ids: F.slice(F.filter(ids, lambda c, i: F.array_position(ids, c) == i + 1), 1, 6)
        return held(held(F.transform(told, lambda p: p["case_id"]), once), cited_by)

    def cited_by(cases: Column) -> Column:
        cited = F.transform(principles, lambda p: F.struct(F.trim(p["text"]).alias("text"), F.array_intersect(p["case_ids"], cases).alias("case_ids")))
        kept = F.slice(F.filter(cited, lambda p: (p["text"] != "") & (F.size(p["case_ids"]) > 0)), 1, 4)
        return held(kept, lambda k: F.when(F.size(cases) >= 2, F.struct(cases.alias("cases"), k.alias("principles"), (F.size(precedents) - F.size(cases) + F.size(principles) - F.size(k)).alias("dropped"))))

    return held(retrieved, briefing)


def has_text_layer(text: Column, pages: Column, least: int = 200, per_page: int = 50) -> Column:
    """Enough characters in all and on the mean page, page marks not counted."""
    size = F.length(F.trim(F.regexp_replace(text, r"(?m)^\[p\.[^\]]*\]$", ""), F.lit(" \n\t\r")))
    return (size >= least) & ((pages <= 0) | (size >= pages * per_page))


def profile_text(*parts: Column) -> Column:
    """What there is of the parts as sentences in a row, blanks made one."""
    there = F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != "")
    return F.trim(F.regexp_replace(F.array_join(there, ". "), r"\s+", " "))


def in_order(present: Column, canonical: tuple[str, ...]) -> Column:
    """The canonical values that are present, in their own order."""
    return F.filter(F.array(*map(F.lit, canonical)), lambda x: F.array_contains(present, x))


def unit_length(v: Column) -> Column:
    """A vector of doubles over its norm; zeros stay."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def gate_decision(false_refusal: Column, false_answer: Column, most_refusal: float = 0.05, most_answer: float = 0.2) -> Column:
    """Refusals are judged first, since only they cost something new."""
    ok, caught = false_refusal <= most_refusal, false_answer <= most_answer
    return F.when(ok & caught, "ship").when(caught, "tune").when(ok, "inert").otherwise("unusable")


def wilson_clamped(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval within 0 and 1; [0, 0] without trials."""
    k, m = hits.cast("double"), n.cast("double")
    p, d = F.try_divide(k, m), 1 + z * z / F.nullif(m, F.lit(0.0))
    middle, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    side = lambda c: F.when(n > 0, clamp(c / d, 0.0, 1.0)).otherwise(0.0)
    return side(middle - spread), side(middle + spread)


def against_bar(low: Column, high: Column, n: Column, bar: float) -> Column:
    """clears or fails where the whole interval is on one side of the bar; nothing is concluded from no trials."""
    return F.when(n <= 0, "empty").when((low <= bar) & (high >= bar), "inconclusive").when(high < bar, "clears").otherwise("fails")
