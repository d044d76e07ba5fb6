"""Text cleaning, normalising, parsing and locating as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of joined letters and what they stand for, and the words that scale a number.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
#: Letters whose capitals are written with several signs, and the one sign that stands for them where case is changed one for one.
WIDE = "".join(c for c in map(chr, range(0xFB18)) if len(c.upper()) > 1)
NARROW = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in WIDE)
#: Unicode's blanks, which SQL's trim takes off.
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
SCALE = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def html_to_text(c: Column) -> Column:
    """Visible text: scripts, styles, heads and page furniture go, block ends become line ends, then entities and blanks."""
    for tag in ("script", "style", "head", "nav", "header", "footer"):
        c = F.regexp_replace(c, f"(?is)<{tag}\\b.*?</{tag}>", " ")
    c = replaced(c, (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", " "))
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(replaced(c, (r"[ \t\r]+", " "), (r" ?\n[ \n]*", "\n")), F.lit(" \n"))


def plain_signs(c: Column) -> Column:
    """Typographic quotes, dashes and no-break blanks made plain."""
    return F.translate(c, "‘’“”–—\u00a0", "''\"\"-- ")


def norm_ws(c: Column) -> Column:
    """Typographic quotes and dashes made plain, all blanks (no-break too) one."""
    return F.trim(F.regexp_replace(plain_signs(c), r"\s+", " "))


def lowered(c: Column) -> Column:
    """Lower case sign by sign, as in SQL: a sigma that ends a word is like any other, and no letter becomes two."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def raised(c: Column) -> Column:
    """Upper case sign by sign, as in SQL: a letter whose capital is written with several signs has one (ẞ) or stays (ﬁ)."""
    sign = lambda x: F.when(F.length(F.upper(x)) > 1, F.translate(x, WIDE, NARROW)).otherwise(F.upper(x))
    return F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(F.array_join(F.transform(F.split(c, ""), sign), ""))


def folded(c: Column) -> Column:
    """norm_ws, and soft hyphens, ellipses, ligatures and blanks before punctuation."""
    c = F.replace(F.replace(c, F.lit("\u00ad"), F.lit("")), F.lit("…"), F.lit("..."))
    for sign, letters in LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return F.regexp_replace(norm_ws(c), r" ([,.;:!?])", "$1")


def alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def quote_occurs(quote: Column, text: Column) -> Column:
    """Every fragment between ellipses of the quote occurs in the text (both alnum); no fragment at all counts as true."""
    fragments = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), alnum), lambda f: f != "")
    return F.forall(fragments, lambda f: F.contains(alnum(text), f))


def amount(c: Column) -> Column:
    """Number after a dollar sign, times its scale word; null without the sign."""
    number = F.try_to_number(F.replace(F.regexp_extract(c, r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")), F.lit("99999999999999.9999")).cast("double")
    scale = F.regexp_extract(F.lower(c), r"\$\s?[0-9][0-9,.]*\s?(thousand|million|billion|bn|k|m|b)\b", 1)
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv]), scale), F.lit(1.0))
    return number * factor


def unit_of(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("$")), "currency").when(F.contains(c, F.lit("%")), "percent").when(c.rlike("[0-9]"), "count").otherwise("none")


def due_date(c: Column) -> Column:
    """ISO date, else the 30th of a quarter's last month, else the year's end; null without a year."""
    iso, quarter, year = F.regexp_extract(c, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1), F.regexp_extract(c, r"\b[qQ]([1-4])\b", 1), F.regexp_extract(c, r"\b((?:19|20)[0-9]{2})\b", 1)
    month = F.lpad((F.try_to_number(quarter, F.lit("9")).cast("int") * 3).cast("string"), 2, "0")
    return F.when(iso != "", iso).when((year != "") & (quarter != ""), F.concat(year, F.lit("-"), month, F.lit("-30"))).when(year != "", F.concat(year, F.lit("-12-31")))


def recurring(c: Column) -> Column:
    return c.rlike(r"(?i)\b(annual|annually|yearly|quarterly|monthly|ongoing|each year|every year)\b")
