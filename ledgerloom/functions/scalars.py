"""Small column functions with the rounding, guarding and mapping rules that all operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(c: Column) -> Column:
    """To the nearest integer, halves toward positive infinity."""
    return F.floor(c + 0.5).cast("long")


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it; an expression named in a lambda is else computed
    for every element."""
    return F.transform(F.array(value), body)[0]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return round_up(ratio(a, b) * 100)


def mapped(c: Column, pairs: dict[str, str], default: str | None = None) -> Column:
    """A crosswalk by literal map; unmapped values give the default."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def iso_week(c: Column) -> Column:
    """YYYY-Www by the Thursday rule."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval, unclamped; null without trials."""
    n_, p = n.cast("double"), F.try_divide(hits.cast("double"), n.cast("double"))
    middle, spread = p + z * z / (2 * n_), z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))
    return tuple(F.when(n > 0, side / (1 + z * z / n_)) for side in (middle - spread, middle + spread))
