"""Price and text scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENS = ("EVS", "EVENS", "EVEN")


def _clean(col: Column) -> Column:
    return F.upper(F.trim(col.cast("string")))


def finite(col: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)


def parse_decimal(col: Column) -> Column:
    """A decimal price; evens are 2.0, other text is null, and so is a price of at most 1."""
    text = _clean(col)
    price = F.when(text.isin(*EVENS), 2.0).otherwise(F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")))
    return F.when(price > 1, price)


def parse_fractional(col: Column) -> Column:
    """``a/b`` as 1 + a/b; evens are 2.0; b = 0 is null."""
    text, pattern = _clean(col), r"^(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)$"
    top, bottom = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2).try_cast("double")
    price = F.when(text.isin(*EVENS), 2.0).otherwise(1 + F.try_divide(top, bottom))
    return F.when(price > 1, price)


def coalesce_odds(decimal: Column, fractional: Column) -> Column:
    return F.coalesce(parse_decimal(decimal), parse_fractional(fractional))


def implied_raw(odds: Column) -> Column:
    return F.when(finite(odds) > 0, 1 / odds)


def clip_prob(col: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.least(col, F.lit(1 - eps)), F.lit(eps))


def leading_rank(col: Column) -> Column:
    return F.regexp_extract(col.cast("string"), r"^\s*(\d+)", 1).try_cast("int")


def distance_to_m(col: Column) -> Column:
    """``1m2f110y`` in metres; a plain number passes through."""
    text = F.lower(F.regexp_replace(F.trim(col.cast("string")), r"\s+", ""))
    part = lambda unit: F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double")
    miles, furlongs, yards = part("m"), part("f"), part("y")
    metres = F.coalesce(miles, F.lit(0.0)) * 1609.344 + F.coalesce(furlongs, F.lit(0.0)) * 201.168 + F.coalesce(yards, F.lit(0.0)) * 0.9144
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double")).when(F.coalesce(miles, furlongs, yards).isNotNull(), metres)


def rank_score(rank: Column, size: Column) -> Column:
    """1 for the first, 0 for the last; 1 where the field has one entrant; 0 where rank or size lacks."""
    return F.when(rank.isNull() | size.isNull(), 0.0).when(size <= 1, 1.0).otherwise(1 - (rank - 1) / F.when(size > 1, size - 1))


def bucket(col: Column, edges: list[float]) -> Column:
    """Left-closed buckets as labels ``[a,b)``; null outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges[:-1], edges[1:]):
        out = F.when((col >= a) & (col < b), f"[{a},{b})").otherwise(out)
    return out
