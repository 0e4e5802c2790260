"""Decimal arithmetic: half-even rounding, basis points, fixed-scale text, level parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_dp(c: str | Column, places: int) -> Column:
    """Half-even rounding, the only rounding that published values get."""
    return F.bround(col(c), places)


def ratio_bps(part: str | Column, whole: str | Column) -> Column:
    """part / whole in basis points to four places; NULL where the whole is zero or missing."""
    return round_dp(col(part) * 10000 / F.nullif(col(whole), F.lit(0)), 4)


def price(c: str | Column) -> Column:
    """Text to an exact price; NULL if it is none (or needs more than eight places)."""
    return col(c).try_cast("decimal(18,8)")


def quantity(c: str | Column) -> Column:
    """Text to a quantity; NULL if it is none or negative. Zero deletes a level."""
    q = price(c)
    return F.when(q >= 0, q)


def level_error(price_text: str | Column, qty_text: str | Column) -> Column:
    """Why a level is malformed, or NULL."""
    return F.when(price(price_text).isNull(), F.lit("malformed price")).when(quantity(qty_text).isNull(), F.lit("malformed quantity"))


def fixed(c: str | Column, scale: int) -> Column:
    """Text with exactly ``scale`` places."""
    return round_dp(c, scale).cast(f"decimal(38,{scale})").cast("string")


def skew_ns(venue_ts: str | Column, wall: str | Column) -> Column:
    """Venue clock minus our wall clock; reported, never ordered by."""
    return col(venue_ts) - col(wall)
