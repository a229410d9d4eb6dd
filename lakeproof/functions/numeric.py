"""Rounding and percentages with half-up-to-positive rounding (P-19 to P-24, A-03)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """P-24: nearest integer, ties towards positive infinity (-2.5 gives -2); Spark's round() differs on negative ties."""
    return F.floor(x + F.lit(0.5))


def round_places(x: Column, places: int) -> Column:
    """P-24 at so many decimal places."""
    scale = float(10**places)
    return round_half_up(x * F.lit(scale)).cast("double") / F.lit(scale)


def _ratio(part: Column, whole: Column, empty: float, body) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(body(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")))


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """P-20: share in percent, two places, scaled before rounding; `empty` for a whole of 0."""
    return _ratio(part, whole, empty, lambda r: round_half_up(r * F.lit(10000.0)).cast("double") / F.lit(100.0))


def percent_scaled(part: Column, whole: Column) -> Column:
    """P-21: percent first, then rounded to two places."""
    return _ratio(part, whole, 0.0, lambda r: round_places(r * F.lit(100.0), 2))


def percent_fixed(part: Column, whole: Column) -> Column:
    """P-22: percent with two fixed places; an empty whole counts as fully covered."""
    return _ratio(part, whole, 100.0, lambda r: F.round(r * F.lit(100.0), 2))


def percent_whole(part: Column, whole: Column) -> Column:
    """P-23: whole percent."""
    return _ratio(part, whole, 0.0, lambda r: round_half_up(r * F.lit(100.0)).cast("double"))


def share_of_flags(*flags: Column) -> Column:
    """A-03: the share of true flags; null is false."""
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0)).cast("double") / F.lit(float(len(flags)))


def to_number(text: Column) -> Column:
    """P-19: the leading number of a text, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")
