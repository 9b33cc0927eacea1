"""Lenient casts, rounding and risk bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_float(x: Column | str) -> Column:
    """A number from text; what is none, and NaN, is 0."""
    v = F.nanvl(col(x).try_cast("double"), F.lit(0.0))
    return F.coalesce(v, F.lit(0.0))


def as_int(x: Column | str) -> Column:
    """A whole number from text, cut towards zero."""
    return F.coalesce(as_float(x).try_cast("int"), F.lit(0))


def blank(x: Column | str) -> Column:
    """Null for an empty string: the empty string is this model's null."""
    return F.nullif(col(x), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    return F.coalesce(*map(blank, xs), F.lit(""))


def detector_level(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 60, "high").when(s >= 25, "medium").when(s >= 15, "low").otherwise("clean")


def summary_band(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 60, "high").when(s >= 25, "medium").when(s > 0, "low").otherwise("clean")


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded half to even; 0 for a zero denominator."""
    return F.coalesce(F.bround(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))
