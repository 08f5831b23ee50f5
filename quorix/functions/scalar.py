"""Scalar functions: clamping, fixed-point quantization, time parts of ISO texts, category codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000


def f32(x: Column) -> Column:
    return x.cast("float")


def lit32(x: float) -> Column:
    return F.lit(x).cast("float")


def clamp01(x: Column) -> Column:
    """Null stays null: least and greatest would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lit32(0)), lit32(1)))


def portion(x: Column, most: float) -> Column:
    """x over most, in single precision."""
    return f32(f32(x) / lit32(most))


def quantize(x: Column, scale: int = SCALE) -> Column:
    """Half away from zero on the grid of 1/scale, in single precision; -1 stays the sentinel."""
    inside = F.least(F.greatest(f32(x), lit32(-1)), lit32(1))
    moved = f32(inside * lit32(scale)) + F.when(f32(x) >= 0, lit32(0.5)).otherwise(lit32(-0.5))
    return F.when(x.isNotNull(), f32(moved).cast("int"))


def dequantize(q: Column, scale: int = SCALE) -> Column:
    return f32(f32(q) / lit32(scale))


def iso_hour(ts: Column) -> Column:
    """0 to 23, by position; the zone isn't looked at."""
    return F.least(F.greatest(F.substring(ts, 12, 2).try_cast("int"), F.lit(0)), F.lit(23))


def iso_weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(F.substring(ts, 1, 10).try_cast("date"))


def iso_seconds(ts: Column) -> Column:
    """Seconds since 1970 of the first 19 characters, read as UTC whatever the session's zone is."""
    day = F.unix_date(F.substring(ts, 1, 10).try_cast("date")).cast("long")
    part = lambda at: F.substring(ts, at, 2).try_cast("long")
    return day * 86_400 + part(12) * 3600 + part(15) * 60 + part(18)


def minutes_between(a: Column, b: Column) -> Column:
    return F.floor(F.abs(iso_seconds(a) - iso_seconds(b)) / 60).cast("long")


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    return F.unix_date(F.make_date(year, month, day)).cast("long")


def category_code(mcc: Column) -> Column:
    """The first four characters if they are digits, else null."""
    return F.when(mcc.rlike("^[0-9]{4}"), F.substring(mcc, 1, 4))
