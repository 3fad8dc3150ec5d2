"""Scalar expressions. All are built-in columns, so they stay in generated code; NaN and infinities become null first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
PRECISION = 6
CLAMP = 1e-12
#: The relative and the absolute tolerance of `close`.
RELATIVE, ABSOLUTE = 1e-5, 1e-8
SOLVER_TOLERANCE = 1e-6
# Strings that count as missing in text sources.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def finite(c: Column) -> Column:
    """A double; null for NaN and infinities."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column) -> Column:
    """A double from any value; null for what isn't a finite number."""
    return finite(c.try_cast("double"))


def timestamp(c: Column) -> Column:
    """A timestamp without zone; null for what isn't one."""
    return c.try_cast("timestamp_ntz")


def present(c: Column) -> Column:
    """A string; null where it is one of the tokens for missing."""
    return F.when(~c.isin(MISSING_TOKENS), c)


def age(anchor_age: Column, anchor_year: Column, at: Column) -> Column:
    return anchor_age + (F.year(at) - anchor_year)


def minutes(start: Column, stop: Column) -> Column:
    """Minutes from start to stop, 0 at least; null if either is missing."""
    between = (F.unix_micros(stop.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60e6)
    return F.when(between.isNotNull(), F.greatest(between, F.lit(0.0)))


def item_key(primary: Column, fallback: Column) -> Column:
    """Upper-case trimmed key; the fallback serves a null only, and a blank or NAN key is null."""
    key = F.upper(F.trim(F.coalesce(primary, fallback)))
    return F.when(~key.isin("", "NAN"), key)


def category(c: Column) -> Column:
    """Upper-case trimmed category; UNKNOWN for null, blank and NAN."""
    key = F.upper(F.trim(c.cast("string")))
    return F.when(~key.isin("", "NAN"), key).otherwise(F.lit(UNKNOWN))


def clip(c: Column, low: Column, high: Column) -> Column:
    """The value within its bounds; a missing bound doesn't bind, and a missing value stays missing."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def sigmoid(margin: Column) -> Column:
    """1 / (1 + exp(-margin)), by the branch that can't overflow."""
    return F.when(margin >= 0, 1 / (1 + F.exp(-margin))).otherwise(F.exp(margin) / (1 + F.exp(margin)))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(CLAMP)), F.lit(1 - CLAMP))
    return F.ln(p / (1 - p))


def close(a: Column, b: Column) -> Column:
    """Whether a equals b within a tolerance scaled by b; two nulls are close, one isn't."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b))


def moved(before: Column, after: Column) -> Column:
    """Whether a solver's value counts as changed."""
    return F.coalesce(F.abs(after - before) > SOLVER_TOLERANCE, F.lit(False))


def decimals(c: Column) -> Column:
    """Decimal places that a value is written with, PRECISION at most."""
    return F.length(F.rtrim(F.split(F.format_string(f"%.{PRECISION}f", c.cast("double")), r"\.")[1], F.lit("0")))


def nearest_binary(c: Column, low: Column, high: Column) -> Column:
    """0 or 1, the one nearer to the value that lies within the bounds (0 for a tie); null if neither does."""
    zero, one = F.lit(0.0), F.lit(1.0)
    fits = lambda v: (low <= v) & (v <= high)
    first = F.when(F.abs(c) <= F.abs(c - 1), zero).otherwise(one)
    return F.when(fits(first), first).when(fits(1 - first), 1 - first)


def projected(value: Column, low: Column, high: Column, least: Column, most: Column, mutable: Column, binary: Column, allow_missing: Column) -> Column:
    """struct<ok, value>: the value moved into [low, high] and the learned range [least, most].

    A missing value may only stay missing, an immutable one only where it already fits; ok is false where that fails.
    """
    inside = (low <= value) & (value <= high)
    floor, ceiling = F.greatest(low, F.coalesce(least, low)), F.least(high, F.coalesce(most, high))
    free = F.when(binary, nearest_binary(value, floor, ceiling)).otherwise(F.when(floor <= ceiling, F.least(F.greatest(value, floor), ceiling)))
    moved_ = F.when(mutable, free).otherwise(F.when(inside, value))
    return F.struct(F.when(value.isNull(), allow_missing).otherwise(moved_.isNotNull()).alias("ok"), F.when(value.isNotNull(), moved_).alias("value"))
