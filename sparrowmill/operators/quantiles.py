"""Exact quantiles by rank selection, with no task holding all values of a key and no shuffle of all values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written

#: Ranges that a key's values are counted in, STEP groups of as many; only ranges that hold a wanted rank are sorted, each by itself.
STEP = 11
#: Keys whose ranges are broadcast, about a kilobyte each.
BROADCAST_KEYS = 8192


def _range_of(v: Column, step: int) -> Column:
    """How many of the sorted `_cuts` are below a value, in two steps: every STEP-th cut first, then those behind it."""
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < v))
    coarse = below(F.col("_coarse")) * step
    return coarse + below(F.slice("_cuts", coarse + 1, step - 1))


def exact(df: DataFrame, key: str, value: str, shares: Sequence[float], out: str = "q", step: int = STEP) -> DataFrame:
    """(key, out): the quantiles of each key's values, by linear interpolation between ranks; null for a key without a value.

    Three scans: a mergeable sketch gives each key's ranges; counts by range, partial sums only, say which ranges hold the wanted
    ranks; the values of these ranges alone, a few hundredths of all, are shuffled, counted and taken in order. What the first two
    leave is a row a key and a row a wanted rank. A null key is a key; null values don't count.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    ranges = step * step
    grid = [k / ranges for k in range(1, ranges)]
    keys = written(rows.groupBy("_key").agg(F.count("_v").alias("_n"), F.percentile_approx("_v", grid, 4 * ranges).alias("_cuts")), "cuts")
    small = keys.count() <= BROADCAST_KEYS

    def met(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
        other = {c: f"{c}_other" for c in on}
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])
        right = right.withColumnsRenamed(other)
        return left.join(F.broadcast(right) if small else right, same, how).drop(*other.values())

    coarse = F.filter("_cuts", lambda c, i: (i + 1) % step == 0)
    # the values' key is kept apart from the cuts, whose arrays are only in the join
    ranged = met(rows.where("_v is not null"), keys.select("_key", "_cuts", coarse.alias("_coarse")), ["_key"]).select("_key", "_v", _range_of(F.col("_v"), step).alias("_range"))
    up = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_key", "_range").agg(F.count("*").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(up), F.lit(0)))
    at = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("_k", "_share")
    asked = keys.where("_n > 0").select("_key", "_n", at).withColumn("_rank", (F.col("_n") - 1) * F.col("_share"))
    asked = asked.select("_key", "_k", "_rank", F.explode(F.array_distinct(F.array(F.floor("_rank"), F.ceil("_rank")))).alias("_whole"))
    holds = (F.col("_whole") >= F.col("_before")) & (F.col("_whole") < F.col("_before") + F.col("_in"))
    wanted = written(met(counts, asked, ["_key"]).where(holds).select("_key", "_k", "_rank", "_whole", "_range", "_before"), "ranks")
    inner = met(ranged, wanted.select("_key", "_range", "_before").distinct(), ["_key", "_range"]).groupBy("_key", "_range", "_before", "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_key", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.select("_key", "_range", "_v", "_c", (F.col("_before") + F.coalesce(F.sum("_c").over(order), F.lit(0))).alias("_from"))
    found = met(inner, wanted.drop("_before"), ["_key", "_range"]).where((F.col("_whole") >= F.col("_from")) & (F.col("_whole") < F.col("_from") + F.col("_c")))
    low, high = F.min("_v"), F.max("_v")
    below = F.floor(F.first("_rank"))
    mixed = F.when(low == high, low).otherwise((below + 1 - F.first("_rank")) * low + (F.first("_rank") - below) * high)
    each = found.groupBy("_key", "_k").agg(mixed.alias("_q")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_k", "_q")))["_q"].alias(out))
    return met(keys.select("_key"), each, ["_key"], "left").select(F.col("_key").alias(key), out)
