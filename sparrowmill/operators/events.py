"""Timed events: which fall in an entity's window, and what an entity's events of a concept amount to.

Values are summed as decimals of SCALE places, so sums don't depend on the order of addition. Defined results: events without a
time aren't in any window; values that aren't finite numbers are skipped by summaries and still counted by exposures; of
events at the same time, the one with the least tie key is both the first and the last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import quantiles, sampling
from .cohort import later

SCALE = 6
EXACT = f"decimal(28,{SCALE})"


def windows(events: DataFrame, entity: str, time: str, hours: int = 48) -> DataFrame:
    """(entity, intime, feature_end) from each entity's first event."""
    first = events.groupBy(entity).agg(F.min(time).alias("intime"))
    return first.withColumn("feature_end", later(F.col("intime"), hours))


def in_window(events: DataFrame, cohort: DataFrame, on: str | list[str], time: str, start: str = "intime", stop: str = "feature_end", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events with start <= time <= stop of their entity, both ends included, and the wanted cohort columns."""
    on = [on] if isinstance(on, str) else on
    bounds = cohort.select(*on, F.col(start).alias("_start"), F.col(stop).alias("_stop"), *keep)
    return events.join(bounds, on).where((F.col(time) >= F.col("_start")) & (F.col(time) <= F.col("_stop"))).drop("_start", "_stop")


def whole_interval(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Each end stands in for the other where one is missing."""
    return df.withColumns({start: F.coalesce(start, stop), stop: F.coalesce(stop, start)})


def overlapping(df: DataFrame, cohort: DataFrame, on: str | list[str], start: str, stop: str, window_start: str = "intime", window_stop: str = "feature_end") -> DataFrame:
    """Intervals that touch their entity's window, ends included."""
    on = [on] if isinstance(on, str) else on
    bounds = cohort.select(*on, F.col(window_start).alias("_start"), F.col(window_stop).alias("_stop"))
    whole = whole_interval(df, start, stop)
    return whole.join(bounds, on).where((F.col(start) <= F.col("_stop")) & (F.col(stop) >= F.col("_start"))).drop("_start", "_stop")


def clipped(events: DataFrame, bounds: DataFrame, concept: str, value: str, low: str = "low", high: str = "high") -> DataFrame:
    """Values within their concept's bounds; concepts without bounds are unchanged."""
    return events.join(bounds.select(concept, F.col(low).alias("_low"), F.col(high).alias("_high")), concept, "left").withColumn(
        value, scalars.clip(F.col(value), F.col("_low"), F.col("_high"))
    ).drop("_low", "_high")


def quantile_bounds(events: DataFrame, concept: str, value: str, low: float = 0.01, high: float = 0.99, approximate: int | None = None, sample: int | None = None, ids: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(concept, low, high): quantiles of each concept, exact by linear interpolation.

    The exact form selects ranks by counted ranges of values. `approximate` gives the accuracy of a mergeable sketch instead, in
    one pass, whose size doesn't grow with the data. With `sample`, concepts of more values than that have the quantiles of a uniform
    sample of so many, drawn by the hash of `ids`.
    """
    v = scalars.number(F.col(value))
    if sample:
        events = sampling.bottom_k(events.where(v.isNotNull()), concept, ids, sample, seed)
    if approximate:
        q = F.percentile_approx(v, [low, high], approximate)
        return events.groupBy(concept).agg(q.alias("_q")).select(concept, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))
    found = quantiles.exact(events.select(concept, v.alias("_value")), concept, "_value", [low, high], "_q")
    return found.select(concept, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def within(bounds: DataFrame, hard: DataFrame, concept: str) -> DataFrame:
    """Learned bounds cut down to hard ranges (concept, hard_low, hard_high) where there are any."""
    both = bounds.join(hard, concept, "left")
    return both.select(concept, F.greatest("low", "hard_low").alias("low"), F.least("high", "hard_high").alias("high"))


def exact_sum(v: Column) -> Column:
    return F.sum(v.cast(EXACT)).cast("double")


def summary(events: DataFrame, keys: list[str], time: str, value: str, tie: list[str]) -> DataFrame:
    """(keys, n, first, last, min, max, mean) of the finite values with a time."""
    rows = events.select(*keys, F.col(time).alias("_t"), scalars.number(F.col(value)).alias("_v"), *[F.col(c).alias(f"_tie{k}") for k, c in enumerate(tie)]).where("_t is not null and _v is not null")
    ties = [f"_tie{k}" for k in range(len(tie))]
    # the last by time, then the least tie key: the least by (negated time, tie)
    instant = F.unix_micros(F.col("_t").cast("timestamp"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by("_v", F.struct(instant, *ties)).alias("first"),
        F.min_by("_v", F.struct(-instant, *ties)).alias("last"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        (exact_sum(F.col("_v")) / F.count("*")).alias("mean"),
    )


def exposure(events: DataFrame, keys: list[str], value: str, second: str | None = None) -> DataFrame:
    """(keys, cnt, sum, mean, max[, sum_second]): cnt has every row; sums of nothing are 0, mean and max of nothing are null."""
    v = scalars.number(F.col(value))
    extra = [F.coalesce(exact_sum(scalars.number(F.col(second))), F.lit(0.0)).alias("sum_second")] if second else []
    return events.groupBy(*keys).agg(
        F.count("*").alias("cnt"),
        F.coalesce(exact_sum(v), F.lit(0.0)).alias("sum"),
        F.try_divide(exact_sum(v), F.count(v)).alias("mean"),
        F.max(v).alias("max"),
        *extra,
    )


def prevalence(events: DataFrame, entity: str, concept: str, share: float, entities: int | None = None, most: int | None = None) -> DataFrame:
    """(concept, n_entities) of the concepts that at least a share of entities have, most frequent first where `most` limits them.

    Pairs are made distinct first, so that counting a frequent concept is a plain partial sum.
    """
    pairs = events.select(entity, concept).dropna().distinct()
    counts = pairs.groupBy(concept).agg(F.count("*").alias("n_entities"))
    total = F.lit(entities) if entities is not None else events.agg(F.countDistinct(entity)).scalar()
    least = F.greatest(F.ceil(total * share), F.lit(1))
    counts = counts.where(F.col("n_entities") >= least).select(concept, "n_entities")
    return counts.orderBy(F.desc("n_entities"), concept).limit(most) if most else counts


def rare_bucket(events: DataFrame, chosen: DataFrame, key: str, other: str | None) -> DataFrame:
    """Keys that weren't chosen become `other`; without it their rows go. Rows without a key go."""
    known = chosen.select(key).distinct().withColumn("_chosen", F.lit(True))
    out = events.where(F.col(key).isNotNull()).join(known, key, "left")
    if other is None:
        return out.where("_chosen").drop("_chosen")
    return out.withColumn(key, F.when(F.col("_chosen"), F.col(key)).otherwise(F.lit(other))).drop("_chosen")


def with_category(events: DataFrame, dictionary: DataFrame, item: str, category: str = "category") -> DataFrame:
    """Events with their item's category; UNKNOWN for items that the dictionary lacks."""
    known = dictionary.groupBy(item).agg(F.min(scalars.category(F.col(category))).alias(category))
    return events.join(known, item, "left").withColumn(category, F.coalesce(category, F.lit(scalars.UNKNOWN)))
