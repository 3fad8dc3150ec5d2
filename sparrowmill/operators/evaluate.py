"""How good counterfactuals are: validity, proximity, sparsity, actionability and range violations, from long pairs.

Missing values count as 0 in scales and distances, so tables have to be dense: a row for each row and feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.staging import cut
from . import quantiles
from .changes import is_changed

MAD = 1.4826
#: What a run's summary takes the mean and the median of.
MEASURES = (
    "risk_reduction", "proximity_l1_mad", "proximity_l2_mad", "proximity_l1_iqr", "proximity_l2_iqr", "n_changed", "share_changed", "n_violations", "knn_distance", "lof_score", "mahalanobis", "n_outside",
)


def scale_stats(dense: DataFrame) -> DataFrame:
    """(feature, median, iqr, mad, q01, q99) with missing values as 0; a spread of 0 is 1."""
    rows = dense.select("feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    found = cut(quantiles.exact(rows, "feature", "value", [0.5, 0.25, 0.75, 0.01, 0.99]))  # a row a feature, read three times
    gaps = rows.join(found.select("feature", F.col("q")[0].alias("median")), "feature").select("feature", F.abs(F.col("value") - F.col("median")).alias("gap"))
    away = quantiles.exact(gaps, "feature", "gap", [0.5], "away").select("feature", F.col("away")[0].alias("away"))
    one_for_zero = lambda c: F.when(c == 0, F.lit(1.0)).otherwise(c)
    return found.join(away, "feature").select(
        "feature", F.col("q")[0].alias("median"), one_for_zero(F.col("q")[2] - F.col("q")[1]).alias("iqr"), one_for_zero(F.col("away") * MAD).alias("mad"), F.col("q")[3].alias("q01"), F.col("q")[4].alias("q99")
    )


def feature_scale(dense: DataFrame) -> DataFrame:
    """(feature, scale): the interquartile range, else the sample deviation, else 1."""
    q = quantiles.exact(dense, "feature", "value", [0.25, 0.75]).join(dense.groupBy("feature").agg(F.stddev_samp("value").alias("s")), "feature")
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select("feature", F.when(iqr > 0, iqr).when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)).alias("scale"))


def feature_ranges(dense: DataFrame) -> DataFrame:
    """(feature, least, most, range, is_binary): an empty range is 1; binary features have no values but 0 and 1."""
    out = dense.groupBy("feature").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.every(F.coalesce(F.col("value").isin(0.0, 1.0), F.lit(True))).alias("is_binary"))
    width = F.col("most") - F.col("least")
    return out.select("feature", "least", "most", F.when(width > 0, width).otherwise(F.lit(1.0)).alias("range"), "is_binary")


def normalised_l1(pairs: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, distance): the sum of shifts over ranges; missing values add nothing."""
    term = F.abs(F.col("after") - F.col("before")) / F.col("range")
    return pairs.join(ranges.select("feature", "range"), "feature").groupBy(*keys).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("distance"))


def proximity(pairs: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, proximity_l1_mad, proximity_l2_mad, proximity_l1_iqr, proximity_l2_iqr)."""
    d = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    measures = []
    for spread in ("mad", "iqr"):
        term = d / F.col(spread)
        measures += [F.sum(F.abs(term)).alias(f"proximity_l1_{spread}"), F.sqrt(F.sum(term * term)).alias(f"proximity_l2_{spread}")]
    return pairs.join(stats.select("feature", "mad", "iqr"), "feature").groupBy(*keys).agg(*measures)


def sparsity(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_changed, share_changed) of all features."""
    n = F.count_if(is_changed(F.col("before"), F.col("after")))
    return pairs.groupBy(*keys).agg(n.alias("n_changed"), (n / F.count("*")).alias("share_changed"))


def actionability(pairs: DataFrame, mutable: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_violations, all_mutable): changed features that may not change."""
    may = mutable.select("feature").distinct().withColumn("_may", F.lit(True))
    broken = F.count_if(is_changed(F.col("before"), F.col("after")) & F.col("_may").isNull())
    return pairs.join(may, "feature", "left").groupBy(*keys).agg(broken.alias("n_violations"), (broken == 0).alias("all_mutable"))


def precision(dense: DataFrame) -> DataFrame:
    """(feature, places): the most frequent number of decimal places of its values (the fewest among ties)."""
    counts = dense.where(F.col("value").isNotNull()).groupBy("feature", scalars.decimals(F.col("value")).alias("places")).agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg(F.max_by("places", F.struct("n", -F.col("places"))).alias("places"))


def rounded(c: Column, places: Column) -> Column:
    """Half-even rounding to a number of places that varies by row."""
    cases = None
    for k in range(scalars.PRECISION + 1):
        cases = F.when(places == k, F.bround(c, k)) if cases is None else cases.when(places == k, F.bround(c, k))
    return cases.otherwise(c)


def rounded_bounds(ranges: DataFrame, places: DataFrame) -> DataFrame:
    """(feature, low, high, places) from (feature, low, high), at the precision of the feature's values."""
    both = ranges.join(places, "feature", "left").withColumn("places", F.coalesce("places", F.lit(scalars.PRECISION)))
    return both.select("feature", rounded(F.col("low"), F.col("places")).alias("low"), rounded(F.col("high"), F.col("places")).alias("high"), "places")


def range_violations(pairs: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_outside): changed features whose value, at their precision, is outside their bounds."""
    v = rounded(F.col("after"), F.col("places"))
    outside = F.coalesce(is_changed(F.col("before"), F.col("after")) & ((v < F.col("low")) | (v > F.col("high"))), F.lit(False))
    return pairs.join(bounds, "feature", "left").groupBy(*keys).agg(F.count_if(outside).alias("n_outside"))


def validity(scored: DataFrame, threshold: float, target: int = 0) -> DataFrame:
    """`scored` (proba_factual, proba_counterfactual) with `valid`, whether the target label was reached, and `risk_reduction`."""
    after = F.col("proba_counterfactual")
    return scored.withColumn("valid", after < threshold if target == 0 else after >= threshold).withColumn("risk_reduction", F.col("proba_factual") - after)


def summary(evaluated: DataFrame, measures: Sequence[str] = MEASURES, row: str = "row_id") -> DataFrame:
    """One row: counterfactuals, rows, shares of valid counterfactuals, of rows with a valid one and of those that change what may not change, mean and median of each measure."""
    evaluated = cut(evaluated.select(row, "valid", *measures))  # read by several steps
    by_row = evaluated.groupBy(row).agg(F.max("valid").alias("_any"))
    stats = [F.avg(c).alias(f"mean_{c}") for c in measures]
    if "n_violations" in measures:
        stats.append(F.avg((F.col("n_violations") > 0).cast("double")).alias("violation_rate"))
    whole = evaluated.agg(F.count("*").alias("n_counterfactuals"), F.avg(F.col("valid").cast("double")).alias("flip_rate"), *stats)
    n_rows, flipped = by_row.agg(F.count("*")).scalar(), by_row.agg(F.avg(F.col("_any").cast("double"))).scalar()
    long = evaluated.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures])))
    medians = {r["measure"]: r["q"][0] if r["q"] else None for r in quantiles.exact(long, "measure", "value", [0.5]).collect()}  # one row a measure
    return whole.select(whole["*"], *[F.lit(medians.get(c)).cast("double").alias(f"median_{c}") for c in measures], n_rows.alias("n_rows"), flipped.alias("row_flip_rate"))


def run_summary(asked: DataFrame, found: DataFrame, failed: DataFrame, row: str = "row_id") -> DataFrame:
    """One row (n_asked, n_success, n_failed, success_rate): failed rows are those that failed and never succeeded."""
    ok = found.select(row).distinct()
    lost = failed.select(row).distinct().join(ok, row, "left_anti")
    marks = asked.select(row).distinct().join(ok.withColumn("_ok", F.lit(1)), row, "left").join(lost.withColumn("_lost", F.lit(1)), row, "left")
    return marks.agg(F.count("*").alias("n_asked"), F.count("_ok").alias("n_success"), F.count("_lost").alias("n_failed"), F.try_divide(F.count("_ok").cast("double"), F.count("*")).alias("success_rate"))


def flips(scores: DataFrame, threshold: float) -> DataFrame:
    """One row: how many predictions imputation flips, from (proba_native, proba_imputed)."""
    before, after = F.col("proba_native") >= threshold, F.col("proba_imputed") >= threshold
    return scores.agg(F.count("*").alias("n"), F.count_if(before & ~after).alias("n_lost"), F.count_if(~before & after).alias("n_gained"), F.avg((before != after).cast("double")).alias("flip_rate"), F.max(F.abs(F.col("proba_imputed") - F.col("proba_native"))).alias("max_gap"))
