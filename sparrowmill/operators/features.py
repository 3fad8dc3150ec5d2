"""Feature tables: long (stay, feature, value) as the working form, wide only at the end.

In the long form an absent row is a missing value, so statistics, pruning, encoding and comparisons are aggregates and joins on
`feature`, and no plan has thousands of columns. `densified` writes the absent rows out where a count needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, scalars
from . import quantiles

LEVELS = 12
RARE = "RARE"
LEAST_EXPOSED = 0.002
MOST_CONDITIONAL = 60
# Prefixes of features, their group and mutability.
PREFIXES = {
    "chart_": ("clinical_measurement", "mutable_with_clinical_constraints"),
    "lab_": ("clinical_measurement", "mutable_with_clinical_constraints"),
    "output_": ("physiology_response", "non_actionable_or_constrained"),
    "input_": ("treatment_response", "non_actionable_by_default"),
    "proc_": ("treatment_response", "non_actionable_by_default"),
    "drug_cnt_": ("treatment_response", "non_actionable_by_default"),
}
EXPOSURES = ("input_", "output_", "proc_", "drug_cnt_")
MUTABLE = ("mutable_with_clinical_constraints",)
TREATMENTS = ("non_actionable_by_default", "non_actionable_or_constrained")


def to_long(summary: DataFrame, entity: str, concept: str, stats: dict[str, str], infix: str = "_item_") -> DataFrame:
    """(entity, feature, value) from one row for each entity and concept; a column's features are named by its prefix, infix and concept.

    All columns are written out in one pass: a union of tables with the same partitioning and then a grouping by the same key
    isn't safe in this Spark version, as adaptive execution may merge the partitions of its sides differently.
    """
    pairs = F.array(*[F.struct(F.concat(F.lit(f"{prefix}{infix}"), F.col(concept).cast("string")).alias("feature"), F.col(column).cast("double").alias("value")) for column, prefix in stats.items()])
    return summary.select(entity, F.inline(pairs))


def melted(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids, feature, value) of every other column, missing values included."""
    return wide.unpivot(list(ids), [c for c in wide.columns if c not in ids], "feature", "value")


def to_wide(long: DataFrame, entity: str | list[str], features: Sequence[str], fill: float | None = None) -> DataFrame:
    """One column for each of the named features, in their order; naming them spares the pass that looks for them.

    Up to MOST_CONDITIONAL features each is a conditional aggregate, one shuffle of an entity's partial row. A pivot, which groups by
    entity and feature first, takes two, but its buffer is one array, so it holds beyond that. A feature has one row an entity.
    """
    keys = [entity] if isinstance(entity, str) else entity
    if len(features) <= MOST_CONDITIONAL:
        wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])
    else:
        wide = long.groupBy(*keys).pivot("feature", list(features)).agg(F.first("value"))
    return wide.fillna(fill, list(features)) if fill is not None else wide


def to_vector(long: DataFrame, entity: str, features: Sequence[str]) -> DataFrame:
    """(entity, vector): an array<double> in the order of `features`, with null for missing values.

    This is the form that models and distances take: one column however many features there are.
    """
    have = long.where(F.col("value").isNotNull()).groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_map"))
    return have.select(entity, F.transform(F.array(*[F.lit(f) for f in features]), lambda f: F.col("_map")[f]).alias("vector"))


def densified(long: DataFrame, entities: DataFrame, features: DataFrame, entity: str) -> DataFrame:
    """A row for each entity and feature; missing values are null, and 0 for exposures.

    The features of each entity are written out from one array of their names, which is bounded by the feature catalogue.
    """
    every = features.agg(F.array_sort(F.collect_set("feature")))
    grid = entities.select(entity).distinct().select(entity, F.explode(every.scalar()).alias("feature"))
    full = grid.join(long.select(entity, "feature", "value"), [entity, "feature"], "left")
    return full.withColumn("value", filled(F.col("feature"), scalars.finite(F.col("value"))))


def is_exposure(feature: Column) -> Column:
    out = F.lit(False)
    for prefix in EXPOSURES:
        out = out | feature.startswith(prefix)
    return out


def filled(feature: Column, value: Column) -> Column:
    """Exposures that are missing are 0; measurements stay missing."""
    return F.when(value.isNull() & is_exposure(feature), F.lit(0.0)).otherwise(value)


# Columns that tell the outcome.
LEAKS = ("discharge_location", "last_careunit", "outtime", "admittime", "dischtime", "deathtime")


def static_columns(df: DataFrame, keys: Sequence[str], wanted: Sequence[str], leaks: Sequence[str] = LEAKS) -> DataFrame:
    """The keys and those wanted columns that exist and don't tell the outcome, in the order they are wanted."""
    return df.select(*keys, *[c for c in wanted if c in df.columns and c not in leaks and c not in keys])


def levels(train: DataFrame, column: str, least: int = 1, most: int = LEVELS) -> DataFrame:
    """(level, n): at most `most` levels with `least` rows or more, the frequent ones first, then UNKNOWN and RARE."""
    counts = train.select(F.coalesce(F.col(column).cast("string"), F.lit(scalars.UNKNOWN)).alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "level").limit(most)
    extra = train.sparkSession.createDataFrame([(scalars.UNKNOWN,), (RARE,)], "level string")
    return top.unionByName(extra.join(top, "level", "left_anti").withColumn("n", F.lit(0).cast("long")))


def frequency_encoded(df: DataFrame, train: DataFrame, column: str, least: int = 1, most: int = LEVELS, out: str | None = None) -> DataFrame:
    """`df` with the level's share of the training rows; levels that weren't kept have the share of all such rows, 0 at least."""
    named = lambda d: d.withColumn("_level", F.coalesce(F.col(column).cast("string"), F.lit(scalars.UNKNOWN)))
    kept = levels(train, column, least, most).select(F.col("level").alias("_level"), F.lit(True).alias("_kept"))
    bucketed = lambda d: named(d).join(kept, "_level", "left").withColumn("_level", F.when(F.col("_kept"), F.col("_level")).otherwise(F.lit(RARE))).drop("_kept")
    shares = bucketed(train).groupBy("_level").agg(F.count("*").alias("_n"))
    shares = shares.select("_level", (F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0)))).alias("_share"))  # LEVELS + 2 rows at most
    out = out or f"{column}_freq"
    return bucketed(df).join(shares, "_level", "left").withColumn(out, F.coalesce("_share", F.lit(0.0))).drop("_level", "_share")


def _few_values() -> Column:
    """The number of distinct values, missing counting as one, if that is 0 or 1; else 2. From partial minima and maxima, without a shuffle of values."""
    missing = F.max(F.col("value").isNull().cast("int"))
    return F.when(F.min("value") != F.max("value"), F.lit(2)).otherwise(F.max("value").isNotNull().cast("int") + missing).cast("long")


def constant_features(dense: DataFrame) -> DataFrame:
    """(feature, n_distinct): features with one value at most, missing counting as a value."""
    return dense.groupBy("feature").agg(_few_values().alias("n_distinct")).where("n_distinct <= 1")


def sparse_features(dense: DataFrame, least: float = LEAST_EXPOSED) -> DataFrame:
    """(feature, prevalence): features that are zero or missing for all but a few."""
    return dense.groupBy("feature").agg(F.avg((F.coalesce("value", F.lit(0.0)) != 0).cast("int")).alias("prevalence")).where(F.col("prevalence") < least)


def pruned(long: DataFrame, train: DataFrame, least: float = LEAST_EXPOSED) -> DataFrame:
    """`long` without features that are constant in the training rows, or exposures that are too rare there."""
    share = F.avg((F.coalesce("value", F.lit(0.0)) != 0).cast("int"))
    drop = train.groupBy("feature").agg(_few_values().alias("_n"), share.alias("_share")).where((F.col("_n") <= 1) | is_exposure(F.col("feature")) & (F.col("_share") < least))
    return long.join(drop.select("feature"), "feature", "left_anti")


def group_and_mutability(feature: Column, static: Sequence[str] = ("age",)) -> tuple[Column, Column]:
    group, mutability = F.lit("other"), F.lit("review_before_counterfactuals")
    rules = [(feature == "n_transfers_before_icu", "pre_icu_context", "immutable"), (feature.isin(list(static)), "baseline_static", "immutable")]
    rules += [(feature.startswith(prefix), g, m) for prefix, (g, m) in reversed(PREFIXES.items())]
    for condition, g, m in rules:
        group, mutability = F.when(condition, g).otherwise(group), F.when(condition, m).otherwise(mutability)
    return group, mutability


def catalogue(dense: DataFrame, static: Sequence[str] = ("age",)) -> DataFrame:
    """(feature, group, mutability, train_min, train_max, train_median, train_missing_rate) of dense training rows."""
    group, mutability = group_and_mutability(F.col("feature"), static)
    stats = dense.groupBy("feature").agg(
        F.min("value").alias("train_min"),
        F.max("value").alias("train_max"),
        F.avg(F.col("value").isNull().cast("int")).alias("train_missing_rate"),
    )
    stats = stats.join(quantiles.exact(dense, "feature", "value", [0.5]).select("feature", F.col("q")[0].alias("train_median")), "feature")
    return stats.select("feature", group.alias("group"), mutability.alias("mutability"), "train_min", "train_max", "train_median", "train_missing_rate")


def is_mutable(mutability: Column, feature: Column, labels: Sequence[str] = MUTABLE, treatments: bool = False) -> Column:
    return mutability.isin([*labels, *(TREATMENTS if treatments else ())]) & ~feature.endswith("_missing")


def permitted_ranges(catalogue_: DataFrame) -> DataFrame:
    """(feature, low, high) of the features whose learned range isn't empty or a point."""
    return catalogue_.where(F.col("train_min") < F.col("train_max")).select("feature", F.col("train_min").alias("low"), F.col("train_max").alias("high"))


def within_ranges(long: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values moved into their feature's range (feature, low, high); features without one, and missing values, are unchanged."""
    both = long.join(ranges.select("feature", "low", "high"), "feature", "left")
    return both.withColumn("value", scalars.clip(F.col("value"), F.col("low"), F.col("high"))).drop("low", "high")


def with_names(catalogue_: DataFrame, new: dict[str, str]) -> DataFrame:
    """The catalogue under the model's feature names; names without a new one stay."""
    table = catalogue_.sparkSession.createDataFrame(list(new.items()) or [("", "")], "feature string, _new string")
    return catalogue_.join(table, "feature", "left").withColumn("feature", F.coalesce("_new", "feature")).drop("_new")


def missing_summary(vectors: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: rows, rows with a missing value, and mean and median number of missing values."""
    n = missing_features(vectors.withColumn("_row", F.lit(1)), "_row", features).select("n_missing")
    return n.agg(F.count("*").alias("n_rows"), F.count_if(F.col("n_missing") > 0).alias("n_with_missing"), F.avg("n_missing").alias("mean_missing"), F.percentile("n_missing", F.lit(0.5)).alias("median_missing"))


def matrix(df: DataFrame, reference: Sequence[str], ids: Sequence[str] = ("stay_id", "subject_id", "hadm_id", "split")) -> DataFrame:
    """The reference's columns in its order: absent ones are 0, booleans become 0 and 1; the ids that exist come first."""
    kinds = dict(df.dtypes)
    column = lambda c: F.col(f"`{c}`").cast("double") if kinds.get(c) != "boolean" else F.col(f"`{c}`").cast("int").cast("double")
    return df.select(*[c for c in ids if c in df.columns], *[(column(c) if c in kinds else F.lit(0.0)).alias(c) for c in reference])


def renamed_safely(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    new = names.safe_names(df.columns)
    return df.withColumnsRenamed({a: b for a, b in new.items() if a != b}), new


def ranked(catalogue_: DataFrame, importance: DataFrame) -> DataFrame:
    """(feature, importance_gain) of the catalogue's features that the model uses, the most important first by `rank`."""
    both = catalogue_.select("feature").join(importance, "feature")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance_gain"), "feature")))


def capped(observed: DataFrame, ranks: DataFrame, entity: str, most: int) -> DataFrame:
    """For each entity, the `most` best ranked of the features that it has a value for."""
    have = observed.where(F.col("value").isNotNull()).join(ranks.select("feature", "rank"), "feature")
    place = F.row_number().over(Window.partitionBy(entity).orderBy("rank", "feature"))
    return have.withColumn("place", place).where(F.col("place") <= most).select(entity, "feature", "place")


def missing_features(vectors: DataFrame, entity: str, features: Sequence[str]) -> DataFrame:
    """(entity, n_missing, missing): the features without a value, in order."""
    names_ = F.array(*[F.lit(f) for f in features])
    missing = F.filter(names_, lambda f, k: F.col("vector")[k].isNull())
    return vectors.select(entity, F.size(missing).cast("long").alias("n_missing"), missing.alias("missing"))
