"""What a counterfactual changes, in long form (pair ids, feature, before, after), and repairs to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

CHANGES_TYPE = "map<string,struct<`from`:double,`to`:double>>"


def paired(counterfactuals: DataFrame, factuals: DataFrame, keys: Sequence[str], row: str = "row_id") -> DataFrame:
    """(keys, feature, before, after) from long tables (keys, feature, value) and (row, feature, value), missing values included.

    A feature that the counterfactual lacks keeps the factual's value only if the row isn't in the counterfactual at all.
    """
    before = factuals.select(row, "feature", F.col("value").alias("before"))
    after = counterfactuals.select(*keys, "feature", F.col("value").alias("after"))
    return after.join(before, [row, "feature"], "left").select(*keys, "feature", "before", "after")


def restored(pairs: DataFrame) -> DataFrame:
    """Values that were missing before are missing again; `was_restored` says where a value was taken away."""
    return pairs.withColumn("was_restored", F.col("before").isNull() & F.col("after").isNotNull()).withColumn("after", F.when(F.col("before").isNotNull(), F.col("after")))


def frozen(pairs: DataFrame, allowed: DataFrame, row: str = "row_id") -> DataFrame:
    """Features outside the row's allowed ones (row, feature) have their value of before."""
    may = allowed.select(row, "feature").distinct().withColumn("_may", F.lit(True))
    return pairs.join(may, [row, "feature"], "left").withColumn("after", F.when(F.col("_may"), F.col("after")).otherwise(F.col("before"))).drop("_may")


def is_changed(before: Column, after: Column) -> Column:
    """Changed beyond tolerance, seen from the value of after; from or to missing is a change."""
    return ~scalars.close(before, after)


def payload(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_changed, changed, changes, total_abs_shift): sorted features, a map of from and to, the sum of the shifts."""
    item = F.struct("feature", F.struct(F.col("before").alias("from"), F.col("after").alias("to")).alias("change"))
    changed = is_changed(F.col("before"), F.col("after"))
    out = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(changed, item))).alias("_items"), F.coalesce(F.sum(F.when(changed, F.abs(F.col("after") - F.col("before")))), F.lit(0.0)).alias("total_abs_shift"))
    return out.select(*keys, F.size("_items").cast("long").alias("n_changed"), F.col("_items.feature").alias("changed"), F.map_from_entries("_items").alias("changes"), "total_abs_shift")


def encoded(df: DataFrame) -> DataFrame:
    return df.withColumns({"changed": F.to_json("changed"), "changes": F.to_json("changes")})


def decoded(df: DataFrame) -> DataFrame:
    """JSON text back to arrays and maps; text that isn't such JSON is empty."""
    changed = F.coalesce(F.from_json("changed", "array<string>"), F.array().cast("array<string>"))
    changes = F.coalesce(F.from_json("changes", CHANGES_TYPE), F.create_map().cast(CHANGES_TYPE))
    return df.withColumns({"changed": changed, "changes": changes})


def rebuilt(factuals: DataFrame, changes: DataFrame, keys: Sequence[str], row: str = "row_id") -> DataFrame:
    """(keys, feature, value): the factual's values with the changes put in, from decoded changes (keys, changes)."""
    both = changes.select(*keys, "changes").join(factuals.select(row, "feature", "value"), row)
    return both.select(*keys, "feature", F.coalesce(F.col("changes")[F.col("feature")]["to"], F.col("value")).alias("value"))


def rejected(pairs: DataFrame, verdicts: DataFrame, mutable: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """(keys, error_type): the first rule that a counterfactual breaks; rows that break none are absent.

    Rules in order: missing values stay missing and others don't become so; missing-indicators don't change; the prediction has
    to be the target label; only mutable features change.
    """
    may = mutable.select("feature").distinct().withColumn("_may", F.lit(True))
    changed = is_changed(F.col("before"), F.col("after"))
    facts = pairs.join(may, "feature", "left").groupBy(*keys).agg(
        F.max(F.col("before").isNull() != F.col("after").isNull()).alias("missingness"),
        F.max(F.col("feature").endswith("_missing") & changed).alias("indicator"),
        F.max(changed & F.col("_may").isNull()).alias("immutable"),
    )
    error = F.when(F.col("missingness"), "MissingnessChanged").when(F.col("indicator"), "MissingIndicatorChanged").when(F.col("pred_label") != target, "NotFlipped").when(F.col("immutable"), "ImmutableChanged")
    return facts.join(verdicts.select(*keys, "pred_label"), list(keys)).select(*keys, error.alias("error_type")).where("error_type is not null")
