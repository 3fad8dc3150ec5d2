"""Filling of missing values with statistics of training rows, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quantiles
from .events import exact_sum


def fill_values(train: DataFrame, how: str = "median") -> DataFrame:
    """(feature, fill): the mean or the median of the values there are, 0 without any."""
    if how not in ("mean", "median"):
        raise ValueError(f"missing values are filled by mean or median, not {how}")
    if how == "median":
        return quantiles.exact(train, "feature", "value", [0.5]).select("feature", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("fill"))
    return train.groupBy("feature").agg(F.coalesce(F.try_divide(exact_sum(F.col("value")), F.count("value")), F.lit(0.0)).alias("fill"))


def imputed(dense: DataFrame, fills: DataFrame) -> DataFrame:
    """`dense` with every missing value filled; `was_missing` says where."""
    return dense.join(fills, "feature", "left").withColumn("was_missing", F.col("value").isNull()).withColumn("value", F.coalesce("value", "fill", F.lit(0.0))).drop("fill")


def overlaid(factuals: DataFrame, imputed_: DataFrame, row: str = "row_id") -> DataFrame:
    """Imputed values in place of the factuals' values, matched by row id and feature."""
    new = imputed_.select(row, "feature", F.col("value").alias("_new"))
    return factuals.join(new, [row, "feature"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")
