"""Uniform samples of bounded size for each key, the same in every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written
from .cohort import hash_order

#: Deviations of room above the wanted share, so that a key has too few rows in it about once in 10^9 times; then all its rows are ranked.
ROOM = 6.0


def _share(at: Column) -> Column:
    return F.conv(F.substring(at, 1, 13), 16, 10).cast("double") / float(16**13)


def bottom_k(df: DataFrame, key: str, ids: Sequence[str], k: int, seed: int = 0, room: float = ROOM) -> DataFrame:
    """The rows of `df` that come first in random order, `k` of each key; all rows of keys with fewer. Rows with a null key have one key.

    Counts by key, partial sums only, say which share of the hash range holds k rows and some more: only these rows are shuffled and ranked, so
    a key with most of the rows costs no more than another. Should a share hold too few, that key's rows are all ranked.
    """
    columns = df.columns
    rows = df.withColumn("_place", hash_order(*ids, seed=seed))
    counts = written(rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")), "counts")
    order = F.row_number().over(Window.partitionBy(key).orderBy("_place", *ids))
    share = (k + room * F.sqrt(F.lit(float(k))) + room * room) / F.col("_n")
    met = rows.join(counts, F.col(key).eqNullSafe(F.col("_key"))).where(_share(F.col("_place")) <= share)
    first = written(met.withColumn("_rank", order).where(F.col("_rank") <= k).select(*columns, "_key", "_n"), "sample")
    few = written(first.groupBy("_key").agg(F.count("*").alias("_got"), F.first("_n").alias("_n")).where(F.col("_got") < F.least(F.lit(k), F.col("_n"))).select("_key"), "few")
    none = counts.join(first.select(F.col("_key").alias("_other")).distinct(), F.col("_key").eqNullSafe(F.col("_other")), "left_anti").select("_key")
    few = few.unionByName(none)
    if few.isEmpty():
        return first.select(columns)
    whole = rows.join(few, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_rank", order).where(F.col("_rank") <= k)
    lacking = few.withColumnRenamed("_key", "_few")
    return first.join(lacking, F.col("_key").eqNullSafe(F.col("_few")), "left_anti").select(columns).unionByName(whole.select(columns))
