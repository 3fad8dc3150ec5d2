"""Which rows are explained: prediction tables, pools, fixed cohorts, windows of an ordered set, and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import cut
from .cohort import hash_order

# Column names that predictions come under, the first that exists counts.
ROW_IDS = ("row_id", "row_index", "index")
LABELS = ("y_true", "label")
PROBABILITIES = ("pred_proba", "proba", "y_proba", "prediction_proba")
PER_RANGE = 100_000


def numbered(df: DataFrame, order: list[str], out: str = "row_id") -> DataFrame:
    """`df` with a position from 0 in the given order, which has to be a total one.

    Rows are sorted in ranges by Spark and counted by partition, so no task sees all rows. The ranges are checkpointed, so that rows and
    counts are of the same ranges whatever adaptive execution does.
    """
    ranges = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = cut(ranges.withColumn("_place", F.row_number().over(inside)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part")  # one row a partition
    counts = counts.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    return placed.join(counts, "_part").withColumn(out, F.col("_place") - 1 + F.col("_before")).drop("_part", "_place", "_before")


def predictions(df: DataFrame, threshold: float, order: list[str] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(row_id, y_true, pred_proba, pred_label) from a table that may name these in other ways.

    Without a row id, rows are numbered in `order`. Without a label column, `labels` (row_id, label) gives it. A pred_label that
    is there is kept, otherwise the probability decides.
    """
    first = lambda names: next((c for c in names if c in df.columns), None)
    row, label, proba = first(ROW_IDS), first(LABELS), first(PROBABILITIES)
    if proba is None and "pred_label" not in df.columns:
        raise ValueError(f"predictions need pred_label or one of {', '.join(PROBABILITIES)}")
    if row is None:
        if not order:
            raise ValueError(f"predictions need one of {', '.join(ROW_IDS)}, or an order to number them")
        df, row = numbered(df, order), "row_id"
    p = F.col(proba).cast("double") if proba else F.lit(None).cast("double")
    said = F.col("pred_label").cast("int") if "pred_label" in df.columns else (p >= threshold).cast("int")
    out = df.select(F.col(row).cast("long").alias("row_id"), (F.col(label).cast("int") if label else F.lit(None).cast("int")).alias("y_true"), p.alias("pred_proba"), said.alias("pred_label"))
    if label is None and labels is not None:
        out = out.drop("y_true").join(labels.select("row_id", F.col("label").cast("int").alias("y_true")), "row_id", "left").select("row_id", "y_true", "pred_proba", "pred_label")
    return out


def pool(predicted: DataFrame, label: int | None, true_only: bool = False) -> DataFrame:
    """Rows of a predicted class (of any, if None), if asked for only those that are truly positive."""
    out = predicted if label is None else predicted.where(F.col("pred_label") == label)
    if true_only:
        if "y_true" not in predicted.columns:
            raise ValueError("true labels are asked for, but there are none")
        out = out.where(F.col("y_true") == 1)
    return out


def factuals(predicted: DataFrame, threshold: float, most: int | None = None, random: bool = False, seed: int = 0, positive: int = 1) -> DataFrame:
    """Rows to explain: predicted positive and at the threshold or above; the highest risk first, or a random sample by id."""
    eligible = predicted.where((F.col("pred_label") == positive) & (F.col("pred_proba") >= threshold))
    if most is None:
        return eligible
    order = [hash_order("row_id", seed=seed)] if random else [F.desc("pred_proba")]
    return eligible.orderBy(*order, "row_id").limit(most)


def fixed_cohort(df: DataFrame, ids: DataFrame, order: str = "position") -> DataFrame:
    """The rows of a list of ids (row_id, position), with its order and repeats; an id that isn't there is an error."""
    lost = ids.join(df.select("row_id"), "row_id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"unknown row ids: {', '.join(str(r['row_id']) for r in lost)}")
    return ids.join(df, "row_id").orderBy(order)


def window_of(df: DataFrame, order: list, offset: int, size: int | None) -> DataFrame:
    """Rows offset to offset + size of an ordered set, by Spark's offset and limit."""
    out = df.orderBy(*order).offset(offset)
    return out if size is None else out.limit(size)


def batches(pool_: DataFrame, size: int, n: int, seed: int = 0, disjoint: bool = True) -> DataFrame:
    """(batch, place, row_id): n random batches. Disjoint ones cut one random order; others draw anew for each batch.

    Only the rows that some batch takes are kept before they are numbered: Spark's ordered limit finds them without sorting all.
    """
    if size <= 0 or n <= 0:
        raise ValueError("batch size and number have to be positive")
    need, have = size * n if disjoint else size, pool_.select("row_id").distinct().count()
    if have < need:
        raise ValueError(f"{need} rows are needed, the pool has {have}")
    ids = pool_.select("row_id").distinct()
    place = Window.partitionBy("batch").orderBy("_order", "row_id")
    if disjoint:
        order = hash_order("row_id", seed=seed)
        taken = ids.withColumn("_order", order).orderBy("_order", "row_id").limit(need)
        numbered_ = taken.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_order", "row_id")) - 1)  # size * n rows
        drawn = numbered_.select((F.floor(F.col("_k") / size) + 1).cast("int").alias("batch"), "row_id", "_order")
    else:
        drawn = None
        for k in range(1, n + 1):
            one = ids.withColumn("_order", hash_order("row_id", seed=seed + k)).orderBy("_order", "row_id").limit(size).select(F.lit(k).alias("batch"), "row_id", "_order")
            drawn = one if drawn is None else drawn.unionByName(one)
    return drawn.select("batch", (F.row_number().over(place)).alias("place"), "row_id")


def manifest(batched: DataFrame, predicted: DataFrame) -> DataFrame:
    """(batch, pred_label, y_true, n)."""
    return batched.join(predicted.select("row_id", "pred_label", "y_true"), "row_id").groupBy("batch", "pred_label", "y_true").agg(F.count("*").alias("n"))
