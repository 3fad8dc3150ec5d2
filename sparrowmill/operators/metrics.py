"""Measures of scored rows (label 0 or 1, proba), from counts by score where order matters.

Rows are counted by distinct score first, so cumulative counts run over scores and ties share one place. Order-dependent measures
put distinct scores in ranges, sum the ranges up in order, and only then run within each range: no task sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

THRESHOLDS = [round(0.05 + 0.005 * k, 3) for k in range(181)]
BINS = 1024


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """(n_negative, n_positive, weight): weight is negatives for each positive, 1 without positives."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label) == 1).alias("n_positive"))
    return n.withColumn("weight", F.when(F.col("n_positive") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive"))))


def confusion(df: DataFrame, threshold: float | Column, label: str = "label", proba: str = "proba") -> DataFrame:
    said, is_ = F.col(proba) >= threshold, F.col(label) == 1
    return df.agg(F.count_if(~said & ~is_).alias("tn"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & is_).alias("fn"), F.count_if(said & is_).alias("tp"))


def cumulated(df: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """(score, pos, neg, pos_above, neg_above): counts at each distinct score and at all higher ones."""
    counts = df.where(F.col(proba).isNotNull()).groupBy(F.col(proba).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    counts = counts.withColumn("bin", F.floor(F.col("score") * BINS))
    per_bin = counts.groupBy("bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))  # one row a bin, BINS + 1 at most
    per_bin = per_bin.select("bin", (F.sum("p").over(above) - F.col("p")).alias("p"), (F.sum("n").over(above) - F.col("n")).alias("n"))
    inside = Window.partitionBy("bin").orderBy(F.desc("score"))
    return counts.join(per_bin, "bin").select(
        "score", "pos", "neg", (F.sum("pos").over(inside) - F.col("pos") + F.col("p")).alias("pos_above"), (F.sum("neg").over(inside) - F.col("neg") + F.col("n")).alias("neg_above")
    )


def roc_auc(df: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """(auc): the chance that a positive scores above a negative, a tie counting half; null with one class only."""
    wins = F.sum(F.col("neg") * (F.col("pos_above") * 2 + F.col("pos")))
    return cumulated(df, label, proba).agg(F.try_divide(wins.cast("double"), (F.sum("pos") * F.sum("neg") * 2).cast("double")).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """(average_precision): precision at each score weighed by the recall that it adds, by steps."""
    hits, shown = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    return cumulated(df, label, proba).agg(F.try_divide(F.sum(F.col("pos") * (hits / shown)), F.sum("pos").cast("double")).alias("average_precision"))


def losses(df: DataFrame, threshold: float, label: str = "label", proba: str = "proba") -> DataFrame:
    """(brier, log_loss, prevalence, predicted_positive_rate, f1)."""
    p, y = F.col(proba), F.col(label).cast("double")
    kept = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    said = p >= threshold
    twice = 2.0 * F.count_if(said & (y == 1))
    return df.agg(
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.ln(kept) + (1 - y) * F.ln(1 - kept))).alias("log_loss"),
        F.avg(y).alias("prevalence"),
        F.avg(said.cast("double")).alias("predicted_positive_rate"),
        F.coalesce(F.try_divide(twice, (F.count_if(said) + F.count_if(y == 1)).cast("double")), F.lit(0.0)).alias("f1"),
    )


def sweep(df: DataFrame, thresholds: list[float] = THRESHOLDS, label: str = "label", proba: str = "proba") -> DataFrame:
    """(threshold, tp, fp, fn, f1) for each threshold.

    Each row is counted once, at the highest threshold that it reaches; running sums over the thresholds do the rest.
    """
    steps = sorted(thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in steps]), lambda t: t <= F.col(proba)))
    counts = df.where(F.col(proba).isNotNull()).groupBy(reached.alias("k")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    grid = df.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate([0.0, *steps])], "k int, threshold double")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))  # one row a threshold
    full = grid.join(counts, "k", "left").fillna(0, ["pos", "neg"])
    run = full.select("k", "threshold", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(Window.partitionBy(F.lit(0))).alias("all_pos")).where("k > 0")
    fn = F.col("all_pos") - F.col("tp")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + fn).cast("double")), F.lit(0.0))
    return run.select("threshold", "tp", "fp", fn.alias("fn"), f1.alias("f1"))


def best_threshold(df: DataFrame, thresholds: list[float] = THRESHOLDS, label: str = "label", proba: str = "proba", metric: str = "f1") -> DataFrame:
    """(threshold, f1): the best F1, the lowest threshold among ties. Other metrics aren't known."""
    if metric != "f1":
        raise ValueError(f"thresholds are chosen by f1, not {metric}")
    return sweep(df, thresholds, label, proba).select("threshold", "f1").orderBy(F.desc("f1"), "threshold").limit(1)


def predicted(df: DataFrame, threshold: float, proba: str = "proba") -> DataFrame:
    return df.withColumn("pred_label", (F.col(proba) >= threshold).cast("int"))


def probability(margin: Column) -> Column:
    return scalars.sigmoid(margin)
