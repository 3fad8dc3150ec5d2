"""Roles that the driver's tables play, as DataFrames and as SQL for the oracle.

events: entity user_id, concept event_type, time ts; a user's window is 48 hours from the first event. Model features are
each type's mean value (a measurement, missing without events) and count (an exposure, 0 without events) in the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble as trees
from ..operators import events, features

HOURS = 48
TYPES = ["click", "error", "purchase", "signup", "view"]
STATS = ["first", "last", "min", "max", "mean"]
MEANS = [f"chart_mean_item_{t}" for t in TYPES]
COUNTS = [f"input_cnt_item_{t}" for t in TYPES]
FEATURES = [*MEANS, *COUNTS]
THRESHOLD = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in their user's window, by a join with the windows: the aggregate behind them combines before its shuffle, and the events
    aren't shuffled at all while the windows are small enough for Spark to broadcast; a user with most of the events is no harm."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.in_window(rows, events.windows(rows, "user_id", "ts", HOURS), "user_id", "ts")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.summary(windowed(spark, sf_dir), ["user_id", "event_type"], "ts", "value", ["event_id"])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and FEATURES."""
    own = windowed(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("cnt"), (events.exact_sum(F.col("value")) / F.count("value")).alias("mean"))
    long = features.to_long(own, "user_id", "event_type", {"mean": "chart_mean", "cnt": "input_cnt"})
    return features.to_wide(long, "user_id", FEATURES).fillna(0.0, COUNTS)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, feature, value) with a row for each user and feature."""
    return features.melted(wide(spark, sf_dir), ["user_id"])


def _tree(tree: int, root: tuple, low: tuple, high: tuple, leaves: list[float]) -> list[trees.Node]:
    inner = [trees.Node(tree, k, 2 * k + 1, 2 * k + 2, f, t, d, None, g) for k, (f, t, d, g) in enumerate((root, low, high))]
    return inner + [trees.Node(tree, 3 + k, None, None, None, None, None, v) for k, v in enumerate(leaves)]


#: A small fixed model, both kinds of features and both default directions.
TOY = trees.Ensemble(
    [
        *_tree(0, ("chart_mean_item_click", 50.0, True, 9.0), ("input_cnt_item_view", 1.0, True, 4.0), ("chart_mean_item_view", 40.0, False, 3.0), [-0.6, 0.3, 0.2, 0.7]),
        *_tree(1, ("chart_mean_item_error", 35.0, False, 7.0), ("chart_mean_item_purchase", 20.0, True, 2.0), ("input_cnt_item_error", 2.0, True, 5.0), [-0.4, 0.1, 0.35, -0.2]),
        *_tree(2, ("chart_mean_item_signup", 45.0, True, 6.0), ("chart_mean_item_click", 25.0, False, 1.0), ("input_cnt_item_signup", 2.0, True, 8.0), [0.25, -0.3, 0.5, -0.15]),
    ],
    base_margin=0.0513,
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, proba, pred_label, features): label 1 for a purchase in the 48 hours after the window."""
    ev = table(spark, sf_dir, "events")
    w = events.windows(ev, "user_id", "ts", HOURS)
    after = ev.where("event_type = 'purchase'").select("user_id", "ts").join(w, "user_id").where("ts > feature_end and ts <= feature_end + interval 48 hours").select("user_id").distinct().withColumn("label", F.lit(1))
    rows = trees.scored(wide(spark, sf_dir), TOY).join(after, "user_id", "left")
    p = F.round("proba", 9)
    return rows.select(F.col("user_id").alias("row_id"), F.coalesce("label", F.lit(0)).alias("label"), p.alias("proba"), (p >= THRESHOLD).cast("int").alias("pred_label"), *FEATURES)


def _mean_sql(t: str) -> str:
    return f"(sum(value::DECIMAL(28,6)) FILTER (event_type = '{t}'))::DOUBLE / count(value) FILTER (event_type = '{t}') AS chart_mean_item_{t}"


def _count_sql(t: str) -> str:
    return f"count(*) FILTER (event_type = '{t}')::DOUBLE AS input_cnt_item_{t}"


WINDOWED_SQL = f"""
windows AS (SELECT user_id, min(ts) AS intime, min(ts) + INTERVAL {HOURS} HOUR AS feature_end FROM events GROUP BY user_id),
windowed AS (SELECT e.* FROM events e JOIN windows w ON e.user_id = w.user_id AND e.ts >= intime AND e.ts <= feature_end)"""
WIDE_SQL = f"""{WINDOWED_SQL},
wide AS (SELECT user_id, {", ".join([*map(_mean_sql, TYPES), *map(_count_sql, TYPES)])} FROM windowed GROUP BY user_id)"""
DENSE_SQL = f"""{WIDE_SQL},
dense AS (SELECT user_id, feature, value FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(FEATURES)})))"""
SCORED_SQL = f"""{WIDE_SQL},
later AS (SELECT DISTINCT e.user_id FROM events e JOIN windows w ON e.user_id = w.user_id WHERE event_type = 'purchase' AND ts > feature_end AND ts <= feature_end + INTERVAL 48 HOUR),
margins AS (SELECT *, {trees.margin_sql(TOY)} AS margin FROM wide),
scored AS (
  SELECT m.user_id AS row_id, (l.user_id IS NOT NULL)::INT AS label, round(1 / (1 + exp(-margin)), 9) AS proba, (round(1 / (1 + exp(-margin)), 9) >= {THRESHOLD})::INT AS pred_label, {", ".join(FEATURES)}
  FROM margins m LEFT JOIN later l ON m.user_id = l.user_id)"""
