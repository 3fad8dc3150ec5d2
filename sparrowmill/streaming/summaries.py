"""Event summaries over a stream: the same aggregates as in batch, kept up to date as events arrive.

The reference work is batch only; this is the incremental form of its two aggregates, for tables that keep growing. Counts, sums and
extremes are kept for each key and tumbling window in Spark's state store; events later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars
from ..operators.events import exact_sum


def windowed_summary(stream: DataFrame, keys: list[str], time: str, value: str, width: str = "48 hours", lateness: str = "1 hour") -> DataFrame:
    """(window_start, keys, n, sum, mean, min, max, first, last) of the finite values in each tumbling window."""
    at = F.col(time).cast("timestamp")
    rows = stream.select(*keys, at.alias("_t"), scalars.number(F.col(value)).alias("_v")).where("_v is not null").withWatermark("_t", lateness)
    sums = rows.groupBy(F.window("_t", width), *keys).agg(
        F.count("*").alias("n"), exact_sum(F.col("_v")).alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.min_by("_v", "_t").alias("first"), F.max_by("_v", "_t").alias("last")
    )
    return sums.select(F.col("window.start").alias("window_start"), *keys, "n", "sum", (F.col("sum") / F.col("n")).alias("mean"), "min", "max", "first", "last")


def to_table(summary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each finished window to Parquet once; the checkpoint folder has to be one that all executors share."""
    return summary.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
