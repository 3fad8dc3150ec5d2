"""Intermediate tables in the cluster's shared folder, and joins whose broadcast is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..sources.staging import discard, new_path, shared_folder, written

__all__ = ["BROADCAST_DIGESTS", "BROADCAST_ROWS", "discard", "documents", "keyed_join", "new_path", "shared_folder", "small_batches", "written"]

#: Rows of 8-byte keys that may be broadcast (16 MB of keys); above it a join shuffles.
BROADCAST_ROWS = 2_000_000
#: The same for rows of a few 16-byte digests (tens of MB as a hash table).
BROADCAST_DIGESTS = 200_000
#: Bytes of texts and array elements among them, which rows don't bound.
BROADCAST_BYTES = 16 << 20


#: Rows and bytes of a batch sent to Python, where the session doesn't set them: a worker holds some copies of a batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Have Spark send small batches to Python from now on, unless the session has settings of its own."""
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def keyed_join(left: DataFrame, keys: DataFrame, on: str | list[str], how: str, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large table with a narrow written table of keys, broadcast only if it is small.

    It has at most `most` rows, which partial sums or the files' footers count, and its texts and arrays have `most_bytes` at most.
    """
    sizes = [F.octet_length(f.name) if isinstance(f.dataType, StringType) else 16 * F.size(f.name) for f in keys.schema.fields if isinstance(f.dataType, (ArrayType, StringType))]
    if sizes:
        rows, size = keys.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(s, F.lit(0)).cast("long") for s in sizes), F.lit(0))), F.lit(0))).first()
    else:
        rows, size = keys.count(), 0
    return left.join(F.broadcast(keys) if rows <= most and size <= most_bytes else keys, on, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
