"""Entity windows as a stream against the same summaries in batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import events
from sparrowmill.streaming import entities


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, entities.PROVIDER)
    yield spark
    spark.conf.unset(key)


def test_windows_of_entities_as_a_stream(rocks, tmp_path):
    """Events in any order within the lateness, over several files: an earlier first event moves a window that is open."""
    spark, draw = rocks, np.random.default_rng(3)
    start = 1_700_000_000
    rows = []
    for k in range(600):
        user = int(draw.integers(0, 25))
        at = start + user * 3600 + int(draw.integers(0, 5 * 86400))
        rows.append((k, user, str(draw.choice(["a", "b"])), at, [None, float("nan"), float(np.round(draw.normal(), 4))][min(int(draw.integers(0, 12)), 2)]))
    rows += [(700 + k, 900, "a", start + 30 * 86400 + k, 1.0) for k in range(2)]  # pushes the watermark; its own window stays open
    rows += [(800, None, "a", start, 1.0), (801, 4, "a", None, 2.0), (802, 4, "b", start + 4 * 3600, 5.0), (803, 4, "b", start + 4 * 3600, 6.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, kind string, at long, value double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    # within a file any order; between files at most the lateness of disorder, here hours
    order = {r.event_id: r.ts.timestamp() + draw.uniform(-2, 2) * 3600 if r.ts else 0 for r in df.collect()}
    ids = sorted(order, key=order.get)
    for n, part in enumerate(np.array_split(np.array(ids), 6)):
        df.where(F.col("event_id").isin(part.tolist())).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    found = entities.own_window_summary(stream, "user_id", "kind", "ts", "value", "event_id", lateness="6 hours")
    query = found.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out")
    query.awaitTermination(240)
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("entity", "concept", "n", "first", "last", "min", "max", "mean").collect())
    known = df.where("ts is not null and user_id is not null and user_id <> 900")
    inside = events.in_window(known, events.windows(known, "user_id", "ts"), "user_id", "ts")
    want = events.summary(inside, ["user_id", "kind"], "ts", "value", ["event_id"]).select("user_id", "kind", "n", "first", "last", "min", "max", "mean")
    want = sorted(tuple(r) for r in want.collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) > 40
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


def test_needs_a_store_with_timers(spark):
    with pytest.raises(ValueError, match="providerClass"):
        entities.own_window_summary(spark.createDataFrame([], "user_id long, kind string, ts timestamp, value double, event_id long"), "user_id", "kind", "ts", "value", "event_id")
