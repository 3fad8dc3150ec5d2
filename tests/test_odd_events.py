"""Queries on events with odd values, against their SQL: means of exactly 0, users with other events only, values on a model's thresholds."""

from datetime import datetime, timedelta

import duckdb
import pytest

from sparrowmill import queries
from sparrowmill.plans.tables import TOY, TYPES

CUTS = sorted({n.threshold for n in TOY.nodes if n.feature and n.feature.startswith("chart")})


def same(spark, tmp_path, name, events):
    """The query's rows are its SQL's over (user_id, event_type, value)."""
    begin = datetime(2024, 1, 1)
    rows = [(k, begin + timedelta(minutes=k), user, kind, value, "{}") for k, (user, kind, value) in enumerate(events)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    key = lambda r: [str(x) for x in r]
    got = sorted([tuple(r[c] for c in want.columns) for r in found.collect()], key=key)
    assert got == sorted(want.fetchall(), key=key)
    return got


def test_zero_fill_keeps_means_of_zero_and_every_user(spark, tmp_path):
    events = [(1, "click", 0.0), (1, "view", 3.5), (2, "error", 1.0), (2, "error", -1.0), (3, "other", 7.0), (4, "signup", None)]
    got = same(spark, tmp_path, "zero_fill", events)
    assert {(1, "chart_mean_item_click", 0.0), (2, "chart_mean_item_error", 0.0), (3, "chart_mean_item_click", None), (3, "input_cnt_item_click", 0.0)} <= set(got)


@pytest.mark.parametrize("name", ["exact_search", "exact_apart"])
def test_exact_search_crosses_thresholds_that_values_lie_on(spark, tmp_path, name):
    """Every user has each value at a threshold; a step below it may be all that flips the prediction."""
    n, kinds = len(CUTS), len(TYPES)
    events = [(u, t, CUTS[(u // n**k + k) % n] if (u + k) % 4 else 10.0 * (u % 9)) for u in range(60) for k, t in enumerate(TYPES)]
    events += [(u, TYPES[u % kinds], CUTS[u % n]) for u in range(0, 60, 3)]
    assert same(spark, tmp_path, name, events)
