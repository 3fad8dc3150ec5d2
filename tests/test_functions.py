import datetime as dt
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.functions import names, scalars


def one(spark, column, **values):
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", dt.datetime: "timestamp_ntz"}
    schema = ", ".join(f"{k} {kinds[v] if isinstance(v, type) else kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(None if isinstance(v, type) else v for v in values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("1.5", 1.5), (" 2 ", 2.0), ("x", None), ("nan", None), ("inf", None), ("", None)])
def test_number(spark, text, want):
    assert one(spark, scalars.number(F.col("x")), x=text) == want


def test_timestamp(spark):
    assert one(spark, scalars.timestamp(F.col("x")), x="2020-01-02 03:04:05") == dt.datetime(2020, 1, 2, 3, 4, 5)
    assert one(spark, scalars.timestamp(F.col("x")), x="soon") is None


def test_minutes_are_floored_and_keep_missing(spark):
    a, b = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 1, 30)
    assert one(spark, scalars.minutes(F.col("a"), F.col("b")), a=a, b=b) == 90
    assert one(spark, scalars.minutes(F.col("a"), F.col("b")), a=b, b=a) == 0
    assert one(spark, scalars.minutes(F.col("a"), F.col("b")), a=dt.datetime, b=b) is None


@pytest.mark.parametrize(("drug", "code", "want"), [(" aspirin ", "c", "ASPIRIN"), ("", "c", None), ("  ", "c", None), ("nan", "c", None), (str, "abc", "ABC"), (str, str, None)])
def test_item_key(spark, drug, code, want):
    assert one(spark, scalars.item_key(F.col("a"), F.col("b")), a=drug, b=code) == want


@pytest.mark.parametrize(("v", "low", "high", "want"), [(5.0, float, float, 5.0), (5.0, 6.0, 9.0, 6.0), (5.0, 1.0, 3.0, 3.0), (float, 1.0, 3.0, None), (5.0, float, 3.0, 3.0)])
def test_clip(spark, v, low, high, want):
    assert one(spark, scalars.clip(F.col("v"), F.col("l"), F.col("h")), v=v, l=low, h=high) == want


@pytest.mark.parametrize("margin", [-800.0, -1.5, 0.0, 2.5, 800.0])
def test_sigmoid_and_logit(spark, margin):
    p = one(spark, scalars.sigmoid(F.col("m")), m=margin)
    assert p == pytest.approx(1 / (1 + math.exp(-margin)) if margin > -700 else 0.0)
    assert one(spark, scalars.logit(F.lit(0.25)), m=margin) == pytest.approx(math.log(1 / 3))


def test_close_is_scaled_by_the_second(spark):
    close = scalars.close(F.col("a"), F.col("b"))
    assert one(spark, close, a=1.0, b=1.0 + 1e-6) is True
    assert one(spark, close, a=1.0, b=1.1) is False
    assert one(spark, close, a=float, b=1.0) is False
    assert one(spark, close, a=float, b=float) is True


@pytest.mark.parametrize(("v", "want"), [(1.0, 0), (1.5, 1), (1.25, 2), (1.25000001, 2), (0.123456, 6)])
def test_decimals(spark, v, want):
    assert one(spark, scalars.decimals(F.col("v")), v=v) == want


@pytest.mark.parametrize(("v", "low", "high", "want"), [(0.2, 0.0, 1.0, 0.0), (0.9, 0.0, 1.0, 1.0), (0.2, 0.5, 1.0, 1.0), (0.2, 2.0, 3.0, None)])
def test_nearest_binary(spark, v, low, high, want):
    assert one(spark, scalars.nearest_binary(F.col("v"), F.col("l"), F.col("h")), v=v, l=low, h=high) == want


def test_projection(spark):
    def put(v, low, high, mutable, allow):
        got = one(spark, scalars.projected(F.col("v"), F.col("l"), F.col("h"), F.lit(0.0), F.lit(10.0), F.lit(mutable), F.lit(False), F.lit(allow)), v=v, l=low, h=high)
        return (got["ok"], got["value"])

    assert put(5.0, 6.0, 8.0, True, True) == (True, 6.0)
    assert put(5.0, 6.0, 8.0, False, True) == (False, None)
    assert put(7.0, 6.0, 8.0, False, True) == (True, 7.0)
    assert put(float, 6.0, 8.0, True, True) == (True, None)
    assert put(float, 6.0, 8.0, True, False) == (False, None)
    assert put(5.0, 20.0, 30.0, True, True) == (False, None)  # outside the learned range


def test_safe_names():
    assert names.safe_names(["a b", "a/b", "<5>", "__", "a_b"]) == {"a b": "a_b", "a/b": "a_b_1", "<5>": "lt_5_gt", "__": "feature", "a_b": "a_b_2"}


@given(st.lists(st.text(max_size=8), unique=True, max_size=12))
def test_safe_names_are_distinct(given_names):
    out = names.safe_names(given_names)
    assert len(set(out.values())) == len(given_names)
    assert not any(c in name for name in out.values() for c in names.REPLACEMENTS if c != "-" or "-" in name)
