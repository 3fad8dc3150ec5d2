import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import cohort, events, features, quantiles, sampling

T = dt.datetime(2020, 1, 1)
H = dt.timedelta(hours=1)
US = dt.timedelta(microseconds=1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def stays(spark):
    return frame(spark, [(1, T, T + 48 * H)], "stay long, intime timestamp_ntz, feature_end timestamp_ntz")


def test_window_has_both_ends(spark, stays):
    times = [T, T + 48 * H, T - US, T + 48 * H + US, None]
    ev = frame(spark, [(1, k, t) for k, t in enumerate(times)], "stay long, k int, t timestamp_ntz")
    assert [r.k for r in events.in_window(ev, stays, "stay", "t").orderBy("k").collect()] == [0, 1]


def test_intervals(spark, stays):
    rows = [(0, T + H, None), (1, None, T + H), (2, None, None), (3, T - H, T), (4, T + 48 * H, T + 50 * H), (5, T - H, T + 60 * H), (6, T - 2 * H, T - H), (7, T + 3 * H, T + 2 * H)]
    iv = frame(spark, [(1, *r) for r in rows], "stay long, k int, start timestamp_ntz, stop timestamp_ntz")
    assert sorted(r.k for r in events.overlapping(iv, stays, "stay", "start", "stop").collect()) == [0, 1, 3, 4, 5, 7]


def test_ties_take_the_least_key_for_first_and_last(spark):
    ev = frame(spark, [(1, "a", T, 3.0, 2), (1, "a", T, 4.0, 1), (1, "a", T, float("nan"), 0), (1, "a", None, 9.0, 0)], "e long, c string, t timestamp_ntz, v double, tie int")
    r = events.summary(ev, ["e", "c"], "t", "v", ["tie"]).first()
    assert (r.n, r["first"], r["last"], r["min"], r["max"], r["mean"]) == (2, 4.0, 4.0, 3.0, 4.0, 3.5)


def test_exposure_of_nothing(spark):
    ev = frame(spark, [(1, None), (1, float("inf")), (2, 1.5), (2, None)], "e long, v double")
    got = {r.e: (r.cnt, r["sum"], r["mean"], r["max"]) for r in events.exposure(ev, ["e"], "v").collect()}
    assert got == {1: (2, 0.0, None, None), 2: (2, 1.5, 1.5, 1.5)}


@pytest.mark.parametrize("n", [1, 2, 101])
def test_quantiles_interpolate(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    r = events.quantile_bounds(frame(spark, [("a", float(x)) for x in v], "c string, v double"), "c", "v", 0.1, 0.9).first()
    assert (r.low, r.high) == pytest.approx((np.quantile(v, 0.1), np.quantile(v, 0.9)))


def test_aggregates_do_not_depend_on_partitions(spark):
    draw = np.random.default_rng(1)
    rows = [(int(draw.integers(3)), "c", T + int(draw.integers(50)) * H, float(round(draw.normal() * 100, 2)), k) for k in range(300)]
    ev = frame(spark, rows, "e long, c string, t timestamp_ntz, v double, tie int")
    whole = sorted(map(tuple, events.summary(ev.coalesce(1), ["e", "c"], "t", "v", ["tie"]).collect()))
    assert whole == sorted(map(tuple, events.summary(ev.repartition(7), ["e", "c"], "t", "v", ["tie"]).collect()))


def test_prevalence_and_rare(spark):
    ev = frame(spark, [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, None)], "e long, c string")
    assert [(r.c, r.n_entities) for r in events.prevalence(ev, "e", "c", 0.5).collect()] == [("a", 2)]
    chosen = events.prevalence(ev, "e", "c", 0.5)
    assert sorted(r.c for r in events.rare_bucket(ev, chosen, "c", "OTHER").collect()) == ["OTHER", "a", "a", "a"]
    assert sorted(r.c for r in events.rare_bucket(ev, chosen, "c", None).collect()) == ["a", "a", "a"]


@pytest.mark.parametrize(
    ("death", "discharge", "flag", "want"),
    [(None, None, None, 0), (None, None, 1, 1), (None, T, 0, 0), (T + H, None, 0, 1), (T + H, T + 2 * H, 0, 1), (T + 3 * H, T + 2 * H, 1, 0), (T - H, None, 1, 0), (T, None, 0, 1)],
)
def test_hospital_death(spark, death, discharge, flag, want):
    df = frame(spark, [(death, T, discharge, flag)], "d timestamp_ntz, s timestamp_ntz, x timestamp_ntz, f int")
    assert df.select(cohort.died_in_hospital(F.col("d"), F.col("s"), F.col("x"), F.col("f"))).first()[0] == want
    if death == T:
        assert df.select(cohort.died_in_hospital(F.col("d"), F.col("s"), F.col("x"), F.col("f"), strictly_after=True)).first()[0] == 0


def test_split_is_disjoint_and_stratified(spark):
    df = spark.range(1000).select((F.col("id") % 400).alias("s"), (F.col("id") % 400 < 100).cast("int").alias("y"))
    got = cohort.stratified_split(df, "s", "y").collect()
    assert len({r.s for r in got}) == len(got) == 400
    count = lambda y, split: sum(r.y == y and r.split == split for r in got)
    assert [count(1, s) for s in ("test", "val", "train")] == [15, 15, 70]
    assert [count(0, s) for s in ("test", "val", "train")] == [45, 45, 210]


def test_earlier_transfers(spark):
    stays = frame(spark, [(1, 10, T), (2, 20, T)], "stay_id long, hadm_id long, intime timestamp_ntz")
    moves = frame(spark, [(10, T - H, "ED"), (10, T - 2 * H, "WARD"), (10, T, "ICU")], "hadm_id long, moved timestamp_ntz, careunit string")
    got = {r.stay_id: (r.n_before, r.last_before) for r in cohort.earlier_transfers(stays, moves).collect()}
    assert got == {1: (2, "ED"), 2: (0, "UNKNOWN")}


def test_encoder(spark):
    train = frame(spark, [(k,) for k in ["a"] * 4 + ["b"] * 3 + ["c"] * 2 + ["d"] + [None]], "x string")
    enc = lambda rows, **o: {r.x: r.f for r in features.frequency_encoded(frame(spark, [(x,) for x in rows], "x string"), train, "x", out="f", **o).collect()}
    got = enc(["a", "c", "z", None], least=2, most=2)
    assert got[None] == pytest.approx(1 / 11)
    assert got["a"] == pytest.approx(4 / 11)
    assert got["c"] == got["z"] == pytest.approx(3 / 11)  # c twice and d once
    assert enc(["z"], least=1, most=12)["z"] == 0.0


def test_pruning(spark):
    rows = [(k, f, v) for k in range(1000) for f, v in (("lab_a", None), ("lab_b", 1.0), ("lab_c", 1.0 if k else None), ("lab_d", float(k % 2)), ("input_rare", float(k == 0)), ("input_some", float(k < 2)))]
    df = frame(spark, rows, "stay long, feature string, value double")
    assert sorted(r.feature for r in features.pruned(df, df).select("feature").distinct().collect()) == ["input_some", "lab_c", "lab_d"]


def test_wide_and_vector(spark):
    long = frame(spark, [(1, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0)], "e long, feature string, value double")
    assert [tuple(r) for r in features.to_wide(long, "e", ["b", "a", "z"]).orderBy("e").collect()] == [(1, 2.0, 1.0, None), (2, 3.0, None, None)]
    many = [f"f{k}" for k in range(features.MOST_CONDITIONAL)] + ["b"]
    assert [r.b for r in features.to_wide(long, "e", many).orderBy("e").collect()] == [2.0, 3.0]
    assert [r.vector for r in features.to_vector(long, "e", ["a", "b"]).orderBy("e").collect()] == [[1.0, 2.0], [None, 3.0]]


def test_matrix(spark):
    df = frame(spark, [(1, True, 2)], "stay_id long, b boolean, c int")
    assert features.matrix(df, ["c", "b", "z"]).first().asDict() == {"stay_id": 1, "c": 2.0, "b": 1.0, "z": 0.0}


def test_quantiles_are_those_of_all_values(spark):
    """Hot keys, ties, few ranges, missing values, null keys: rank selection equals the plain quantiles."""
    import numpy as np

    draw = np.random.default_rng(1)
    groups = {"hot": draw.normal(size=3000), "ties": draw.integers(0, 3, 500).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 4.0]), None: draw.random(40)}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("none", None), ("two", None)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for step in (2, 11):
        got = {r.c: r.q for r in quantiles.exact(frame(spark, rows, "c string, v double").repartition(5), "c", "v", shares, step=step).collect()}
        assert got.pop("none") is None and set(got) == set(groups)
        for k, own in groups.items():
            assert got[k] == pytest.approx(np.quantile(own, shares)), k


def test_bottom_k_is_the_same_in_every_partitioning(spark):
    """Hot, small and null keys; with no room above the share some keys fall short, and all their rows are ranked."""
    import hashlib

    rows = [("hot" if k % 10 else ("few" if k % 100 else None), k) for k in range(4000)]
    df = frame(spark, rows, "c string, id long")
    want = {c: set(sorted((k for d, k in rows if d == c), key=lambda k: hashlib.md5(f"5|{k}".encode()).hexdigest())[:60]) for c in ("hot", "few", None)}
    for parts, room in ((1, sampling.ROOM), (7, sampling.ROOM), (3, -5.0)):
        got = sampling.bottom_k(df.repartition(parts), "c", ["id"], 60, seed=5, room=room).collect()
        assert {c: {r.id for r in got if r.c == c} for c in want} == want and len(got) == 60 + 60 + 40
    assert sampling.bottom_k(df.limit(0), "c", ["id"], 5).count() == 0
