import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import mixing


def levels(sizes):
    """Water filling by repetition: {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    rest, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("hot", [0, 400])
def test_targets_and_sizes(spark, hot):
    df = spark.range(600 + hot).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.expr("transform(sequence(1, 1 + int(id % 37)), x -> concat('w', x))")).alias("text"),
        F.when(F.col("id") >= 600, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), F.lit("x").alias("rank"), F.lit(1).alias("row"),
    ).repartition(5)
    got = mixing.as_contract(mixing.mix(df)).join(df.select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.taken % r.size == 0 and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = levels(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 37
    again = mixing.as_contract(mixing.mix(df.repartition(2))).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document is drawn about as often as its source's share."""
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 20, "a").when(F.col("id") < 40, "b").otherwise("c").alias("source"))
    drawn = None
    for seed in range(6):
        one = mixing.mix(df, seed=seed).select("id", "source", "copies")
        drawn = one if drawn is None else drawn.union(one)
    mean = {r.source: r.m for r in drawn.groupBy("source").agg(F.avg("copies").alias("m")).collect()}
    assert mean == pytest.approx({"a": 2.0, "b": 5 / 6, "c": 5 / 3}, abs=0.05)


def test_inclusion_follows_the_weight_inside_a_source(spark):
    """Within a source, a document is drawn as often as its own weight says, by length or by a column, and the words stay near the target."""
    df = spark.range(600).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', if(id % 2 = 0, 4, 64))").alias("text"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"), (F.col("id") % 3).cast("double").alias("score")
    )
    for column, group in ((None, lambda i: i % 2), ("score", lambda i: i % 3)):
        copies, n = defaultdict(list), 2
        for seed in range(n):
            for r in mixing.mix(df, seed=seed, weight_col=column).select("id", "source", "copies", "size").collect():
                copies[r.source, group(r.id)].append((r.copies, r.size))
        for source, ratio in (("a", 2.0), ("b", 1.0)):
            own = {k: v for (s, k), v in copies.items() if s == source}
            weigh = {k: (len(bin(v[0][1])) - 2 if column is None else k) for k, v in own.items()}
            total = sum(size for v in own.values() for _, size in v)
            mean = sum(weigh[k] * size for k, v in own.items() for _, size in v) / total
            reach = max(abs(w - mean) for w in weigh.values())
            for k, v in own.items():
                want = ratio + 0.5 * min(ratio, 2 - ratio) * (weigh[k] - mean) / reach
                assert sum(c for c, _ in v) / len(v) == pytest.approx(want, abs=0.12)
            assert abs(sum(c * size for v in own.values() for c, size in v) - ratio * total) <= n * 64


@pytest.mark.parametrize("parts", [1, 7])
def test_hot_repeated_id(spark, parts):
    """A third of all rows repeats one id: they tie in rank, and still as many are taken as the target wants."""
    rows = [(k, f"w{k} a b c", f"s{k % 2}") for k in range(400)] + [(7, "one two three four", "s0")] * 200 + [(8, "just this", "s1")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r.copies <= 2 for r in got)
    for source in ("s0", "s1"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    count = lambda rs: sorted((r[0], r[1], r[4]) for r in rs)
    assert count([tuple(r) for r in mixing.as_contract(mixing.mix(df)).collect()]) == count(con.sql(mixing.ORACLE).fetchall())


def test_awkward(spark, awkward, empty):
    got = mixing.as_contract(mixing.mix(awkward)).collect()
    assert len(got) == awkward.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(empty).count() == 0
    rows = awkward.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", rows)
    want = con.sql(mixing.ORACLE).fetchall()
    key = lambda rs: sorted((str(r[0]), r[1], r[2], round(r[3], 6)) for r in rs)
    assert key([tuple(r) for r in got]) == key(want)
    kept = mixing.mixed(awkward.where("doc_id is not null"))
    assert kept.columns == awkward.columns and all(r.copies in (1, 2) for r in kept.collect())
    assert mixing.mixed(empty).count() == 0
