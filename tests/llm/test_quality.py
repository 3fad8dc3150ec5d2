import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import quality

SF = "/root/testdata/sf0.01"


def test_accuracy_on_rows_that_were_held_out(spark):
    got = quality.op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    brier = np.mean([(r.score - r.quality) ** 2 for r in got])
    assert brier < 0.05  # calibrated: far below the 0.11 of always saying the base rate


def test_pooling_does_not_depend_on_batches():
    vectors = quality.word_vectors(pa.array(["a b c d e f g", "b c d x y z", None]))
    texts = ["a b c", "", None, "d e f " * 100, "?? b"]
    together = quality.pooled(pa.array(texts), vectors)
    alone = np.concatenate([quality.pooled(pa.array([t], pa.string()), vectors) for t in texts])
    assert together == pytest.approx(alone)
    assert (together[1] == 0).all() and (together[2] == 0).all()


def test_words_in_like_company_are_alike():
    vectors = quality.word_vectors(pa.array(["the red cat sleeps now", "the red dog sleeps now", "one two tea four five"] * 20))
    at = lambda w: vectors[quality.slots(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]]
    assert at("cat") @ at("dog") > 0.9 > at("cat") @ at("tea")


def test_temperature_calibrates():
    draw = np.random.default_rng(3)
    p = draw.random(4000)
    y = (draw.random(4000) < p).astype(float)
    logits = np.log(p / (1 - p))
    assert quality._temperature(logits * 3, y) == pytest.approx(3, rel=0.15)


def test_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (5, 1), (7, 0), (8, 0), (3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    network = quality.fit(awkward, labels)
    out = quality.scored(awkward, network)
    assert out.columns == [*[c for c in awkward.columns if c != "score"], "score"]
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == awkward.count()
    assert quality.scored(empty, network).count() == 0
    assert {r.score for r in quality.scored(awkward, quality.fit(awkward, labels.where("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.scored(awkward, quality.fit(awkward, labels.limit(0))).collect()} == {0.5}
    assert quality.fit(empty, labels).layers is None


def test_labels_of_held_out_rows_are_not_read(spark, folder):
    """Turning all held-out labels around changes no score."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id", 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    path = folder(documents=docs, labels=other)
    score = lambda d: {r.doc_id: r.score for r in quality.op10_quality(spark, d).collect()}
    assert score(path) == score(SF)


def test_sample_is_bounded_by_ids_and_bytes(spark, monkeypatch):
    """Repeated rows of an id are learned from once, and texts beyond the bytes aren't."""
    rows = [(1, "bad text " * 5)] * 500 + [(k, f"good words number {k} " * 3) for k in range(2, 60)] + [(60, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 61)], "doc_id long, quality int")
    seen = []
    plain = quality.word_vectors
    monkeypatch.setattr(quality, "word_vectors", lambda column: seen.append(column) or plain(column))
    quality.fit(df, labels)
    quality.fit(df, labels, sample_bytes=2000)
    assert [len(c) for c in seen][0] == 60 and len(seen[1]) < 40 and sum(len(t.as_py()) for t in seen[1]) <= 2000


def test_query_against_single_rows(spark, folder):
    """Scores of the query equal those of a plain loop over single texts: mean of the token vectors, two layers, temperature."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(150), spark.read.parquet(f"{SF}/labels.parquet")
    path = folder(documents=docs, labels=labels)
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), quality.held_out("doc_id", 3, 1)
    network = quality.fit(docs.where(~out), labels.where(~out))
    got = {r.doc_id: r for r in quality.op10_quality(spark, path).collect()}
    mean, spread, w1, b1, w2, b2 = network.layers
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        slots, _ = quality.slots(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        x = sum((network.vectors[k].astype(float) for k in slots), np.zeros(quality.DIMENSIONS)) / max(len(slots), 1)
        hidden = [np.tanh(sum((x[d] - mean[d]) / spread[d] * w1[d, h] for d in range(len(x))) + b1[h]) for h in range(len(b1))]
        want = 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2) / network.temperature))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-6)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
