import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language_id.fit(docs.where(~language_id.held_out("doc_id", 4, 2)), 80)


def test_held_out_is_crc32_of_the_id(spark):
    df = spark.range(200).select("id", language_id.held_out("id", 4, 2).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in df.collect())
    assert spark.createDataFrame([(None,)], "id long").select(language_id.held_out("id", 4, 2)).first()[0] is False


def test_accuracy_on_rows_that_were_held_out(spark):
    out = language_id.op1_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.98 and 0 <= r.lo <= r.hi <= 1


def test_families_then_pairs(model):
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert model.pairs == [("germanic", "romance"), ("de", "en"), ("es", "fr")]


def test_margins_equal_scores_of_single_texts(model):
    """A text's score doesn't depend on its neighbours in a batch, and equals the sum over its n-grams."""
    texts = ["Der Hund und die Katze", "", "the dog and the cat", "é", "una casa " * 1000]
    together = model.margins(pa.array(texts))
    alone = np.concatenate([model.margins(pa.array([t])) for t in texts])
    assert together == pytest.approx(alone)
    by_frequency = language_id.frequencies(pa.array(texts)) @ model.weights[:, :-1].T + model.bias
    assert together == pytest.approx(by_frequency, abs=1e-5)


def test_awkward(spark, model, awkward, empty):
    out = language_id.identify(awkward, model)
    assert out.columns == [*[c for c in awkward.columns if c != "score"], "lang_pred", "score"]
    got = out.select("doc_id", "text", "lang_pred", "score").collect()
    assert len(got) == awkward.count()
    for r in got:
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(awkward, nothing).collect()} == {"und"}
    assert language_id.fit(awkward).families == {"germanic": ["en"]}


def test_hot_language_is_sampled_alike(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 50 == 0, "fr").otherwise("en").alias("lang"))
    one, many = language_id.fit(df.coalesce(1), 60), language_id.fit(df.repartition(9), 60)
    assert one.pairs == many.pairs and all(np.array_equal(a, b) for a, b in zip(one.weights, many.weights, strict=True))


def test_repeated_ids_count_once(spark):
    """A language whose rows repeat one id keeps its texts, and gets no more of the sample."""
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("der Hund und die Katze").alias("text"), F.lit("de").alias("lang"))
    rows = rows.union(spark.range(200).select(F.col("id") + 10, F.concat(F.lit("the dog and the cat "), F.col("id").cast("string")), F.lit("en")))
    model = language_id.fit(rows, 50)
    assert model.families == {"germanic": ["de", "en"]}
    assert list(model.predict(pa.array(["der Hund und die Katze", "the dog and the cat"]))[0]) == ["de", "en"]


def test_eighty_languages_are_all_learned(spark):
    """The sample bounds documents, not languages: each of 81 is learned from a few documents, and predicted."""
    scripts = ["abcdefghijklmnop", "абвгдежзиклмнопр", "αβγδεζηθικλμνξοπ"]
    draw = random.Random(5)
    words = [["".join(draw.choice(scripts[k % 3]) for _ in range(6)) for _ in range(5)] for k in range(81)]
    text = lambda k, n: " ".join(words[k][(i + n) % 5] for i in range(20))
    rows = [(k * 10 + n, text(k, n), f"x{k:02}") for k in range(81) for n in range(5)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=243)
    assert {f: len(own) for f, own in model.families.items()} == {"latin script": 27, "cyrillic script": 27, "greek script": 27}
    assert len(model.pairs) == 3 + 3 * 27 * 26 // 2
    got = model.predict(pa.array([t for _, t, _ in rows]))[0]
    assert np.mean([a == b for a, (_, _, b) in zip(got, rows, strict=True)]) > 0.97


def test_query_against_single_texts(spark, folder):
    """The query's rows from a plain loop: n-grams of one text, one machine after the other, votes counted one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "en", None, 0), (10**6 + 1, "?! 12", None, None, 5), (10**6 + 2, "Ünïcode 漢字 words", "en", None, 16)], docs.schema))
    path = folder(documents=docs)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out("doc_id", 4, 2)))
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, path).collect()}
    machine = dict(zip(model.pairs, zip(model.weights[:, :-1].astype(float), model.bias, strict=True), strict=True))

    def vote(x, sides):
        votes, faith = dict.fromkeys(sides, 0), dict.fromkeys(sides, 0.0)
        for i, a in enumerate(sides):
            for b in sides[i + 1 :]:
                w, c = machine[a, b]
                p = 1 / (1 + np.exp(-2 * (x @ w + c)))
                votes[a if p > 0.5 else b] += 1
                faith[a] += p / (len(sides) - 1)
                faith[b] += (1 - p) / (len(sides) - 1)
        best = max(sides, key=lambda s: votes[s] + faith[s] / 2)
        return best, faith[best] if len(sides) > 1 else 1.0

    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = ("und", 0.0)
        if r.text and any(c.isalpha() for c in r.text):
            x = language_id.frequencies(pa.array([r.text]))[0].astype(float)
            family, sure = vote(x, sorted(model.families))
            lang, inner = vote(x, model.families[family])
            want = (lang, sure * inner)
        assert got[r.doc_id].lang_pred == want[0] and got[r.doc_id].score == pytest.approx(want[1], abs=1e-4)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_decide_is_the_plain_vote():
    """Votes, mean confidences and ties as a loop over single rows has them."""
    draw = np.random.default_rng(2)
    model, sides = language_id.LanguageModel({}, [], np.zeros((0, 1)), np.zeros(0)), ["a", "b", "c", "d"]
    margins = np.round(draw.normal(size=(300, 6)), 1)
    best, faith = model.decide(margins, sides)
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    for row, got, sure in zip(margins, best, faith, strict=True):
        votes, confidence = [0] * 4, [0.0] * 4
        for (a, b), m in zip(pairs, row, strict=True):
            p = 1 / (1 + np.exp(-2 * m))
            votes[a] += p > 0.5
            votes[b] += 1 - p > 0.5
            confidence[a] += p / 3
            confidence[b] += (1 - p) / 3
        want = max(range(4), key=lambda k: (votes[k] + confidence[k] / 2, -k))
        assert got == want and sure == pytest.approx(confidence[want])


def test_machine_is_gradient_descent_on_weights():
    """The steps over the examples' products give what the same steps over the weights give."""
    draw = np.random.default_rng(4)
    x, y = draw.normal(size=(30, 12)), np.where(draw.random(30) < 0.4, 1.0, -1.0)
    part, bias = language_id._machine(x @ x.T, y)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    rate, full = 0.5 / ((share[:, None] * x * x).sum() + 1 + 1e-3), np.hstack([x, np.ones((30, 1))])
    w = ahead = np.zeros(13)
    for step in range(150):
        gap = np.maximum(0, 1 - y * (full @ ahead))
        new = ahead - rate * (-2 * full.T @ (share * y * gap) + 1e-3 * np.append(ahead[:-1], 0))
        ahead, w = new + step / (step + 3) * (new - w), new
    assert part @ x == pytest.approx(w[:-1]) and bias == pytest.approx(w[-1])
