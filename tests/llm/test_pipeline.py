import random

from pyspark.sql import functions as F

import corpus_pipeline
from sparrowmill.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "AKIA" + "Q7ZP" * 4


def corpus():
    draw = random.Random(11)
    words = {"en": "the dog and with house of that is this for have".split(), "de": "der hund und mit haus von dass ist diese für haben".split()}
    prose = lambda lang, n: " ".join(draw.choice(words[lang]) + draw.choice(["", "s", "er", "ing", "en"]) for _ in range(n))
    texts = [(prose(lang, 80), lang) for k in range(60) for lang in ("en", "de")]
    item = prose("en", 20)
    texts += [(texts[0][0], "en"), (texts[1][0] + " more", "de"), (f"{prose('en', 30)} {item} {prose('en', 30)}", "en"), (f"{prose('en', 40)} {SECRET} {prose('en', 40)}", "en"), ("?! 123", None), (None, None)]
    return [(k, t, lang, f"src{k % 3}", len(t) if t is not None else None) for k, (t, lang) in enumerate(texts)], item


def test_stages(spark, folder):
    rows, item = corpus()
    path = folder(documents=spark.createDataFrame(rows, SCHEMA), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    n = len(rows)
    copy, near, leak, secret, symbols, null = range(n - 6, n)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "mixing"]
    gone = [{symbols, null}, {copy, near}, {leak}, set()]
    for (_, stage), lost in zip(corpus_pipeline.STAGES, gone, strict=False):
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, path)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert before - {r.doc_id for r in docs.collect()} == lost
    kept = {r.doc_id: r for r in docs.collect()}
    assert SECRET not in kept[secret].text and "[aws-access-key]" in kept[secret].text and kept[secret].n_chars == len(kept[secret].text)
    assert all(kept[k].text == rows[k][1] for k in kept if k != secret)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.copies for r in mixed} <= {1, 2} and {r.doc_id for r in mixed} <= set(kept)
    run = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id, r.text, r.copies) for r in run.collect()) == sorted((r.doc_id, r.text, r.copies) for r in mixed)


def test_no_rows(spark, folder):
    path = folder(documents=spark.createDataFrame([], SCHEMA), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_awkward_rows(spark, folder, awkward):
    """Null ids, repeated rows, a very long text, and extra columns with the names that stages use inside."""
    names = {"lang_pred": F.lit(1), "findings": F.lit("f"), "item_ids": F.lit("i"), "component_id": F.lit(2), "text_key": F.lit("k")}
    items = spark.createDataFrame([(1, None), (2, ""), (3, "not in any of these texts at all")], "item_id long, text string")
    path = folder(documents=awkward.withColumns(names), benchmark=items)
    docs = first = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == first.columns
    texts = {(r.doc_id, r.text) for r in first.collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert set(kept) <= texts and sorted((i for i, _ in kept), key=str) == sorted([3, 4, 6, 7, 11, None], key=str)
    run = corpus_pipeline.run(spark, path)
    assert run.columns == [*[c for c in first.columns if c != "copies"], "copies"]
    assert {(r.doc_id, r.text) for r in run.collect()} <= set(kept)


def test_dedup_takes_five_words(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, None, None, 1), (2, text + " x", None, None, 1)], SCHEMA)
    assert near_dedup.deduplicated(df).agg(F.collect_list("doc_id")).first()[0] == [1]
