"""A training corpus from `documents`: language, near-duplicates, benchmark leaks, secrets, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in the shared folder and hands
it, read again, to the next stage. All but the last return the columns of `documents`; the last adds `copies`.

- language: texts without a letter, or null, have no language and go.
- near_dedup: of each group of near-duplicates (five words, 0.8) the document with the least id stays. Repeated rows of one id
  count as one document. Rows without id can't be named as a copy and stay.
- decontaminate: documents that hold a benchmark item go.
- secrets: secrets are replaced in the text, and n_chars follows; no document goes.
- mix: documents in the mix, with the number of copies of each; documents with no copy go.

Rows without id or source take part like others (a null source is one source, last in order). Texts are read whole, whatever their length; a
stage holds one text at a time. Columns that a stage adds on the way replace none of the table's, and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm import decontaminate, language_id, mixing, near_dedup, secret_scan, tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model, lang_out="lang_pred", score_out="lang_score")
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.contaminated(docs, items, out="item_ids")
    return found.where(F.size("item_ids") == 0).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = secret_scan.fit(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(docs, forest, path_col="source")
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("findings")))
    any_secret = F.exists("findings", lambda f: f["secret"])
    return clean.withColumn("n_chars", F.when(any_secret, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", dedup),
    ("decontaminate", decontaminated),
    ("secret_scan", secrets),
    ("mixing", mix),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`; a stage's table is deleted when the next one's is written."""
    docs, before = tables.documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            tables.discard(before)
        before = docs
    return docs
