"""Tables and small documents in files. Everything goes through Spark's readers and writers, so any store that Spark knows will do.

Text tables are read as strings, tokens for missing values become null, and each wanted column is cast with bad values as null;
columns that a table may lack are null columns. Parquet is preferred, CSV is the fallback where only that exists.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ensemble as trees

ITEM_COLUMNS = ("label", "category", "unitname", "fluid")
DEFAULT_THRESHOLD = 0.5
SPLITS = ("train", "val", "test")


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """The named columns with their types; only those are parsed. A column that isn't optional has to be there."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    lost = [c for c in columns if c not in raw.columns and c not in optional]
    if lost:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    cell = lambda c: scalars.present(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")
    cast = lambda c, kind: scalars.number(cell(c)) if kind == "double" else cell(c).try_cast("double").cast("long") if kind == "long" else cell(c).try_cast(kind)
    return raw.select(*[cast(c, kind).alias(c) for c, kind in columns.items()])


def read_table(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """folder/stem as Parquet, else as CSV with a header."""
    for suffix, read in ((".parquet", spark.read.parquet), (".csv", lambda p: spark.read.csv(p, header=True, inferSchema=True))):
        try:
            return read(f"{folder}/{stem}{suffix}")
        except AnalysisException as error:
            if not _missing(error):
                raise
    raise FileNotFoundError(f"there is neither {stem}.parquet nor {stem}.csv in {folder}")


def write_table(df: DataFrame, folder: str, stem: str, kind: str = "parquet") -> str:
    path = f"{folder}/{stem}.{kind}"
    writer = df.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.csv(path, header=True)
    return path


def write_json(spark: SparkSession, document: object, path: str) -> None:
    """A small document as one text file in the folder `path`."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, default: object = None) -> object:
    """The document in a file or folder; the default where there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).where("trim(value) <> ''").limit(1).collect()
    except AnalysisException as error:
        if not _missing(error):
            raise
        return default
    return json.loads(rows[0]["value"]) if rows else default


def item_metadata(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(itemid, label, category, unitname, fluid) of the wanted ids; columns that the dictionary lacks are null; without a file, no rows."""
    kinds = {"itemid": "long"} | dict.fromkeys(ITEM_COLUMNS, "string")
    try:
        table = read_csv(spark, path, kinds, ITEM_COLUMNS)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], ", ".join(f"{c} {'bigint' if k == 'long' else k}" for c, k in kinds.items()))
    return table.join(ids.select("itemid"), "itemid", "left_semi")


def item_categories(spark: SparkSession, path: str) -> DataFrame:
    """(itemid, category): trimmed and upper-case, UNKNOWN where it is missing."""
    table = read_csv(spark, path, {"itemid": "long", "category": "string"}, ("category",)).where("itemid is not null")
    return table.select("itemid", scalars.category(F.col("category")).alias("category"))


def read_split(spark: SparkSession, folder: str, split: str, key: str = "stay_id") -> DataFrame:
    """Features with their label, matched by key and not by position."""
    x, y = read_table(spark, folder, f"X_{split}"), read_table(spark, folder, f"y_{split}")
    return x.join(y.select(key, F.col("label").cast("int").alias("label")), key)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A predictions table by its path, with or without suffix."""
    for suffix in (".parquet", ".csv"):
        if path.endswith(suffix):
            folder, _, name = path.removesuffix(suffix).rpartition("/")
            return read_table(spark, folder or ".", name)
    folder, _, name = path.rpartition("/")
    return read_table(spark, folder or ".", name)


def read_query_ids(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, position): the column row_id, else the first one; rows without an id are dropped.

    The order is that of the files by name, of their blocks and of their lines, whatever tasks read them.
    """
    raw = spark.read.csv(path, header=True)
    name = "row_id" if "row_id" in raw.columns else raw.columns[0]
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    ids = raw.select(F.col(f"`{name}`").try_cast("double").cast("long").alias("row_id"), at.alias("position"))
    return ids.where("row_id is not null")


def write_batches(batches: DataFrame, predicted: DataFrame, folder: str) -> None:
    """A CSV folder of row ids for each batch, and the manifest of counts by label."""
    from ..operators.selection import manifest

    batches.orderBy("batch", "place").select("batch", "row_id").write.mode("overwrite").partitionBy("batch").csv(f"{folder}/row_ids", header=True)
    rows = manifest(batches, predicted).orderBy("batch", "pred_label", "y_true").collect()  # a row for each batch and label
    write_json(batches.sparkSession, [r.asDict() for r in rows], f"{folder}/manifest.json")


def save_model(spark: SparkSession, model: trees.Ensemble, metrics: Mapping[str, object], names: Mapping[str, str], folder: str) -> None:
    """Node table, metrics, importance and name map."""
    table = model.table(spark)
    write_table(table, folder, "nodes")
    write_table(trees.importance(table).orderBy(F.desc("importance_gain"), "feature").coalesce(1), folder, "feature_importance", "csv")
    write_json(spark, dict(metrics) | {"base_margin": model.base_margin}, f"{folder}/metrics.json")
    write_json(spark, dict(names), f"{folder}/feature_names.json")


MODEL_JSON = "model.json"


def load_model(spark: SparkSession, folder: str) -> tuple[trees.Ensemble, float]:
    """The ensemble and its tuned threshold; the default where metrics have none. A model that other software trained is a file model.json."""
    metrics = read_json(spark, f"{folder}/metrics.json", {})
    threshold = metrics.get("threshold_selection", {}).get("best_threshold", DEFAULT_THRESHOLD)
    if read_json(spark, f"{folder}/{MODEL_JSON}") is not None:
        return load_ensemble_json(spark, f"{folder}/{MODEL_JSON}"), float(threshold)
    return trees.Ensemble.load(read_table(spark, folder, "nodes"), metrics.get("base_margin", 0.0)), float(threshold)


def load_ensemble_json(spark: SparkSession, path: str) -> trees.Ensemble:
    """An ensemble from the usual JSON of gradient-boosted trees, with arrays for each tree."""
    document = read_json(spark, path)
    if document is None:
        raise FileNotFoundError(path)
    learner = document["learner"]
    names = learner["feature_names"]
    nodes = []
    for k, tree in enumerate(learner["gradient_booster"]["model"]["trees"]):
        nodes += trees.array_nodes(k, tree["left_children"], tree["right_children"], tree["split_indices"], tree["split_conditions"], tree["default_left"], tree["base_weights"], names)
    p = float(str(learner["learner_model_param"]["base_score"]).strip("[]"))
    return trees.Ensemble(nodes, spark.range(1).select(scalars.logit(F.lit(p))).first()[0])


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed_batches(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches (folders batch=K) whose write was committed."""
    system, at = _file_system(spark, f"{path}/batch=*/_SUCCESS")
    return {int(s.getPath().getParent().getName().removeprefix("batch=")) for s in system.globStatus(at) or []}


def remove(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def log_attempts(attempts: DataFrame, path: str, restart: bool = False) -> None:
    """Attempts as JSON lines, added to those of earlier steps unless the run restarts."""
    attempts.write.mode("overwrite" if restart else "append").json(path)


def write_imputed(frames: Mapping[str, DataFrame], facts: Mapping[str, object], folder: str) -> None:
    """Imputed frames for later runs, with what they were made from."""
    spark = next(iter(frames.values())).sparkSession
    counts = {}
    for name, df in frames.items():
        write_table(df, folder, name)
        counts[name] = {"rows": read_table(spark, folder, name).count(), "columns": df.columns}
    write_json(spark, {"facts": dict(facts), "frames": counts}, f"{folder}/metadata.json")


def read_imputed(spark: SparkSession, facts: Mapping[str, object], folder: str) -> dict[str, DataFrame]:
    """The imputed frames, if they are whole and were made from the same facts; an error says what differs."""
    metadata = read_json(spark, f"{folder}/metadata.json")
    if metadata is None:
        raise FileNotFoundError(f"{folder}/metadata.json")
    other = sorted(k for k, v in facts.items() if metadata["facts"].get(k) != v)
    if other:
        raise ValueError(f"the imputed frames were made with other values of {', '.join(other)}")
    frames = {name: read_table(spark, folder, name) for name in metadata["frames"]}
    for name, df in frames.items():
        asked = metadata["frames"][name]
        if df.columns != asked["columns"] or df.count() != asked["rows"]:
            raise ValueError(f"the imputed frame {name} isn't as it was written")
    return frames
