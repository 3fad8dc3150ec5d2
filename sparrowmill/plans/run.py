"""The stages of a whole run, from raw tables to every counterfactual method, and a command line for them.

    python -m sparrowmill.plans.run --raw DIR --data DIR --model DIR --results DIR --query-ids DIR [--stages a,b] [--strict] [--dry-run] [--list] [--set stage.option=value]
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, selection
from ..sources import files
from .explanations import ExplainConfig, explain
from .pipelines import FeatureConfig, Stage, build_features, overridden, run_stages, train_model, write_features

# Raw tables by file name, with the role of each column that is read.
RAW = {
    "stays": ("icustays", {"stay_id": "long", "hadm_id": "long", "subject_id": "long", "intime": "timestamp_ntz", "outtime": "timestamp_ntz", "first_careunit": "string"}),
    "admissions": (
        "admissions",
        {"hadm_id": "long", "subject_id": "long", "dischtime": "timestamp_ntz", "deathtime": "timestamp_ntz", "hospital_expire_flag": "int"}
        | dict.fromkeys(("admission_type", "admission_location", "insurance", "language", "marital_status", "race"), "string"),
    ),
    "patients": ("patients", {"subject_id": "long", "anchor_age": "double", "anchor_year": "int", "dod": "timestamp_ntz", "gender": "string"}),
    "transfers": ("transfers", {"hadm_id": "long", "intime": "timestamp_ntz", "careunit": "string"}),
    "chart": ("chartevents", {"stay_id": "long", "itemid": "long", "charttime": "timestamp_ntz", "valuenum": "double"}),
    "lab": ("labevents", {"hadm_id": "long", "itemid": "long", "charttime": "timestamp_ntz", "valuenum": "double"}),
    "input": ("inputevents", {"stay_id": "long", "itemid": "long", "starttime": "timestamp_ntz", "endtime": "timestamp_ntz", "amount": "double", "rate": "double"}),
    "output": ("outputevents", {"stay_id": "long", "itemid": "long", "charttime": "timestamp_ntz", "value": "double"}),
    "procedure": ("procedureevents", {"stay_id": "long", "itemid": "long", "starttime": "timestamp_ntz", "endtime": "timestamp_ntz"}),
    "drugs": ("prescriptions", {"hadm_id": "long", "drug": "string", "formulary_drug_cd": "string", "starttime": "timestamp_ntz", "stoptime": "timestamp_ntz"}),
    "items": ("d_items", {"itemid": "long", "category": "string"}),
}
NEEDED = ("stays", "admissions", "patients")
OPTIONAL = ("dod", "first_careunit", "rate", "amount", "category", "deathtime", "dischtime", "hospital_expire_flag", "gender", "admission_type", "admission_location", "insurance", "language", "marital_status", "race", "outtime")
NEW_NAMES = {"charttime": "time", "valuenum": "value", "starttime": "start", "endtime": "stop", "stoptime": "stop", "amount": "value", "formulary_drug_cd": "code"}
QUERY_IDS = {"label": 1, "true_only": True, "size": 300, "n": 1, "seed": 0, "disjoint": True}
#: The counterfactual methods by stage name.
METHODS = {"facet": ("beam", None), "dice_mean": ("genetic", "mean"), "dice_median": ("genetic", "median"), "dice_knn": ("genetic", "knn"), "ocean": ("exact", "median")}


def raw_tables(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, DataFrame]:
    """Raw CSV tables under their roles, each scanned with the columns that are used; a table that isn't there is left out, unless needed."""
    out = {}
    for role, (stem, columns) in RAW.items():
        try:
            df = files.read_csv(spark, f"{folder}/{stem}{suffix}", columns, OPTIONAL)
        except files.AnalysisException as error:
            if not files._missing(error) or role in NEEDED:
                raise
            continue
        out[role] = df.withColumnsRenamed({a: b for a, b in NEW_NAMES.items() if a in df.columns})
    # tables by admission reach its stays; the windows choose among them
    for role in ("lab", "drugs"):
        if role in out:
            out[role] = out[role].join(out["stays"].select("hadm_id", "stay_id"), "hadm_id").drop("hadm_id")
    for role in ("chart", "lab"):
        if role in out:
            out[role] = out[role].withColumn("tie", F.xxhash64("value"))
    return out


def query_ids(spark: SparkSession, model: str, out: str, split: str = "test", **given) -> None:
    """Batches of row ids from a pool of predicted rows, with their manifest."""
    options = QUERY_IDS | given
    _, threshold = files.load_model(spark, model)
    predicted = selection.predictions(files.read_predictions(spark, f"{model}/predictions_{split}"), threshold)
    pool = selection.pool(predicted, options["label"], options["true_only"])
    files.write_batches(selection.batches(pool, options["size"], options["n"], options["seed"], options["disjoint"]), predicted, out)


def stages(spark: SparkSession, folders: Mapping[str, str], options: Mapping[str, Mapping[str, object]] | None = None) -> list[Stage]:
    """The stages over folders raw, data, model, query_ids and results; options by stage name, `cf` for every method."""
    given = options or {}
    own = lambda name: dict(given.get(name, {}))

    def preprocess() -> None:
        config = overridden(FeatureConfig(), own("preprocess"))
        write_features(build_features(raw_tables(spark, folders["raw"]), config), folders["data"], config=config)

    def method(name: str) -> Stage:
        kind, fill = METHODS[name]
        config = lambda: overridden(ExplainConfig(method=kind, fill=fill), dict(given.get("cf", {})) | own(name))
        return Stage(name, lambda: explain(spark, folders["data"], folders["model"], f"{folders['results']}/{name}", config()))

    return [
        Stage("preprocess", preprocess, core=True),
        Stage("train", lambda: train_model(spark, folders["data"], folders["model"], overridden(boosting.Settings(), own("train"))), core=True),
        Stage("query_ids", lambda: query_ids(spark, folders["model"], folders["query_ids"], **own("query_ids"))),
        *map(method, METHODS),
    ]


def parsed(settings: Sequence[str]) -> dict[str, dict[str, object]]:
    """stage.option=value, the value as JSON or else as text."""
    out: dict[str, dict[str, object]] = {}
    for setting in settings:
        name, _, text = setting.partition("=")
        stage, _, option = name.partition(".")
        if not text or not option:
            raise ValueError(f"not stage.option=value: {setting}")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        out.setdefault(stage, {})[option] = value
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all wanted stages are done."""
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("raw", "data", "model", "query-ids", "results"):
        parser.add_argument(f"--{name}", default=name.replace("-", "_"))
    parser.add_argument("--stages", default="all")
    parser.add_argument("--set", action="append", default=[], dest="settings")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--list", action="store_true")
    given = parser.parse_args(arguments)
    folders = {"raw": given.raw, "data": given.data, "model": given.model, "query_ids": given.query_ids, "results": given.results}
    spark = spark or (None if given.list or given.dry_run else SparkSession.builder.getOrCreate())
    all_ = stages(spark, folders, parsed(given.settings))
    if given.list:
        print("\n".join(f"{s.name}{' (core)' if s.core else ''}" for s in all_))
        return 0
    wanted = None if given.stages == "all" else [s.strip() for s in given.stages.split(",") if s.strip()]
    report = run_stages(all_, wanted, given.strict, given.dry_run)
    for r in report:
        print(json.dumps(r))
    return int(any(r["status"] == "failed" for r in report))


if __name__ == "__main__":
    raise SystemExit(main())
