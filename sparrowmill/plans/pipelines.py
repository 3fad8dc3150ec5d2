"""Whole jobs: raw events to feature tables, and feature tables to a model; and a stage runner.

The feature job scans each event table once: events are cut to the cohort's windows, checkpointed, and selection, bounds and aggregates
all branch from that. Tables that several steps read are checkpointed, so plans stay small and nothing stays in executors' memory.
"""

from __future__ import annotations

import dataclasses
import re
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as naming
from ..functions import scalars
from ..operators import boosting, cohort, ensemble, events, features, metrics
from ..sources import files
from ..sources.staging import cut


@dataclass(frozen=True)
class FeatureConfig:
    """`share`: the share of training stays that a concept needs. `low`, `high`: the quantiles that values are clipped to."""

    hours: int = 48
    share: float = 0.01
    most: int | None = None
    low: float = 0.01
    high: float = 0.99
    levels: int = 12
    least_level: int = 1
    least_exposed: float = 0.002
    test: float = 0.15
    val: float = 0.15
    seed: int = 42
    rare: str | None = "OTHER_RARE_DRUG"
    procedure_categories: bool = False


def overridden(config, given: Mapping[str, object]):
    """The config with those of the given values that aren't None."""
    return dataclasses.replace(config, **{k: v for k, v in given.items() if v is not None})


MEASURES = {"first": "first", "last": "last", "min": "min", "max": "max", "mean": "mean"}
STATIC = ("gender", "race", "language", "marital_status", "insurance", "admission_type", "admission_location", "first_careunit", "last_pre_icu_careunit")


def build_features(tables: Mapping[str, DataFrame], config: FeatureConfig = FeatureConfig()) -> dict[str, DataFrame]:  # noqa: B008
    """Feature tables from raw ones.

    tables: stays, admissions, patients and, each optional, transfers, chart, lab (point events with stay_id, itemid, time, value,
    tie), input, procedure (intervals with stay_id, itemid, start, stop, value), output (points), drugs (intervals with stay_id,
    drug, code), items (itemid, category). Returns cohort, long (stay_id, feature, value) of all splits, and catalogue.
    """
    who = cohort.build(tables["stays"], tables["admissions"], tables["patients"], tables.get("transfers"), config.hours)
    split = cohort.stratified_split(who, "subject_id", "hospital_mortality", config.test, config.val, config.seed).select("subject_id", "split")
    who = cut(who.join(split, "subject_id"))
    train = who.where("split = 'train'")
    n_train = train.count()
    longs: list[DataFrame] = []
    for name in ("chart", "lab"):
        if name in tables:
            inside = cut(events.in_window(tables[name], who, "stay_id", "time", keep=("split",)))
            learned = inside.where("split = 'train' and value is not null")
            wanted = events.prevalence(learned, "stay_id", "itemid", config.share, n_train, config.most).select("itemid")
            chosen = inside.join(wanted, "itemid", "left_semi")
            clipped = events.clipped(chosen, events.quantile_bounds(learned.join(wanted, "itemid", "left_semi"), "itemid", "value", config.low, config.high), "itemid", "value")
            longs.append(features.to_long(events.summary(clipped, ["stay_id", "itemid"], "time", "value", ["tie"]), "stay_id", "itemid", {c: f"{name}_{p}" for c, p in MEASURES.items()}))
    if "output" in tables:
        inside = cut(events.in_window(tables["output"], who, "stay_id", "time", keep=("split",)))
        wanted = events.prevalence(inside.where("split = 'train' and value is not null"), "stay_id", "itemid", config.share, n_train, config.most)
        sums = events.exposure(inside.join(wanted.select("itemid"), "itemid", "left_semi"), ["stay_id", "itemid"], "value")
        longs.append(features.to_long(sums, "stay_id", "itemid", {"cnt": "output_cnt", "sum": "output_sum", "mean": "output_mean", "max": "output_max"}))
    if "input" in tables:
        inside = cut(events.overlapping(tables["input"], who, "stay_id", "start", "stop"))
        wanted = events.prevalence(inside.join(train.select("stay_id"), "stay_id", "left_semi"), "stay_id", "itemid", config.share, n_train, config.most)
        sums = events.exposure(inside.join(wanted.select("itemid"), "itemid", "left_semi"), ["stay_id", "itemid"], "value", "rate" if "rate" in inside.columns else None)
        longs.append(features.to_long(sums, "stay_id", "itemid", {"cnt": "input_cnt", "sum": "input_sum", "mean": "input_mean"} | ({"sum_second": "input_sum_rate"} if "rate" in inside.columns else {})))
    if "procedure" in tables:
        inside = events.overlapping(tables["procedure"], who, "stay_id", "start", "stop").withColumn("minutes", scalars.minutes(F.col("start"), F.col("stop")))
        key = F.col("itemid").cast("string")
        if config.procedure_categories and "items" in tables:
            inside, key = events.with_category(inside, tables["items"], "itemid"), F.col("category")
        inside = cut(inside.withColumn("key", key))
        wanted = events.prevalence(inside.join(train.select("stay_id"), "stay_id", "left_semi"), "stay_id", "key", config.share, n_train, config.most)
        sums = events.exposure(inside.join(wanted.select("key"), "key", "left_semi"), ["stay_id", "key"], "minutes")
        longs.append(features.to_long(sums, "stay_id", "key", {"cnt": "proc_cnt", "sum": "proc_sum", "mean": "proc_mean", "max": "proc_max"}, "_"))
    if "drugs" in tables:
        inside = cut(events.overlapping(tables["drugs"], who, "stay_id", "start", "stop").withColumn("key", scalars.item_key(F.col("drug"), F.col("code"))))
        wanted = events.prevalence(inside.join(train.select("stay_id"), "stay_id", "left_semi"), "stay_id", "key", config.share, n_train, config.most)
        counts = cut(events.rare_bucket(inside, wanted, "key", config.rare).groupBy("stay_id", "key").agg(F.count("*").alias("cnt")))
        # drugs whose names become the same stay apart; one row a key
        named = naming.safe_names(sorted((r["key"] for r in counts.select("key").distinct().collect()), key=lambda k: (k != config.rare, k)), lambda k: re.sub("[ /]", "_", k))
        named = counts.sparkSession.createDataFrame(list(named.items()), "key string, name string")
        longs.append(features.to_long(counts.join(named, "key"), "stay_id", "name", {"cnt": "drug_cnt"}, "_"))
    static = features.static_columns(who, [], STATIC).columns
    encoded = who
    for column in static:
        encoded = cut(features.frequency_encoded(encoded, train, column, config.least_level, config.levels, f"_freq_{column}"))
    numbers = {"age": F.col("age").cast("double")} | ({"n_transfers_before_icu": F.col("n_transfers_before_icu").cast("double")} if "n_transfers_before_icu" in who.columns else {})
    numbers |= {c: F.col(f"_freq_{c}") for c in static}
    longs.append(encoded.select("stay_id", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), v.alias("value")) for f, v in numbers.items()]))))
    long = longs[0]
    for more in longs[1:]:
        long = long.unionByName(more)
    # sources repartitioned by hand: a union of grouped tables isn't to be grouped again as it stands
    long = cut(long.repartition("stay_id", "feature"))
    dense = cut(features.densified(long, who, long.select("feature").distinct(), "stay_id").join(who.select("stay_id", "split"), "stay_id"))
    dense = cut(features.pruned(dense, dense.where("split = 'train'"), config.least_exposed))
    return {"cohort": who, "long": dense, "catalogue": features.catalogue(dense.where("split = 'train'"), ("age", *static))}


def write_features(made: Mapping[str, DataFrame], folder: str, label: str = "hospital_mortality", config: FeatureConfig = FeatureConfig()) -> list[str]:  # noqa: B008
    """X, y and meta of each split as wide tables, the cohort, the catalogue and the specifications; returns the features in their order."""
    spark = made["long"].sparkSession
    names = [r["feature"] for r in made["catalogue"].select("feature").orderBy("feature").collect()]  # one row a feature
    who = made["cohort"]
    for split in files.SPLITS:
        own = who.where(F.col("split") == split)
        files.write_table(own.select("stay_id", "subject_id", "hadm_id").join(features.to_wide(made["long"].where(F.col("split") == split), "stay_id", names), "stay_id"), folder, f"X_{split}")
        files.write_table(own.select("stay_id", F.col(label).alias("label")), folder, f"y_{split}")
        files.write_table(own.select("stay_id", "subject_id", "hadm_id", "split", "intime", "feature_end", "hospital_mortality", "icu_mortality"), folder, f"meta_{split}")
    files.write_table(who, folder, "cohort")
    files.write_table(made["catalogue"].coalesce(1), folder, "counterfactual_feature_metadata", "csv")
    files.write_json(spark, {"features": names, "label": label, "ids": ["stay_id", "subject_id", "hadm_id"]}, f"{folder}/feature_spec.json")
    groups = made["catalogue"].groupBy("group").agg(F.sort_array(F.collect_list("feature")).alias("features")).collect()  # one row a group
    files.write_json(spark, {"hours": config.hours, "clipped_to": [config.low, config.high], "zero_filled": list(features.EXPOSURES), "groups": {r["group"]: r["features"] for r in groups}}, f"{folder}/preprocessing_spec.json")
    files.write_json(spark, dataclasses.asdict(config), f"{folder}/config_used.json")
    return names


def train_model(spark: SparkSession, data: str, model: str, settings: boosting.Settings = boosting.Settings()) -> dict:  # noqa: B008
    """Fit to the training split, choose the threshold on validation rows, measure all splits, and write model and predictions."""
    raw = {s: files.read_split(spark, data, s) for s in files.SPLITS}
    ids = ("stay_id", "subject_id", "hadm_id", "split", "label")
    _, new = features.renamed_safely(raw["train"].drop(*ids))
    splits = {s: df.withColumnsRenamed(new) for s, df in raw.items()}
    names = list(new.values())
    vectors = {s: features.matrix(df, [*names, "label"], ("stay_id",)).select(F.col("stay_id").alias("row_id"), F.col("label").cast("int").alias("label"), F.array(*[f"`{c}`" for c in names]).alias("vector")) for s, df in splits.items()}
    fitted = boosting.fit(vectors["train"], vectors["val"], names, settings)
    margin = ensemble.vector_margin_column(fitted.ensemble, names)
    scored = {s: cut(df.select("row_id", "label", scalars.sigmoid(margin).alias("proba"))) for s, df in vectors.items()}
    best = metrics.best_threshold(scored["val"]).first()
    report: dict = {"threshold_selection": {"best_threshold": best["threshold"], "best_f1": best["f1"]}, "losses": fitted.losses}
    for s, df in scored.items():
        report[s] = metrics.roc_auc(df).first().asDict() | metrics.average_precision(df).first().asDict() | metrics.losses(df, best["threshold"]).first().asDict() | metrics.confusion(df, best["threshold"]).first().asDict()
        files.write_table(metrics.predicted(df, best["threshold"]).select(F.col("row_id").alias("stay_id"), "row_id", "label", F.col("proba").alias("pred_proba"), "pred_label"), model, f"predictions_{s}")
    files.save_model(spark, fitted.ensemble, report, new, model)
    return report


@dataclass(frozen=True)
class Stage:
    """A step of a run; after a core stage has failed nothing more is run."""

    name: str
    run: Callable[[], object]
    core: bool = False


def run_stages(stages: Sequence[Stage], wanted: Sequence[str] | None = None, strict: bool = False, dry_run: bool = False) -> list[dict]:
    """Run the wanted stages in order, in this session; a report of status and seconds of each.

    A stage that isn't core may fail and the rest goes on, unless `strict`. An unknown name is an error before anything runs.
    """
    known = {s.name: s for s in stages}
    unknown = [n for n in wanted or () if n not in known]
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(unknown)}; there are {', '.join(known)}")
    report: list[dict] = []
    for stage in [known[n] for n in wanted] if wanted is not None else stages:
        if dry_run:
            report.append({"stage": stage.name, "status": "planned", "seconds": 0.0})
            continue
        began = time.monotonic()
        try:
            stage.run()
            report.append({"stage": stage.name, "status": "done", "seconds": time.monotonic() - began})
        except Exception as error:
            report.append({"stage": stage.name, "status": "failed", "seconds": time.monotonic() - began, "error": f"{type(error).__name__}: {error}"})
            if stage.core or strict:
                break
    return report
