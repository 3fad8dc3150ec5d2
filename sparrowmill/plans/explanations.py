"""A run of counterfactual search: artefacts, the rows asked for, complete vectors, the search, repairs, audit, evaluation and sinks.

Each row may change the features that may change at all, that it has a value for, and that the model ranks highest, `vary` at most.
With `fill`, rows are searched with missing values filled from the training rows (mean, median, or nearest rows); what was
missing is put back afterwards and the result is scored again with its missing values. Nothing that fails is dropped: every
row asked for is in `counterfactuals`, or in `failed_queries` with a typed reason.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import changes, ensemble, evaluate, features, impute, neighbours, search, selection
from ..sources import files
from ..sources.staging import cut

KEYS = ["row_id", "cf_rank"]
METHODS = ("beam", "genetic", "exact")
FILLS = (None, "mean", "median", "knn")


@dataclass(frozen=True)
class ExplainConfig:
    """`most` rows from `offset` on, of the riskiest or of those in the file `ids`; `vary`: features that a row may change at most (0: all); `cache`: a folder for filled vectors; `batch`: rows that are searched and logged together; `resume`: go on from the batches that an earlier run has logged."""

    method: str = "beam"
    fill: str | None = None
    most: int | None = 50
    offset: int = 0
    ids: str | None = None
    random: bool = False
    seed: int = 0
    split: str = "test"
    target: int = 0
    vary: int = 0
    treatments: bool = False
    neighbours: int = 5
    cache: str | None = None
    batch: int = 1000
    resume: bool = False
    options: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Artefacts:
    """What training left, under the model's feature names: vectors (row_id, vector) of each split, and the catalogue of the model's features."""

    ensemble: ensemble.Ensemble
    threshold: float
    names: list[str]
    vectors: dict[str, DataFrame]
    catalogue: DataFrame
    predictions: dict[str, DataFrame]

    @classmethod
    def load(cls, spark: SparkSession, data: str, model: str) -> Artefacts:
        trees, threshold = files.load_model(spark, model)
        new = files.read_json(spark, f"{model}/feature_names.json", {})
        names = [new.get(f, f) for f in files.read_json(spark, f"{data}/feature_spec.json")["features"]]
        absent = sorted(set(trees.features()) - set(names))
        if absent:
            raise ValueError(f"the model uses features that the data lack: {', '.join(absent[:5])}")
        rows = lambda s: features.matrix(files.read_split(spark, data, s).withColumnsRenamed(new), names, ("stay_id",))
        vectors = {s: rows(s).select(F.col("stay_id").alias("row_id"), F.array(*[f"`{c}`" for c in names]).alias("vector")) for s in files.SPLITS}
        catalogue = features.with_names(spark.read.csv(f"{data}/counterfactual_feature_metadata.csv", header=True, inferSchema=True), new)
        own = spark.createDataFrame([(f,) for f in names], "feature string")
        predicted = {s: selection.predictions(files.read_table(spark, model, f"predictions_{s}"), threshold) for s in files.SPLITS}
        return cls(trees, threshold, names, vectors, catalogue.join(own, "feature", "left_semi"), predicted)

    def long(self, df: DataFrame, vector: str = "vector", ids: tuple[str, ...] = ("row_id",)) -> DataFrame:
        """(ids, feature, value)."""
        return df.select(*ids, F.inline(F.arrays_zip(F.array(*[F.lit(f) for f in self.names]).alias("feature"), F.col(vector).alias("value"))))

    def proba(self, vector: str = "vector"):
        return scalars.sigmoid(ensemble.vector_margin_column(self.ensemble, self.names, vector))


def asked_rows(spark: SparkSession, made: Artefacts, config: ExplainConfig) -> DataFrame:
    """(row_id) of the rows to explain; a listed id that isn't in the split is an error, and one that is listed twice is explained once."""
    predicted = made.predictions[config.split]
    if config.ids:
        listed = selection.fixed_cohort(predicted, files.read_query_ids(spark, config.ids))
        chosen = selection.window_of(listed, ["position"], config.offset, config.most)
    else:
        pool = selection.factuals(predicted, made.threshold)
        order = [selection.hash_order("row_id", seed=config.seed)] if config.random else [F.desc("pred_proba")]
        chosen = selection.window_of(pool, [*order, "row_id"], config.offset, config.most)
    return chosen.select("row_id").distinct()


def searchable(made: Artefacts, rows: DataFrame, mutable: DataFrame, vary: int) -> DataFrame:
    """(row_id, search): the features that each row may change, the highest ranked first; none for a row without any."""
    importance = ensemble.importance(made.ensemble.table(rows.sparkSession))
    ranks = features.ranked(mutable, importance)
    if ranks.isEmpty():  # the model uses no feature that may change: all count alike
        ranks = features.ranked(mutable, mutable.select("feature", F.lit(0.0).alias("importance_gain")))
    allowed = features.capped(made.long(rows), ranks, "row_id", vary or len(made.names))
    own = allowed.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature")))["feature"].alias("search"))
    return rows.select("row_id").join(own, "row_id", "left").select("row_id", F.coalesce("search", F.array().cast("array<string>")).alias("search"))


def filled_vectors(spark: SparkSession, made: Artefacts, rows: DataFrame, config: ExplainConfig) -> tuple[DataFrame, DataFrame]:
    """Training rows and rows to explain (row_id, vector) with missing values filled; from the cache if there is one made from the same facts."""
    train = made.vectors["train"]
    if config.fill is None:
        return train, rows
    facts = {"fill": config.fill, "neighbours": config.neighbours, "split": config.split, "features": made.names}
    if config.cache:
        try:
            frames = files.read_imputed(spark, facts, config.cache)
            lost = rows.join(frames["rows"], "row_id", "left_anti")
            if lost.isEmpty():
                return frames["train"], frames["rows"].join(rows.select("row_id"), "row_id", "left_semi")
        except FileNotFoundError:
            pass
    if config.fill == "knn":
        by_id = lambda df: df.select(F.col("row_id").alias("id"), "vector")
        fill = lambda df: neighbours.knn_imputed(by_id(train), by_id(df), len(made.names), config.neighbours).select(F.col("id").alias("row_id"), "vector")
        # training rows are the reference; as a set of queries they are filled with medians, as the scaling of distances has them
        train_fill = "median"
    else:
        train_fill = config.fill
    values = impute.fill_values(made.long(train), train_fill)
    by_value = lambda df: features.to_vector(impute.imputed(made.long(df), values).select("row_id", "feature", "value"), "row_id", made.names)
    new_rows = impute.overlaid(made.long(rows), made.long(fill(rows) if config.fill == "knn" else by_value(rows)))
    frames = {"train": by_value(train), "rows": features.to_vector(new_rows, "row_id", made.names)}
    if config.cache:
        files.write_imputed(frames, facts, config.cache)
        frames = files.read_imputed(spark, facts, config.cache)
    return frames["train"], frames["rows"]


def searched(made: Artefacts, rows: DataFrame, space: search.Space, config: ExplainConfig) -> DataFrame:
    """(row_id, cf_rank, counterfactual, error_type): what the search says of every row; cf_rank 0 with a reason for those without a counterfactual."""
    options = dict(config.options)
    if config.method == "beam":
        found = search.beam(rows, made.ensemble, space, made.threshold, config.target, **options)
        rank, reason = F.col("found").cast("int"), F.lit("NoFlipInSteps")
    elif config.method == "genetic":
        found = search.genetic(rows, made.ensemble, space, made.threshold, config.target, search.Genes(**options), every_row=True)
        rank, reason = F.col("cf_rank"), F.lit("EmptyCounterfactuals")
    else:
        found = search.exact(rows, made.ensemble, space, made.threshold, config.target, costs=search.Costs(**options))
        rank, reason = F.col("cf_rank"), F.when(F.col("status").isin("budget", "time"), "SearchBudget").otherwise("Infeasible")
    return found.select("row_id", rank.alias("cf_rank"), "counterfactual", F.when(rank == 0, reason).alias("error_type"))


def attempted(made: Artefacts, rows: DataFrame, space: search.Space, config: ExplainConfig, out: str) -> DataFrame:
    """What `searched` says, batch by batch: rows are dealt to batches by hash, and each batch's attempts are committed to the log before the next one is searched.

    With `resume`, batches that an earlier run of the same search over as many rows has committed are read back and not searched again.
    """
    spark, path = rows.sparkSession, f"{out}/attempts"
    n = rows.count()
    batches = n // config.batch + 1
    settings = {k: v for k, v in dataclasses.asdict(config).items() if k not in ("resume", "cache")}
    facts = json.loads(json.dumps(settings | {"rows": n, "batches": batches, "threshold": made.threshold, "features": made.names}))
    done = files.committed_batches(spark, path) if config.resume and files.read_json(spark, f"{out}/attempts.json") == facts else set()
    if not done:
        files.remove(spark, path)
        files.write_json(spark, facts, f"{out}/attempts.json")
    for k in range(batches):
        if k not in done:
            own = cut(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(batches)) == k))
            found = searched(made, own, space, config)
            files.log_attempts(found.select("row_id", "cf_rank", "counterfactual", F.coalesce("error_type", F.lit("found")).alias("status")), f"{path}/batch={k}", restart=True)
    logged = spark.read.schema("row_id long, cf_rank int, counterfactual array<double>, status string").json([f"{path}/batch={k}" for k in range(batches)])
    return logged.select("row_id", "cf_rank", "counterfactual", F.when(F.col("status") != "found", F.col("status")).alias("error_type"))


def explain(spark: SparkSession, data: str, model: str, out: str, config: ExplainConfig = ExplainConfig()) -> dict:  # noqa: B008
    """Search counterfactuals, evaluate them against the training rows, and write them, what failed, a log of attempts, the summary and the config."""
    if config.method not in METHODS or config.fill not in FILLS:
        raise ValueError(f"unknown search method or fill: {config.method}, {config.fill}; there are {', '.join(METHODS)} and {', '.join(map(str, FILLS))}")
    made = Artefacts.load(spark, data, model)
    # every table that several steps read is checkpointed: plans stay small, and a lost executor costs its own tasks only
    mutable = cut(made.catalogue.where(features.is_mutable(F.col("mutability"), F.col("feature"), treatments=config.treatments)))
    native = cut(made.vectors[config.split].join(asked_rows(spark, made, config), "row_id"))
    missing = features.missing_features(native, "row_id", made.names)
    train, complete = filled_vectors(spark, made, native, config)
    train = cut(train)
    dense = cut(made.long(train))
    space = search.Space.learn(evaluate.feature_ranges(dense), made.names, {r["feature"] for r in mutable.select("feature").collect()})
    allowed = searchable(made, native, mutable, config.vary)
    rows = cut(complete.join(allowed, "row_id"))

    idle = rows.where(F.size("search") == 0).select("row_id", F.lit("NoMutableObservedFeatures").alias("error_type"))
    attempts = cut(attempted(made, rows.where(F.size("search") > 0), space, config, out))
    hits = attempts.where("cf_rank > 0")
    # what was missing is missing again, and the model sees it so
    before = native.select("row_id", F.col("vector").alias("native"), made.proba().alias("proba_factual"))
    back = F.zip_with("counterfactual", "native", lambda a, b: F.when(b.isNotNull(), a))
    both = hits.join(before, "row_id").withColumn("counterfactual", back)
    both = cut(both.withColumn("proba_counterfactual", made.proba("counterfactual")))
    zipped = F.arrays_zip(F.array(*[F.lit(f) for f in made.names]).alias("feature"), F.col("native").alias("before"), F.col("counterfactual").alias("after"))
    pairs = cut(both.select(*KEYS, F.inline(zipped)))
    label = (F.col("proba_counterfactual") >= made.threshold).cast("int").alias("pred_label")
    bad = changes.rejected(pairs, both.select(*KEYS, label), mutable, KEYS, config.target)
    if config.method == "exact":
        bad = bad.unionByName(search.audited(both.select(*KEYS, "counterfactual"), made.ensemble, made.names).where("error_type is not null").select(*KEYS, "error_type")).repartition(*KEYS)
    bad = cut(bad.groupBy(*KEYS).agg(F.min("error_type").alias("error_type")))
    measured = cut(evaluated(made, both.join(bad, KEYS, "left_anti"), pairs.join(bad, KEYS, "left_anti"), dense, mutable, config))

    failed = idle.unionByName(attempts.where("cf_rank = 0").select("row_id", "error_type")).unionByName(bad.select("row_id", "error_type")).repartition("row_id")
    failed = cut(failed.groupBy("row_id").agg(F.min("error_type").alias("error_type")).join(measured.select("row_id").distinct(), "row_id", "left_anti").join(missing, "row_id"))
    factuals = cut(rows.join(before, "row_id").withColumn("proba_filled", made.proba()))
    files.write_table(factuals.select("row_id", F.col("native").alias("vector"), F.col("vector").alias("filled"), "search", "proba_factual", "proba_filled"), out, "selected_factuals")
    files.write_table(measured, out, "counterfactuals")
    files.write_table(failed, out, "failed_queries")
    report = evaluate.run_summary(native, measured.where("valid"), failed).first().asDict() | features.missing_summary(native, made.names).first().asDict()
    report |= evaluate.flips(factuals.select(F.col("proba_factual").alias("proba_native"), F.col("proba_filled").alias("proba_imputed")), made.threshold).drop("n").first().asDict()
    report |= {"threshold": made.threshold, "n_counterfactuals": 0, "failures": {r["error_type"]: r["count"] for r in failed.groupBy("error_type").count().collect()}}
    if not measured.isEmpty():
        report |= evaluate.summary(measured).drop("n_rows").first().asDict()
    files.write_json(spark, report, f"{out}/summary.json")
    files.write_json(spark, dataclasses.asdict(config) | {"data": data, "model": model}, f"{out}/run_config.json")
    return report


def evaluated(made: Artefacts, found: DataFrame, pairs: DataFrame, dense: DataFrame, mutable: DataFrame, config: ExplainConfig) -> DataFrame:
    """Every measure of each counterfactual (row_id, cf_rank), with what it changes as JSON."""
    stats = cut(evaluate.scale_stats(dense))
    out = evaluate.validity(found.select(*KEYS, "counterfactual", "proba_factual", "proba_counterfactual"), made.threshold, config.target)
    for part in (
        evaluate.proximity(pairs, stats, KEYS),
        evaluate.sparsity(pairs, KEYS),
        evaluate.actionability(pairs, mutable, KEYS),
        evaluate.range_violations(pairs, evaluate.rounded_bounds(features.permitted_ranges(mutable), evaluate.precision(dense)), KEYS),
        changes.encoded(changes.payload(pairs, KEYS)).drop("n_changed"),
    ):
        out = cut(out.join(part, KEYS))
    centre = stats.select("feature", "median", "iqr")

    def scaled(df: DataFrame) -> DataFrame:
        value = (F.coalesce("value", F.lit(0.0)) - F.col("median")) / F.col("iqr")
        return features.to_vector(df.join(centre, "feature").withColumn("value", value), "row_id", made.names).withColumnRenamed("row_id", "id")

    reference = cut(scaled(dense))
    # neighbours go by one number: a counterfactual's place among all of them
    numbered = cut(selection.numbered(found.select(*KEYS), KEYS, "number"))
    queries = cut(scaled(pairs.join(numbered, KEYS).select(F.col("number").alias("row_id"), "feature", F.col("after").alias("value"))))
    near = cut(neighbours.plausibility(reference, queries).join(cut(neighbours.lof(reference, queries)), "query", "left").join(neighbours.mahalanobis(reference, queries).withColumnRenamed("distance", "mahalanobis"), "query", "left"))
    return out.join(numbered.join(near, numbered["number"] == near["query"]).select(*KEYS, "knn_distance", "lof_score", "mahalanobis"), KEYS, "left")
