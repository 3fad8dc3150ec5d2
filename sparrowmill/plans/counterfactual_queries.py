"""Queries over counterfactuals: repairs, change records, evaluation, imputation and the searches themselves.

Most work on made-up counterfactuals that SQL can repeat, two for each scored row: rank 1 moves a mutable measurement to its
median, rank 2 moves another to twice its maximum and sets an exposure to 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import changes, ensemble, evaluate, events, features, impute, neighbours, quantiles, search
from .registry import query
from .tables import COUNTS, DENSE_SQL, FEATURES, MEANS, THRESHOLD, TOY, dense, table, wide

KEYS = ["row_id", "cf_rank"]
CUT = 0.55

PAIRS_SQL = f"""{DENSE_SQL},
stats AS (SELECT feature, quantile_cont(value, 0.5) AS median, max(value) AS most, min(value) AS least FROM dense GROUP BY feature),
pairs AS (
  SELECT d.user_id AS row_id, cf_rank, d.feature, d.value AS before,
    CASE WHEN cf_rank = 1 AND d.feature = 'chart_mean_item_click' THEN median WHEN cf_rank = 2 AND d.feature = 'chart_mean_item_view' THEN 2 * most WHEN cf_rank = 2 AND d.feature = 'input_cnt_item_click' THEN 0.0::DOUBLE ELSE d.value END AS after
  FROM dense d JOIN stats s ON d.feature = s.feature, (VALUES (1), (2)) v(cf_rank))"""
#: Whether a pair differs, in SQL.
CHANGED_SQL = "(CASE WHEN before IS NULL OR after IS NULL THEN (before IS NULL) <> (after IS NULL) ELSE abs(before - after) > 1e-8::DOUBLE + 1e-5::DOUBLE * abs(after) END)"
SCALES_SQL = f"""{PAIRS_SQL},
zeros AS (SELECT feature, coalesce(value, 0) AS value FROM dense),
q AS (SELECT feature, quantile_cont(value, [0.5, 0.25, 0.75, 0.01, 0.99]) AS q FROM zeros GROUP BY feature),
away AS (SELECT z.feature, quantile_cont(abs(value - q[1]), 0.5) AS away FROM zeros z JOIN q ON z.feature = q.feature GROUP BY z.feature),
scales AS (SELECT q.feature, q[1] AS median, CASE WHEN q[3] - q[2] = 0 THEN 1.0::DOUBLE ELSE q[3] - q[2] END AS iqr, CASE WHEN away * 1.4826::DOUBLE = 0 THEN 1.0::DOUBLE ELSE away * 1.4826::DOUBLE END AS mad, q[4] AS q01, q[5] AS q99 FROM q JOIN away ON q.feature = away.feature)"""
RESCORED_SQL = f"""{PAIRS_SQL},
after AS (SELECT row_id, cf_rank, {", ".join(f"max(after) FILTER (feature = '{f}') AS {f}" for f in FEATURES)} FROM pairs GROUP BY row_id, cf_rank),
before AS (SELECT row_id, cf_rank, {", ".join(f"max(before) FILTER (feature = '{f}') AS {f}" for f in FEATURES)} FROM pairs GROUP BY row_id, cf_rank),
a AS (SELECT row_id, cf_rank, {ensemble.margin_sql(TOY)} AS margin FROM after), b AS (SELECT row_id, cf_rank, {ensemble.margin_sql(TOY)} AS margin FROM before),
rescored AS (
  SELECT a.row_id, a.cf_rank, round(1 / (1 + exp(-b.margin)), 9) AS proba_factual, round(1 / (1 + exp(-a.margin)), 9) AS proba_counterfactual
  FROM a JOIN b ON a.row_id = b.row_id AND a.cf_rank = b.cf_rank)"""


def pairs(spark, sf_dir):
    """(row_id, cf_rank, feature, before, after) of the made-up counterfactuals."""
    rows = dense(spark, sf_dir)
    stats = quantiles.exact(rows, "feature", "value", [0.5, 1.0]).select("feature", F.col("q")[0].alias("median"), F.col("q")[1].alias("most"))
    f, rank = F.col("feature"), F.col("cf_rank")
    both = rows.join(stats, "feature").withColumn("cf_rank", F.explode(F.array(F.lit(1), F.lit(2))))
    after = F.when((rank == 1) & (f == "chart_mean_item_click"), F.col("median")).when((rank == 2) & (f == "chart_mean_item_view"), 2 * F.col("most")).when((rank == 2) & (f == "input_cnt_item_click"), F.lit(0.0)).otherwise(F.col("value"))
    return both.select(F.col("user_id").alias("row_id"), "cf_rank", "feature", F.col("value").alias("before"), after.alias("after"))


def _mutable(spark):
    return spark.createDataFrame([(f,) for f in MEANS], "feature string")


def _rescored(spark, sf_dir):
    """(row_id, cf_rank, proba_factual, proba_counterfactual)."""
    sides = {"before": "proba_factual", "after": "proba_counterfactual"}
    own = [F.max(F.when(F.col("feature") == f, F.col(side))).alias(f"{side}_{f}") for side in sides for f in FEATURES]
    both = pairs(spark, sf_dir).groupBy(*KEYS).agg(*own)  # one row for both sides, one shuffle
    proba = lambda side: F.round(scalars.sigmoid(ensemble.margin(TOY, lambda f: f"{side}_{f}")), 9)
    return both.select(*KEYS, *[proba(side).alias(name) for side, name in sides.items()])


@query(f"WITH {PAIRS_SQL} SELECT row_id, cf_rank, feature, before, CASE WHEN before IS NOT NULL THEN after END AS after, before IS NULL AND after IS NOT NULL AS was_restored FROM pairs")
def restore_missing(spark, sf_dir):
    return changes.restored(pairs(spark, sf_dir))


@query(f"WITH {PAIRS_SQL} SELECT row_id, cf_rank, feature, before, CASE WHEN feature[:5] = 'chart' AND row_id % 2 = 0 THEN after ELSE before END AS after FROM pairs")
def freeze_features(spark, sf_dir):
    """Rows with an even id may change measurements, the others nothing."""
    p = pairs(spark, sf_dir)
    allowed = p.where("row_id % 2 = 0 and feature like 'chart%'").select("row_id", "feature")
    return changes.frozen(p, allowed).select(*KEYS, "feature", "before", "after")


@query(f"""WITH {PAIRS_SQL} SELECT row_id, cf_rank, count(*) FILTER ({CHANGED_SQL}) AS n_changed, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER ({CHANGED_SQL}), '') AS changed,
round(coalesce(sum(abs(after - before)) FILTER ({CHANGED_SQL}), 0), 6) AS total_abs_shift FROM pairs GROUP BY row_id, cf_rank""")
def changes_payload(spark, sf_dir):
    found = changes.payload(pairs(spark, sf_dir), KEYS)
    return found.select(*KEYS, "n_changed", F.array_join("changed", ",").alias("changed"), F.round("total_abs_shift", 6).alias("total_abs_shift"))


@query(f"""WITH {PAIRS_SQL} SELECT row_id, cf_rank, CASE WHEN row_id % 5 = 0 THEN 0 ELSE count(*) FILTER ({CHANGED_SQL}) END AS n_changes, coalesce(round(CASE WHEN row_id % 5 <> 0 THEN sum(after) FILTER ({CHANGED_SQL}) END, 6), 0.0::DOUBLE) AS sum_to FROM pairs GROUP BY row_id, cf_rank""")
def changes_json(spark, sf_dir):
    """Change records written as JSON and read back, a fifth of them damaged."""
    text = changes.encoded(changes.payload(pairs(spark, sf_dir), KEYS)).withColumn("changes", F.when(F.col("row_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("changes")))
    back = changes.decoded(text)
    total = F.aggregate(F.map_values("changes"), F.lit(0.0), lambda s, c: s + F.coalesce(c["to"], F.lit(0.0)))
    return back.select(*KEYS, F.size("changes").cast("long").alias("n_changes"), F.round(total, 6).alias("sum_to"))


@query(f"WITH {PAIRS_SQL} SELECT row_id, cf_rank, feature, CASE WHEN {CHANGED_SQL} THEN after ELSE before END AS value FROM pairs")
def rebuilt_matrix(spark, sf_dir):
    """Counterfactual values again, from factuals and change records alone."""
    p = pairs(spark, sf_dir)
    factual = dense(spark, sf_dir).withColumnRenamed("user_id", "row_id")
    return changes.rebuilt(factual, changes.payload(p, KEYS), KEYS)


@query(f"""WITH {PAIRS_SQL} SELECT row_id, cf_rank, p.feature, CASE WHEN p.feature[:5] = 'chart' AND after IS NOT NULL THEN least(greatest(after, least), most) ELSE after END AS value FROM pairs p JOIN stats s ON p.feature = s.feature""")
def range_clip(spark, sf_dir):
    """Counterfactual measurements moved into the range of the factuals."""
    rows = dense(spark, sf_dir)
    ranges = rows.where(F.col("feature").isin(MEANS)).groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return features.within_ranges(pairs(spark, sf_dir).select(*KEYS, "feature", F.col("after").alias("value")), ranges).select(*KEYS, "feature", "value")


@query(f"""WITH {PAIRS_SQL}, native AS (SELECT row_id, cf_rank, {", ".join(f"max(CASE WHEN before IS NOT NULL THEN after END) FILTER (feature = '{f}') AS {f}" for f in FEATURES)} FROM pairs GROUP BY row_id, cf_rank),
m AS (SELECT row_id, cf_rank, {ensemble.margin_sql(TOY)} AS margin FROM native) SELECT row_id, cf_rank, round(1 / (1 + exp(-margin)), 9) AS proba FROM m""")
def native_score(spark, sf_dir):
    """Counterfactuals scored with the missing values of their factuals."""
    native = changes.restored(pairs(spark, sf_dir)).select(*KEYS, "feature", F.col("after").alias("value"))
    return ensemble.scored(features.to_wide(native, KEYS, FEATURES), TOY).select(*KEYS, F.round("proba", 9).alias("proba"))


@query(f"WITH {DENSE_SQL} SELECT DISTINCT CASE WHEN feature = 'chart_mean_item_click' THEN 'click_mean' ELSE feature END AS feature FROM dense")
def named_catalogue(spark, sf_dir):
    """The features under a model's names, one of them renamed."""
    catalogue = dense(spark, sf_dir).select("feature").distinct()
    return features.with_names(catalogue, {"chart_mean_item_click": "click_mean", "absent": "x"})


@query(f"""WITH {RESCORED_SQL}, facts AS (SELECT row_id, cf_rank, bool_or((before IS NULL) <> (after IS NULL)) AS missingness, bool_or({CHANGED_SQL} AND feature[:5] <> 'chart') AS immutable FROM pairs GROUP BY row_id, cf_rank)
SELECT f.row_id, f.cf_rank, CASE WHEN missingness THEN 'MissingnessChanged' WHEN proba_counterfactual >= {CUT} THEN 'NotFlipped' ELSE 'ImmutableChanged' END AS error_type
FROM facts f JOIN rescored r ON f.row_id = r.row_id AND f.cf_rank = r.cf_rank WHERE missingness OR proba_counterfactual >= {CUT} OR immutable""")
def rejected_results(spark, sf_dir):
    verdicts = _rescored(spark, sf_dir).select(*KEYS, (F.col("proba_counterfactual") >= CUT).cast("int").alias("pred_label"))
    return changes.rejected(pairs(spark, sf_dir), verdicts, _mutable(spark), KEYS, 0)


@query(f"WITH {SCALES_SQL} SELECT * FROM scales")
def scale_stats(spark, sf_dir):
    return evaluate.scale_stats(dense(spark, sf_dir))


@query(f"""WITH {DENSE_SQL}, q AS (SELECT feature, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_samp(value) AS s FROM dense GROUP BY feature)
SELECT feature, round(CASE WHEN iqr > 0 THEN iqr WHEN s > 0 THEN s ELSE 1 END, 6) AS scale FROM q""")
def feature_scale(spark, sf_dir):
    return evaluate.feature_scale(dense(spark, sf_dir)).select("feature", F.round("scale", 6).alias("scale"))


@query(f"""WITH {DENSE_SQL} SELECT feature, min(value) AS least, max(value) AS most, CASE WHEN max(value) > min(value) THEN max(value) - min(value) ELSE 1.0::DOUBLE END AS range, bool_and(coalesce(value IN (0, 1), true)) AS is_binary FROM dense GROUP BY feature""")
def feature_ranges(spark, sf_dir):
    return evaluate.feature_ranges(dense(spark, sf_dir))


@query(f"""WITH {SCALES_SQL} SELECT row_id, cf_rank, round(sum(abs(d / mad)), 6) AS proximity_l1_mad, round(sqrt(sum((d / mad) * (d / mad))), 6) AS proximity_l2_mad, round(sum(abs(d / iqr)), 6) AS proximity_l1_iqr, round(sqrt(sum((d / iqr) * (d / iqr))), 6) AS proximity_l2_iqr
FROM (SELECT row_id, cf_rank, p.feature, coalesce(after, 0) - coalesce(before, 0) AS d, mad, iqr FROM pairs p JOIN scales s ON p.feature = s.feature) GROUP BY row_id, cf_rank""")
def proximity(spark, sf_dir):
    found = evaluate.proximity(pairs(spark, sf_dir), evaluate.scale_stats(dense(spark, sf_dir)), KEYS)
    return found.select(*KEYS, *[F.round(c, 6).alias(c) for c in found.columns if c not in KEYS])


@query(f"WITH {PAIRS_SQL} SELECT row_id, cf_rank, count(*) FILTER ({CHANGED_SQL}) AS n_changed, count(*) FILTER ({CHANGED_SQL})::DOUBLE / count(*) AS share_changed FROM pairs GROUP BY row_id, cf_rank")
def sparsity(spark, sf_dir):
    return evaluate.sparsity(pairs(spark, sf_dir), KEYS)


@query(f"WITH {PAIRS_SQL} SELECT row_id, cf_rank, count(*) FILTER ({CHANGED_SQL} AND feature[:5] <> 'chart') AS n_violations, count(*) FILTER ({CHANGED_SQL} AND feature[:5] <> 'chart') = 0 AS all_mutable FROM pairs GROUP BY row_id, cf_rank")
def actionability(spark, sf_dir):
    return evaluate.actionability(pairs(spark, sf_dir), _mutable(spark), KEYS)


PLACES_SQL = """places AS (
  SELECT feature, arg_max(places, (n, -places)) AS places FROM (
    SELECT feature, length(rtrim(split_part(printf('%.6f', value), '.', 2), '0')) AS places, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL) GROUP BY feature)"""


@query(f"""WITH v AS (SELECT 'events' AS feature, value FROM events UNION ALL SELECT 'price', l_extendedprice FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem),
{PLACES_SQL} SELECT feature, places::INT AS places FROM places""")
def decimal_precision(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.inline(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(c).alias("value")) for name, c in (("price", "l_extendedprice"), ("quantity", "l_quantity"), ("discount", "l_discount"))])))
    return evaluate.precision(lines.unionByName(table(spark, sf_dir, "events").select(F.lit("events").alias("feature"), "value")))


@query(f"""WITH {PAIRS_SQL}, v AS (SELECT feature, value FROM dense), {PLACES_SQL},
bounds AS (SELECT s.feature, round_even(least, places::INT) AS low, round_even(most, places::INT) AS high, places FROM stats s JOIN places p ON s.feature = p.feature WHERE s.feature[:5] = 'chart' AND least < most)
SELECT row_id, cf_rank, count(*) FILTER ({CHANGED_SQL} AND (round_even(after, places::INT) < low OR round_even(after, places::INT) > high)) AS n_outside FROM pairs p LEFT JOIN bounds b ON p.feature = b.feature GROUP BY row_id, cf_rank""")
def range_violation(spark, sf_dir):
    rows = dense(spark, sf_dir)
    ranges = rows.where(F.col("feature").isin(MEANS)).groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low < high")
    return evaluate.range_violations(pairs(spark, sf_dir), evaluate.rounded_bounds(ranges, evaluate.precision(rows)), KEYS)


@query(f"WITH {RESCORED_SQL} SELECT *, proba_counterfactual < {CUT} AS valid, round(proba_factual - proba_counterfactual, 9) AS risk_reduction FROM rescored")
def validity(spark, sf_dir):
    return evaluate.validity(_rescored(spark, sf_dir), CUT).withColumn("risk_reduction", F.round("risk_reduction", 9))


_MEASURED_SQL = f"""{SCALES_SQL.replace(PAIRS_SQL, RESCORED_SQL)},
near AS (SELECT row_id, cf_rank, round(sum(abs(d / mad)), 6) AS proximity_l1_mad, round(sqrt(sum((d / mad) * (d / mad))), 6) AS proximity_l2_mad, round(sum(abs(d / iqr)), 6) AS proximity_l1_iqr, round(sqrt(sum((d / iqr) * (d / iqr))), 6) AS proximity_l2_iqr
  FROM (SELECT row_id, cf_rank, p.feature, coalesce(after, 0) - coalesce(before, 0) AS d, mad, iqr FROM pairs p JOIN scales s ON p.feature = s.feature) GROUP BY row_id, cf_rank),
counted AS (SELECT row_id, cf_rank, count(*) FILTER ({CHANGED_SQL}) AS n_changed, count(*) FILTER ({CHANGED_SQL})::DOUBLE / count(*) AS share_changed, count(*) FILTER ({CHANGED_SQL} AND feature[:5] <> 'chart') AS n_violations FROM pairs GROUP BY row_id, cf_rank),
measured AS (SELECT * FROM near JOIN counted USING (row_id, cf_rank))"""
_MEASURES = ["proximity_l1_mad", "proximity_l2_mad", "proximity_l1_iqr", "proximity_l2_iqr", "n_changed", "share_changed", "n_violations"]


@query(f"""WITH {_MEASURED_SQL} SELECT count(*) AS n_counterfactuals, {", ".join(f"round(avg({m}), 5) AS mean_{m}, round(quantile_cont({m}, 0.5), 5) AS median_{m}" for m in _MEASURES)}, avg((n_violations > 0)::INT)::DOUBLE AS violation_rate FROM measured""")
def eval_measures(spark, sf_dir):
    """Means and medians of the measures of distance, sparsity and actionability."""
    p = pairs(spark, sf_dir)
    found = proximity(spark, sf_dir).join(evaluate.sparsity(p, KEYS), KEYS).join(evaluate.actionability(p, _mutable(spark), KEYS), KEYS).withColumn("valid", F.lit(True))
    out = evaluate.summary(found, _MEASURES)
    return out.select("n_counterfactuals", *[F.round(f"{s}_{m}", 5).alias(f"{s}_{m}") for m in _MEASURES for s in ("mean", "median")], "violation_rate")


@query(f"""WITH {RESCORED_SQL} SELECT row_id, cf_rank, {len(TOY.by_tree)}::BIGINT AS n_leaves, round(margin, 9) AS leaf_margin, round(margin, 9) AS margin, NULL::VARCHAR AS error_type FROM a""")
def solution_audit(spark, sf_dir):
    """Changed rows divided by the conditions of all leaves: one leaf of each tree, and their sum is the margin."""
    vectors = pairs(spark, sf_dir).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("feature", "after"))).alias("m")).select(*KEYS, F.array(*[F.col("m")[f] for f in FEATURES]).alias("counterfactual"))
    found = search.audited(vectors, TOY, FEATURES)
    return found.select(*KEYS, "n_leaves", F.round("leaf_margin", 9).alias("leaf_margin"), F.round("margin", 9).alias("margin"), "error_type")


@query(f"""WITH {RESCORED_SQL}, e AS (SELECT *, proba_counterfactual < {CUT} AS valid, round(proba_factual - proba_counterfactual, 9) AS risk_reduction FROM rescored)
SELECT count(*) AS n_counterfactuals, avg(valid::INT)::DOUBLE AS flip_rate, round(avg(risk_reduction), 9) AS mean_risk_reduction, quantile_cont(risk_reduction, 0.5) AS median_risk_reduction,
  count(DISTINCT row_id) AS n_rows, (SELECT avg(v::INT)::DOUBLE FROM (SELECT bool_or(valid) AS v FROM e GROUP BY row_id)) AS row_flip_rate FROM e""")
def eval_summary(spark, sf_dir):
    return evaluate.summary(validity(spark, sf_dir), ["risk_reduction"]).withColumn("mean_risk_reduction", F.round("mean_risk_reduction", 9))


@query(f"""WITH {RESCORED_SQL}, ok AS (SELECT DISTINCT row_id FROM rescored WHERE proba_counterfactual < {CUT}), bad AS (SELECT DISTINCT row_id FROM rescored WHERE proba_counterfactual >= {CUT} AND row_id NOT IN (SELECT row_id FROM ok))
SELECT (SELECT count(*) FROM wide) AS n_asked, (SELECT count(*) FROM ok) AS n_success, (SELECT count(*) FROM bad) AS n_failed, (SELECT count(*) FROM ok)::DOUBLE / (SELECT count(*) FROM wide) AS success_rate""")
def run_summary(spark, sf_dir):
    v = validity(spark, sf_dir)
    return evaluate.run_summary(v.select("row_id"), v.where("valid"), v.where("not valid"))


@query(f"""WITH {PAIRS_SQL} SELECT row_id, cf_rank, round(coalesce(sum(abs(after - before) / CASE WHEN most > least THEN most - least ELSE 1 END), 0), 6) AS distance FROM pairs p JOIN stats s ON p.feature = s.feature GROUP BY row_id, cf_rank""")
def normalised_l1(spark, sf_dir):
    return evaluate.normalised_l1(pairs(spark, sf_dir), evaluate.feature_ranges(dense(spark, sf_dir)), KEYS).withColumn("distance", F.round("distance", 6))


def _imputed_sql(stat: str) -> str:
    return f"""WITH {DENSE_SQL}, fills AS (SELECT feature, coalesce({stat}, 0) AS fill FROM dense GROUP BY feature)
    SELECT user_id, d.feature, coalesce(value, fill) AS value, value IS NULL AS was_missing FROM dense d JOIN fills f ON d.feature = f.feature"""


@query(_imputed_sql("sum(value::DECIMAL(28,6))::DOUBLE / count(value)"))
def mean_impute(spark, sf_dir):
    rows = dense(spark, sf_dir)
    return impute.imputed(rows, impute.fill_values(rows, "mean"))


@query(_imputed_sql("quantile_cont(value, 0.5)"))
def median_impute(spark, sf_dir):
    rows = dense(spark, sf_dir)
    return impute.imputed(rows, impute.fill_values(rows, "median"))


@query(f"""WITH {DENSE_SQL}, fills AS (SELECT feature, quantile_cont(value, 0.5) AS fill FROM dense GROUP BY feature),
filled AS (SELECT user_id, {", ".join(f"coalesce({f}, (SELECT fill FROM fills WHERE feature = '{f}')) AS {f}" for f in FEATURES)} FROM wide),
a AS (SELECT user_id, {ensemble.margin_sql(TOY)} AS margin FROM filled), b AS (SELECT user_id, {ensemble.margin_sql(TOY)} AS margin FROM wide),
s AS (SELECT round(1 / (1 + exp(-b.margin)), 9) AS native, round(1 / (1 + exp(-a.margin)), 9) AS imputed FROM a JOIN b ON a.user_id = b.user_id)
SELECT count(*) AS n, count(*) FILTER (native >= {THRESHOLD} AND imputed < {THRESHOLD}) AS n_lost, count(*) FILTER (native < {THRESHOLD} AND imputed >= {THRESHOLD}) AS n_gained,
  avg(((native >= {THRESHOLD}) <> (imputed >= {THRESHOLD}))::INT)::DOUBLE AS flip_rate, round(max(abs(imputed - native)), 9) AS max_gap FROM s""")
def flip_diagnostics(spark, sf_dir):
    """How many predictions change when missing values are filled with medians."""
    filled = features.to_wide(median_impute(spark, sf_dir), "user_id", FEATURES)
    proba = lambda df, name: ensemble.scored(df, TOY).select("user_id", F.round("proba", 9).alias(name))
    both = proba(wide(spark, sf_dir), "proba_native").join(proba(filled, "proba_imputed"), "user_id")
    return evaluate.flips(both, THRESHOLD).withColumn("max_gap", F.round("max_gap", 9))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query, list_distance(q.v, e.v) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.v), e.vec_id) AS place FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, round(avg(distance), 6) AS knn_distance FROM d WHERE place <= 5 GROUP BY query""")
def knn_plausibility(spark, sf_dir):
    """Mean distance of every fiftieth vector to its five nearest among all others."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = neighbours.nearest(rows, rows.where("id % 50 = 0"), 5, exclude_self=True)
    return found.groupBy("query").agg(F.round(F.avg("distance"), 6).alias("knn_distance"))


@query(f"""WITH {DENSE_SQL}, f AS (SELECT feature, row_number() OVER () - 1 AS i FROM (VALUES {", ".join(f"('{f}')" for f in FEATURES)}) v(feature)),
z AS (SELECT user_id, i, coalesce(value, 0) AS value FROM dense d JOIN f ON d.feature = f.feature)
SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.value, b.value), 6) AS covariance FROM z a JOIN z b ON a.user_id = b.user_id GROUP BY ALL""")
def covariance(spark, sf_dir):
    return neighbours.covariance(_zero_vectors(spark, sf_dir)).select("i", "j", F.round("covariance", 6).alias("covariance"))


def _zero_vectors(spark, sf_dir):
    return wide(spark, sf_dir).select(F.col("user_id").alias("id"), F.array(*[F.coalesce(f, F.lit(0.0)) for f in FEATURES]).alias("vector"))


def _vectors(spark, sf_dir):
    return wide(spark, sf_dir).select(F.col("user_id").alias("id"), F.array(*FEATURES).alias("vector"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.id AS q, b.id AS i, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id <> b.id),
near AS (SELECT q, i, d FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, i) <= 35),
far AS (SELECT q, max(d) AS far FROM near GROUP BY q),
density AS (SELECT n.q, 1 / (avg(greatest(n.d, f.far)) + 1e-10::DOUBLE) AS density FROM near n JOIN far f ON n.i = f.q GROUP BY n.q)
SELECT n.q AS query, round(-avg(t.density) / any_value(o.density), 6) AS lof_score FROM near n JOIN density t ON n.i = t.q JOIN density o ON n.q = o.q GROUP BY n.q""")
def lof_score(spark, sf_dir):
    """Local outlier factor of every embedding among all of them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return neighbours.lof(rows, rows, exclude_self=True).select("query", F.round("lof_score", 6).alias("lof_score"))


_N = len(FEATURES)
_INDEX_SQL = f"names AS (SELECT feature, row_number() OVER () - 1 AS j FROM (VALUES {', '.join(f"('{f}')" for f in FEATURES)}) v(feature))"


@query(f"""WITH RECURSIVE {DENSE_SQL}, {_INDEX_SQL}, z AS (SELECT user_id, j, coalesce(value, 0) AS value FROM dense d JOIN names n ON d.feature = n.feature),
cells AS (SELECT a.j AS i, b.j AS j, covar_samp(a.value, b.value) + CASE WHEN a.j = b.j THEN 1e-6::DOUBLE ELSE 0 END AS c FROM z a JOIN z b ON a.user_id = b.user_id GROUP BY a.j, b.j),
lines AS (SELECT i, list(c ORDER BY j) || [CASE WHEN i = k THEN 1.0::DOUBLE ELSE 0 END for k in range({_N})] AS line FROM cells GROUP BY i),
steps AS (
  SELECT 0 AS k, list(line ORDER BY i) AS m FROM lines
  UNION ALL SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1 THEN list_transform(line, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(line, lambda x, j: x - line[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
  FROM steps WHERE k < {_N}),
inverse AS (SELECT list_transform(m, lambda line: line[{_N + 1}:]) AS m FROM steps WHERE k = {_N}),
vectors AS (SELECT user_id, list(value ORDER BY j) AS v FROM z GROUP BY user_id)
SELECT user_id AS query, round(sqrt(greatest(list_dot_product(v, list_transform(m, lambda line: list_dot_product(line, v))), 0)), 4) AS distance FROM vectors, inverse""")
def mahalanobis(spark, sf_dir):
    v = _zero_vectors(spark, sf_dir)
    return neighbours.mahalanobis(v, v).select("query", F.round("distance", 4).alias("distance"))


@query(f"""WITH {DENSE_SQL}, {_INDEX_SQL}, x AS (SELECT user_id AS id, j, value FROM dense d JOIN names n ON d.feature = n.feature),
medians AS (SELECT j, coalesce(quantile_cont(value, 0.5), 0) AS m FROM x GROUP BY j),
spreads AS (SELECT x.j, any_value(m) AS m, avg(coalesce(value, m)) AS mean, CASE WHEN stddev_pop(coalesce(value, m)) = 0 THEN 1 ELSE stddev_pop(coalesce(value, m)) END AS s FROM x JOIN medians d ON x.j = d.j GROUP BY x.j),
z AS (SELECT id, x.j, value, (value - mean) / s AS z FROM x JOIN spreads p ON x.j = p.j),
asked AS (SELECT DISTINCT id FROM x WHERE value IS NULL),
apart AS (SELECT a.id, b.id AS donor, sqrt(sum((b.z - a.z) * (b.z - a.z)) * {_N} / count(*)) AS d FROM z a JOIN z b ON a.j = b.j WHERE a.id IN (SELECT id FROM asked) AND a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY a.id, b.id),
given AS (
  SELECT x.id, x.j, y.value FROM x JOIN apart p ON x.id = p.id JOIN x y ON y.id = p.donor AND y.j = x.j AND y.value IS NOT NULL WHERE x.value IS NULL
  QUALIFY row_number() OVER (PARTITION BY x.id, x.j ORDER BY round(d, 9), p.donor) <= 5),
new AS (SELECT id, j, avg(value) AS value FROM given GROUP BY id, j)
SELECT x.id, names.feature, round(coalesce(x.value, new.value, medians.m), 6) AS value FROM x JOIN names ON x.j = names.j JOIN medians ON x.j = medians.j LEFT JOIN new ON x.id = new.id AND x.j = new.j WHERE x.id IN (SELECT id FROM asked)""")
def knn_impute(spark, sf_dir):
    """Missing measurements of every user who lacks some, filled from the five nearest of all users."""
    v = _vectors(spark, sf_dir)
    found = neighbours.knn_imputed(v, v.where(F.exists("vector", lambda x: x.isNull())), len(FEATURES))
    names = F.array(*[F.lit(f) for f in FEATURES])
    return found.select("id", F.inline(F.arrays_zip(names.alias("feature"), F.transform("vector", lambda x: F.round(x, 6)).alias("value"))))


@query(f"""WITH {DENSE_SQL}, ranges AS (SELECT feature, min(value) AS least, max(value) AS most FROM dense GROUP BY feature),
b AS (
  SELECT user_id, d.feature, value, least, most, d.feature[:5] = 'chart' AS mutable, greatest(30.0::DOUBLE, least) AS floor, least(45.0::DOUBLE, most) AS ceiling FROM dense d JOIN ranges r ON d.feature = r.feature),
f AS (SELECT *, CASE WHEN NOT mutable THEN CASE WHEN 30 <= value AND value <= 45 THEN value END WHEN floor <= ceiling THEN least(greatest(value, floor), ceiling) END AS moved FROM b)
SELECT user_id, feature, CASE WHEN value IS NULL THEN feature <> 'chart_mean_item_view' ELSE moved IS NOT NULL END AS ok, CASE WHEN value IS NOT NULL THEN moved END AS value FROM f""")
def projected_values(spark, sf_dir):
    """Every value moved into [30, 45] and its feature's range: counts may not change, a missing mean view may not stay."""
    rows = dense(spark, sf_dir)
    ranges = evaluate.feature_ranges(rows).select("feature", "least", "most")
    f = F.col("feature")
    moved = scalars.projected(F.col("value"), F.lit(30.0), F.lit(45.0), F.col("least"), F.col("most"), f.startswith("chart"), F.lit(False), f != "chart_mean_item_view")
    return rows.join(ranges, "feature").select("user_id", "feature", moved.alias("p")).select("user_id", "feature", "p.ok", "p.value")


@query(f"""WITH {DENSE_SQL}, steps AS (SELECT user_id, feature, value / 60 AS x FROM dense WHERE value IS NOT NULL AND feature[:5] = 'chart'),
near AS (SELECT *, CASE WHEN abs(x) <= abs(x - 1) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS first FROM steps)
SELECT user_id, feature, CASE WHEN 0.2::DOUBLE <= first AND first <= x + 0.5::DOUBLE THEN first WHEN 0.2::DOUBLE <= 1 - first AND 1 - first <= x + 0.5::DOUBLE THEN 1 - first END AS bit FROM near""")
def binary_projection(spark, sf_dir):
    """0 or 1, the one nearer to each measurement over 60 that lies between 0.2 and half above it."""
    rows = dense(spark, sf_dir).where(F.col("value").isNotNull() & F.col("feature").startswith("chart")).withColumn("x", F.col("value") / 60)
    return rows.select("user_id", "feature", scalars.nearest_binary(F.col("x"), F.lit(0.2), F.col("x") + 0.5).alias("bit"))


@query(f"""WITH {DENSE_SQL}, fills AS (SELECT feature, coalesce(quantile_cont(value, 0.5), 0) AS fill FROM dense GROUP BY feature),
new AS (SELECT user_id AS row_id, d.feature, coalesce(value, fill) AS value FROM dense d JOIN fills f ON d.feature = f.feature WHERE user_id % 2 = 0)
SELECT d.user_id AS row_id, d.feature, coalesce(n.value, d.value) AS value FROM dense d LEFT JOIN new n ON d.user_id = n.row_id AND d.feature = n.feature""")
def overlaid_factuals(spark, sf_dir):
    """All rows' values with the imputed ones of the even rows laid over them, by row id and feature."""
    rows = dense(spark, sf_dir).withColumnRenamed("user_id", "row_id")
    filled = impute.imputed(rows.where("row_id % 2 = 0"), impute.fill_values(rows))
    return impute.overlaid(rows, filled)


def _search_rows(spark, sf_dir):
    """Predicted positives with their vectors, and the space to search in."""
    space = search.Space.learn(evaluate.feature_ranges(dense(spark, sf_dir)), FEATURES, set(MEANS))
    rows = ensemble.scored(wide(spark, sf_dir), TOY).where(F.col("proba") >= CUT)
    return rows.select(F.col("user_id").alias("row_id"), F.array(*FEATURES).alias("vector"), F.lit(None).cast("array<string>").alias("search")), space


@query()
def beam_search(spark, sf_dir):
    rows, space = _search_rows(spark, sf_dir)
    return search.beam(rows, TOY, space, CUT)


#: Shifts over ranges, added up, between two answers for one row.
APART = 0.5


def _exact_sql(apart: float = 0.0) -> str:
    """Every combination of cells between thresholds, the cheapest two of each row that flip it; the second at least `apart` from the first."""
    cuts = sorted({(n.feature, n.threshold) for n in TOY.nodes if n.feature in MEANS})
    joins = " ".join(f"JOIN options o{k} ON o{k}.user_id = w.user_id AND o{k}.feature = '{f}'" for k, f in enumerate(MEANS))
    away = " + ".join(f"coalesce(abs(f.{m} - b.{m}) / (SELECT most - least FROM ranges WHERE feature = '{m}'), 0)" for m in MEANS)
    return f"""WITH {DENSE_SQL}, ranges AS (SELECT feature, min(value) AS least, max(value) AS most FROM dense GROUP BY feature),
    cuts AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {t!r}::DOUBLE)" for f, t in cuts)}) c(feature, cut)),
    edges AS (SELECT feature, least AS low FROM ranges UNION SELECT c.feature, cut FROM cuts c JOIN ranges r ON c.feature = r.feature WHERE least < cut AND cut <= most),
    cells AS (SELECT e.feature, low, coalesce(lead(low) OVER (PARTITION BY e.feature ORDER BY low) - 1e-9::DOUBLE, most) AS high, most - least AS width FROM edges e JOIN ranges r ON e.feature = r.feature),
    options AS (
      SELECT user_id, d.feature, least(greatest(value, low), high) AS v, abs(least(greatest(value, low), high) - value) / width AS cost FROM dense d JOIN cells c ON d.feature = c.feature WHERE value IS NOT NULL AND width > 0
      UNION ALL SELECT user_id, d.feature, value, 0 FROM dense d JOIN ranges r ON d.feature = r.feature WHERE value IS NULL OR NOT least < most),
    now AS (SELECT user_id, {ensemble.margin_sql(TOY)} AS margin FROM wide), asked AS (SELECT user_id FROM now WHERE 1 / (1 + exp(-margin)) >= {CUT}),
    tried AS (SELECT w.user_id, {", ".join(f"o{k}.v AS {f}" for k, f in enumerate(MEANS))}, {", ".join(COUNTS)}, {" + ".join(f"o{k}.cost" for k in range(len(MEANS)))} AS cost FROM wide w JOIN asked USING (user_id) {joins}),
    priced AS (SELECT user_id, cost, {", ".join(MEANS)}, {ensemble.margin_sql(TOY)} AS margin FROM tried),
    flipped AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost) AS k FROM priced WHERE margin <= ln({CUT} / (1 - {CUT})) - 1e-5::DOUBLE),
    best AS (
      SELECT user_id, k, cost FROM flipped WHERE k = 1
      UNION ALL SELECT f.user_id, 2, min(f.cost) FROM flipped f JOIN flipped b ON f.user_id = b.user_id AND b.k = 1 WHERE f.k > 1 AND {away} >= {apart} GROUP BY f.user_id)
    SELECT a.user_id AS row_id, coalesce(k, 0)::INT AS cf_rank, round(cost, 6) AS cost, true AS proven, CASE WHEN k IS NULL THEN 'infeasible' ELSE 'optimal' END AS status FROM asked a LEFT JOIN (SELECT * FROM best WHERE k <= 2) b ON a.user_id = b.user_id"""


@query(_exact_sql())
def exact_search(spark, sf_dir):
    """The two cheapest counterfactuals of each predicted positive, proven."""
    rows, space = _search_rows(spark, sf_dir)
    found = search.exact(rows, TOY, space, CUT, costs=search.Costs(sparsity=0.0, solutions=2, gap=0.0, seconds=None, apart=0.0))
    return found.select("row_id", "cf_rank", F.round("cost", 6).alias("cost"), "proven", "status")


@query(_exact_sql(APART))
def exact_apart(spark, sf_dir):
    """The cheapest counterfactual of each predicted positive, and the cheapest that lies APART from it, proven."""
    rows, space = _search_rows(spark, sf_dir)
    found = search.exact(rows, TOY, space, CUT, costs=search.Costs(sparsity=0.0, solutions=2, gap=0.0, seconds=None, apart=APART))
    return found.select("row_id", "cf_rank", F.round("cost", 6).alias("cost"), "proven", "status")


@query()
def genetic_search(spark, sf_dir):
    rows, space = _search_rows(spark, sf_dir)
    return search.genetic(rows, TOY, space, CUT, every_row=True)


assert events.SCALE == scalars.PRECISION and len(COUNTS) == len(MEANS)
