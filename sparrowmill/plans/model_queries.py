"""Queries over a model and scored rows: scoring, leaf regions, measures, and which rows are explained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import boosting, cohort, ensemble, features, metrics, selection
from ..sources.staging import discard, written
from .registry import query
from .tables import COUNTS, DENSE_SQL, FEATURES, MEANS, SCORED_SQL, THRESHOLD, TOY, TYPES, WIDE_SQL, dense, scored, table, wide


@query(f"WITH {WIDE_SQL}, m AS (SELECT user_id, {ensemble.margin_sql(TOY)} AS margin FROM wide) SELECT user_id, round(margin, 9) AS margin, round(1 / (1 + exp(-margin)), 9) AS proba FROM m")
def tree_score(spark, sf_dir):
    return ensemble.scored(wide(spark, sf_dir), TOY).select("user_id", F.round("margin", 9).alias("margin"), F.round("proba", 9).alias("proba"))


@query(f"WITH {WIDE_SQL}, m AS (SELECT user_id, {ensemble.margin_sql(TOY)} AS margin FROM wide) SELECT user_id, {len(TOY.by_tree)}::BIGINT AS n_leaves, round(margin, 9) AS margin, round(1 / (1 + exp(-margin)), 9) AS proba FROM m")
def tree_score_leaf_join(spark, sf_dir):
    """The same scores, by dividing rows by the conditions of leaves."""
    found = ensemble.leaf_join_scores(dense(spark, sf_dir), "user_id", TOY)
    return found.select("user_id", "n_leaves", F.round("margin", 9).alias("margin"), F.round("proba", 9).alias("proba"))


@query(f"WITH {WIDE_SQL}, m AS (SELECT user_id, {ensemble.margin_sql(TOY)} AS margin FROM wide) SELECT user_id, round(margin, 9) AS margin FROM m")
def tree_score_vector(spark, sf_dir):
    """The same margins over vectors, in vectorised Python, as for ensembles too large for generated code."""
    vectors = wide(spark, sf_dir).select("user_id", F.array(*FEATURES).alias("vector"))
    return vectors.select("user_id", F.round(ensemble.vector_margin(TOY, FEATURES)("vector"), 9).alias("margin"))


_NODES = ", ".join(
    f"({n.tree}, {n.node}, {n.left if n.left is not None else 'NULL'}, {n.right if n.right is not None else 'NULL'}, "
    + (f"'{n.feature}', {n.threshold!r}::DOUBLE, {n.default_left}" if n.feature else "NULL, NULL, NULL")
    + f", {f'{n.leaf!r}::DOUBLE' if n.leaf is not None else 'NULL'}, {f'{n.gain!r}::DOUBLE' if n.gain is not None else 'NULL'})"
    for n in TOY.nodes
)
NODES_SQL = f"nodes AS (SELECT * FROM (VALUES {_NODES}) n(tree, node, l, r, feature, threshold, default_left, leaf, gain))"
REGIONS_SQL = f"""{NODES_SQL},
steps AS (
  SELECT tree, node AS parent, l AS node, feature, NULL::DOUBLE AS lower, threshold AS upper, default_left AS allow_missing FROM nodes WHERE feature IS NOT NULL
  UNION ALL SELECT tree, node, r, feature, threshold, NULL, NOT default_left FROM nodes WHERE feature IS NOT NULL),
paths AS (
  SELECT tree, node AS leaf, node AS at, leaf AS value, NULL::VARCHAR AS feature, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, true AS allow_missing FROM nodes WHERE leaf IS NOT NULL
  UNION ALL SELECT p.tree, p.leaf, s.parent, p.value, s.feature, s.lower, s.upper, s.allow_missing FROM paths p JOIN steps s ON p.tree = s.tree AND p.at = s.node),
region AS (SELECT tree, leaf, any_value(value) AS value, feature, max(lower) AS lower, min(upper) AS upper, bool_and(allow_missing) AS allow_missing FROM paths WHERE feature IS NOT NULL GROUP BY tree, leaf, feature)"""


_LEAVES = " UNION ALL ".join(f"SELECT row_id, label, {t} AS tree, {ensemble.tree_sql(TOY, t, numbers=True)} AS leaf FROM scored" for t in TOY.by_tree)
SUPPORT_SQL = f"""{SCORED_SQL}, reached AS ({_LEAVES}), support AS (SELECT tree, leaf, count(*) AS n_rows, sum(label)::BIGINT AS n_positive FROM reached GROUP BY tree, leaf), {REGIONS_SQL}"""
GAINS_SQL = f"""{SUPPORT_SQL},
held AS (SELECT p.tree, p.up AS node, sum(n_rows)::DOUBLE AS n, sum(n_positive)::DOUBLE AS p FROM (SELECT DISTINCT q.tree, q.leaf, q.at AS up FROM paths q) p JOIN support s ON p.tree = s.tree AND p.leaf = s.leaf GROUP BY p.tree, p.up),
gains AS (
  SELECT feature, coalesce(a.n * b.n / (a.n + b.n) * power(a.p / a.n - b.p / b.n, 2), 0) AS gain FROM nodes d
  LEFT JOIN held a ON d.tree = a.tree AND d.l = a.node LEFT JOIN held b ON d.tree = b.tree AND d.r = b.node WHERE feature IS NOT NULL),
g AS (SELECT feature, avg(gain) AS gain FROM gains GROUP BY feature),
importance AS (SELECT feature, gain / sum(gain) OVER () AS importance_gain FROM g)"""


def _supported(spark, sf_dir):
    """What each leaf's path asks of each feature, with the leaf's rows and positive labels; leaves without rows have 0."""
    support = ensemble.leaf_support(scored(spark, sf_dir), TOY)
    return ensemble.region_table(spark, TOY).join(support, ["tree", "leaf"], "left").fillna(0, ["n_rows", "n_positive"])


@query(f"""WITH RECURSIVE {SUPPORT_SQL}
SELECT r.tree, r.leaf, value, feature, lower, upper, allow_missing, coalesce(n_rows, 0) AS n_rows, coalesce(n_positive, 0) AS n_positive FROM region r LEFT JOIN support s ON r.tree = s.tree AND r.leaf = s.leaf""")
def leaf_regions(spark, sf_dir):
    """What each leaf's path asks of each feature, and how many rows and positive labels it holds."""
    return _supported(spark, sf_dir)


@query(f"""WITH RECURSIVE {SUPPORT_SQL}, leaves AS (SELECT DISTINCT r.tree, r.leaf, value, n_rows, n_positive FROM region r JOIN support s ON r.tree = s.tree AND r.leaf = s.leaf),
own AS (SELECT * FROM leaves QUALIFY row_number() OVER (PARTITION BY tree ORDER BY value, leaf) <= 2) SELECT tree, leaf, value, n_rows, n_positive FROM own ORDER BY value, tree, leaf LIMIT 5""")
def top_facets(spark, sf_dir):
    """Of the leaves that any row comes to, those that lower the margin most: two of each tree, five in all (a top-k report)."""
    return ensemble.top_facets(_supported(spark, sf_dir).where("n_rows > 0"), 0, 2, 5)


@query(f"""WITH RECURSIVE {SUPPORT_SQL}
SELECT c.row_id, feature, max(lower) AS lower, min(upper) AS upper, bool_and(allow_missing) AS allow_missing, coalesce(max(lower) < min(upper), true) OR bool_and(allow_missing) AS feasible
FROM reached c JOIN region r ON c.tree = r.tree AND c.leaf = r.leaf GROUP BY c.row_id, feature""")
def merged_constraints(spark, sf_dir):
    """For each row the intersection of the conditions of its leaves: how far each feature may move before a tree says something else."""
    reached = ensemble.leaves_reached(scored(spark, sf_dir), TOY, ["row_id"])
    return ensemble.merged(reached.join(ensemble.region_table(spark, TOY), ["tree", "leaf"]), ["row_id"])


def _importance(spark, sf_dir):
    return ensemble.importance(ensemble.observed_gains(ensemble.leaf_support(scored(spark, sf_dir), TOY), TOY))


@query(f"WITH RECURSIVE {GAINS_SQL} SELECT feature, round(importance_gain, 9) AS importance_gain FROM importance")
def feature_importance(spark, sf_dir):
    """Shares of the mean gain of each feature's splits, gains as the labelled rows show them."""
    return _importance(spark, sf_dir).withColumn("importance_gain", F.round("importance_gain", 9))


@query(f"""WITH RECURSIVE {GAINS_SQL}, s AS (SELECT feature, round(importance_gain, 9) AS importance_gain FROM importance WHERE feature IN ({", ".join(f"'{m}'" for m in MEANS)}))
SELECT *, row_number() OVER (ORDER BY importance_gain DESC, feature)::INT AS rank FROM s""")
def ranked_features(spark, sf_dir):
    """Measurements that the model uses, the most important by the rows first."""
    catalogue = dense(spark, sf_dir).where(F.col("feature").startswith("chart_")).select("feature").distinct()
    return features.ranked(catalogue, _importance(spark, sf_dir).withColumn("importance_gain", F.round("importance_gain", 9)))


@query(f"WITH {SCORED_SQL} SELECT count(*) FILTER (label = 0) AS n_negative, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0)::DOUBLE / count(*) FILTER (label = 1) AS weight FROM scored")
def class_balance(spark, sf_dir):
    return metrics.class_balance(scored(spark, sf_dir))


@query(f"""WITH {SCORED_SQL} SELECT count(*) FILTER (proba < {THRESHOLD} AND label = 0) AS tn, count(*) FILTER (proba >= {THRESHOLD} AND label = 0) AS fp,
count(*) FILTER (proba < {THRESHOLD} AND label = 1) AS fn, count(*) FILTER (proba >= {THRESHOLD} AND label = 1) AS tp FROM scored""")
def confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), THRESHOLD)


@query(f"""WITH {SCORED_SQL} SELECT round(sum(CASE WHEN a.proba > b.proba THEN 1.0 WHEN a.proba = b.proba THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 9) AS auc
FROM scored a JOIN scored b ON a.label = 1 AND b.label = 0""")
def roc_auc(spark, sf_dir):
    """The share of pairs of a positive and a negative that are in order, ties as half; counted by score, not by pairs."""
    return metrics.roc_auc(scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"""WITH {SCORED_SQL}, s AS (SELECT proba, sum(label) AS pos, count(*) AS n FROM scored GROUP BY proba),
c AS (SELECT pos, sum(pos) OVER w AS hits, sum(n) OVER w AS shown FROM s WINDOW w AS (ORDER BY proba DESC))
SELECT round(sum(pos * (hits::DOUBLE / shown)) / sum(pos), 9) AS average_precision FROM c""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(f"""WITH {SCORED_SQL} SELECT round(avg((proba - label) * (proba - label)), 9) AS brier, round(avg(-(label * ln(proba) + (1 - label) * ln(1 - proba))), 9) AS log_loss,
avg(label)::DOUBLE AS prevalence, avg(pred_label)::DOUBLE AS predicted_positive_rate, coalesce(2.0::DOUBLE * count(*) FILTER (label = 1 AND pred_label = 1) / (sum(label) + sum(pred_label)), 0.0) AS f1 FROM scored""")
def brier_logloss(spark, sf_dir):
    m = metrics.losses(scored(spark, sf_dir), THRESHOLD)
    return m.withColumns({"brier": F.round("brier", 9), "log_loss": F.round("log_loss", 9)})


SWEEP_SQL = f"""{SCORED_SQL}, steps AS (SELECT round(0.05::DOUBLE + 0.005::DOUBLE * k, 3) AS threshold FROM range(181) r(k)),
swept AS (SELECT threshold, count(*) FILTER (proba >= threshold AND label = 1) AS tp, count(*) FILTER (proba >= threshold AND label = 0) AS fp, count(*) FILTER (proba < threshold AND label = 1) AS fn FROM steps, scored GROUP BY threshold),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM swept)"""


@query(f"WITH {SWEEP_SQL} SELECT * FROM f")
def threshold_sweep(spark, sf_dir):
    return metrics.sweep(scored(spark, sf_dir))


@query(f"WITH {SWEEP_SQL} SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    """The threshold with the best F1, the lowest among ties."""
    return metrics.best_threshold(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL} SELECT row_id, label AS y_true, proba AS pred_proba, pred_label FROM scored")
def predictions(spark, sf_dir):
    """Predictions under the names that a table of them may have, without a predicted label."""
    raw = scored(spark, sf_dir).select(F.col("row_id").alias("row_index"), "label", F.col("proba").alias("y_proba"))
    return selection.predictions(raw, THRESHOLD)


def _predicted(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", F.col("label").alias("y_true"), F.col("proba").alias("pred_proba"), "pred_label")


@query(f"WITH {SCORED_SQL} SELECT row_id, label AS y_true, proba AS pred_proba, pred_label FROM scored WHERE pred_label = 1 AND proba >= {THRESHOLD} ORDER BY proba DESC, row_id LIMIT 20")
def select_factuals(spark, sf_dir):
    """The twenty rows of highest risk (a top-k report)."""
    return selection.factuals(_predicted(spark, sf_dir), THRESHOLD, 20)


@query(f"WITH {SCORED_SQL} SELECT row_id, label AS y_true, proba AS pred_proba, pred_label FROM scored WHERE pred_label = 1 ORDER BY md5('7|' || row_id), row_id LIMIT 20")
def random_factuals(spark, sf_dir):
    """Twenty rows by seeded hash order (a sampling operator)."""
    return selection.factuals(_predicted(spark, sf_dir), THRESHOLD, 20, random=True, seed=7)


@query(f"WITH {SCORED_SQL}, ids AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 11)) i(position, row_id)) SELECT i.row_id::BIGINT AS row_id, position, label, proba FROM ids i JOIN scored s ON i.row_id = s.row_id")
def fixed_cohort(spark, sf_dir):
    """A list of ids with an order and a repeat."""
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 11)], "position int, row_id long")
    return selection.fixed_cohort(scored(spark, sf_dir), ids).select("row_id", "position", "label", "proba")


@query(f"WITH {SCORED_SQL} SELECT row_id, proba FROM scored ORDER BY proba DESC, row_id LIMIT 25 OFFSET 10")
def query_window(spark, sf_dir):
    """Rows 10 to 34 by risk (offset and limit are the feature)."""
    return selection.window_of(scored(spark, sf_dir).select("row_id", "proba"), [F.desc("proba"), "row_id"], 10, 25)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders")
def row_positions(spark, sf_dir):
    """Positions of all orders by date, counted by range and not in one task."""
    return selection.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_id")


BATCHES_SQL = f"""{SCORED_SQL}, k AS (SELECT row_id, row_number() OVER (ORDER BY md5('5|' || row_id), row_id) - 1 AS k FROM scored WHERE pred_label = 1),
batches AS (SELECT (k // 2 + 1)::INT AS batch, (k % 2 + 1)::INT AS place, row_id FROM k WHERE k < 6)"""


@query(f"WITH {BATCHES_SQL} SELECT * FROM batches")
def query_batches(spark, sf_dir):
    """Three disjoint random batches of two predicted positives (a sampling operator)."""
    return selection.batches(selection.pool(_predicted(spark, sf_dir), 1), 2, 3, seed=5)


@query(f"""WITH {SCORED_SQL}, k AS (SELECT b AS batch, row_id, row_number() OVER (PARTITION BY b ORDER BY md5((5 + b) || '|' || row_id), row_id)::INT AS place FROM scored, (VALUES (1), (2)) v(b) WHERE pred_label = 1)
SELECT batch, place, row_id FROM k WHERE place <= 4""")
def overlapping_batches(spark, sf_dir):
    """Two independent random batches of four (a sampling operator)."""
    return selection.batches(selection.pool(_predicted(spark, sf_dir), 1), 4, 2, seed=5, disjoint=False)


@query(f"WITH {BATCHES_SQL} SELECT batch, pred_label, label AS y_true, count(*) AS n FROM batches b JOIN scored s ON b.row_id = s.row_id GROUP BY ALL")
def batch_manifest(spark, sf_dir):
    predicted = _predicted(spark, sf_dir)
    return selection.manifest(selection.batches(selection.pool(predicted, 1), 2, 3, seed=5), predicted)


@query(f"WITH {DENSE_SQL} SELECT user_id, count(*) FILTER (value IS NULL) AS n_missing, coalesce(list(feature ORDER BY feature) FILTER (value IS NULL AND feature[:5] = 'chart'), []) AS missing FROM dense GROUP BY user_id")
def missing_features(spark, sf_dir):
    vectors = wide(spark, sf_dir).select("user_id", F.array(*FEATURES).alias("vector"))
    return features.missing_features(vectors, "user_id", FEATURES)


@query(f"WITH {SCORED_SQL} SELECT row_id, round(ln(proba / (1 - proba)), 6) AS margin FROM scored")
def logits(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", F.round(scalars.logit(F.col("proba")), 6).alias("margin"))


@query(f"""WITH {SCORED_SQL}, p AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM scored)
SELECT CASE WHEN k <= ceil(n * 0.15) THEN 'test' WHEN k <= ceil(n * 0.15) + ceil(n * 0.15) THEN 'val' ELSE 'train' END AS split, label, count(*) AS n FROM p GROUP BY ALL""")
def label_counts(spark, sf_dir):
    """Rows by split and label."""
    return cohort.stratified_split(scored(spark, sf_dir), "row_id", "label").groupBy("split", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {WIDE_SQL}, m AS (SELECT user_id, {ensemble.margin_sql(TOY)} AS whole, {ensemble.margin_sql(TOY.truncated(2))} AS part FROM wide)
SELECT user_id, round(1 / (1 + exp(-part)), 9) AS proba_subset, round(1 / (1 + exp(-whole)), 9) AS proba_full, round(abs(1 / (1 + exp(-whole)) - 1 / (1 + exp(-part))), 9) AS gap FROM m""")
def subset_gap(spark, sf_dir):
    """How far the first two trees alone are from the whole model."""
    return ensemble.subset_gap(wide(spark, sf_dir), TOY, 2).select("user_id", *[F.round(c, 9).alias(c) for c in ("proba_subset", "proba_full", "gap")])


@query(f"""WITH {WIDE_SQL}, m AS (SELECT user_id, {ensemble.margin_sql(TOY)} AS margin FROM wide)
SELECT user_id, round(1 / (1 + exp(-margin)), 9) AS proba, CASE WHEN 1 / (1 + exp(-margin)) < 0.55 THEN 'NotPositive' END AS error_type FROM m""")
def rescored_factuals(spark, sf_dir):
    return ensemble.rescored(wide(spark, sf_dir), TOY, 0.55).select("user_id", F.round("proba", 9).alias("proba"), "error_type")


@query(f"""WITH {DENSE_SQL}, n AS (SELECT count(*) FILTER (value IS NULL) AS n FROM dense GROUP BY user_id)
SELECT count(*) AS n_rows, count(*) FILTER (n > 0) AS n_with_missing, avg(n)::DOUBLE AS mean_missing, quantile_cont(n, 0.5)::DOUBLE AS median_missing FROM n""")
def missing_summary(spark, sf_dir):
    return features.missing_summary(wide(spark, sf_dir).select(F.array(*FEATURES).alias("vector")), FEATURES)


def labelled_vectors(spark, sf_dir):
    """(row_id, split, label, vector) of FEATURES; splits are by subject within labels."""
    rows = scored(spark, sf_dir)
    split = cohort.stratified_split(rows, "row_id", "label").select("row_id", "split")
    return rows.join(split, "row_id").select("row_id", "split", "label", F.array(*FEATURES).alias("vector"))


@query()
def boost_fit(spark, sf_dir):
    """(tree, node, ...): the trees that boosting fits to the labels, stopped by the validation rows.

    All settings are the operator's defaults but for the least weight of a node, which few users don't reach.
    """
    rows = written(labelled_vectors(spark, sf_dir), "vectors")  # read for the labels, the bins and the matrix
    fitted = boosting.fit(rows.where("split = 'train'"), rows.where("split = 'val'"), FEATURES, boosting.Settings(least_weight=2.0))
    discard(rows)
    return fitted.ensemble.table(spark)


assert len(TYPES) == len(COUNTS)
