import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.operators import boosting, ensemble, evaluate, features, impute, metrics, neighbours, search, selection
from sparrowmill.plans.tables import FEATURES, TOY

EDGES = sorted({n.threshold for n in TOY.nodes if n.threshold is not None})
VALUE = st.one_of(st.none(), st.sampled_from(EDGES), st.floats(0, 100, allow_nan=False))


def rows_of(seed, n=60):
    draw = np.random.default_rng(seed)
    x = np.round(draw.uniform(0, 90, (n, len(FEATURES))), 2)
    x[:, 5:] = draw.integers(0, 4, (n, 5))
    x[draw.random((n, len(FEATURES))) < 0.2] = np.nan
    return x


def frame(spark, x):
    vectors = [(k, [None if math.isnan(v) else float(v) for v in row]) for k, row in enumerate(x)]
    return spark.createDataFrame(vectors, "row_id long, vector array<double>")


def wide(spark, x):
    return frame(spark, x).select("row_id", *[F.col("vector")[k].alias(f) for k, f in enumerate(FEATURES)])


@settings(max_examples=100, deadline=None)
@given(st.lists(VALUE, min_size=len(FEATURES), max_size=len(FEATURES)))
def test_regions_partition_the_space(row):
    x = dict(zip(FEATURES, row, strict=True))
    inside = lambda r: all(m if x[f] is None else a <= x[f] < b for f, (a, b, m) in r.bounds.items())
    held = [r for r in ensemble.regions(TOY) if inside(r)]
    assert [r.tree for r in held] == [0, 1, 2]
    m = ensemble.margins(np.array([[math.nan if v is None else v for v in row]]), ensemble.arrays(TOY, FEATURES), TOY.base_margin)[0]
    assert m == pytest.approx(TOY.base_margin + sum(r.value for r in held))


def test_all_scorers_agree(spark):
    x = rows_of(3)
    x[0, :] = 50.0
    x[1, :] = np.nan
    df = wide(spark, x)
    want = ensemble.margins(x, ensemble.arrays(TOY, FEATURES), TOY.base_margin)
    case = [r.margin for r in ensemble.scored(df, TOY).orderBy("row_id").collect()]
    vector = [r.m for r in frame(spark, x).select("row_id", ensemble.vector_margin(TOY, FEATURES)("vector").alias("m")).orderBy("row_id").collect()]
    column = [r.m for r in frame(spark, x).select("row_id", ensemble.vector_margin_column(TOY, FEATURES).alias("m")).orderBy("row_id").collect()]
    joined = [(r.n_leaves, r.margin) for r in ensemble.leaf_join_scores(features.melted(df, ["row_id"]), "row_id", TOY).orderBy("row_id").collect()]
    assert case == pytest.approx(want) and vector == pytest.approx(want) and column == pytest.approx(want)
    assert [n for n, _ in joined] == [3] * len(x) and [m for _, m in joined] == pytest.approx(want)


def test_ensemble_checks(spark):
    with pytest.raises(ValueError, match="one tree"):
        ensemble.Ensemble([ensemble.Node(0, 0, 1, 2, "a", 1.0, True, None)])
    with pytest.raises(ValueError, match="differ in length"):
        ensemble.array_nodes(0, [1], [2, 3], [0], [0.0], [True], [0.0], ["a"])
    again = ensemble.Ensemble.load(TOY.table(spark), TOY.base_margin)
    assert sorted(again.nodes, key=lambda n: (n.tree, n.node)) == sorted(TOY.nodes, key=lambda n: (n.tree, n.node))
    lone = ensemble.Ensemble([ensemble.Node(0, 0, None, None, None, None, None, 0.5)])
    df = spark.createDataFrame([(1, "a", 1.0)], "row_id long, feature string, value double")
    assert ensemble.leaf_join_scores(df, "row_id", lone).first().margin == 0.5


def test_nested_form():
    dump = {"nodeid": 0, "split": "a", "split_condition": 2.0, "yes": 1, "no": 2, "missing": 2, "children": [{"nodeid": 1, "leaf": -1.0}, {"nodeid": 2, "leaf": 1.0}]}
    e = ensemble.Ensemble(ensemble.nested_regions(dump))
    assert list(ensemble.margins(np.array([[1.9], [2.0], [np.nan]]), ensemble.arrays(e, ["a"]), 0.0)) == [-1, 1, 1]


def test_measures_with_ties(spark):
    draw = np.random.default_rng(5)
    y, p = draw.integers(0, 2, 300), np.round(draw.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "label int, proba double")
    pos, neg = p[y == 1], p[y == 0]
    auc = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first().auc == pytest.approx(auc)
    steps = sorted(set(p), reverse=True)
    ap = sum(np.sum(pos == s) / len(pos) * np.sum(pos >= s) / np.sum(p >= s) for s in steps)
    assert metrics.average_precision(df).first().average_precision == pytest.approx(ap)
    f1 = {t: 2 * np.sum(pos >= t) / (2 * np.sum(pos >= t) + np.sum(neg >= t) + np.sum(pos < t)) for t in metrics.THRESHOLDS}
    best = metrics.best_threshold(df).first()
    assert best.f1 == pytest.approx(max(f1.values()))
    assert best.threshold == min(t for t in f1 if f1[t] == max(f1.values()))
    one_class = df.where("label = 1")
    assert metrics.roc_auc(one_class).first().auc is None
    assert metrics.class_balance(df.where("label = 0")).first().weight == 1.0
    with pytest.raises(ValueError, match="f1"):
        metrics.best_threshold(df, metric="accuracy")


def test_selection(spark):
    df = spark.createDataFrame([(k, k % 2, k / 10, int(k >= 5)) for k in range(10)], "row_id long, y_true int, pred_proba double, pred_label int")
    assert [r.row_id for r in selection.factuals(df, 0.6, 3).collect()] == [9, 8, 7]
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, 7)], "position int, row_id long")
    assert [r.row_id for r in selection.fixed_cohort(df, ids).collect()] == [7, 3, 7]
    with pytest.raises(ValueError, match="99"):
        selection.fixed_cohort(df, spark.createDataFrame([(0, 99)], "position int, row_id long"))
    got = selection.batches(df, 3, 3, seed=1).collect()
    assert len({r.row_id for r in got}) == 9 and {r.batch for r in got} == {1, 2, 3}
    both = selection.batches(df, 8, 2, seed=1, disjoint=False).collect()
    assert len(both) == 16 and len({(r.batch, r.row_id) for r in both}) == 16
    with pytest.raises(ValueError, match="11"):
        selection.batches(df, 11, 1)
    with pytest.raises(ValueError, match="positive"):
        selection.batches(df, 0, 1)
    assert [r.row_id for r in selection.window_of(df, ["row_id"], 2, 3).collect()] == [2, 3, 4]
    numbered = selection.numbered(df.select(F.col("pred_proba").alias("p")).repartition(5), ["p"]).orderBy("p").collect()
    assert [r.row_id for r in numbered] == list(range(10))
    with pytest.raises(ValueError, match="pred_label"):
        selection.predictions(df.select("row_id"), 0.5)


def test_boosting_learns_and_stops(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1200, 4))
    y = (x[:, 0] + (x[:, 1] > 0) + 0.3 * draw.normal(size=1200) > 0.5).astype(int)
    x[draw.random(x.shape) < 0.1] = np.nan
    df = frame(spark, x).join(spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "row_id long, label int"), "row_id")
    fitted = boosting.fit(df.where("row_id < 800"), df.where("row_id >= 800"), list("abcd"), boosting.Settings(rounds=6, rate=0.4, depth=3, least_weight=3.0, columns=0.8))
    losses = [v for _, v in fitted.losses]
    assert losses[-1] < losses[0] < math.log(2)
    m = ensemble.margins(x[800:], ensemble.arrays(fitted.ensemble, list("abcd")), 0.0)
    pos, neg = m[y[800:] == 1], m[y[800:] == 0]
    assert np.mean(pos[:, None] > neg) > 0.9
    none = boosting.fit(df.where("label = 1"), df, list("abcd"), boosting.Settings(rounds=1))
    assert none.ensemble.nodes == []


def plain_boosting(x, y, held, s, cuts):
    """The same trees in plain arrays: every round starts from all earlier trees, every node is summed, rows by rows."""
    width = x.shape[1]
    draw, trees, losses = np.random.default_rng(s.seed), [], []
    weight = (y[~held] == 0).sum() / (y[~held] == 1).sum()

    def leaf(tree, row):
        at = tree
        while isinstance(at, tuple):
            j, t, missing_left, left, right = at
            at = left if (missing_left if np.isnan(row[j]) else row[j] < t) else right
        return at

    def grow(rows, g, h, chosen, depth):
        value = boosting.leaf_value(g[rows].sum(), h[rows].sum(), s)
        best = (1e-12, None)
        for j in chosen if depth else []:
            for missing_left in (True, False):
                for t in cuts[j]:
                    left = np.where(np.isnan(x[rows, j]), missing_left, x[rows, j] < t)
                    a, b = rows[left], rows[~left]
                    if h[a].sum() < s.least_weight or h[b].sum() < s.least_weight:
                        continue
                    gain = sum(k * boosting._gain(g[i].sum(), h[i].sum(), s) for k, i in ((1, a), (1, b), (-1, rows)))
                    if gain > best[0] + 1e-12:
                        best = (gain, (j, t, missing_left, a, b))
        if best[1] is None:
            return value
        j, t, missing_left, a, b = best[1]
        return j, t, missing_left, grow(a, g, h, chosen, depth - 1), grow(b, g, h, chosen, depth - 1)

    for round_ in range(s.rounds):
        chosen = np.sort(draw.permutation(width)[: max(1, int(width * s.columns))])
        margin = np.array([sum(leaf(t, row) for t in trees) for row in x], float)
        g, h = boosting.gradients(y.astype(float), margin, weight)
        rows = np.flatnonzero(~held & (boosting.hash_share(np.arange(len(x)), s.seed + round_) < s.rows))
        tree = grow(rows, g, h, chosen, s.depth)
        trees.append(tree if isinstance(tree, tuple) else 0.0)
        loss, weights = boosting.loss_sums(y[held].astype(float), np.array([sum(leaf(t, row) for t in trees) for row in x[held]], float), weight)
        losses.append(loss / weights)
    return losses


@pytest.mark.parametrize("carry", [1, 3, 100])
def test_boosting_against_plain_arrays(spark, carry):
    """Losses of each round equal those of a plain fit, however often margins are written."""
    draw = np.random.default_rng(9)
    x = np.round(draw.normal(size=(300, 3)), 1)
    y = (x[:, 0] * x[:, 1] + 0.4 * draw.normal(size=300) > 0.2).astype(int)
    x[draw.random(x.shape) < 0.1] = np.nan
    s = boosting.Settings(rounds=8, rate=0.3, depth=3, least_weight=2.0, columns=0.7, bins=8, patience=50)
    df = frame(spark, x).join(spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "row_id long, label int"), "row_id")
    fitted = boosting.fit(df.where("row_id < 200"), df.where("row_id >= 200"), list("abc"), s, carry=carry)
    want = plain_boosting(x, y, np.arange(300) >= 200, s, boosting.cut_points(df.where("row_id < 200"), 3, s.bins))
    assert [v for _, v in fitted.losses] == pytest.approx(want, rel=1e-9)
    assert len(fitted.ensemble.by_tree) == int(np.argmin(want)) + 1


def test_a_round_costs_the_same_late(spark, monkeypatch):
    """Tasks never walk more trees than are carried, and only the lighter of two siblings is summed."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 3))
    y = (x[:, 0] > 0.1).astype(int)
    seen, plain = [], boosting._summed
    monkeypatch.setattr(boosting, "_summed", lambda blocks, trees, tree, asked, *a: seen.append((len(trees), len(asked), len(tree.values))) or plain(blocks, trees, tree, asked, *a))
    df = frame(spark, x).join(spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "row_id long, label int"), "row_id")
    boosting.fit(df.where("row_id < 300"), df.where("row_id >= 300"), list("abc"), boosting.Settings(rounds=14, rate=0.1, depth=3, least_weight=1.0), carry=4)
    assert max(t for t, _, _ in seen) == 3 and all(2 * asked <= max(values, 2) for _, asked, values in seen)


def test_a_level_is_one_job_of_one_stage(spark):
    """A round runs a job a level, each of one stage without a shuffle; only writing the matrix adds some."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(400, 3))
    y = (x[:, 0] + draw.normal(size=400) > 0.1).astype(int)
    df = frame(spark, x).join(spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "row_id long, label int"), "row_id")
    stages = []
    for rounds in (2, 12):
        spark.sparkContext.setJobGroup(f"boosting-{rounds}", "")
        fitted = boosting.fit(df.where("row_id < 300"), df.where("row_id >= 300"), list("abc"), boosting.Settings(rounds=rounds, rate=0.1, depth=3, least_weight=1.0))
        assert len(fitted.losses) == rounds
        tracker = spark.sparkContext.statusTracker()
        stages.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"boosting-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages[1] - stages[0] <= 10 * 3


@pytest.mark.parametrize("direct", [0, 8 << 20])
def test_sums_of_many_tasks(spark, monkeypatch, direct):
    """The same losses from one task and from several, whose sums come to the driver directly or in groups."""
    draw = np.random.default_rng(7)
    x = draw.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] + draw.normal(size=600) > 0).astype(int)
    df = frame(spark, x).join(spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "row_id long, label int"), "row_id")
    fit = lambda: [v for _, v in boosting.fit(df.where("row_id < 400"), df.where("row_id >= 400"), list("abc"), boosting.Settings(rounds=6, rate=0.2, depth=3, least_weight=1.0)).losses]
    one = fit()
    monkeypatch.setattr(boosting, "TASK_ROWS", 40)
    monkeypatch.setattr(boosting, "DIRECT", direct)
    assert fit() == pytest.approx(one, rel=1e-9)


def test_large_ensembles_are_scored_without_python(spark):
    """A hundred trees of depth four, over columns and over a vector: the margins of plain arrays, and no Python in the plan."""
    draw, nodes, names = np.random.default_rng(8), [], list("abcdef")
    for t in range(100):
        nodes += [ensemble.Node(t, k, 2 * k + 1, 2 * k + 2, str(draw.choice(names)), float(draw.normal()), bool(draw.integers(2)), None, 1.0) for k in range(15)]
        nodes += [ensemble.Node(t, k, None, None, None, None, None, float(draw.normal())) for k in range(15, 31)]
    model = ensemble.Ensemble(nodes, 0.2)
    x = draw.normal(size=(50, 6))
    x[draw.random(x.shape) < 0.2] = np.nan
    df = frame(spark, x)
    wide = df.select("row_id", *[F.col("vector")[k].alias(n) for k, n in enumerate(names)])
    want = ensemble.margins(x, ensemble.arrays(model, names), 0.2)
    for found in (ensemble.scored(wide, model).select("row_id", "margin"), df.select("row_id", ensemble.vector_margin_column(model, names).alias("margin"))):
        assert [r.margin for r in found.orderBy("row_id").collect()] == pytest.approx(want)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(4)
    x, q = draw.normal(size=(200, 3)), draw.normal(size=(9, 3))
    table = lambda v: spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(v)], "id long, vector array<double>").repartition(5)
    ref, asked = table(x), table(q)
    d = np.sqrt(((x[None] - q[:, None]) ** 2).sum(2))
    got = sorted((r.query, r.place, r.id) for r in neighbours.nearest(ref, asked, 4, block=4).collect())
    assert got == [(a, k + 1, int(i)) for a in range(9) for k, i in enumerate(np.argsort(d[a], kind="stable")[:4])]
    cov = np.zeros((3, 3))
    for r in neighbours.covariance(ref).collect():
        cov[r.i, r.j] = r.covariance
    assert cov == pytest.approx(np.cov(x, rowvar=False))
    inverse = np.linalg.pinv(cov + np.eye(3) * 1e-6)
    assert {r.query: r.distance for r in neighbours.mahalanobis(ref, asked).collect()} == pytest.approx({k: math.sqrt(v @ inverse @ v) for k, v in enumerate(q)})
    k = 6
    inner = np.sqrt(((x[None] - x[:, None]) ** 2).sum(2))
    np.fill_diagonal(inner, np.inf)
    near = np.argsort(inner, 1)[:, :k]
    reach = np.sort(inner, 1)[:, k - 1]
    density = np.array([1 / (np.mean(np.maximum(reach[near[i]], inner[i, near[i]])) + 1e-10) for i in range(200)])
    want = {}
    for a in range(9):
        own = np.argsort(d[a], kind="stable")[:k]
        want[a] = -np.mean(density[own]) * (np.mean(np.maximum(reach[own], d[a, own])) + 1e-10)
    assert {r.query: r.lof_score for r in neighbours.lof(ref, asked, k).collect()} == pytest.approx(want)
    assert neighbours.lof(ref.where("id < 2"), asked).first().lof_score is None


@pytest.mark.parametrize(("pivots", "block"), [(1, 7), (6, 3), (40, 2048)])
def test_joins_by_pivots_against_brute_force(spark, pivots, block):
    """All rows as queries, a third of them equal, ties, and rows that lack a coordinate."""
    draw = np.random.default_rng(pivots)
    x = np.round(np.vstack([draw.normal(size=(60, 2)), draw.normal(size=(30, 2)) * 0.1 + 4, np.tile([0.5, -0.5], (40, 1)), draw.integers(0, 3, (30, 2))]), 2)
    x[7, 1] = np.nan
    df = frame(spark, x).select(F.col("row_id").alias("id"), "vector").repartition(6)
    d = np.sqrt(((x[None] - x[:, None]) ** 2).sum(2))
    for exclude in (True, False):
        got = sorted((r.query, r.place, r.id) for r in neighbours.nearest(df, df, 5, exclude_self=exclude, block=block, pivots=pivots).collect())
        want = [(a, k + 1, b) for a in range(len(x)) if a != 7 for k, b in enumerate(sorted((b for b in range(len(x)) if b != 7 and not (exclude and a == b)), key=lambda b: (d[a, b], b))[:5])]
        assert got == want


def test_pivots_spare_rows(spark):
    """Of clusters far apart, rows are sent to the cells of their own cluster only."""
    x = np.vstack([np.random.default_rng(k).normal(size=(50, 2)) + 1000 * k for k in range(8)])
    df = frame(spark, x).select(F.col("row_id").alias("id"), "vector")
    sent, plain = [], neighbours.streamed
    try:
        neighbours.streamed = lambda asked, rows, *a: sent.append((asked.select("group").distinct().count(), rows.count())) or plain(asked, rows, *a)
        assert neighbours.nearest(df, df, 3, exclude_self=True, pivots=64).count() == 1200
    finally:
        neighbours.streamed = plain
    (groups, rows), = sent
    assert groups > 8 and rows < 400 * groups / 4


@pytest.mark.parametrize("block", [2, 9, 2048])
def test_knn_imputation_against_brute_force(spark, block):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(60, 4)) * [1, 10, 5, 1]
    x[draw.random(x.shape) < 0.25] = np.nan
    x[:, 3] = np.nan
    x[40:] = x[:20]  # equal queries are asked once
    df = frame(spark, x).select(F.col("row_id").alias("id"), "vector")
    got = {r.id: r.vector for r in neighbours.knn_imputed(df, df, 4, 3, block=block).collect()}
    assert len(got) == 60
    fill = np.array([np.nanmedian(c) if not np.isnan(c).all() else 0.0 for c in x.T])
    whole = np.where(np.isnan(x), fill, x)
    z = (x - whole.mean(0)) / np.where(whole.std(0) == 0, 1, whole.std(0))
    for i in range(60):
        gap = z - z[i]
        n = (~np.isnan(gap)).sum(1)
        d = np.where(n > 0, np.sqrt(np.nansum(gap**2, 1) * 4 / np.maximum(n, 1)), np.inf)
        for j in np.flatnonzero(np.isnan(x[i])):
            can = [k for k in range(60) if not np.isnan(x[k, j]) and np.isfinite(d[k])]
            near = sorted(can, key=lambda k: (d[k], k))[:3]
            assert got[i][j] == pytest.approx(np.mean(x[near, j]) if near else fill[j])


def test_fill_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), ("b", None)], "feature string, value double")
    assert {r.feature: r.fill for r in impute.fill_values(df, "mean").collect()} == {"a": 2.5, "b": 0.0}
    assert [r.value for r in impute.imputed(df, impute.fill_values(df)).orderBy("feature", "value").collect()] == [1.0, 2.5, 4.0, 0.0]
    with pytest.raises(ValueError, match="mode"):
        impute.fill_values(df, "mode")


CUT = 0.55
SPACE = search.Space(FEATURES, [0.0] * 10, [90.0] * 5 + [4.0] * 5, set(FEATURES[:5]))


@pytest.fixture(scope="module")
def explained(spark):
    x = rows_of(8, 80)
    p = 1 / (1 + np.exp(-ensemble.margins(x, ensemble.arrays(TOY, FEATURES), TOY.base_margin)))
    keep = np.flatnonzero(p >= CUT)
    df = frame(spark, x).where(F.col("row_id").isin([int(k) for k in keep])).withColumn("search", F.when(F.col("row_id") % 3 == 0, F.array(F.lit(FEATURES[0]), F.lit(FEATURES[1]))))
    return x, df, keep


def check(x, row_id, cf, target=0, flipped=True):
    before, after = x[row_id], np.array([math.nan if v is None else v for v in cf])
    assert (np.isnan(before) == np.isnan(after)).all()
    changed = {k for k in range(10) if not np.isnan(before[k]) and before[k] != after[k]}
    assert changed <= ({0, 1} if row_id % 3 == 0 else set(range(5)))
    assert all(0 <= after[k] <= 90 for k in changed)
    m = ensemble.margins(after[None], ensemble.arrays(TOY, FEATURES), TOY.base_margin)[0]
    if flipped:
        assert 1 / (1 + math.exp(-m)) < CUT
    return sum(abs(before[k] - after[k]) / 90 for k in changed)


def test_exact_is_never_farther_than_the_others(spark, explained):
    x, df, keep = explained
    beam = {r.row_id: r for r in search.beam(df, TOY, SPACE, CUT, steps=3, width=30).collect()}
    exact = {r.row_id: r for r in search.exact(df, TOY, SPACE, CUT, costs=search.Costs(sparsity=0.0, gap=0.0)).collect()}
    genes = search.genetic(df, TOY, SPACE, CUT, genes=search.Genes(generations=2, population=24)).collect()
    assert set(beam) == set(exact) == {int(k) for k in keep}
    assert all(r.proven for r in exact.values())
    best = {}
    for k, r in exact.items():
        if r.cf_rank:
            best[k] = check(x, k, r.counterfactual)
            assert best[k] == pytest.approx(r.cost)
    for k, r in beam.items():
        d = check(x, k, r.counterfactual, flipped=r.found)
        assert d == pytest.approx(r.distance)
        if r.found:
            assert best[k] <= d + 1e-9
    for r in genes:
        assert best[r.row_id] <= check(x, r.row_id, r.counterfactual) + 1e-9
    assert len({(r.row_id, r.cf_rank) for r in genes}) == len(genes)


def test_genetic_shuffles_rows_once(spark, explained):
    """No join and one shuffle in all generations, also of rows that come grouped by id; and work for every core."""
    _, df, _ = explained
    spark.catalog.clearCache()
    grouped = df.groupBy("row_id").agg(F.first("vector").alias("vector"), F.first("search").alias("search"))
    found = search.genetic(grouped, TOY, SPACE, CUT, genes=search.Genes(generations=3, population=12))
    assert found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(row_id") == 2, plan
    assert found.rdd.getNumPartitions() >= 8


def test_genetic_names_rows_without_a_counterfactual(spark, explained):
    _, df, keep = explained
    fixed = df.withColumn("search", F.when(F.col("row_id") == int(keep[0]), F.array().cast("array<string>")).otherwise(F.col("search")))
    found = search.genetic(fixed, TOY, SPACE, CUT, genes=search.Genes(generations=1, population=8), every_row=True).collect()
    assert {r.row_id for r in found} == {int(k) for k in keep}
    none = [r for r in found if r.cf_rank == 0]
    assert int(keep[0]) in {r.row_id for r in none} and all(r.status == "budget" and r.counterfactual is None for r in none)
    assert all(r.status == "found" and r.counterfactual for r in found if r.cf_rank)


def test_exact_against_a_grid(spark, explained):
    """Every cell of the two free features of a row, tried one by one."""
    x, df, _ = explained
    trees = ensemble.arrays(TOY, FEATURES)
    for r in search.exact(df.where("row_id % 3 = 0"), TOY, SPACE, CUT, costs=search.Costs(sparsity=0.0, gap=0.0)).collect():
        before, best = x[r.row_id], math.inf
        grid = lambda v: [v] if math.isnan(v) else sorted({v, *(t for t in EDGES), *(float(np.nextafter(t, -1)) for t in EDGES)})
        for a in grid(before[0]):
            for b in grid(before[1]):
                after = before.copy()
                after[:2] = a, b
                if ensemble.margins(after[None], trees, TOY.base_margin)[0] <= math.log(CUT / (1 - CUT)) - 1e-5:
                    best = min(best, float(np.nansum(np.abs(after[:2] - before[:2])) / 90))
        assert (r.cost if r.cf_rank else math.inf) == pytest.approx(best)


def test_scale_of_constants(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None), ("b", None)], "feature string, value double")
    got = {r.feature: (r.iqr, r.mad) for r in evaluate.scale_stats(df).collect()}
    assert got == {"a": (1.0, 1.0), "b": (1.0, 1.0)}
    assert {r.feature: r.scale for r in evaluate.feature_scale(df).collect()} == {"a": 1.0, "b": 1.0}
    assert {r.feature: (r.range, r.is_binary) for r in evaluate.feature_ranges(df).collect()} == {"a": (1.0, True), "b": (1.0, True)}
