"""Exact search and set diversity against trying everything."""

import itertools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparrowmill.operators import ensemble, search
from sparrowmill.operators.ensemble import Ensemble, Node, regions
from sparrowmill.plans.tables import FEATURES, TOY

SIDE = 6.0


def problem(seed, trees, depth, features, costs):
    """A random ensemble, a random row, and the boxes of its cells."""
    draw, nodes = np.random.default_rng(seed), []
    for t in range(trees):
        n = 2**depth - 1
        nodes += [Node(t, k, 2 * k + 1, 2 * k + 2, f"f{draw.integers(features)}", float(np.round(draw.normal(), 2)), bool(draw.integers(2)), None, 1.0) for k in range(n)]
        nodes += [Node(t, k, None, None, None, None, None, float(np.round(draw.normal() * 0.1, 3))) for k in range(n, 2 * n + 1)]
    model, names = Ensemble(nodes, 0.1), [f"f{j}" for j in range(features)]
    cuts = {f: sorted({n.threshold for n in nodes if n.feature == f}) for f in names}
    x = {f: float(np.round(draw.normal(), 2)) for f in names}
    cells = {f: search._cells(x[f], cuts[f], -3.0, 3.0, SIDE, costs) for f in names if cuts[f]}
    boxes = search._Boxes(x, list(cells), cells, list(regions(model)), dict.fromkeys(names, SIDE), 1)
    now = np.array([[v for v, _, _ in cells[f]].index(x[f]) for f in cells])
    return boxes, cells, boxes.look(now, now, -1e9)[2] - 0.1 * math.sqrt(trees)


@pytest.mark.parametrize("seed", range(24))
def test_cheapest_cells_against_all(seed):
    """With gaps of 0 each solution is the cheapest that flips, changes enough and lies far enough from those before it."""
    costs = search.Costs(gap=0.0, seconds=None, solutions=3, apart=[0, 0.05, 0.3][seed % 3], least_changed=seed % 4, sparsity=[0.0, 0.05][seed % 2])
    boxes, cells, most = problem(seed, 5, 3, 4, costs)
    found, _ = search._solve(boxes, most, costs)
    flips = []
    for combo in itertools.product(*[range(len(own)) for own in cells.values()]):
        at = np.array(combo)
        if boxes.n_changed(at) >= costs.least_changed and boxes.leaf[((boxes.low <= at) & (at <= boxes.high)).all(1)].sum() <= most:
            flips.append((sum(own[k][1] for own, k in zip(cells.values(), combo, strict=True)), at))
    before = []
    for k in range(3):
        free = [cost for cost, at in flips if all((at != s.cells).any() and (np.abs(boxes.point(at) - boxes.point(s.cells)) / boxes.scale).sum() >= costs.apart for s in before)]
        assert (k < len(found)) == bool(free)
        if free:
            assert found[k].cost == pytest.approx(min(free)) and found[k].status == "optimal"
            before.append(found[k])


@pytest.mark.parametrize("seed", range(3))
def test_large_models_end_with_a_stated_gap(seed):
    """A hundred trees of depth four over ten features: within the gap, whose bound a search with less gap doesn't break."""
    boxes, _, most = problem(seed, 100, 4, 10, search.Costs())
    (near,), _ = search._solve(boxes, most, search.Costs(gap=0.3, seconds=60))
    (best,), _ = search._solve(boxes, most, search.Costs(gap=0.02, seconds=60))
    assert near.gap <= 0.3 and best.gap <= 0.02 and {near.status, best.status} <= {"optimal", "gap"}
    assert near.cost * (1 - near.gap) <= best.cost + 1e-9 <= near.cost + 2e-9


def test_limits_end_the_search():
    boxes, _, most = problem(2, 100, 4, 10, search.Costs())
    found, ended = search._solve(boxes, most, search.Costs(gap=0.0, nodes=3))
    assert ended == "budget" and all(s.status == "budget" and s.gap > 0 for s in found)
    found, ended = search._solve(boxes, most, search.Costs(gap=0.0, seconds=0.0))
    assert ended == "time"
    assert search._solve(boxes, -1e9, search.Costs()) == ([], "infeasible")


def of_set(kernel, cost, rows, weight):
    return -cost[list(rows)].sum() + weight * np.linalg.slogdet(kernel[np.ix_(rows, rows)])[1]


@pytest.mark.parametrize("seed", range(6))
def test_diverse_sets_against_all_subsets(seed):
    """The greedy set is the best of all for two, and close to it for more; each step is the best one."""
    draw = np.random.default_rng(seed)
    x, cost, ranges = draw.normal(size=(10, 3)), draw.random(10) * 0.2, np.array([1.0, 2.0, 0.5])
    x[3, 1] = np.nan
    kernel = search.alikeness(x, ranges)
    picked = search.diverse(x, cost, ranges, 4, 1.0)
    for size in range(1, 5):
        step = max(of_set(kernel, cost, [*picked[: size - 1], k], 1.0) for k in range(10) if k not in picked[: size - 1])
        assert of_set(kernel, cost, picked[:size], 1.0) == pytest.approx(step)
        best = max(of_set(kernel, cost, s, 1.0) for s in itertools.combinations(range(10), size))
        assert of_set(kernel, cost, picked[:size], 1.0) >= best - 0.25
    assert search.diverse(x, cost, ranges, 3, 0.0) == np.argsort(cost)[:3].tolist()


def test_equal_candidates_come_last():
    x = np.array([[0.0], [0.0], [5.0]])
    assert search.diverse(x, np.array([0.0, 0.0, 0.4]), np.array([1.0]), 3, 1.0) == [0, 2, 1]


def projected(value, low, high, least, most, may, allow):
    """(ok, value): a missing value may only stay missing, a fixed one only where it fits, others go to the nearest end."""
    if value is None:
        return allow, None
    if not may:
        return low <= value <= high, value
    floor, ceiling = max(low, least), min(high, most)
    return floor <= ceiling, min(max(value, floor), ceiling)


def plain_beam(x, may, facets, score, space, threshold, steps, width):
    """One row's beam in plain lists: (found, proba, distance, facets used)."""
    ranges = space.ranges()
    start = ((), [-math.inf] * len(x), [math.inf] * len(x), [True] * len(x), x, score(x), 0.0)
    states, best = [start], start
    towards = lambda s: 1 - s[5]
    for _ in range(steps):
        tried = {}
        for used, lower, upper, allow, *_ in states:
            for tree, leaf, low, high, ok in facets:
                if tree in {t for t, _ in used}:
                    continue
                a, b, m = [max(p) for p in zip(lower, low, strict=True)], [min(p) for p in zip(upper, high, strict=True)], [p and q for p, q in zip(allow, ok, strict=True)]
                moved = [projected(x[j], a[j], b[j], space.least[j], space.most[j], may[j], m[j]) if a[j] > -math.inf or b[j] < math.inf or not m[j] else (True, x[j]) for j in range(len(x))]
                if all(fits for fits, _ in moved):
                    vector = [v for _, v in moved]
                    d = sum(abs(v - w) / r for v, w, r in zip(vector, x, ranges, strict=True) if w is not None)
                    tried[tuple(sorted((*used, (tree, leaf))))] = (tuple(sorted((*used, (tree, leaf)))), a, b, m, vector, score(vector), d)
        flipped = [s for s in tried.values() if s[5] < threshold]
        if flipped:
            best = min(flipped, key=lambda s: (s[6], len(s[0]), s[0]))
            return True, best[5], best[6], len(best[0])
        states = sorted(tried.values(), key=lambda s: (-towards(s), s[6], len(s[0]), s[0]))[:width]
        if not states:
            break
        top = max(states, key=lambda s: (towards(s), -s[6]))
        best = top if (towards(top), -top[6]) > (towards(best), -best[6]) else best
    return False, best[5], best[6], len(best[0])


@pytest.mark.parametrize(("steps", "width", "threshold"), [(3, 4, 0.5), (2, 30, 0.42), (4, 2, 0.46)])
def test_beam_against_a_plain_beam(spark, steps, width, threshold):
    draw = np.random.default_rng(steps)
    rows = [[None if draw.random() < 0.2 else float(round(v, 1)) for v in (*draw.uniform(0, 90, 5), *draw.integers(0, 5, 5))] for _ in range(14)]
    names = [None if k % 2 else FEATURES[: 2 + k % 4] for k in range(14)]
    space = search.Space(FEATURES, [0.0] * 10, [90.0] * 5 + [4.0] * 5, set(FEATURES[:5]))
    df = spark.createDataFrame([(k, v, s) for k, (v, s) in enumerate(zip(rows, names, strict=True))], "row_id long, vector array<double>, search array<string>")
    trees = ensemble.arrays(TOY, FEATURES)
    score = lambda v: float(1 / (1 + np.exp(-ensemble.margins(np.array([v], float), trees, TOY.base_margin)[0])))
    facets = [tuple(r) for r in search.facets(spark, TOY, FEATURES, 0).collect()]
    got = {r.row_id: r for r in search.beam(df, TOY, space, threshold, steps=steps, width=width).select("row_id", "found", "proba", "distance", "n_facets", F.size("counterfactual").alias("n")).collect()}
    for k, x in enumerate(rows):
        may = [f in space.mutable and (names[k] is None or f in names[k]) for f in FEATURES]
        found, proba, d, n = plain_beam(x, may, facets, score, space, threshold, steps, width)
        assert (got[k].found, got[k].n_facets, got[k].n) == (found, n, 10)
        assert (got[k].proba, got[k].distance) == pytest.approx((proba, d))
