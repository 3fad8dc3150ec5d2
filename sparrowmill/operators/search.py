"""Counterfactual search: a changed row, near the original, that the model predicts otherwise.

Rows to explain are (row_id, vector, search), a vector of the model's features with null for missing values, and search, the names
of the features that may change (null: all of `Space.mutable`). Rows are independent of each other.

- `beam` and `genetic` are loops of Spark steps over tables of candidates: candidates of all rows are expanded, scored and ranked
  together. The survivors of each step of `beam` are checkpointed; those of `genetic` stay with their row, which is shuffled once.
- `exact` finds the nearest counterfactuals of a row by branch and bound over boxes of cells between the model's thresholds, a small helper
  for each row in pandas tasks. It ends with a proven answer or one within the gap that is asked for, or with the gap that was
  left when its time or nodes ran out.

Missing values stay missing in all of them. Rows for which nothing is found are in the result with their reason, those of
`genetic` if asked for with `every_row`.
"""

from __future__ import annotations

import heapq
import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.staging import cut
from .ensemble import Ensemble, Region, leaf_join_scores, regions, vector_margin_column

INFINITY = float("inf")
#: Generations in one plan.
UNCUT = 8
#: Of so many open boxes, one is followed down to a solution.
DIVE = 32


@dataclass
class Space:
    """The model's features, their learned range, which may change, and which are binary."""

    features: list[str]
    least: list[float | None]
    most: list[float | None]
    mutable: set[str]
    binary: set[str] = field(default_factory=set)

    @classmethod
    def learn(cls, ranges: DataFrame, features: Sequence[str], mutable: set[str]) -> Space:
        """From (feature, least, most, is_binary), one row a feature."""
        rows = {r["feature"]: r for r in ranges.collect()}
        have = lambda f, c: rows[f][c] if f in rows else None
        return cls(list(features), [have(f, "least") for f in features], [have(f, "most") for f in features], mutable, {f for f in features if have(f, "is_binary")})

    def ranges(self) -> list[float]:
        return [b - a if a is not None and b is not None and b > a else 1.0 for a, b in zip(self.least, self.most, strict=True)]


def _doubles(values: Sequence[float | None]) -> Column:
    return F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in values])


def distance(before: Column, after: Column, ranges: Sequence[float]) -> Column:
    """Sum of shifts over ranges; missing values add nothing."""
    terms = F.zip_with(F.zip_with(before, after, lambda a, b: F.abs(b - a)), _doubles(ranges), lambda d, r: F.coalesce(d / r, F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _may_change(space: Space) -> Column:
    """array<boolean> by feature, from the row's own search list."""
    own = F.transform(F.array(*[F.lit(f) for f in space.features]), lambda f: F.coalesce(F.array_contains("search", f), F.lit(True)))
    return F.zip_with(own, F.array(*[F.lit(f in space.mutable) for f in space.features]), lambda a, b: a & b)


def facets(spark: SparkSession, ensemble: Ensemble, features: Sequence[str], target: int, per_tree: int = 3, total: int = 400) -> DataFrame:
    """(tree, leaf, lower, upper, allow): arrays by feature; the leaves that push most towards the target, both ends closed."""
    rank = sorted(regions(ensemble), key=lambda r: ((-1 if target else 1) * r.value, r.tree, r.leaf))
    taken: dict[int, int] = {}
    rows = []
    for r in rank:
        taken[r.tree] = taken.get(r.tree, 0) + 1
        if taken[r.tree] <= per_tree and len(rows) < total:
            get = [r.bounds.get(f, (-math.inf, math.inf, True)) for f in features]
            rows.append((r.tree, r.leaf, [a for a, _, _ in get], [b if math.isinf(b) else float(np.nextafter(b, -math.inf)) for _, b, _ in get], [m for _, _, m in get]))
    return spark.createDataFrame(rows, "tree int, leaf int, lower array<double>, upper array<double>, allow array<boolean>")


def beam(rows: DataFrame, ensemble: Ensemble, space: Space, threshold: float, target: int = 0, steps: int = 8, width: int = 20, per_tree: int = 3, total: int = 400) -> DataFrame:
    """(row_id, vector, counterfactual, proba_factual, proba, distance, n_facets, found).

    A state is a set of leaf regions, at most one of each tree, and the projection of the original row into their intersection.
    Each step adds a region to every state; as soon as some state of a row flips, the nearest one is the row's answer, else the
    `width` best states go on. Without a flip the best state seen is returned with found = false.
    """
    spark = rows.sparkSession
    score = lambda v: scalars.sigmoid(vector_margin_column(ensemble, space.features, v))
    towards = lambda p: p if target == 1 else 1 - p
    every = facets(spark, ensemble, space.features, target, per_tree, total).agg(F.collect_list(F.struct("tree", "leaf", "lower", "upper", "allow"))).first()[0]  # at most `total`
    listed = spark.createDataFrame([(every,)], "f array<struct<tree:int,leaf:int,lower:array<double>,upper:array<double>,allow:array<boolean>>>")
    k = len(space.features)
    start = rows.select("row_id", F.col("vector").alias("original"), _may_change(space).alias("may"))
    start = start.withColumn("proba_factual", score(F.col("original")))
    state = start.select(
        "*", F.array().cast("array<struct<tree:int,leaf:int>>").alias("used"), F.array_repeat(F.lit(-INFINITY), k).alias("lower"), F.array_repeat(F.lit(INFINITY), k).alias("upper"),
        F.array_repeat(F.lit(True), k).alias("allow"), F.col("original").alias("vector"), F.col("proba_factual").alias("proba"), F.lit(0.0).alias("distance"),
    )
    state = cut(state)
    answer = F.struct(towards(F.col("proba")).alias("t"), F.col("vector"), F.col("proba"), F.col("distance"), F.size("used").alias("n"))
    done: DataFrame | None = None
    best = state.select("row_id", F.struct(F.lit(0.0).alias("a"), "vector", "proba", "distance", F.size("used").alias("n")).alias("s"), towards(F.col("proba")).alias("t"))
    for _ in range(steps):
        tried = state.withColumn("f", F.explode(listed.select("f").scalar())).where(~F.exists("used", lambda u: u["tree"] == F.col("f.tree")))
        merged = tried.withColumns(
            {
                "used": F.array_sort(F.concat("used", F.array(F.struct(F.col("f.tree").alias("tree"), F.col("f.leaf").alias("leaf"))))),
                "lower": F.zip_with("lower", "f.lower", lambda a, b: F.greatest(a, b)),
                "upper": F.zip_with("upper", "f.upper", lambda a, b: F.least(a, b)),
                "allow": F.zip_with("allow", "f.allow", lambda a, b: a & b),
            }
        ).drop("f")
        # a region set is reached in any order, with the same intersection and projection
        merged = merged.dropDuplicates(["row_id", "used"])
        least, most, binary = _doubles(space.least), _doubles(space.most), F.array(*[F.lit(f in space.binary) for f in space.features])
        bound = F.zip_with("lower", "upper", lambda a, b: (a > -INFINITY) | (b < INFINITY))
        put = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda j: F.when(bound[j] | ~F.col("allow")[j], scalars.projected(F.col("original")[j], F.col("lower")[j], F.col("upper")[j], least[j], most[j], F.col("may")[j], binary[j], F.col("allow")[j])).otherwise(
                F.struct(F.lit(True).alias("ok"), F.col("original")[j].alias("value"))
            ),
        )
        moved = merged.withColumn("put", put).where(F.forall("put", lambda p: p["ok"])).withColumn("vector", F.col("put.value")).drop("put")
        moved = moved.withColumn("proba", score(F.col("vector"))).withColumn("distance", distance(F.col("original"), F.col("vector"), space.ranges()))
        moved = cut(moved)
        flipped = moved.where((F.col("proba") >= threshold).cast("int") == target)
        found = flipped.groupBy("row_id").agg(F.min_by(answer, F.struct("distance", F.size("used"), "used")).alias("s"))
        done = found if done is None else done.unionByName(found)
        order = Window.partitionBy("row_id").orderBy(F.desc(towards(F.col("proba"))), "distance", F.size("used"), "used")
        rest = moved.join(found.select("row_id"), "row_id", "left_anti")
        state = cut(rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width).drop("place"))
        tops = state.groupBy("row_id").agg(F.max_by(F.struct(F.lit(0.0).alias("a"), "vector", "proba", "distance", F.size("used").alias("n")), F.struct(towards(F.col("proba")), -F.col("distance"))).alias("s"), F.max(towards(F.col("proba"))).alias("t"))
        both = best.join(tops.select("row_id", F.col("s").alias("s2"), F.col("t").alias("t2")), "row_id", "left")
        better = F.coalesce(F.struct(F.col("t2"), -F.col("s2.distance")) > F.struct(F.col("t"), -F.col("s.distance")), F.lit(False)) & F.col("t2").isNotNull()
        best = cut(both.select("row_id", F.when(better, F.col("s2")).otherwise(F.col("s")).alias("s"), F.when(better, F.col("t2")).otherwise(F.col("t")).alias("t")))
        if state.isEmpty():
            break
    done = done.repartition("row_id").select("row_id", F.col("s").alias("d"))  # a union's partitioning isn't to be relied on
    out = start.join(best.select("row_id", "s"), "row_id").join(done, "row_id", "left")
    pick = lambda c: F.when(F.col("d").isNotNull(), F.col(f"d.{c}")).otherwise(F.col(f"s.{c}"))
    return out.select("row_id", F.col("original").alias("vector"), pick("vector").alias("counterfactual"), "proba_factual", pick("proba").alias("proba"), pick("distance").alias("distance"), pick("n").alias("n_facets"), F.col("d").isNotNull().alias("found"))


@dataclass(frozen=True)
class Genes:
    total: int = 8
    population: int = 48
    generations: int = 8
    keep: float = 0.5
    mutate: float = 0.15
    proximity: float = 0.5
    sparsity: float = 0.2
    diversity: float = 1.0
    seed: int = 17


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def alikeness(x: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """1 / (1 + distance) for all pairs of rows; distance is the sum of shifts over ranges, missing values add nothing."""
    return 1 / (1 + (np.nan_to_num(np.abs(x[:, None] - x[None])) / ranges).sum(2))


def diverse(x: np.ndarray, cost: np.ndarray, ranges: np.ndarray, total: int, weight: float) -> list[int]:
    """Rows chosen one by one, each the best for the sum of -cost plus weight times the log determinant of the chosen rows' alikeness.

    That is the greedy choice in a determinantal point process. What a row adds to the log determinant is the log of what the chosen rows
    leave over of it, kept up to date by one Cholesky column a step; ties go to the earlier row, rows equal to a chosen one come last.
    """
    kernel = alikeness(x, ranges)
    left, columns, out = np.ones(len(x)), np.zeros((len(x), 0)), []
    for _ in range(min(total, len(x))):
        score = -cost + weight * np.log(np.maximum(left, 1e-12))
        score[out] = -np.inf
        best = int(np.argmax(score))
        column = (kernel[:, best] - columns @ columns[best]) / math.sqrt(max(left[best], 1e-12))
        columns, left = np.hstack([columns, column[:, None]]), left - column**2
        out.append(best)
    return out


def genetic(rows: DataFrame, ensemble: Ensemble, space: Space, threshold: float, target: int = 0, genes: Genes = Genes(), every_row: bool = False) -> DataFrame:  # noqa: B008
    """(row_id, cf_rank, vector, counterfactual, proba_factual, proba, distance, n_changed, status): up to `total` distinct valid ones a row.

    Rows are shuffled once. After that a row holds its population as an array; each generation takes the better half of it, explodes the children, which
    cross two of that half and mutate, scores them and groups them by row again, in the partition they are in. Of equal members the earliest stays. Cost is how far the prediction is
    from flipping, plus weighed proximity and sparsity. Of the last generation's valid members a set is chosen in which each is near and the set is
    diverse, see `diverse`. With `every_row`, a row without any
    has cf_rank 0 and the status `budget`: the generations ended, nothing is proven; else it isn't in the result. All draws are hashes of row, member, generation and feature, so reruns agree.
    """
    score = lambda v: scalars.sigmoid(vector_margin_column(ensemble, space.features, v))
    least, most, ranges, k = _doubles(space.least), _doubles(space.most), space.ranges(), len(space.features)
    binary = F.array(*[F.lit(f in space.binary) for f in space.features])
    spark = rows.sparkSession
    # a number, as populations are larger than the rows they grow from, by whose size Spark would merge partitions; not the session's, at which it leaves out the shuffle of rows that it has grouped by id
    parts = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    start = rows.select("row_id", F.col("vector").alias("original"), _may_change(space).alias("may")).withColumn("proba_factual", score(F.col("original"))).repartition(parts, "row_id")
    places = F.sequence(F.lit(0), F.lit(k - 1))

    def drawn(generation: int, j: Column) -> Column:
        value = least[j] + _uniform(F.lit(genes.seed), F.col("row_id"), F.col("member"), F.lit(generation), j, F.lit(1)) * (most[j] - least[j])
        return F.when(binary[j], F.round(value)).otherwise(value)

    def changeable(j: Column) -> Column:
        return F.col("may")[j] & F.col("original")[j].isNotNull() & least[j].isNotNull() & (least[j] < most[j])

    def costed(df: DataFrame) -> DataFrame:
        df = df.withColumn("proba", score(F.col("vector"))).withColumn("distance", distance(F.col("original"), F.col("vector"), ranges))
        n = F.size(F.filter(F.zip_with("original", "vector", lambda a, b: ~scalars.close(a, b)), lambda x: x))
        df = df.withColumn("n_changed", n)
        gap = F.greatest(F.lit(0.0), F.col("proba") - F.lit(threshold) if target == 0 else F.lit(threshold) - F.col("proba"))
        wrong = F.when((F.col("proba") >= threshold).cast("int") != target, 1 + gap).otherwise(F.lit(0.0))
        return df.withColumn("wrong", wrong).withColumn("cost", 10 * wrong + genes.proximity * F.col("distance") / k + genes.sparsity * F.col("n_changed") / k)

    own = ("original", "may", "proba_factual")
    scored = ("cost", "member", "vector", "proba", "distance", "n_changed", "wrong")  # in this order: least cost, then least member

    def gathered(df: DataFrame) -> DataFrame:
        """A row for each row_id again, with its valid scored members as an array."""
        return costed(df).groupBy("row_id").agg(*[F.first(c).alias(c) for c in own], F.first("parents", ignorenulls=True).alias("parents"), F.collect_list(F.when(F.col("valid"), F.struct(*scored))).alias("people"))

    share = F.col("member") / F.lit(float(genes.population))  # from few changes to many
    first = start.withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(genes.population)))).withColumns({"valid": F.lit(True), "parents": F.lit(None).cast("array<int>")})
    first = first.withColumn("vector", F.transform(places, lambda j: F.when(changeable(j) & (_uniform(F.lit(genes.seed), F.col("row_id"), F.col("member"), j) < share), drawn(0, j)).otherwise(F.col("original")[j])))
    people = gathered(first).withColumn("people", F.sort_array("people"))
    half = max(2, int(genes.population * genes.keep))
    for generation in range(1, genes.generations + 1):
        pick = lambda n, m: (F.floor(_uniform(F.lit(genes.seed), F.col("row_id"), m, F.lit(generation), F.lit(n)) * half) + 1).cast("int")  # noqa: E731, B023
        born = F.sequence(F.lit(generation * genes.population + 1), F.lit((generation + 1) * genes.population - half))
        parent = lambda n, m: F.get(F.col("parents"), pick(n, m) - 1)["vector"]  # noqa: E731, B023
        couple = lambda m, i: F.struct(m.alias("member"), parent(-1, m).alias("of_a"), parent(-2, m).alias("of_b"), F.when(i == 0, F.col("parents")).alias("parents"))  # noqa: E731, B023
        children = people.select("row_id", *own, F.slice("people", 1, half).alias("parents")).select("row_id", *own, F.inline(F.transform(born, couple)))
        children = children.withColumn("valid", F.col("of_a").isNotNull() & F.col("of_b").isNotNull())  # ranks that a small population lacks have no children
        coin = lambda j, n: _uniform(F.lit(genes.seed), F.col("row_id"), F.col("member"), F.lit(generation), j, F.lit(n))  # noqa: E731, B023
        crossed = F.transform(places, lambda j: F.when(changeable(j) & (coin(j, 2) < genes.mutate), drawn(generation, j)).when(changeable(j) & (coin(j, 3) < genes.mutate), F.col("original")[j]).when(coin(j, 4) < 0.5, F.col("of_a")[j]).otherwise(F.col("of_b")[j]))  # noqa: B023
        children = children.withColumn("vector", F.when(F.col("valid"), crossed).otherwise(F.col("original"))).drop("of_a", "of_b")
        # equal vectors have equal costs, so they lie side by side in the order of cost and vector
        keyed = F.transform(F.concat("parents", "people"), lambda p: F.struct(p["cost"].alias("cost"), p["vector"].alias("vector"), p["member"].alias("member"), p.alias("p")))
        people = gathered(children).withColumn("people", F.sort_array(keyed)).drop("parents")
        apart = F.filter("people", lambda p, i: (i == 0) | ~p["vector"].eqNullSafe(F.get(F.col("people"), i - 1)["vector"]))
        people = people.withColumn("people", F.sort_array(F.transform(apart, lambda p: p["p"])))
        if generation % UNCUT == 0 and generation < genes.generations:
            people = cut(people)

    @F.pandas_udf("array<int>")
    def set_of(vectors: pd.Series, costs: pd.Series) -> pd.Series:  # of a row at most a population
        return pd.Series([diverse(np.asarray(x, dtype=float).reshape(len(c), k), np.asarray(c), np.array(ranges), genes.total, genes.diversity) for x, c in zip(vectors, costs, strict=True)])

    found = people.select("row_id", "original", "proba_factual", F.filter("people", lambda p: p["wrong"] == 0).alias("people"))
    found = found.withColumn("chosen", set_of(F.flatten(F.transform("people", lambda p: p["vector"])), F.transform("people", lambda p: p["cost"])))
    chosen = F.transform("chosen", lambda i: F.get(F.col("people"), i))
    found = found.select("row_id", F.col("original").alias("vector"), "proba_factual", (F.posexplode_outer if every_row else F.posexplode)(chosen).alias("place", "p"))
    rank, status = F.coalesce(F.col("place") + 1, F.lit(0)), F.when(F.col("place").isNull(), F.lit("budget")).otherwise(F.lit("found"))
    return found.select("row_id", rank.alias("cf_rank"), "vector", F.col("p.vector").alias("counterfactual"), "proba_factual", F.col("p.proba").alias("proba"), F.col("p.distance").alias("distance"), F.col("p.n_changed").alias("n_changed"), status.alias("status"))


@dataclass(frozen=True)
class Costs:
    """Weights and limits of the exact search.

    `gap` ends the search for a solution once its cost is within that share of the bound; `seconds` and `nodes` end it for the row, with the
    gap reported. Solutions after the first lie at least `apart` (shifts over scale, added up) from all earlier ones.
    """

    proximity: float = 1.0
    sparsity: float = 0.05
    solutions: int = 1
    least_changed: int = 0
    gap: float = 0.02
    seconds: float | None = 180.0
    nodes: int | None = None
    apart: float = 1e-3
    slack: float = 1e-5


def _cells(value: float, cuts: list[float], low: float, high: float, scale: float, costs: Costs) -> list[tuple[float, float, int]]:
    """(value, cost, changed) of the nearest value of each cell between cuts within [low, high], by value.

    A step across a cut next to the value is too small to count as a change, but it's taken: the other cell's value stays on its side.
    """
    edges = [low, *[c for c in cuts if low < c <= high]]
    out = []
    for k, a in enumerate(edges):
        b = float(np.nextafter(edges[k + 1], -math.inf)) if k + 1 < len(edges) else high
        v = min(max(value, a), b)
        changed = int(abs(v - value) > scalars.SOLVER_TOLERANCE)
        out.append((v, costs.proximity * abs(v - value) / scale + costs.sparsity * changed, changed))
    if not low <= value <= high:
        out.append((value, 0.0, 0))  # staying outside the learned range is allowed
    return sorted(out)


class _Boxes:
    """A row's cells by feature, and what boxes of them, ranges of cells of each feature, can reach in the trees.

    A leaf is kept as the range of cells of each feature that it takes in, so bounds over all leaves are a few array steps.
    """

    def __init__(self, x: dict[str, float | None], free: list[str], cells: dict[str, list[tuple[float, float, int]]], leaves: list[Region], scale: dict[str, float], sign: int):
        self.values = [np.array([v for v, _, _ in cells[f]]) for f in free]
        self.changed = [np.array([c for _, _, c in cells[f]]) for f in free]
        self.scale = np.array([scale[f] for f in free])
        width = max((len(v) for v in self.values), default=1)
        # of each feature, the least cost and its cell for every range of cells
        self.cheapest = np.full((len(free), width, width), np.inf)
        self.cell = np.zeros((len(free), width, width), np.int64)
        for j, f in enumerate(free):
            cost = np.array([c for _, c, _ in cells[f]])
            for a in range(len(cost)):
                self.cheapest[j, a, a:len(cost)] = np.minimum.accumulate(cost[a:])
                at = np.arange(a, len(cost))
                self.cell[j, a, a:len(cost)] = np.maximum.accumulate(np.where(cost[a:] <= np.minimum.accumulate(cost[a:]), at, a))
        self.own = np.arange(len(free))
        low, high, tree, leaf = [], [], [], []
        for r in leaves:
            fixed = all((m if x[f] is None else a <= x[f] < b) for f, (a, b, m) in r.bounds.items() if f not in cells)
            ends = [(np.searchsorted(v, a), np.searchsorted(v, b) - 1) for f, v in zip(free, self.values, strict=True) for a, b, _ in [r.bounds.get(f, (-math.inf, math.inf, True))]]
            if fixed and all(a <= b for a, b in ends):
                low.append([a for a, _ in ends])
                high.append([b for _, b in ends])
                tree.append(r.tree)
                leaf.append(sign * r.value)
        order = np.lexsort((leaf, tree))
        self.low, self.high = (np.array(e, np.int64).reshape(len(leaf), len(free))[order] for e in (low, high))
        self.leaf, self.tree = np.array(leaf, float)[order], np.array(tree)[order]
        self.first = np.flatnonzero(np.concatenate([[True], self.tree[1:] != self.tree[:-1]])) if len(order) else np.zeros(0, np.int64)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(self.own), np.int64), np.array([len(v) - 1 for v in self.values], np.int64)

    def look(self, low: np.ndarray, high: np.ndarray, most: float) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
        """(bound, cells, margin, leaf and target by tree) of a box: its cheapest cells, their margin, and a bound of the cost of a margin of at most `most`.

        A point of the box that costs C more than the cheapest has, in each tree, a leaf that is entered for C at most. So the
        least C at which the best leaves entered for it add up to `most` is a bound; infinite if none does.
        """
        cells = self.cell[self.own, low, high]
        cost = float(self.cheapest[self.own, low, high].sum())
        a, b = np.maximum(self.low, low), np.minimum(self.high, high)
        open_ = (a <= b).all(1)
        enter = np.full(len(self.leaf), np.inf)
        enter[open_] = np.maximum(self.cheapest[self.own, a[open_], b[open_]].sum(1) - cost, 0.0)
        inside = open_ & ((self.low <= cells) & (cells <= self.high)).all(1)
        here = np.flatnonzero(inside)  # one leaf of each tree
        margin = float(self.leaf[here].sum())
        targets = np.minimum.reduceat(np.where(open_, self.leaf, np.inf), self.first) if len(self.first) else np.zeros(0)
        if margin <= most:
            return cost, cells, margin, here, targets
        if targets.sum() > most:
            return math.inf, cells, margin, here, targets
        now = self.leaf[here][np.searchsorted(self.first, np.arange(len(self.leaf)), side="right") - 1]
        better = np.flatnonzero(open_ & (self.leaf < now))
        better = better[np.lexsort((self.leaf[better], enter[better], self.tree[better]))]
        # of each tree, by cost of entry: how much each leaf is better than the best before it
        tree, value = self.tree[better], self.leaf[better]
        start = np.concatenate([[True], tree[1:] != tree[:-1]])
        group = np.cumsum(start) - 1
        shift = group * (4 * np.abs(self.leaf).max() + 1)  # one running minimum for all trees
        best = np.minimum.accumulate(value - shift) + shift
        before = np.where(start, now[better], np.concatenate([[0.0], best[:-1]]))
        gain = np.maximum(before - best, 0.0)
        order = np.argsort(enter[better], kind="stable")
        reached = int(np.searchsorted(np.cumsum(gain[order]), margin - most - 1e-12))
        return cost + (float(enter[better][order[reached]]) if reached < len(order) else 0.0), cells, margin, here, targets

    def split(self, low: np.ndarray, high: np.ndarray, cells: np.ndarray, here: np.ndarray, targets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Two boxes: in the tree with the most to gain, at the side of the best leaf that lies furthest away."""
        lost = self.leaf[here] - targets
        t = int(np.argmax(lost))
        end = self.first[t + 1] if t + 1 < len(self.first) else len(self.leaf)
        rows = np.arange(self.first[t], end)
        a, b = np.maximum(self.low[rows], low), np.minimum(self.high[rows], high)
        row = rows[np.flatnonzero((a <= b).all(1) & (self.leaf[rows] == targets[t]))[0]]
        a, b = np.maximum(self.low[row], low), np.minimum(self.high[row], high)
        far = np.where((a <= cells) & (cells <= b), -1.0, self.cheapest[self.own, a, b] - self.cheapest[self.own, low, high])
        j = int(np.argmax(far))
        at = a[j] if cells[j] < a[j] else b[j] + 1
        return [part for part in (_with(low, high, j, low[j], at - 1), _with(low, high, j, at, high[j])) if part]

    def around(self, low: np.ndarray, high: np.ndarray, cells: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Boxes that cover the box but for the point: each moves one feature off the point's cell and holds those before it."""
        out, a, b = [], low, high
        for j, at in enumerate(cells):
            out += [part for part in (_with(a, b, j, a[j], at - 1), _with(a, b, j, at + 1, b[j])) if part]
            a, b = _with(a, b, j, at, at)
        return out

    def room(self, low: np.ndarray, high: np.ndarray, point: np.ndarray) -> float:
        """The greatest distance of the box's points from a point of values."""
        ends = [max(abs(v[a] - p), abs(v[b] - p)) for v, a, b, p in zip(self.values, low, high, point, strict=True)]
        return float((np.array(ends) / self.scale).sum())

    def point(self, cells: np.ndarray) -> np.ndarray:
        return np.array([v[k] for v, k in zip(self.values, cells, strict=True)])

    def n_changed(self, cells: np.ndarray) -> int:
        return int(sum(c[k] for c, k in zip(self.changed, cells, strict=True)))

    def most_changed(self, low: np.ndarray, high: np.ndarray) -> int:
        return int(sum(c[a : b + 1].max() for c, a, b in zip(self.changed, low, high, strict=True)))


def _with(low: np.ndarray, high: np.ndarray, j: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray] | None:
    if a > b:
        return None
    low, high = low.copy(), high.copy()
    low[j], high[j] = a, b
    return low, high


@dataclass
class _Solution:
    cost: float
    cells: np.ndarray
    gap: float
    status: str


def _solve(boxes: _Boxes, most: float, costs: Costs) -> tuple[list[_Solution], str]:
    """The cheapest cells whose leaves add up to at most `most`, and why there aren't more: `infeasible`, `time` or `budget`.

    The open box with the least bound is looked at first; its cheapest cells, and a dive from it towards the best leaves, give
    solutions, of which the cheapest closes the gap from above.
    """
    found: list[_Solution] = []
    until = None if costs.seconds is None else time.monotonic() + costs.seconds

    def fits(cells: np.ndarray) -> bool:
        point = boxes.point(cells)
        far = all((cells != s.cells).any() and float((np.abs(point - boxes.point(s.cells)) / boxes.scale).sum()) >= costs.apart for s in found)
        return far and boxes.n_changed(cells) >= costs.least_changed

    best: tuple[float, np.ndarray] | None = None
    queue: list[tuple[float, int, np.ndarray, np.ndarray]] = []
    made = visited = 0

    def keep(cells: np.ndarray) -> None:
        nonlocal best
        cost = boxes.look(cells, cells, most)[0]
        if fits(cells) and (best is None or cost < best[0]):
            best = (cost, cells)

    def looked(low: np.ndarray, high: np.ndarray) -> tuple | None:
        """(bound, low, high, ...) of a box that can hold a solution; its cheapest cells are kept if they are one."""
        bound, cells, margin, here, targets = boxes.look(low, high, most)
        if math.isinf(bound) or boxes.most_changed(low, high) < costs.least_changed or any(boxes.room(low, high, boxes.point(s.cells)) < costs.apart for s in found):
            return None
        if margin <= most:
            keep(cells)
        return bound, low, high, cells, margin, here, targets

    def add(box: tuple | None, least: float) -> None:
        nonlocal made
        if box:
            made += 1
            heapq.heappush(queue, (max(box[0], least), made, *box[1:3]))

    add(looked(*boxes.whole()), 0.0)
    ended = "infeasible"
    while len(found) < costs.solutions:
        if best is not None and (not queue or best[0] - queue[0][0] <= costs.gap * abs(best[0]) + 1e-12):
            gap = max(0.0, (best[0] - queue[0][0]) / best[0]) if queue and best[0] else 0.0
            found.append(_Solution(*best, gap, "optimal" if gap <= 1e-12 else "gap"))
            best = None
            continue
        if not queue:
            break
        late = until is not None and time.monotonic() > until
        if late or costs.nodes is not None and visited >= costs.nodes:
            ended = "time" if late else "budget"
            if best is not None:
                found.append(_Solution(*best, max(0.0, (best[0] - queue[0][0]) / best[0]) if best[0] else 0.0, ended))
            break
        least, _, low, high = heapq.heappop(queue)
        visited += 1
        box = looked(low, high)
        if box is None:  # too near to a solution found since
            continue
        *_, cells, margin, here, targets = box
        parts = [looked(*part) for part in (boxes.around(low, high, cells) if margin <= most else boxes.split(low, high, cells, here, targets))]
        for part in parts:
            add(part, least)
        dive = parts[-1] if margin > most and visited % DIVE == 1 else None
        while dive and dive[4] > most:
            dive = looked(*boxes.split(*dive[1:4], *dive[5:])[-1])
    return found, ended


def exact(rows: DataFrame, ensemble: Ensemble, space: Space, threshold: float, target: int = 0, scale: dict[str, float] | None = None, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """(row_id, cf_rank, counterfactual, cost, proven, gap, status): the cheapest counterfactuals, by weighed shifts over scale plus changes.

    `optimal` is proven; `gap` is within the gap asked for; `time` and `budget` ran out, with the gap that was left. A row without a
    solution has cf_rank 0 and says why: `infeasible`, `time` or `budget`.
    """
    scale = scale or dict(zip(space.features, space.ranges(), strict=True))
    sign = 1 if target == 0 else -1
    edge = math.log(threshold / (1 - threshold)) * sign - costs.slack - sign * ensemble.base_margin
    cuts: dict[str, list[float]] = {}
    for n in ensemble.nodes:
        if n.feature is not None:
            cuts.setdefault(n.feature, []).append(n.threshold)
    cuts = {f: sorted(set(c)) for f, c in cuts.items()}
    features, bounds, leaves = space.features, dict(zip(space.features, zip(space.least, space.most, strict=True), strict=True)), list(regions(ensemble))
    binary, mutable = space.binary, space.mutable

    def one(pdf: pd.DataFrame) -> Iterator[tuple]:
        for row in pdf.itertuples(index=False):
            x = {f: None if v is None or np.isnan(v) else float(v) for f, v in zip(features, np.array(row.vector, dtype=float), strict=True)}
            allowed = mutable if row.search is None else mutable & set(row.search)
            cells = {}
            for f in features:
                low, high = bounds[f]
                if f in allowed and f in cuts and x[f] is not None and low is not None and low < high:
                    own = _cells(x[f], cuts[f], low, high, scale[f], costs)
                    cells[f] = [c for c in own if f not in binary or c[0] in (0.0, 1.0)] or [(x[f], 0.0, 0)]
            free = list(cells)
            boxes = _Boxes(x, free, cells, leaves, scale, sign)
            found, ended = _solve(boxes, edge, costs)
            for k, s in enumerate(found, 1):
                values = dict(zip(free, boxes.point(s.cells).tolist(), strict=True))
                yield row.row_id, k, [values.get(f, x[f]) for f in features], s.cost, s.status == "optimal", s.gap, s.status
            if not found:
                yield row.row_id, 0, None, None, ended == "infeasible", None, ended

    schema = "row_id long, cf_rank int, counterfactual array<double>, cost double, proven boolean, gap double, status string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(list(one(batch)), columns=["row_id", "cf_rank", "counterfactual", "cost", "proven", "gap", "status"])

    spread = rows.select("row_id", "vector", "search").repartition(F.col("row_id"))  # rows differ in effort, not in size
    return spread.mapInPandas(run, schema)


def audited(found: DataFrame, ensemble: Ensemble, features: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """(row_id, cf_rank, n_leaves, leaf_margin, margin, error_type) of solutions (row_id, cf_rank, counterfactual).

    Each solution is divided by the conditions of all leaves: it has to lie in one leaf of each tree, and these leaves' sum with the
    base margin has to be the model's margin; `SelectedLeafAudit` says that it isn't so, null that it is.
    """
    keyed = found.withColumn("_key", F.struct("row_id", "cf_rank"))
    names = F.array(*[F.lit(f) for f in features])
    long = keyed.select("_key", F.inline(F.arrays_zip(names.alias("feature"), F.col("counterfactual").alias("value"))))
    leaves = leaf_join_scores(long, "_key", ensemble).select("_key", "n_leaves", F.col("margin").alias("leaf_margin"))
    both = keyed.withColumn("margin", vector_margin_column(ensemble, list(features), "counterfactual")).join(leaves, "_key", "left")
    right = (F.col("n_leaves") == len(ensemble.by_tree)) & (F.abs(F.col("leaf_margin") - F.col("margin")) <= tolerance)
    return both.select("row_id", "cf_rank", "n_leaves", "leaf_margin", "margin", F.when(~F.coalesce(right, F.lit(False)), F.lit("SelectedLeafAudit")).alias("error_type"))
