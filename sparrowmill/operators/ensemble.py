"""Tree ensembles as a node table: scoring by generated CASE, by joining leaf regions, or over vectors; leaf regions; facets.

A value below a node's threshold goes left, one at or above it right, a missing one where the node's default says. The margin
is the base margin plus one leaf of each tree. A model is a bounded table (trees times nodes), so it may live on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars

NODE_SCHEMA = "tree int, node int, left int, right int, feature string, threshold double, default_left boolean, leaf double, gain double"
#: Ensembles of more nodes are scored by CASEs in chunks of CHUNK trees, so that no generated method or expression tree is deep.
MOST_CASE_NODES = 400
CHUNK = 25


@dataclass(frozen=True)
class Node:
    """An inner node has a feature and two children; a leaf has a value instead."""

    tree: int
    node: int
    left: int | None
    right: int | None
    feature: str | None
    threshold: float | None
    default_left: bool | None
    leaf: float | None
    gain: float | None = None


@dataclass
class Ensemble:
    nodes: list[Node]
    base_margin: float = 0.0
    by_tree: dict[int, dict[int, Node]] = field(init=False)

    def __post_init__(self) -> None:
        self.by_tree = {}
        for n in sorted(self.nodes, key=lambda n: (n.tree, n.node)):
            if n.node in self.by_tree.setdefault(n.tree, {}):
                raise ValueError(f"tree {n.tree} has node {n.node} twice")
            self.by_tree[n.tree][n.node] = n
        for tree, own in self.by_tree.items():
            children = [c for n in own.values() if n.feature is not None for c in (n.left, n.right)]
            if sorted([0, *children]) != sorted(own):
                raise ValueError(f"the nodes of tree {tree} don't form one tree from node 0")
            if any((n.feature is None) == (n.leaf is None) or n.feature is not None and (n.threshold is None or n.default_left is None) for n in own.values()):
                raise ValueError(f"tree {tree} has a node that is neither a leaf nor a split")

    @classmethod
    def load(cls, table: DataFrame, base_margin: float = 0.0) -> Ensemble:
        return cls([Node(*row) for row in table.select("tree", "node", "left", "right", "feature", "threshold", "default_left", "leaf", "gain").collect()], base_margin)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n.tree, n.node, n.left, n.right, n.feature, n.threshold, n.default_left, n.leaf, n.gain) for n in self.nodes], NODE_SCHEMA)

    def features(self) -> list[str]:
        return sorted({n.feature for n in self.nodes if n.feature is not None})

    def truncated(self, trees: int) -> Ensemble:
        """The first trees only, as after early stopping."""
        return Ensemble([n for n in self.nodes if n.tree < trees], self.base_margin)


def tree_sql(ensemble: Ensemble, tree: int, numbers: bool = False, column: Callable[[str], str] = str) -> str:
    """The tree as nested CASE, giving the leaf's value, or its number; the text is SQL for Spark and other engines alike. `column` gives a feature's SQL."""

    def text(node: Node) -> str:
        if node.feature is None:
            return str(node.node) if numbers else f"CAST({node.leaf!r} AS DOUBLE)"
        name = column(node.feature)
        test = f"{name} < CAST({node.threshold!r} AS DOUBLE)" + (f" OR {name} IS NULL" if node.default_left else "")
        own = ensemble.by_tree[tree]
        return f"CASE WHEN {test} THEN {text(own[node.left])} ELSE {text(own[node.right])} END"

    return text(ensemble.by_tree[tree][0])


def margin_sql(ensemble: Ensemble, column: Callable[[str], str] = str) -> str:
    return " + ".join([f"CAST({ensemble.base_margin!r} AS DOUBLE)", *(f"({tree_sql(ensemble, t, column=column)})" for t in ensemble.by_tree)])


def margin(ensemble: Ensemble, column: Callable[[str], str] = str) -> Column:
    """The margin over columns; `column` gives a feature's SQL."""
    return F.expr(margin_sql(ensemble, column)) if len(ensemble.nodes) <= MOST_CASE_NODES else chunked_margin(ensemble, column)


def chunked_margin(ensemble: Ensemble, column: Callable[[str], str] = str) -> Column:
    """The margin of an ensemble of any size: generated code for chunks of trees, whose sums are added up. Planning grows with the nodes, rows don't leave the JVM."""
    own = [f"({tree_sql(ensemble, t, column=column)})" for t in ensemble.by_tree]
    sums = [" + ".join(own[k : k + CHUNK]) for k in range(0, len(own), CHUNK)]
    return F.aggregate(F.expr(f"array({', '.join(sums)})"), F.lit(float(ensemble.base_margin)), lambda total, part: total + part)


def scored(df: DataFrame, ensemble: Ensemble) -> DataFrame:
    """`df`, with a column for each feature, plus margin and proba."""
    return df.withColumn("margin", margin(ensemble)).withColumn("proba", scalars.sigmoid(F.col("margin")))


def subset_gap(df: DataFrame, ensemble: Ensemble, trees: int) -> DataFrame:
    """`df` with proba_subset, of the first trees only, proba_full, and the gap between them; 0 where all trees are used."""
    part = scalars.sigmoid(margin(ensemble.truncated(trees)))
    return df.withColumns({"proba_subset": part, "proba_full": scalars.sigmoid(margin(ensemble))}).withColumn("gap", F.abs(F.col("proba_full") - F.col("proba_subset")))


def rescored(factuals: DataFrame, ensemble: Ensemble, threshold: float) -> DataFrame:
    """Factuals scored again, with error_type for those that aren't positive any more: a failure, not a silent loss."""
    again = scored(factuals, ensemble)
    return again.withColumn("error_type", F.when(F.col("proba") < threshold, F.lit("NotPositive")))


def arrays(ensemble: Ensemble, features: Sequence[str]) -> list[tuple[np.ndarray, ...]]:
    """For each tree (feature index or -1, threshold, left, right, default_left, leaf), nodes numbered from 0."""
    where = {f: k for k, f in enumerate(features)}
    out = []
    for own in ensemble.by_tree.values():
        place = {node: k for k, node in enumerate(own)}
        rows = [
            (-1, 0.0, 0, 0, False, n.leaf) if n.feature is None else (where[n.feature], n.threshold, place[n.left], place[n.right], n.default_left, 0.0)
            for n in own.values()
        ]
        out.append(tuple(np.array(c) for c in zip(*rows, strict=True)))
    return out


def leaves_of(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The place of each row's leaf in the tree's arrays; missing values are NaN."""
    feature, threshold, left, right, default_left, _ = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (inner := feature[at] >= 0).any():
        value = x[rows, np.maximum(feature[at], 0)]
        goes_left = np.where(np.isnan(value), default_left[at], value < threshold[at])
        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
    return at


def margins(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], base: float) -> np.ndarray:
    out = np.full(len(x), base)
    for tree in trees:
        out += tree[5][leaves_of(x, tree)]
    return out


def vector_margin(ensemble: Ensemble, features: Sequence[str]):
    """A vectorised function of a column array<double> in the order of `features`, for ensembles too large for CASE."""
    trees, base = arrays(ensemble, features), ensemble.base_margin

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        x = np.array([np.array(v, dtype=float) for v in vectors]).reshape(len(vectors), len(features))
        return pd.Series(margins(x, trees, base))

    return run


def vector_margin_column(ensemble: Ensemble, features: Sequence[str], vector: str | Column = "vector") -> Column:
    """The margin of a vector: generated code for small ensembles and for vectors of a named column.

    A large ensemble over an expression, as in the loops of searches, which plan anew in each step, is scored in vectorised Python.
    """
    where = {f: k for k, f in enumerate(features)}
    if len(ensemble.nodes) > MOST_CASE_NODES:
        return chunked_margin(ensemble, lambda f: f"`{vector}`[{where[f]}]") if isinstance(vector, str) else vector_margin(ensemble, features)(vector)
    vector = F.col(vector) if isinstance(vector, str) else vector

    def value(own: dict[int, Node], node: Node) -> Column:
        if node.feature is None:
            return F.lit(float(node.leaf))
        x = vector[where[node.feature]]
        return F.when(F.coalesce(x < node.threshold, F.lit(bool(node.default_left))), value(own, own[node.left])).otherwise(value(own, own[node.right]))

    out = F.lit(float(ensemble.base_margin))
    for own in ensemble.by_tree.values():
        out = out + value(own, own[0])
    return out


@dataclass(frozen=True)
class Region:
    """A leaf and what its path asks of each feature: lower <= value < upper, or missing where allowed."""

    tree: int
    leaf: int
    value: float
    bounds: dict[str, tuple[float, float, bool]]


def regions(ensemble: Ensemble) -> Iterator[Region]:
    for tree, own in ensemble.by_tree.items():
        todo: list[tuple[int, dict[str, tuple[float, float, bool]]]] = [(0, {})]
        while todo:
            at, bounds = todo.pop()
            node = own[at]
            if node.feature is None:
                yield Region(tree, at, node.leaf, bounds)
                continue
            low, high, missing = bounds.get(node.feature, (-math.inf, math.inf, True))
            sides = ((node.left, low, min(high, node.threshold), node.default_left), (node.right, max(low, node.threshold), high, not node.default_left))
            for child, a, b, default in sides:
                if a < b or missing and default:
                    todo.append((child, bounds | {node.feature: (a, b, missing and default)}))


def region_table(spark: SparkSession, ensemble: Ensemble) -> DataFrame:
    """(tree, leaf, value, feature, lower, upper, allow_missing): a row for each leaf and feature of its path; open ends are null."""
    end = lambda x: x if math.isfinite(x) else None
    rows = [(r.tree, r.leaf, r.value, f, end(a), end(b), missing) for r in regions(ensemble) for f, (a, b, missing) in sorted(r.bounds.items())]
    rows += [(r.tree, r.leaf, r.value, None, None, None, True) for r in regions(ensemble) if not r.bounds]
    return spark.createDataFrame(rows, "tree int, leaf int, value double, feature string, lower double, upper double, allow_missing boolean")


def satisfied(value: Column, lower: Column, upper: Column, allow_missing: Column) -> Column:
    return F.when(value.isNull(), allow_missing).otherwise((lower.isNull() | (value >= lower)) & (upper.isNull() | (value < upper)))


def leaf_join(long: DataFrame, entity: str, ensemble: Ensemble) -> DataFrame:
    """(entity, tree, leaf, value): the leaf of each tree whose conditions a row meets all, from a dense long table.

    This is relational division: conditions are joined on the feature, and a leaf holds if as many are met as it has. The
    conditions are a bounded table that Spark broadcasts by its measured size.
    """
    table = region_table(long.sparkSession, ensemble)
    table = table.withColumn("asked", F.count("feature").over(Window.partitionBy("tree", "leaf")))
    met = long.join(table.where("feature is not null"), "feature").where(satisfied(long["value"], F.col("lower"), F.col("upper"), F.col("allow_missing")))
    held = met.groupBy(entity, "tree", "leaf").agg(F.count("*").alias("met"), F.first(table["value"]).alias("leaf_value"), F.first("asked").alias("asked")).where("met = asked")
    held = held.select(entity, "tree", "leaf", "leaf_value")
    lone = [F.struct(F.lit(r.tree).alias("tree"), F.lit(r.leaf).alias("leaf"), F.lit(float(r.value)).alias("leaf_value")) for r in regions(ensemble) if not r.bounds]
    return held.unionByName(long.select(entity).distinct().select(entity, F.inline(F.array(*lone)))) if lone else held


def leaf_join_scores(long: DataFrame, entity: str, ensemble: Ensemble) -> DataFrame:
    """(entity, n_leaves, margin, proba)."""
    sums = leaf_join(long, entity, ensemble).groupBy(entity).agg(F.count("*").alias("n_leaves"), F.sum("leaf_value").alias("_sum"))
    return sums.select(entity, "n_leaves", (F.col("_sum") + ensemble.base_margin).alias("margin")).withColumn("proba", scalars.sigmoid(F.col("margin")))


def leaves_reached(df: DataFrame, ensemble: Ensemble, keep: Sequence[str]) -> DataFrame:
    """(keep, tree, leaf): the leaf of each tree that each row of a table with a column for each feature comes to; no shuffle."""
    own = [F.struct(F.lit(t).alias("tree"), F.expr(tree_sql(ensemble, t, numbers=True)).cast("int").alias("leaf")) for t in ensemble.by_tree]
    return df.select(*keep, F.inline(F.array(*own)))


def leaf_support(df: DataFrame, ensemble: Ensemble, label: str = "label") -> DataFrame:
    """(tree, leaf, n_rows, n_positive): the rows and positive labels of each leaf that any row comes to; a row a leaf is shuffled."""
    return leaves_reached(df, ensemble, [label]).groupBy("tree", "leaf").agg(F.count("*").alias("n_rows"), F.sum(F.col(label).cast("long")).alias("n_positive"))


def observed_gains(support: DataFrame, ensemble: Ensemble) -> DataFrame:
    """The node table with each split's gain as the rows show it: how much of the labels' square error it takes away, 0 without rows on both sides.

    Rows of a node are those of its leaves; leaf and ancestor pairs are a bounded table of the model.
    """
    spark = support.sparkSession
    above, children = [], []
    for tree, own in ensemble.by_tree.items():
        todo = [(0, ())]
        while todo:
            at, path = todo.pop()
            node = own[at]
            if node.feature is None:
                above += [(tree, at, up) for up in (*path, at)]
            else:
                children.append((tree, at, node.left, node.right))
                todo += [(node.left, (*path, at)), (node.right, (*path, at))]
    pairs = spark.createDataFrame(above, "tree int, leaf int, node int")
    held = support.join(F.broadcast(pairs), ["tree", "leaf"]).groupBy("tree", "node").agg(F.sum("n_rows").alias("n"), F.sum("n_positive").alias("p"))
    side = lambda name: held.select("tree", F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("p").alias(f"p_{name}"))
    inner = spark.createDataFrame(children, "tree int, node int, left int, right int").join(side("left"), ["tree", "left"], "left").join(side("right"), ["tree", "right"], "left")
    gap = F.col("p_left") / F.col("n_left") - F.col("p_right") / F.col("n_right")
    gains = inner.select("tree", "node", F.coalesce(F.col("n_left") * F.col("n_right") / (F.col("n_left") + F.col("n_right")) * gap * gap, F.lit(0.0)).alias("gain"))
    return ensemble.table(spark).drop("gain").join(gains, ["tree", "node"], "left")


def top_facets(table: DataFrame, target: int, per_tree: int, total: int) -> DataFrame:
    """(tree, leaf, value, ...): the leaves that push most towards the target label, some of each tree, then some of all; counts of rows are kept."""
    towards = F.desc("value") if target == 1 else F.asc("value")
    leaves = table.select("tree", "leaf", "value", *[c for c in ("n_rows", "n_positive") if c in table.columns]).distinct()
    own = F.row_number().over(Window.partitionBy("tree").orderBy(towards, "leaf"))
    return leaves.withColumn("_place", own).where(F.col("_place") <= per_tree).drop("_place").orderBy(towards, "tree", "leaf").limit(total)


def merged(constraints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, lower, upper, allow_missing, feasible): the intersection of all constraints on a feature."""
    out = constraints.groupBy(*keys, "feature").agg(F.max("lower").alias("lower"), F.min("upper").alias("upper"), F.every("allow_missing").alias("allow_missing"))
    return out.withColumn("feasible", F.coalesce(F.col("lower") < F.col("upper"), F.lit(True)) | F.col("allow_missing"))


def importance(table: DataFrame) -> DataFrame:
    """(feature, importance_gain): each feature's share of the mean gain of its splits."""
    gains = table.where("feature is not null").groupBy("feature").agg(F.avg("gain").alias("_gain"))
    return gains.select("feature", F.try_divide("_gain", F.sum("_gain").over(Window.partitionBy(F.lit(0)))).alias("importance_gain"))


def nested_regions(dump: dict) -> list[Node]:
    """Nodes of one tree from its nested form (nodeid, split, split_condition, yes, no, missing, children, leaf)."""
    out, todo = [], [dump]
    while todo:
        d = todo.pop()
        if "leaf" in d:
            out.append(Node(0, d["nodeid"], None, None, None, None, None, float(d["leaf"])))
        else:
            out.append(Node(0, d["nodeid"], d["yes"], d["no"], d["split"], float(d["split_condition"]), d["missing"] == d["yes"], None, d.get("gain")))
            todo += d["children"]
    return out


def array_nodes(tree: int, left: list[int], right: list[int], split: list[int], condition: list[float], default_left: list, weight: list[float], names: Sequence[str]) -> list[Node]:
    """Nodes of one tree from its arrays; a node without children is a leaf with its base weight."""
    if len({len(left), len(right), len(split), len(condition), len(default_left), len(weight)}) != 1:
        raise ValueError(f"the arrays of tree {tree} differ in length")
    return [
        Node(tree, k, None, None, None, None, None, float(weight[k])) if left[k] < 0 else Node(tree, k, left[k], right[k], names[split[k]], float(condition[k]), bool(default_left[k]), None)
        for k in range(len(left))
    ]
