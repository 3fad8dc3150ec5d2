"""Gradient-boosted trees for a label of 0 or 1, by histograms that Spark sums, with missing values routed by the data.

Values are cut into bins once, at quantiles, and written as a binned matrix in blocks of rows, each with its rows' margins. Executors hold the
blocks in memory, or on their disks. A round costs the same however many came before: a task starts from the margins in its blocks and walks
only the trees grown since, at most STEP, which then go into the margins held; after CARRY trees the next version of the matrix is written,
so that a lost executor's blocks are made from few steps. Rows aren't shuffled after that.

For each level of a tree the tasks add up gradients and curvatures by node, sampled feature and bin, one array a task, and only those are sent: a
level is one job of one stage, whose time is mostly Spark's own while the rows are few. The driver adds the arrays up, in groups of tasks first where they
are large, and picks each node's best split, from numbers that don't grow with the rows. Of two sibling nodes only the lighter one is summed, the
other is their parent less that one. The validation loss of a round comes with the next round's first level.

Each split tries missing values on both sides. Rows and features are sampled by seeded hashes. Boosting stops when the validation
loss hasn't improved for `patience` rounds, and the ensemble is cut back to its best round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, written
from .ensemble import Ensemble, Node

#: Rows of a block, and trees after which margins are written, and after which they are brought up to date in memory.
BLOCK, CARRY, STEP = 8192, 24, 4
#: Most rows of a task, where the cores alone would ask for fewer tasks; bytes of sums that the driver takes from all tasks directly.
TASK_ROWS, DIRECT = 1 << 19, 8 << 20


@dataclass(frozen=True)
class Settings:
    rounds: int = 2000
    rate: float = 0.02
    depth: int = 4
    least_weight: float = 15.0
    rows: float = 0.7
    columns: float = 0.5
    l1: float = 1.0
    l2: float = 10.0
    bins: int = 64
    patience: int = 100
    seed: int = 42
    positive_weight: float | None = None


@dataclass
class Fitted:
    ensemble: Ensemble
    losses: list[tuple[int, float]]


@dataclass
class Split:
    """An inner node of a growing tree: values in bins up to `bin` go left, missing ones where `default_left` says."""

    left: int
    right: int
    feature: int
    bin: int
    default_left: bool
    gain: float


@dataclass
class Tree:
    splits: dict[int, Split]
    values: dict[int, float]

    def nodes_of(self, bins: np.ndarray, missing: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), {0: np.arange(len(bins))}
        for node, s in sorted(self.splits.items()):  # a node's number is below its children's
            own = rows.pop(node)
            value = bins[:, s.feature].take(own)
            left = value <= s.bin
            if s.default_left:
                left |= value == missing
            rows[s.left], rows[s.right] = own[left], own[~left]
        for node, own in rows.items():
            at[own] = node
        return at

    def margins(self, bins: np.ndarray, missing: int) -> np.ndarray:
        table = np.zeros(max(self.values) + 1)
        for node, value in self.values.items():
            table[node] = value
        return table[self.nodes_of(bins, missing)]


def cut_points(train: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Quantiles of each coordinate, from a mergeable sketch; one row a coordinate comes to the driver."""
    grid = [k / bins for k in range(1, bins)]
    found = train.select(F.posexplode("vector").alias("j", "x")).where("x is not null").groupBy("j").agg(F.percentile_approx("x", grid, 20 * bins).alias("q"), F.max("x").alias("most")).collect()
    cuts = {r["j"]: np.unique([q for q in r["q"] if q < r["most"]]) for r in found}
    return [np.nextafter(cuts.get(j, np.zeros(0)), np.inf) for j in range(features)]


BLOCKS = "training boolean, ids binary, labels binary, bins binary, margins binary"


def binned(rows: DataFrame, cuts: list[np.ndarray], missing: int, block: int = BLOCK) -> DataFrame:
    """(training, ids, labels, bins, margins): a row for each block of rows (row_id, label, vector, training), its matrices as bytes."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column("training").to_numpy(zero_copy_only=False)
            for training in (True, False):
                own = batch.filter(pa.array(flags == training))
                for part in (own.slice(a, block) for a in range(0, len(own), block)):
                    x = pc.cast(part.column("vector").flatten(), pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(part), width)
                    bins = np.stack([np.where(np.isnan(x[:, j]), missing, np.searchsorted(cuts[j], x[:, j], side="right")) for j in range(width)], 1).astype(np.uint16)
                    matrices = (part.column("row_id").to_numpy().astype(np.int64), part.column("label").to_numpy().astype(np.float64), bins, np.zeros(len(part)))
                    yield pa.RecordBatch.from_arrays([pa.array([training]), *[pa.array([m.tobytes()], pa.binary()) for m in matrices]], ["training", "ids", "labels", "bins", "margins"])

    chosen = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("label").cast("double").alias("label"), F.col("vector").cast("array<double>").alias("vector"), "training")
    return chosen.mapInArrow(run, BLOCKS)


#: A block in memory: training, ids, labels, bins, margins.
Block = tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _block(training: bool, ids: bytes, labels: bytes, bins: bytes, margins: bytes, width: int) -> Block:
    return training, np.frombuffer(ids, np.int64), np.frombuffer(labels), np.frombuffer(bins, np.uint16).reshape(-1, width), np.frombuffer(margins)


def held(blocks: DataFrame, width: int, parts: int) -> RDD[Block]:
    """The written matrix as executors hold it, in at most `parts` tasks; what is lost is read again."""
    return blocks.coalesce(parts).rdd.map(lambda r: _block(*r, width)).persist(StorageLevel.MEMORY_AND_DISK)


def _stepped(blocks: RDD[Block], trees: list[Tree], missing: int) -> RDD[Block]:
    """The held blocks with the margins that some more trees give."""
    return blocks.map(lambda b: (*b[:4], b[4] + sum(t.margins(b[3], missing) for t in trees))).persist(StorageLevel.MEMORY_AND_DISK)


def _carried(blocks: DataFrame, trees: list[Tree], width: int, missing: int) -> DataFrame:
    """The matrix with the margins that some more trees give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_block(*r, width) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            margins = [m + sum(t.margins(bins, missing) for t in trees) for _, _, _, bins, m in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([m.tobytes() for m in margins], pa.binary())], batch.schema.names)

    return blocks.mapInArrow(run, BLOCKS)


def hash_share(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id and seed."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def gradients(labels: np.ndarray, margins: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margins))
    w = np.where(labels > 0.5, weight, 1.0)
    return (p - labels) * w, np.maximum(p * (1 - p), 1e-16) * w


def loss_sums(labels: np.ndarray, margins: np.ndarray, weight: float) -> tuple[float, float]:
    """Sums of the weighted loss and of the weights."""
    w = np.where(labels > 0.5, weight, 1.0)
    return float((np.logaddexp(0, np.where(labels > 0.5, -margins, margins)) * w).sum()), float(w.sum())


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def _summed(blocks: RDD[Block], trees: list[Tree], tree: Tree, asked: list[int], width: int, chosen: np.ndarray, s: Settings, seed: int, weight: float, with_loss: bool) -> tuple[dict[int, np.ndarray], float]:
    """Sums (width, bins + 1, 2) of gradient and curvature for each asked node of a growing tree, 0 for features that aren't chosen; and the validation loss of `trees`."""
    shape = (len(asked), len(chosen), s.bins + 1)
    size = len(chosen) * (s.bins + 1)
    where = np.full(max([0, *asked, *tree.values, *tree.splits]) + 1, -1)
    where[asked] = np.arange(len(asked))
    columns = np.arange(len(chosen)) * (s.bins + 1)

    def run(own_blocks: Iterator[Block]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sums, loss = np.zeros((2, len(asked) * size)), np.zeros(2)
        for training, ids, labels, bins, margins in own_blocks:
            if not (training or with_loss):
                continue
            if training:
                at = where[tree.nodes_of(bins, s.bins)]
                own = np.flatnonzero((hash_share(ids, seed) < s.rows) & (at >= 0))
                at, bins, labels, margins = at[own], bins[own], labels[own], margins[own]
            margins = margins + sum(t.margins(bins, s.bins) for t in trees)
            if not training:
                loss += loss_sums(labels, margins, weight)
                continue
            cell = (at[:, None] * size + columns + bins[:, chosen]).ravel()
            for k, x in enumerate(gradients(labels, margins, weight)):
                sums[k] += np.bincount(cell, np.repeat(x, len(chosen)), len(asked) * size)
        yield sums, loss

    parts = blocks.getNumPartitions()
    depth = 1 if parts * len(asked) * size * 16 <= DIRECT else 2
    found, loss = blocks.mapPartitions(run).treeReduce(_added, depth)  # one array a task
    out = np.zeros((len(asked), width, s.bins + 1, 2))
    out[:, chosen] = found.reshape(2, *shape).transpose(1, 2, 3, 0)
    return dict(zip(asked, out, strict=True)), float(loss[0] / loss[1]) if loss[1] else 0.0


def _thresholded(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _gain(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return _thresholded(g, s.l1) ** 2 / (h + s.l2)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return -float(_thresholded(np.float64(g), s.l1) / (h + s.l2)) * s.rate


def best_split(sums: np.ndarray, n_cuts: Sequence[int], chosen: Sequence[int], s: Settings) -> tuple[float, int, int, bool, tuple[float, float], tuple[float, float]] | None:
    """(gain, feature, bin, default_left, left sums, right sums) of one node; of equal gains the first feature, left default and lowest bin."""
    best = None
    for j in chosen:
        g, h = sums[j, :, 0].sum(), sums[j, :, 1].sum()
        below = np.cumsum(sums[j, : n_cuts[j]], axis=0)
        for default_left in (True, False):
            left = below + (sums[j, -1] if default_left else 0)
            gl, hl = left[:, 0], left[:, 1]
            gr, hr = g - gl, h - hl
            gain = _gain(gl, hl, s) + _gain(gr, hr, s) - _gain(np.array([g]), np.array([h]), s)
            gain[(hl < s.least_weight) | (hr < s.least_weight)] = 0
            if len(gain) and gain.max() > (best[0] if best else 0.0) + 1e-12:
                k = int(np.argmax(gain))
                best = (float(gain[k]), int(j), k, default_left, (float(gl[k]), float(hl[k])), (float(gr[k]), float(hr[k])))
    return best


def grown(sums_of, n_cuts: Sequence[int], chosen: Sequence[int], s: Settings) -> Tree:
    """A tree grown level by level; `sums_of(tree, nodes)` gives histograms, asked for the lighter of two siblings only."""
    tree, sums, open_ = Tree({}, {0: 0.0}), sums_of(Tree({}, {0: 0.0}), [0]), [0]
    for level in range(s.depth):
        pairs = []
        for node in open_:
            found = best_split(sums[node], n_cuts, chosen, s)
            if found is None:
                continue
            gain, j, k, default_left, left, right = found
            a, b = len(tree.splits) + len(tree.values), len(tree.splits) + len(tree.values) + 1
            del tree.values[node]
            tree.splits[node] = Split(a, b, j, k, default_left, gain)
            tree.values[a], tree.values[b] = leaf_value(*left, s), leaf_value(*right, s)
            pairs.append((node, a, b) if left[1] <= right[1] else (node, b, a))
        if not pairs or level == s.depth - 1:
            break
        lighter = sums_of(tree, [light for _, light, _ in pairs])
        parents, sums, open_ = sums, {}, []
        for node, light, heavy in pairs:
            sums[light], sums[heavy] = lighter[light], parents[node] - lighter[light]
            open_ += sorted((light, heavy))
    return tree


def _nodes(tree: Tree, number: int, features: Sequence[str], cuts: list[np.ndarray]) -> list[Node]:
    inner = [Node(number, node, x.left, x.right, features[x.feature], float(cuts[x.feature][x.bin]), x.default_left, None, x.gain) for node, x in tree.splits.items()]
    return inner + [Node(number, node, None, None, None, None, None, value) for node, value in tree.values.items()]


def fit(train: DataFrame, val: DataFrame, features: Sequence[str], settings: Settings = Settings(), carry: int = CARRY) -> Fitted:  # noqa: B008
    """Fit to (row_id, label, vector); `val` has the same columns. Without rows of both classes the ensemble has no trees."""
    s, width, spark = settings, len(features), train.sparkSession
    counts = train.agg(F.count_if(F.col("label") == 0).alias("n"), F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("all")).first()
    if not counts["n"] or not counts["p"]:
        return Fitted(Ensemble([]), [])
    weight = s.positive_weight if s.positive_weight is not None else counts["n"] / counts["p"]
    cuts = cut_points(train, width, s.bins)
    parts = max(-(-counts["all"] // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-counts["all"] // BLOCK)))
    columns = lambda df, training: df.select("row_id", "label", "vector", F.lit(training).alias("training"))
    rows = columns(train, True).unionByName(columns(val, False)).repartition(parts, "row_id")
    matrix = written(binned(rows, cuts, s.bins), "binned")
    blocks, stale = held(matrix, width, parts), []
    draw = np.random.default_rng(s.seed)
    trees: list[Tree] = []
    losses: list[tuple[int, float]] = []
    best, since, stepped = (np.inf, -1), 0, 0
    for round_ in range(s.rounds + 1):
        own = trees[stepped:]
        chosen = np.sort(draw.permutation(width)[: max(1, int(width * s.columns))])
        lost = None

        def sums_of(tree: Tree, nodes: list[int], blocks=blocks, own=own, chosen=chosen, round_=round_) -> dict[int, np.ndarray]:
            nonlocal lost
            sums, loss = _summed(blocks, own, tree, nodes, width, chosen, s, s.seed + round_, weight, nodes == [0])
            lost = loss if nodes == [0] else lost
            return sums

        root = sums_of(Tree({}, {0: 0.0}), [0])
        while stale:  # this round's blocks have been made from them
            stale.pop().unpersist()
        if round_:
            losses.append((round_ - 1, lost))
            if lost < best[0] - 1e-12:
                best = (lost, round_ - 1)
            if round_ == s.rounds or round_ - 1 - best[1] >= s.patience or not trees[-1].splits:
                break
        trees.append(grown(lambda tree, nodes, root=root, more=sums_of: {0: root[0]} if nodes == [0] else more(tree, nodes), [len(c) for c in cuts], chosen, s))
        if len(trees) - since >= carry:
            newer = written(_carried(matrix, trees[since:], width, s.bins), "binned")
            blocks.unpersist()
            discard(matrix)
            matrix, since, stepped = newer, len(trees), len(trees)
            blocks = held(matrix, width, parts)
        elif len(trees) - stepped >= STEP:
            stale.append(blocks)
            blocks, stepped = _stepped(blocks, trees[stepped:], s.bins), len(trees)
    blocks.unpersist()
    discard(matrix)
    return Fitted(Ensemble([n for k, t in enumerate(trees) for n in _nodes(t, k, features, cuts)]).truncated(best[1] + 1), losses)
