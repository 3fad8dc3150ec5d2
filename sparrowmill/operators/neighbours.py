"""Exact nearest neighbours of every row of a table among all rows of another, and what follows from them.

The join goes by pivots. PIVOTS rows are drawn by hash; rows lie in the cell of their nearest pivot. From each cell's least distances to its
pivot follows, by the triangle inequality, how far the k-th neighbour of any query of a cell can be at most; a row is sent only to cells that it
can matter in. A large cell's queries are cut in blocks, and small cells that lie near each other share one; a task holds one block and lets its
rows pass by, so no task holds all of a cell, and the rows are sent as often as there are blocks, not cells. In a task, matrix products tell
which rows can be among the nearest; only these are measured, coordinate by coordinate. Equal
vectors count as one: of rows with equal vectors only the first k + 1 by id can be among the neighbours, and equal queries are asked once.
Only numbers by pivot reach the driver.

Defined results: ties in distance go to the smaller id; queries and rows without a vector, or with a missing coordinate, are left out of
`nearest`; with fewer than k rows there are fewer neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import discard, written
from . import quantiles

#: Pivots at most, queries that a task holds at once, at least if there are as many, and queries and rows that are compared by one product.
PIVOTS, BLOCK_ROWS, LEAST_BLOCK, TILE = 512, 16384, 512, 1024
#: Share of the rows that is sent to two cells, of those sent to either, from which they share a block.
ALIKE = 0.8


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists as rows of doubles; null is NaN."""
    return column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), from_pandas=True))


def _apart(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows of x, points), summed in the order of coordinates."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in points], 1) if len(points) else np.zeros((len(x), 0))


class _Nearest:
    """The k nearest candidates so far of each of n queries, by distance and id; what is offered is merged in when there is enough of it."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)]  # query, distance, id, value
        self.offered: list[list[np.ndarray]] = []
        self.bound, self.waiting = np.full(n, np.inf), 0

    def offer(self, queries: np.ndarray, rough: np.ndarray, slack: float, measured: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> None:
        """Squared distances (queries, candidates) that are right within `slack`, infinite for none; NaN is always measured. `measured(rows, columns)` gives distances, ids and values."""
        bound = self.bound[queries]
        odd = np.isnan(rough)
        open_ = np.flatnonzero(np.isinf(bound))
        if len(open_) and rough.shape[1] > self.k and not odd.any():
            bound[open_] = np.sqrt(np.maximum(np.partition(rough[open_], self.k - 1, axis=1)[:, self.k - 1] + slack, 0))
        limit = np.minimum((bound + 1e-9) ** 2 + slack, np.finfo(float).max)
        at, candidate = np.nonzero((rough <= limit[:, None]) | odd)
        if len(at):
            self.offered.append([queries[at], *measured(at, candidate)])
            self.waiting += len(at)
            if self.waiting >= max(self.n * self.k, 1 << 16):
                self.merge()

    def merge(self) -> None:
        if not self.offered:
            return
        query, distance, ids, value = (np.concatenate(c) for c in zip(self.kept, *self.offered, strict=True))
        order = np.lexsort((ids, distance, query))
        query = query[order]
        place = np.arange(len(order)) - np.searchsorted(query, query)
        own = order[place < self.k]
        self.kept = [query[place < self.k], distance[own], ids[own], value[own]]
        last = place == self.k - 1
        self.bound[query[last]] = distance[order[last]]
        self.offered, self.waiting = [], 0


def _tiles(n: int) -> list[slice]:
    return [slice(at, min(at + TILE, n)) for at in range(0, n, TILE)]


def _block(df: DataFrame, n: int, block: int) -> int:
    """Queries of a block: at most `block`; fewer, down to LEAST_BLOCK, if else some cores would have none."""
    return min(block, max(LEAST_BLOCK, -(-n // (2 * df.sparkSession.sparkContext.defaultParallelism))))


def _walk(far: np.ndarray) -> list[int]:
    """The pivots in an order in which each is the nearest to the one before it that is left."""
    left, out = far.copy(), [0]
    left[:, 0] = np.inf
    while len(out) < len(far):
        out.append(int(np.argmin(left[out[-1]])))
        left[:, out[-1]] = np.inf
    return out


def streamed(asked: DataFrame, rows: DataFrame, width: int, schema: str, start: Callable, take: Callable, finish: Callable) -> DataFrame:
    """For each `group` of `asked` (group, id, vector), its rows of the table `rows` passed by in batches.

    `start(ids, vectors)` makes a state, `take(state, ids, vectors)` adds a batch of rows to it, `finish(state)` gives a record batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, held = None, None, []
        for batch in batches:
            groups, kinds, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = _matrix(batch.column(3), width)
            edges = np.flatnonzero((groups[1:] != groups[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(groups)], strict=True):
                if a == b:
                    continue
                if groups[a] != group:
                    if state is not None:
                        yield finish(state)
                    group, state, held = groups[a], None, []
                if kinds[a] == 0:
                    held.append((ids[a:b], x[a:b]))
                    continue
                if state is None and held:
                    state = start(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                if state is not None:
                    take(state, ids[a:b], x[a:b])
        if state is not None:
            yield finish(state)

    both = asked.select("group", F.lit(0).alias("kind"), "id", "vector").unionByName(rows.select("group", F.lit(1).alias("kind"), "id", "vector"))
    return both.repartition("group").sortWithinPartitions("group", "kind").mapInArrow(run, schema)


def _mapped(df: DataFrame, pivots: np.ndarray, schema: str, run: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]) -> DataFrame:
    """`run(ids, vectors, distances to pivots)` for each batch of (id, vector)."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, len(batch), 2048)):
                x = _matrix(part.column(1), shared.value.shape[1])
                yield from run(part.column(0).to_numpy(), x, _apart(x, shared.value))

    return df.mapInArrow(mapped, schema)


def nearest(table: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK_ROWS, id_col: str = "id", vector: str = "vector", pivots: int = PIVOTS) -> DataFrame:
    """(query, id, distance, place): the k nearest rows by Euclidean distance of each query; both tables are (id, vector)."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    plain = lambda df: df.where(whole).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    rows = written(plain(table).withColumn("first", first).where(F.col("first") <= k + 1).drop("first"), "rows")
    asked = plain(queries)
    alike = written(asked.groupBy("vector").agg(F.min("id").alias("rep")), "asked")
    once = alike.select(F.col("rep").alias("id"), "vector")
    n = rows.count()
    drawn = rows.select("vector").distinct().select("vector", F.xxhash64("vector").alias("place")).orderBy("place", "vector").limit(min(pivots, int(n**0.5) + 1)).collect()  # at most `pivots`
    if not drawn:
        discard(rows, alike)
        return table.sparkSession.createDataFrame([], "query long, id long, distance double, place int")
    points = np.array([r["vector"] for r in drawn], float)
    width, far = points.shape[1], _apart(points, points)

    def least(ids: np.ndarray, x: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, near = d.argmin(1), d.min(1)
        order = np.lexsort((near, cell))
        place = np.arange(len(order)) - np.searchsorted(cell[order], cell[order])
        own = order[place <= k]
        yield pa.RecordBatch.from_arrays([pa.array(cell[own].astype(np.int32)), pa.array(near[own])], ["cell", "distance"])

    # how far the (k + 1)-th neighbour of any query of a cell can be at most
    place = F.row_number().over(Window.partitionBy("cell").orderBy("distance"))
    held = _mapped(rows, points, "cell int, distance double", least).withColumn("place", place).where(F.col("place") <= k + 1).toArrow()  # at most k + 1 a pivot
    cells, distances = held["cell"].to_numpy(), held["distance"].to_numpy()

    def celled(ids: np.ndarray, x: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(x), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["id", "vector", "cell", "distance"])

    placed = written(_mapped(once, points, "id long, vector array<double>, cell int, distance double", celled), "placed")
    sizes = {r["cell"]: (r["n"], r["most"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("most")).collect()}  # a row a pivot
    blocks, base, reach = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), np.full(len(points), -1.0)
    block = _block(table, sum(size for size, _ in sizes.values()), block)
    for c, (size, most) in sizes.items():
        bounds = most + far[c, cells] + distances
        limit = float(np.partition(bounds, k)[k]) if len(bounds) > k else np.inf
        reach[c], blocks[c] = (most + limit) * (1 + 1e-9) + 1e-12, -(-size // block)
    groups = filled = 0  # the last group and its queries
    needs = np.zeros(len(points), bool)  # which of the pivots, a sample of the rows, are sent to it
    for c in (c for c in _walk(far) if c in sizes):
        size, own = sizes[c][0], far[c] <= reach[c]
        # cells share a block if mostly the same rows are sent to both
        if filled and (filled + size > block or (needs & own).sum() < ALIKE * (needs | own).sum()):
            groups, filled = groups + 1, 0
        base[c], needs, filled = groups, own | needs if filled else own, filled + size
        if blocks[c] > 1:
            groups, filled = groups + int(blocks[c]), 0
    members = np.zeros((len(points), groups + 1), np.float32)  # cells by group
    for c in sizes:
        members[c, base[c] : base[c] + blocks[c]] = 1

    def sent(ids: np.ndarray, x: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, group = np.nonzero((d <= reach).astype(np.float32) @ members)
        for a in range(0, len(at), 4096):
            own = at[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(group[a : a + 4096]), pa.array(ids[own]), _lists(x[own])], ["group", "id", "vector"])

    per = lambda values: F.array(*[F.lit(int(v)) for v in values])[F.col("cell")]
    grouped = placed.select((per(base) + F.pmod(F.xxhash64("id"), F.greatest(per(blocks), F.lit(1)))).cast("long").alias("group"), "id", "vector")
    passed = _mapped(rows, points, "group long, id long, vector array<double>", sent)

    def start(ids: np.ndarray, x: np.ndarray) -> dict:
        return {"ids": ids, "x": x, "square": (x**2).sum(1), "best": _Nearest(len(ids), k + 1)}

    def take(state: dict, ids: np.ndarray, x: np.ndarray) -> None:
        for own in _tiles(len(ids)):
            rows, square = x[own], (x[own] ** 2).sum(1)
            for part in _tiles(len(state["ids"])):
                asked, squares = state["x"][part], state["square"][part]
                rough = squares[:, None] + square - 2 * (asked @ rows.T)
                measured = lambda q, c, asked=asked, rows=rows, names=ids[own]: [d := np.sqrt(((rows[c] - asked[q]) ** 2).sum(1)), names[c], d]
                state["best"].offer(np.arange(part.start, part.stop), rough, 1e-12 * (squares.max() + square.max()), measured)

    def finish(state: dict) -> pa.RecordBatch:
        state["best"].merge()
        query, distance, ids, _ = state["best"].kept
        return pa.RecordBatch.from_arrays([pa.array(state["ids"][query]), pa.array(ids), pa.array(distance)], ["rep", "id", "distance"])

    found = written(streamed(grouped, passed, width, "rep long, id long, distance double", start, take, finish), "nearest")
    discard(placed)
    pairs = asked.join(alike, "vector").select(F.col("id").alias("query"), "rep").join(found, "rep")
    pairs = pairs.where(F.col("query") != F.col("id")) if exclude_self else pairs
    order = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    out = written(pairs.select("query", "id", "distance", order.alias("place")).where(F.col("place") <= k), "neighbours")
    discard(rows, alike, found)
    return out


def plausibility(reference: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, knn_distance): the mean distance to the k nearest rows of the reference."""
    return nearest(reference, queries, k).groupBy("query").agg(F.avg("distance").alias("knn_distance"))


def lof(reference: DataFrame, queries: DataFrame, k: int = 35, exclude_self: bool = False) -> DataFrame:
    """(query, lof_score): novelty of each query against the reference, -1 for as dense as its neighbours, lower for more outlying.

    With `exclude_self` queries are rows of the reference, and aren't neighbours of themselves.

    Neighbours are those of an exact join by pivots. Where queries are rows of the reference one join serves for all; else the neighbours
    of queries, and their neighbours, are searched as well. With fewer than three rows of reference there is no score.
    """
    n = reference.where(F.col("vector").isNotNull()).count()
    if n < 3:
        return queries.select(F.col("id").cast("long").alias("query"), F.lit(None).cast("double").alias("lof_score"))
    k = min(k, max(2, n - 1))
    if exclude_self:
        every = nearest(reference, reference, k, exclude_self=True)
        first = every.join(queries.select(F.col("id").cast("long").alias("query")).distinct(), "query", "left_semi")
    else:
        of = lambda ids: reference.join(ids.select("id").distinct(), "id", "left_semi")
        first = nearest(reference, queries, k)
        near = nearest(reference, of(first), k, exclude_self=True)
        every = nearest(reference, of(near.select("id").union(first.select("id"))), k, exclude_self=True)
    reach = written(every.groupBy(F.col("query").alias("id")).agg(F.max("distance").alias("k_distance")), "reach")
    density = lambda pairs: pairs.join(reach, "id").groupBy("query").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + F.lit(1e-10))).alias("density"))
    of_first = density(every if exclude_self else near).select(F.col("query").alias("id"), F.col("density").alias("theirs"))
    out = first.select("query", "id").join(of_first, "id").groupBy("query").agg(F.avg("theirs").alias("theirs")).join(density(first), "query")
    return out.select("query", (-F.col("theirs") / F.col("density")).alias("lof_score"))


def covariance(df: DataFrame, vector: str = "vector") -> DataFrame:
    """(i, j, covariance): sample covariance of the coordinates, from one pass of partial sums in the tasks.

    Sums are taken around the coordinates of one row, the least by its text, so that large means cost no precision.
    """
    rows = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(vector).cast("array<double>").alias("v"))
    centre = rows.agg(F.min("v")).first()[0] or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(centre)
        n, sums, cross = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = np.array(batch["v"].tolist(), float).reshape(-1, d) - np.array(centre)
            n, sums, cross = n + len(x), sums + x.sum(0), cross + x.T @ x
        yield pd.DataFrame({"i": range(d), "n": [n] * d, "s": sums, "cross": list(cross)})

    parts = rows.mapInPandas(run, "i int, n long, s double, cross array<double>")
    cells = parts.select("i", "n", "s", F.posexplode("cross").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("si"), F.sum("x").alias("x"))
    other = cells.where("i = j").select(F.col("i").alias("j"), F.col("si").alias("sj"))
    return cells.join(other, "j").select("i", "j", ((F.col("x") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("covariance"))


def mahalanobis(reference: DataFrame, queries: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(query, distance): of vectors that are already centred, by the reference's covariance plus a ridge.

    The covariance has one row for each pair of coordinates; its inverse is found on the driver.
    """
    cells = covariance(reference).collect()
    d = max((c["i"] for c in cells), default=-1) + 1
    cov = np.zeros((d, d))
    for c in cells:
        cov[c["i"], c["j"]] = c["covariance"]
    inverse = np.linalg.pinv(cov + np.eye(d) * ridge)
    flat = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in inverse])
    product = F.transform(flat, lambda row: F.aggregate(F.zip_with(row, "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    form = F.aggregate(F.zip_with(product, "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return queries.select(F.col("id").alias("query"), F.sqrt(F.greatest(form, F.lit(0.0))).alias("distance"))


def knn_imputed(train: DataFrame, queries: DataFrame, features: int, k: int = 5, block: int = BLOCK_ROWS) -> DataFrame:
    """(id, vector): missing coordinates filled with the mean of the k nearest training rows that have them.

    Coordinates are standardised by the mean and the population deviation of the median-filled training rows. Distance is over the
    coordinates that both have, scaled up to all and rounded to nine places, so that ties go to the smaller id; rows that share none can't be donors. Without any donor the median fills, and 0
    where no row has the coordinate. Queries with equal vectors are asked once. Queries lie in groups by the mask of what they miss, a mask with
    very many of them in several; a task holds one group, lets all donors pass by, and keeps the k best for each query and coordinate.
    """
    stats_of = train.select(F.posexplode("vector").alias("j", "x"))
    median = {r["j"]: r["m"][0] if r["m"] else None for r in quantiles.exact(stats_of, "j", "x", [0.5], "m").collect()}  # one row a coordinate
    fill = np.array([median.get(j) if median.get(j) is not None else 0.0 for j in range(features)])
    filled = stats_of.withColumn("x", F.coalesce("x", F.array(*[F.lit(float(m)) for m in fill])[F.col("j")]))
    stats = {r["j"]: (r["m"], r["s"]) for r in filled.groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}
    mean = np.array([stats.get(j, (0.0, 1.0))[0] for j in range(features)])
    spread = np.array([stats.get(j, (0.0, 1.0))[1] or 1.0 for j in range(features)])
    rows = train.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = written(asked, "asked")
    lacking = asked.where(F.exists("vector", lambda x: x.isNull()))
    once = written(lacking.groupBy("vector").agg(F.min("id").alias("id")).withColumn("mask", F.xxhash64(F.transform("vector", lambda x: x.isNull()))), "masked")
    sizes = once.groupBy("mask").agg(F.count("*").alias("size"))
    n = once.count()
    block = _block(train, n, block)
    n_groups = n // block + 1
    salt = lambda size: F.pmod(F.xxhash64("vector"), F.floor(size / block) + 1)
    # small masks share a group, those that fill some have their own
    group = F.when(F.col("size") >= block, F.xxhash64("mask", salt(F.col("size")))).otherwise(F.pmod("mask", F.lit(n_groups)))
    grouped = written(once.join(sizes, "mask").select(group.alias("group"), "id", "vector"), "grouped")
    listed = grouped.agg(F.collect_set("group").alias("groups"))  # a number for each `block` queries
    passed = rows.select("id", "vector", F.explode(listed.select("groups").scalar()).alias("group"))

    def start(ids: np.ndarray, raw: np.ndarray) -> dict:
        lacks = np.isnan(raw)
        return {"ids": ids, "q": (raw - mean) / spread, "best": {int(j): _Nearest(len(ids), k) for j in np.flatnonzero(lacks.any(0))}}

    def take(state: dict, donors: np.ndarray, raw: np.ndarray) -> None:
        for own in _tiles(len(donors)):
            x = (raw[own] - mean) / spread
            has, there = ~np.isnan(x), np.nan_to_num(x)
            for part in _tiles(len(state["ids"])):
                q = state["q"][part]
                asked, given = ~np.isnan(q), np.nan_to_num(q)
                shared = asked.astype(float) @ has.T.astype(float)
                rough = asked.astype(float) @ (there**2).T - 2 * given @ there.T + given**2 @ has.T.astype(float)
                rough = np.where(shared > 0, rough * features / np.maximum(shared, 1), np.inf)
                slack = 1e-12 * features * ((there**2).sum(1).max() + (given**2).sum(1).max())
                for j in np.flatnonzero(~asked.all(0)):
                    want, can = np.flatnonzero(~asked[:, j]), np.flatnonzero(has[:, j])
                    if len(can):

                        def measured(at, c, want=want, can=can, x=x, q=q, j=j, names=donors[own], values=raw[own]) -> list[np.ndarray]:
                            gap = x[can[c]] - q[want[at]]
                            both = ~np.isnan(gap)
                            d = np.sqrt((np.where(both, gap, 0.0) ** 2).sum(1) * features / both.sum(1))
                            return [np.round(d, 9), names[can[c]], values[can[c], j]]

                        state["best"][int(j)].offer(want + part.start, rough[np.ix_(want, can)], slack, measured)

    def finish(state: dict) -> pa.RecordBatch:
        reps, coordinates, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for j, best in state["best"].items():
            best.merge()
            query, _, _, value = best.kept
            times = np.bincount(query, minlength=best.n)
            own = np.flatnonzero(times)
            reps.append(state["ids"][own])
            coordinates.append(np.full(len(own), j, np.int32))
            values.append(np.bincount(query, value, best.n)[own] / times[own])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (reps, coordinates, values)], ["rep", "j", "value"])

    found = streamed(grouped, passed, features, "rep long, j int, value double", start, take, finish)
    by_place = written(found.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("_new")), "donated")
    of_vector = once.select(F.col("id").alias("rep"), "vector").join(by_place, "rep").select("vector", "_new")
    medians = F.array(*[F.lit(float(m)) for m in fill])
    new = F.transform("vector", lambda x, j: F.coalesce(x, F.col("_new")[j], medians[j]))
    return lacking.join(of_vector, "vector", "left").unionByName(asked.where(~F.exists("vector", lambda x: x.isNull())).withColumn("_new", F.lit(None).cast("map<int,double>"))).select("id", new.alias("vector"))
