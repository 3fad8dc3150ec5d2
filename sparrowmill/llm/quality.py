"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network with calibrated probabilities.

A word's index vector is sparse and ternary, drawn from its hash; its word vector is the sum of the index vectors of its
neighbours within WINDOW words over the learned texts, scaled to length 1. Words live in hashed slots, so the vectors have a
fixed size. Tokens are runs of letters and digits, and runs of symbols. A document is the mean of its tokens' vectors. The
network has one hidden layer; a temperature fitted on rows that the weights never saw calibrates its probability.

Learning takes at most SAMPLE labelled documents, those whose hashed ids come first, each that still fits in SAMPLE_BYTES of text together and
has at most SAMPLE_TEXT_BYTES itself. Scoring reads every whole text once.

Defined results: null and empty texts pool to the zero vector and are scored like others; rows without id are scored but
never learned from; labels that disagree for one id count by their mean, and of rows with the same id the least text is learned from; null labels are skipped; with one class only, or
none, every score is that class's share (0.5 without labels); an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import wordhash
from .language_id import held_out
from .tables import discard, documents, small_batches, written

SAMPLE = 4000
SAMPLE_BYTES = 64 << 20
#: Bytes of a text that is learned from; the driver holds a few dozen bytes for each of them.
SAMPLE_TEXT_BYTES = 8 << 20
SLOTS = 1 << 14
DIMENSIONS = 48
NONZERO = 4
WINDOW = 2
HIDDEN = 24
EPOCHS = 20
REPEATED = 0

_KIND = np.full(256, 2, np.int8)  # 0 space, 1 letter or digit, 2 symbol
_KIND[:33] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of each token; case counts. A token equal to the one before it is the token REPEATED instead."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    solid = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][solid], edges[1:][solid]
    hashes, row = wordhash.span_hashes(data, starts, ends, lower=False), np.searchsorted(offsets, starts, side="right") - 1
    slot = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    slot[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])] = REPEATED
    return slot, row


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each slot's index vector."""
    draws = wordhash.mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(99)).reshape(SLOTS, NONZERO)
    return (draws % np.uint64(DIMENSIONS)).astype(np.int64), np.where(draws >> np.uint64(63), 1.0, -1.0)


def word_vectors(column: pa.Array) -> np.ndarray:
    """Random indexing over texts: (SLOTS, DIMENSIONS); zero for slots that never occur."""
    places, signs = index_vectors()
    out = np.zeros(SLOTS * DIMENSIONS)
    data, offsets = wordhash.utf8(column)
    for i, j in wordhash.chunks(offsets):
        slot, row = slots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for step in range(1, WINDOW + 1):
            same = np.flatnonzero(row[:-step] == row[step:])
            for a, b in ((same, same + step), (same + step, same)):
                where = slot[a][:, None] * DIMENSIONS + places[slot[b]]
                out += np.bincount(where.ravel(), signs[slot[b]].ravel(), SLOTS * DIMENSIONS)
    out = out.reshape(SLOTS, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text."""
    data, offsets = wordhash.utf8(column)
    out = np.zeros((len(offsets) - 1, vectors.shape[1]))
    for i, j in wordhash.chunks(offsets, 1 << 18):
        slot, row = slots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if len(slot):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sums = np.add.reduceat(vectors[slot], first, axis=0, dtype=np.float64)
            out[i + row[first]] = sums / np.diff(np.append(first, len(row)))[:, None]
    return out


@dataclass
class Network:
    """Standardised input, one tanh layer, one logit over a temperature; without layers, a constant."""

    vectors: np.ndarray
    layers: tuple | None
    temperature: float = 1.0
    constant: float = 0.5

    def score(self, column: pa.Array) -> np.ndarray:
        if self.layers is None:
            return np.full(len(column), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(pooled(column, self.vectors)) / self.temperature, -40, 40)))

    def logit(self, x: np.ndarray) -> np.ndarray:
        mean, spread, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple:
    """Adam on the cross-entropy, both classes weighing alike in half."""
    draw = np.random.default_rng(seed)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / spread
    params = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            hidden = np.tanh(x[own] @ params[0] + params[1])
            gap = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40))) - y[own]) / len(own)
            back = gap[:, None] * params[2] * (1 - hidden**2)
            turn += 1
            for p, (param, grad) in enumerate(zip(params, (x[own].T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ gap + 1e-4 * params[2], gap.sum(keepdims=True)), strict=True)):
                first[p] = 0.9 * first[p] + 0.1 * grad
                second[p] = 0.999 * second[p] + 0.001 * grad**2
                param -= 3e-3 * (first[p] / (1 - 0.9**turn)) / (np.sqrt(second[p] / (1 - 0.999**turn)) + 1e-8)
    return mean, spread, params[0], params[1], params[2], float(params[3][0])


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy on a grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0.5, -logits, logits) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, text_bytes: int = SAMPLE_TEXT_BYTES) -> Network:
    """Fit on at most `sample` labelled documents, of at most `sample_bytes` together and `text_bytes` each."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    chosen = known.select("*", F.xxhash64("id").alias("place")).orderBy("place", "id").limit(sample)  # a bounded table: `sample` rows
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), "id").groupBy("place", "id", "label").agg(F.min("text").alias("text")).where(F.octet_length("text") <= text_bytes)
    met = written(met, "quality-sample")
    sizes = met.select("place", "id", F.octet_length("text").alias("bytes")).toArrow().sort_by([("place", "ascending"), ("id", "ascending")])  # `sample` rows
    left, fits = sample_bytes, []
    for place, size in zip(sizes["place"].to_pylist(), sizes["bytes"].to_pylist(), strict=True):
        if size <= left:
            left -= size
            fits.append(place)
    rows = met.where(F.col("place").isin(fits)).toArrow().sort_by([("place", "ascending"), ("id", "ascending")])
    discard(met)
    y = (rows["label"].to_numpy() >= 0.5).astype(float) if rows.num_rows else np.zeros(0)
    if len(set(y)) < 2:
        return Network(np.zeros((SLOTS, 0), np.float32), None, constant=float(y.mean()) if len(y) else 0.5)
    texts = rows["text"].combine_chunks()
    vectors = word_vectors(texts)
    x = pooled(texts, vectors)
    held = wordhash.mix(rows["place"].to_numpy().view(np.uint64)) % np.uint64(5) == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    network = Network(vectors, _train(x[~held], y[~held]))
    tried = held if held.any() else ~held
    network.temperature = _temperature(network.logit(x[tried]), y[tried])
    return network


def scored(df: DataFrame, network: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of `df` and the probability of label 1; a column of that name is replaced."""
    small_batches(df.sparkSession)
    df = df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    names = schema.fieldNames()
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(text_col)), pa.float64())], names)

    return df.mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that aren't held out."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out("doc_id", 3, 1)
    network = fit(docs.where(~out), labels.select("doc_id", "quality").where(~out))
    found = scored(docs.select("doc_id", out.alias("held_out"), "text"), network)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
