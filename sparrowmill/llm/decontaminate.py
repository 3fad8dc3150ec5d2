"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words, lower-cased: runs of letters, marks and numbers by Unicode class, and in scripts written
without spaces (`UNSPACED`) each character with its marks. A passage of a text matches an item of W words if it differs by at most
floor(edits * W) words inserted, deleted or replaced, so items below 1 / edits words match only as they are. Items of every length are
searched, also those of one word.

1. Windows are as long as the item; items above SPAN words are searched by even chunks of at most SPAN words, of which
   at least one has no more than its share of the edits. Lengths fall in classes.
2. At every place of a text, the window that begins there is embedded by `walks` random walks: at each step a walk emits the word it
   stands on, and a hashed bit of step and word says whether it moves on. Edit distance becomes Hamming distance.
3. Bit sampling: each of `tables` tables hashes `bits` sampled steps to a bucket; window and chunk that share a bucket are candidates.
   A window that isn't aligned with the item's start counts as well, so that at the most edits allowed about 99 % are found (`test_recall`).
4. Candidates are confirmed by the exact edit distance between the whole item and its best place around the window.

Two filters spare work and lose nothing: each edit breaks at most two pairs of neighbouring words, so a window that holds fewer
than W - 1 - 2 * edits pairs of items of its class isn't embedded; and buckets without an item aren't sent on. The filters are what
is broadcast, at most MOST_SLOTS slots each; items, buckets and candidates are tables that Spark joins. Texts with equal
digests are searched in every row but verified once, so a passage that many rows copy costs no more.

Defined results: null and empty texts match nothing; items that are null or without a word are never found; equal items are all
reported; rows without id are searched like others; repeated rows give repeated results; without items no row is
contaminated; an empty table gives an empty result. Other columns are passed through. Item ids may have any type.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .tables import BROADCAST_DIGESTS, discard, documents, keyed_join, small_batches, written

EDITS = 0.2
SPAN = 64
WALKS = 4
TABLES = 16
BITS = 3
#: Slots of a filter (two bytes each): at least SLOTS_A_KEY for each key, within these bounds.
SLOTS_A_KEY, LEAST_SLOTS, MOST_SLOTS = 8, 1 << 14, 1 << 24
#: Slots that are put together in one row of bytes.
BLOCK_SLOTS = 1 << 12
_SEED = 0x5DEECE66D

# Ranges of code points of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, Tai, Balinese, Javanese, Han, kana, Bopomofo, Yi).
UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035),
    (0x303B, 0x303B), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
]
_NONE, _LETTER, _SINGLE, _SINGLE_MARK = range(4)


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    classes = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    mark = classes == ord("M")
    out = np.where(mark | (classes == ord("L")) | (classes == ord("N")), _LETTER, _NONE).astype(np.uint8)
    for a, b in UNSPACED:
        own = out[a : b + 1]
        own[own == _LETTER] = _SINGLE
        own[mark[a : b + 1]] = _SINGLE_MARK
    return out


_ASCII = np.full(256, _LETTER, np.uint8)  # a byte that is no part of a character counts as a letter
_ASCII[:128] = [_LETTER if chr(c).isalnum() else _NONE for c in range(128)]


def _byte_kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte's character, and which bytes begin a character that is a word of its own."""
    kinds, single = _ASCII[data], np.zeros(len(data), bool)
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        first, n = data[at].astype(np.int64), 2 + (data[at] >= 0xE0).astype(np.int64) + (data[at] >= 0xF0)
        code = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[n]
        for k in range(1, 4):
            code = np.where(n > k, code << 6 | (data[np.minimum(at + k, len(data) - 1)] & 0x3F), code)
        own = _kinds()[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            inside = (n > k) & (at + k < len(data))
            kinds[at[inside] + k] = own[inside]
        single[at[own == _SINGLE]] = True
    return kinds, single


_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[:128] = _ASCII[:128] == _NONE


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kinds, single = _byte_kinds(data)
    solid = kinds != _NONE
    row_start, row_end = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    row_start[offsets[:-1]] = True
    row_end[offsets[1:]] = True
    begins = solid & (np.concatenate([[True], ~solid[:-1]]) | row_start[:-1]) | single
    begins[1:] |= (kinds[1:] == _LETTER) & (kinds[:-1] > _LETTER)
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:] | begins[1:], [True]]) | row_end[1:])) + 1
    return wordhash.span_hashes(data, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of lower-cased texts."""
    return wordhash.piecewise(data, offsets, _tokens, _SEPARATORS)


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words, row of each word) for ranges of rows, lower-cased here."""
    data, offsets = wordhash.utf8(pc.utf8_lower(column))
    for i, j in wordhash.chunks(offsets):
        words, rows = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, words, rows



def allowed(length, edits: float):
    return np.floor(np.asarray(length) * edits + 1e-9).astype(np.int64)


@dataclass(frozen=True)
class Window:
    """A class of chunk lengths `low` to `high`: `steps` of a walk are sampled, `pairs` of items must be among `reach` words, starts up to `near` apart share a region."""

    low: int
    high: int
    steps: int
    reach: int
    pairs: int
    near: int


@cache
def windows(edits: float) -> list[Window]:
    out, low = [], 1
    while low <= SPAN:
        high = min(SPAN, max(low, int(low * 1.22)))
        lengths = np.arange(low, high + 1)
        most = allowed(lengths, edits)
        out.append(Window(low, high, low + low // 4, high + int(most[-1]), int((lengths - 1 - 2 * most).min()), int(most[-1]) + 1))
        low = high + 1
    return out


@cache
def samples(steps: int, walks: int, tables: int, bits: int) -> np.ndarray:
    """Sampled steps (walks, tables, bits)."""
    draw = np.random.default_rng(_SEED)
    return np.array([[np.sort(draw.permutation(steps)[np.arange(bits) % steps]) for _ in range(tables)] for _ in range(walks)])


def moves(words: np.ndarray, walks: int, steps: int) -> np.ndarray:
    """For each walk and 64 steps, a long for each word: bit k says whether the walk moves on from the word at step k."""
    seeds = wordhash.mix(np.arange(1, walks * (-(-steps // 64)) + 1, dtype=np.uint64)).reshape(walks, -1, 1)
    return wordhash.mix(words ^ seeds)


def walk(words: np.ndarray, moving: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int) -> np.ndarray:
    """CGK embeddings (steps, n) of the words from each start on, by one walk's `moves`; 0 from its end on."""
    out, at, last = np.zeros((steps, len(starts)), np.uint64), starts.copy(), len(words) - 1
    for step in range(steps):
        inside, here = at < ends, np.minimum(at, last)
        out[step] = np.where(inside, words[here], np.uint64(0))
        at += inside & (moving[step // 64][here] >> np.uint64(step % 64) & np.uint64(1) == 1)
    return out


def buckets(embedded: np.ndarray, kind: int, table: int, sampled: np.ndarray) -> np.ndarray:
    """Bucket keys (n, tables) of embeddings by one walk's sampled steps (tables, bits); `table` numbers the first table."""
    tables, bits = sampled.shape
    keys = np.full((tables, embedded.shape[1]), kind, np.uint64) + (np.arange(table, table + tables, dtype=np.uint64) << np.uint64(16))[:, None]
    for k in range(bits):
        keys = wordhash.mix(keys * np.uint64(0x9FB21C651E98DF25) + embedded[sampled[:, k]])
    return keys.T


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return wordhash.mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])


class Filter:
    """In which classes hashes occur, by their highest bits; others may seem to."""

    def __init__(self, classes: np.ndarray) -> None:
        self.shift = np.uint64(64 - len(classes).bit_length() + 1)
        self.classes = classes

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """A bit for each class, 0 for hashes that don't occur."""
        return self.classes[(hashes >> self.shift).astype(np.int64)]


def filter_of(hashes: DataFrame) -> Filter:
    """Filter of columns `hash` and `class`, put together by Spark in blocks of bytes; the driver gets two bytes a slot."""
    n, slots = hashes.count(), LEAST_SLOTS
    while slots < min(SLOTS_A_KEY * n, MOST_SLOTS):
        slots *= 2
    one = F.call_function("shiftleft", F.lit(1), F.col("class").cast("int"))
    filled = hashes.groupBy(F.shiftrightunsigned("hash", 64 - slots.bit_length() + 1).alias("at")).agg(F.bit_or(one).alias("classes"))

    def block(table: pa.Table) -> pa.Table:  # at most BLOCK_SLOTS rows
        own = np.zeros(BLOCK_SLOTS, np.uint16)
        at = table["at"].to_numpy()
        own[at % BLOCK_SLOTS] = table["classes"].to_numpy()
        return pa.table({"block": [int(at[0]) // BLOCK_SLOTS], "classes": pa.array([own.tobytes()], pa.binary())})

    blocks = filled.withColumn("block", F.floor(F.col("at") / BLOCK_SLOTS)).groupBy("block").applyInArrow(block, "block long, classes binary").toArrow()
    own = np.zeros((slots // BLOCK_SLOTS, BLOCK_SLOTS), np.uint16)
    for k, part in zip(blocks["block"].to_pylist(), blocks["classes"].to_pylist(), strict=True):
        own[k] = np.frombuffer(part, np.uint16)
    return Filter(own.ravel())


def item_words(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, item, words): the word hashes of each item with a word, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words, rows in texts_of(batch.column(1)):
                for row in np.unique(rows):
                    own = words[rows == row]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + row, 1), pa.array([hashlib.md5(own.tobytes()).digest()]), pa.array([own.view(np.int64)])], ["item_id", "item", "words"])

    known = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    return known.mapInArrow(run, f"item_id {known.schema['item_id'].dataType.simpleString()}, item binary, words array<long>")


def item_buckets(items: DataFrame, edits: float, walks: int, tables: int, bits: int) -> DataFrame:
    """(item, n, at, class, kind, hash) from (item, words): kind `bucket` for those of the chunk at word `at`, `pair` for its pairs of words, or the word itself if it is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = windows(edits)
        lows = np.array([c.low for c in classes])
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1), strict=True):
                own = words.values.to_numpy().view(np.uint64)
                moving = moves(own, walks, classes[-1].steps)
                chunks = -(-len(own) // SPAN)
                cuts = len(own) * np.arange(chunks + 1) // chunks
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    k = int(np.searchsorted(lows, b - a, side="right")) - 1
                    pairs = _pairs(own[a:b]) if b - a > 1 else wordhash.mix(own[a:b])
                    starts, ends = np.array([a]), np.array([b])
                    keys = [buckets(walk(own, moving[w], starts, ends, classes[k].steps), k, w * tables, s).ravel() for w, s in enumerate(samples(classes[k].steps, walks, tables, bits))]
                    hashes = np.concatenate([pairs, *keys]).view(np.int64)
                    n = len(hashes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item.as_py()] * n, pa.binary()), pa.array(np.full(n, len(own))), pa.array(np.full(n, a)), pa.array(np.full(n, k)),
                            pa.array(["pair"] * len(pairs) + ["bucket"] * (n - len(pairs))), pa.array(hashes),
                        ],
                        ["item", "n", "at", "class", "kind", "hash"],
                    )

    return items.select("item", "words").mapInArrow(run, "item binary, n long, at long, class long, kind string, hash long").distinct()


@dataclass
class Search:
    """What every task needs to find the windows that share a bucket with an item; of bounded size."""

    classes: list[int]
    pairs: Filter
    keys: Filter
    edits: float
    walks: int
    tables: int
    bits: int

    def dense(self, rows: np.ndarray, pairs: np.ndarray, pair_classes: np.ndarray, k: int) -> np.ndarray:
        """The starts of a class's windows that hold enough pairs, from the places of pairs; or those of single words."""
        own = windows(self.edits)[k]
        if own.pairs <= 0 and own.high > 1:
            return np.arange(len(rows))
        at = pairs[pair_classes >> np.uint16(k) & np.uint16(1) == 1]
        if own.high == 1:
            return at
        first, last = at[: max(len(at) - own.pairs + 1, 0)], at[own.pairs - 1 :]
        use = (last - first < own.reach - 1) & (rows[first] == rows[last])
        first, last = first[use], last[use]
        low = np.maximum(last - own.reach + 2, np.searchsorted(rows, rows[first]))
        many = first - low + 1
        return np.unique(np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))

    def found(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First words and bucket keys of windows in buckets that hold an item."""
        if not len(words) or not self.classes:
            return
        near = self.pairs.of(_pairs(words))
        near[rows[1:] != rows[:-1]] = 0
        pairs, dense = np.flatnonzero(near), {}
        for k in self.classes:
            if windows(self.edits)[k].high == 1:
                single = self.pairs.of(wordhash.mix(words))
                dense[k] = self.dense(rows, np.flatnonzero(single), single[single > 0], k)
            else:
                dense[k] = self.dense(rows, pairs, near[pairs], k)
        every = np.unique(np.concatenate([*dense.values()]))
        if not len(every):
            return
        # one walk serves all classes: a shorter class samples its first steps
        classes, ends = windows(self.edits), np.searchsorted(rows, rows[every], side="right")
        steps = max(classes[k].steps for k, own in dense.items() if len(own))
        moving = moves(words, self.walks, steps)
        for i in range(0, len(every), 4096):
            starts = every[i : i + 4096]
            for w in range(self.walks):
                embedded = walk(words, moving[w], starts, ends[i : i + 4096], steps)
                for k, own in dense.items():
                    here = np.searchsorted(starts, own[np.searchsorted(own, starts[0]) : np.searchsorted(own, starts[-1], side="right")])
                    if not len(here):
                        continue
                    keys = buckets(embedded[:, here], k, w * self.tables, samples(classes[k].steps, self.walks, self.tables, self.bits)[w])
                    window, table = np.nonzero(self.keys.of(keys) >> np.uint16(k) & np.uint16(1))
                    if not len(window):
                        continue
                    # walks from neighbouring places soon agree: of places in the same region one is enough
                    at, found = starts[here[window]], keys[window, table]
                    order = np.lexsort((at, found))
                    at, found = at[order], found[order]
                    same = (found[1:] == found[:-1]) & (rows[at[1:]] == rows[at[:-1]]) & (at[1:] // classes[k].near == at[:-1] // classes[k].near)
                    new = np.concatenate([[True], ~same])
                    yield at[new], found[new]


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def candidates(df: DataFrame, text_col: str, search: Search) -> DataFrame:
    """(text, at, hash): the digest of each text with a window in an item's bucket, the window's first word and the bucket."""
    shared = df.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for i, words, rows in texts_of(column):
                first = np.searchsorted(rows, rows)
                for starts, keys in shared.value.found(words, rows):
                    own, of = np.unique(rows[starts], return_inverse=True)
                    digests = pa.array([hashlib.md5(column[i + int(r)].as_py().encode()).digest() for r in own], pa.binary())
                    yield pa.RecordBatch.from_arrays([digests.take(pa.array(of)), pa.array(starts - first[starts]), pa.array(keys.view(np.int64))], ["text", "at", "hash"])

    return df.select(text_col).mapInArrow(run, "text binary, at long, hash long")


def _merged(wanted: list[dict], edits: float) -> Iterator[tuple[bytes, int, int]]:
    """(item, first word, end): the regions around the starts of an item, those that meet as one."""
    last: tuple[bytes, int, int] | None = None
    for c in sorted(wanted, key=lambda c: (c["item"], c["start"])):
        more = int(allowed(c["n"], edits))
        low, high = max(0, c["start"] - 2 * more - 2), max(0, c["start"] + c["n"] + 3 * more + 3)
        if last and last[0] == c["item"] and low <= last[2]:
            last = last[0], last[1], max(high, last[2])
            continue
        if last:
            yield last
        last = c["item"], low, high
    if last:
        yield last


def regions(texts: DataFrame, edits: float) -> DataFrame:
    """(text, item, region) from (text, own, wanted): the words around each candidate start (item, n, start) of a text."""

    def batch_of(text: pa.Scalar, items: list[bytes], parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([text.as_py()] * len(items), pa.binary()), pa.array(items, pa.binary()), pa.array(parts, pa.list_(pa.int64()))], ["text", "item", "region"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            for i, words, rows in texts_of(batch.column(1)):
                for row in np.unique(rows):
                    own, k = words[rows == row], int(i + row)
                    items, parts, size = [], [], 0
                    for item, low, high in _merged(wanted[k].as_py(), edits):
                        items.append(item)
                        parts.append(own[low:high].view(np.int64))
                        size += len(parts[-1])
                        if size > 1 << 18:
                            yield batch_of(batch.column(0)[k], items, parts)
                            items, parts, size = [], [], 0
                    yield batch_of(batch.column(0)[k], items, parts)

    return texts.mapInArrow(run, "text binary, item binary, region array<long>")


def edit_distance(item: np.ndarray, region: np.ndarray) -> int:
    """The least number of word edits that turns the item into some contiguous part of the region."""
    before = np.zeros(len(region) + 1, np.int64)  # a match may begin anywhere
    steps = np.arange(len(region) + 1)
    for k, word in enumerate(item):
        row = before + 1
        row[1:] = np.minimum(row[1:], before[:-1] + (region != word))
        row[0] = k + 1
        before = np.minimum.accumulate(row - steps) + steps
    return int(before.min())


def verified(pairs: DataFrame, edits: float) -> DataFrame:
    """(text, item): those rows (text, item, region, words) whose region holds the item within the edits allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [w.values.to_numpy() for w in batch.column(3)]
            keep = [edit_distance(item, region.values.to_numpy()) <= allowed(len(item), edits) for item, region in zip(items, batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["text", "item"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("text", "item", "region", "words").mapInArrow(run, "text binary, item binary").distinct()


def contaminated(
    df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS, walks: int = WALKS, tables: int = TABLES, bits: int = BITS, out: str = "item_ids"
) -> DataFrame:
    """All columns of `df` and the sorted ids of the items found in each row's text; a column of that name is replaced."""
    small_batches(df.sparkSession)
    df = df.drop(out)
    named = written(item_words(items, item_id, item_text), "items")
    known = written(named.groupBy("item").agg(F.first("words").alias("words")), "items-once")
    lsh = written(item_buckets(known, edits, walks, tables, bits), "item-buckets")
    classes = sorted(r["class"] for r in lsh.select("class").distinct().collect())  # one row a class of lengths
    search = Search(classes, *(filter_of(lsh.where(F.col("kind") == kind)) for kind in ("pair", "bucket")), edits, walks, tables, bits)
    met = keyed_join(candidates(df, text_col, search), lsh.where("kind = 'bucket'").select("hash", "item", "n", F.col("at").alias("offset")), "hash", "inner", BROADCAST_DIGESTS)
    # starts that differ by no more than the edits allowed share a region
    step = F.floor(F.col("n") * edits + 1e-9) + 1
    start = F.floor((F.col("at") - F.col("offset")) / step) * step
    wanted = written(met.select("text", F.struct("item", "n", start.alias("start")).alias("one")).groupBy("text").agg(F.collect_set("one").alias("wanted")), "windows")
    texts = keyed_join(df.select(_key(F.col(text_col)).alias("text"), F.col(text_col).alias("own")), wanted.select("text"), "text", "left_semi", BROADCAST_DIGESTS)
    parts = written(regions(texts.groupBy("text").agg(F.first("own").alias("own")).join(wanted, "text"), edits), "regions")
    hits = verified(parts.join(known, "item"), edits).join(named.select("item", "item_id"), "item").groupBy(F.col("text").alias(f"{out} key")).agg(F.array_sort(F.collect_set("item_id")).alias(out))
    hits = written(hits, "hits")
    discard(named, known, lsh, wanted, parts)
    found = keyed_join(df.withColumn(f"{out} key", _key(F.col(text_col))), hits, f"{out} key", "left", BROADCAST_DIGESTS)
    return found.select(*df.columns, F.coalesce(out, F.array().cast(hits.schema[out].dataType)).alias(out))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contaminated(documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")
