r"""Ranked lexical search: impact-ordered lists, worked through score at a time.

Terms are the runs `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` of the whole text, only A-Z lower-cased. A term's weight is
w = floor(1000 ln((2N + 2) / (2df + 1))); its impact on a document, all in whole numbers, is

    w * ((1000000000 tf) div (1000 tf + 20 m)),  m = 100 - 50 + ((50 n N) div L)

with N documents that hold a term, L terms in all, n in the document. A document's score for an item is the sum over the item's terms, once each.

1. One pass over the texts writes a row for each document: n, and the items' terms that it holds with their counts. df, N and L are sums of these rows.
2. Documents lie in portions of at most PORTION postings. A portion keeps a list for each term, by falling impact. For an item,
   postings of equal impact form a group, and groups are taken by falling impact, over all its terms, into one sum a document. The
   next group of each list bounds what is still to come: once that is below the k-th best sum, no document without a sum can
   enter, and none whose sum falls short by more than the bound. Only then are the others' sums completed, and the best k kept.
3. The best k of all portions are merged in two steps, over parts and then over items, so that no task gets all portions' rows.

Items are asked in blocks of ITEM_BYTES of text, the only thing that is brought to the driver and sent to all tasks; each block
is a pass over the documents, and no document meets an item without a common term. Terms are compared by 64-bit hashes.

Defined results: null texts and texts without terms have no terms, and items without one find nothing; equal rows of an item count once, an
id with several texts is asked with each of them, and its results are ranked apart; equal scores go by ascending id, null ids last, repeated rows
of a document one by one; an empty table gives an empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .tables import discard, documents, small_batches, written

BEST = 50
ITEM_BYTES = 4 << 20
PORTION = 1_000_000
#: Parts of the first merging step.
PARTS = 64
#: A level of impacts is this share of the one before.
LEVEL = 0.7

_OTHER = np.zeros(256, bool)
_OTHER[:128] = True
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _OTHER[_first : _last + 1] = False


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = wordhash.word_spans(data, offsets, ~_OTHER[data])
    return wordhash.span_hashes(data, starts, ends), rows


def terms(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hash of each term, row of each term) for portions of the texts."""
    data, offsets = wordhash.utf8(column)
    for i, j in wordhash.chunks(offsets):
        yield i, j, *wordhash.piecewise(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _hashed, _OTHER)


class Items:
    """The distinct terms of some items, in order of hash, and each item's places among them."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        own = [np.zeros(0, np.uint64) for _ in range(len(column))]
        for i, j, hashes, rows in terms(column):
            cut = np.searchsorted(rows, np.arange(j - i + 1))
            own[i:j] = [np.unique(hashes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
        self.places = [np.searchsorted(self.vocabulary, x) for x in own]


def postings(df: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """(id, n, terms, tfs) for each row: all its terms counted, and those of the vocabulary with their occurrences."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for i, j, hashes, rows in terms(batch.column(1)):
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                found = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                pair, tf = np.unique(rows[found] * max(len(known), 1) + at[found], return_counts=True)
                row, term = np.divmod(pair, max(len(known), 1))
                cut = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (term.astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.bincount(rows, minlength=j - i).astype(np.int64)), *lists], ["id", "n", "terms", "tfs"])

    return df.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {id_type}, n long, terms array<int>, tfs array<long>")


def weights(n_documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Portion:
    """Some documents' postings: a list for each term, by falling impact."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_documents: int, n_terms: int):
        m = 100 - 50 + (50 * n * n_documents) // max(n_terms, 1)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.falling = doc[order], impact[order], -impact[order]
        self.cut = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.size = len(n)

    def best(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the best k, and their complete scores above 0; all ties with the k-th are in it."""
        lists = [(int(self.cut[t]), int(self.cut[t + 1])) for t in places if self.cut[t] < self.cut[t + 1]]
        sums, at, ends = np.zeros(self.size, np.int64), [a for a, _ in lists], [b for _, b in lists]
        heads = [int(self.impact[a]) for a in at]
        level, least = max(heads, default=0), 1
        while bound := sum(heads):
            # a document not seen so far has at most `bound`, which has to beat or tie with the k-th sum
            level = min(math.floor(level * LEVEL), max(heads))
            for x, (a, b) in enumerate(zip(at, ends, strict=True)):
                if a < b and heads[x] >= max(level, 1):
                    upto = a + int(np.searchsorted(self.falling[a:b], -max(level, 1), side="right"))  # whole groups of equal impact
                    sums[self.doc[a:upto]] += self.impact[a:upto]  # a list has a document once
                    at[x], heads[x] = upto, int(self.impact[upto]) if upto < b else 0
            if self.size > k:
                least = max(int(np.partition(sums, self.size - k)[self.size - k]), 1)
            if (bound := sum(heads)) < least and bound:
                open_ = sums + bound >= least
                for a, b in zip(at, ends, strict=True):
                    inside = open_[self.doc[a:b]]
                    sums[self.doc[a:b][inside]] += self.impact[a:b][inside]
                sums[~open_] = 0
                break
        if self.size > k:
            least = max(int(np.partition(sums, self.size - k)[self.size - k]), 1)
        found = np.flatnonzero(sums >= least)
        return found, sums[found]


def _search(rows: DataFrame, items: Items, weight: np.ndarray, n_documents: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): the best k of each portion for each item, by its number."""
    shared = rows.sparkSession.sparkContext.broadcast((items.places, weight))

    def best(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, lists = table["id"].combine_chunks(), table["terms"]
        doc = np.repeat(np.arange(len(table)), pc.list_value_length(lists).to_numpy())
        flat = [np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[x].chunks]) for x in ("terms", "tfs")]
        places, weight = shared.value
        portion = Portion(table["n"].to_numpy(), doc, *flat, weight, n_documents, n_terms)
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        for item, own in enumerate(places):
            found, score = portion.best(own, k)
            order = np.lexsort((rank[found], -score))[:k]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), item, np.int32)), ids.take(pa.array(found[order])), pa.array(score[order])], ["item", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= PORTION:
                yield from best(held)
                held, size = [], 0
        if held:
            yield from best(held)

    return rows.mapInArrow(run, f"item int, id {rows.schema['id'].dataType.simpleString()}, score long")


def ranked(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, id, score): for each row of `items` the k rows of `df` with the highest scores above 0."""
    spark = df.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = size * 2 // item_bytes + 1  # on average half full
    found = None
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).toArrow()  # about half of `item_bytes`
        names = spark.createDataFrame(own.select(["item_id"]).append_column("item", pa.array(range(len(own)), pa.int32())), f"item_id {asked.schema['item_id'].dataType.simpleString()}, item int")
        parsed = Items(own["text"])
        rows = written(postings(df, id_col, text_col, parsed.vocabulary), "postings")
        n_documents, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row for each term of the items
        held = np.zeros(len(parsed.vocabulary), np.int64)
        held[counts["term"].to_numpy()] = counts["count"].to_numpy()
        some = _search(rows, parsed, weights(n_documents, held), n_documents, n_terms, k).withColumn("part", F.spark_partition_id() % PARTS)
        best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id")))
        some = some.withColumn("rank", best("item", "part")).where(F.col("rank") <= k)
        some = some.withColumn("rank", best("item")).where(F.col("rank") <= k)
        some = written(some.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score"), "ranked")
        discard(rows)
        found = some if found is None else found.union(some)
    return found


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item."""
    found = ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
size AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n_documents, sum(len(t))::BIGINT AS n_terms FROM docs),
held AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM docs) GROUP BY row, term),
weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, size WHERE term IN (SELECT term FROM items) GROUP BY term),
scores AS (
  SELECT i.item_id, d.row, any_value(d.doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(d.t) * n_documents) // n_terms))))::BIGINT AS score
  FROM items i JOIN weighed USING (term) JOIN held h USING (term) JOIN docs d ON h.row = d.row, size GROUP BY i.item_id, d.row),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50"""
