r"""MinHash near-duplicate detection: one-permutation hashing, banded buckets and star-shaped candidate edges.

Words are `[^\x20\x09-\x0D]+` of the whole text, A-Z lower-cased; a document's set holds its distinct shingles of `size`
words. Documents with equal sets are one node from the start, so copies cost nothing more. Each node has one hash pass: the
range of hashes is cut into BANDS * ROWS bins, a bin keeps its least hash, and an empty bin takes that of a full bin chosen by
hashing (bin, attempt), the optimal densification. Nodes that agree on all ROWS bins of a band share a bucket.

A bucket never gives all pairs: each node is paired with its bucket's hubs only, the least node under each of STARS hash
orders, which partial aggregates find. Pairs are confirmed on full shingle sets, never on sketches. Nodes that still share a
bucket with another component after that, those that the hubs were too far from, are compared by exact prefix filtering,
which loses nothing. Pairs therefore grow with the number of nodes and not with the square of a bucket.

With ROWS 5 and BANDS 32, two sets at the threshold 0.8 miss all buckets with a chance of 3 in a million, more alike ones less.

Defined results: a text without words, or null, has an empty set and is linked with nothing; a row without id takes part
in its set, but gets component null unless another row of the component has an id; rows with the same id and set are
alike; an empty table gives an empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .tables import BROADCAST_DIGESTS, discard, documents, keyed_join, small_batches, written

ROWS = 5
BANDS = 32
STARS = 3


def one_permutation(hashes: np.ndarray, rows: np.ndarray, n_rows: int, bins: int) -> np.ndarray:
    """Densified sketches (n_rows, bins) from sorted distinct hashes of each row; a row without hashes stays 0."""
    sketch, full = np.zeros((n_rows, bins), np.uint64), np.zeros((n_rows, bins), bool)
    if len(hashes):
        at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        cell = rows * bins + at
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        sketch.ravel()[cell[first]] = hashes[first]
        full.ravel()[cell[first]] = True
    row, bin_ = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (wordhash.mix((bin_ + attempt * bins).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        found = full[row, donor]
        sketch[row[found], bin_[found]] = sketch[row[found], donor[found]]
        row, bin_ = row[~found], bin_[~found]
    return sketch


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = wordhash.utf8(column)
    for i, j in wordhash.chunks(offsets):
        words, rows = wordhash.hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, *wordhash.shingles(words, rows, j - i, size)


def _nodes(hashes: np.ndarray, cut: np.ndarray) -> list[bytes | None]:
    """A 16-byte digest of each set; None for an empty one."""
    sums = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(wordhash.mix(hashes + np.uint64(0x1F83D9ABFB41BD6B)), out=sums[0, 1:])
    np.cumsum(wordhash.mix(hashes ^ np.uint64(0x5BE0CD19137E2179)), out=sums[1, 1:])
    both = np.ascontiguousarray((sums[:, cut[1:]] - sums[:, cut[:-1]]).T).astype(">u8")
    return [both[k].tobytes() if cut[k + 1] > cut[k] else None for k in range(len(cut) - 1)]


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def sketched(df: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, text_key, n_shingles, node, bands): node is the digest of the shingle set, bands its bucket keys; both null for an empty set."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, of in _sets(batch.column(1), size):
                cut = np.searchsorted(of, np.arange(j - i + 1))
                counts = np.diff(cut)
                sketch = one_permutation(hashes, of, j - i, bands * rows).reshape(j - i, bands, rows)
                keys = np.zeros((j - i, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for k in range(rows):
                    keys = wordhash.mix(keys * np.uint64(0x9FB21C651E98DF25) + sketch[:, :, k])
                full = counts > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]), pa.int32()), pa.array(keys[full].view(np.int64).ravel()))
                lists = pa.ListArray.from_buffers(lists.type, j - i, [pa.array(full).buffers()[1], lists.buffers()[1]], children=[lists.values])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(_nodes(hashes, cut), pa.binary()), lists], ["id", "text_key", "n_shingles", "node", "bands"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key")).mapInArrow(run, f"id {id_type}, text_key binary, n_shingles long, node binary, bands array<long>")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, shingles): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, of in _sets(batch.column(0), size):
                cut = np.searchsorted(of, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(hashes, cut), pa.binary()), lists], ["node", "shingles"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "node binary, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those written pairs (a, b) whose full sets share at least `percent` of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    small, large = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
    # only the sets of these pairs are shuffled; a ratio of sizes below the threshold already rules a pair out
    right = keyed_join(right, pairs.select("b"), "b", "left_semi", BROADCAST_DIGESTS)
    met = keyed_join(left, pairs, "a", "inner", BROADCAST_DIGESTS).join(right, "b").where(small * 100 >= large * percent)
    met = met.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return met.where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b")


def _hub(order: int) -> Column:
    """The bucket's least node in one of the hash orders."""
    return F.min(F.struct(F.xxhash64("node", F.lit(order)), "node"))["node"]


def _pairs(starred: DataFrame, hubs: list[str]) -> DataFrame:
    linked = starred.select("node", F.explode(F.array(*hubs)).alias("hub")).where("node <> hub")
    return linked.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _rest(sets: DataFrame, loose: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of loose nodes (node, root) in different components that can be alike, by exact prefix filtering.

    Shingles are put in one order for all, rare ones first. Two sets that share `percent` of their union share a shingle within the
    first size - ceil(size * percent / 100) + 1 of each. What many documents have in common comes last in that order, so it is in
    few prefixes; shingles whose prefixes lie in one component are left out before the join, and so are pairs whose shared
    shingle has too little after it. Of a pair, the smaller set has more than half of what the threshold wants after the shingle that
    they share first: only such `strong` rows are joined with the rest, so documents that have a long boilerplate in
    common, but not enough of it to be alike, don't meet at all. Rows are of fixed size, whatever a text's length.
    """
    each = keyed_join(sets, loose, "node", "inner", BROADCAST_DIGESTS).select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    at_root = F.xxhash64("root")  # a long, so that these aggregates stay in hash tables
    common = each.groupBy("shingle").agg(F.count("*").alias("many"), F.min(at_root).alias("low"), F.max(at_root).alias("high")).where("low <> high")
    common = written(common.select("shingle", F.floor(F.log2("many")).cast("int").alias("level")), "common")
    # shingles of one component match no other, so they only count: they come first, and don't count as shared
    met = keyed_join(each, common, "shingle", "inner").withColumn("at", F.struct("level", F.xxhash64("shingle").alias("order"), "shingle"))
    whole = met.groupBy("node", "root", "n").agg(F.array_sort(F.collect_list("at")).alias("all"))
    alone = F.col("n") - F.size("all")
    length = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)) + 1).cast("int") - alone
    first = whole.where(length > 0).select("node", "root", "n", F.size("all").alias("shared"), F.posexplode(F.slice("all", F.lit(1), length)).alias("before", "own"))
    prefixes = written(first.select("node", "root", "n", (F.col("shared") - F.col("before")).alias("left"), F.col("own.shingle").alias("shingle")), "prefixes")
    several = prefixes.groupBy("shingle").agg(F.min(at_root).alias("low"), F.max(at_root).alias("high")).where("low <> high").select("shingle")
    some = written(keyed_join(prefixes, written(several, "several"), "shingle", "left_semi"), "prefixes")
    # from a shared shingle on, two sets can't share more than what is left of either, this shingle included
    strong = some.where(F.col("left") * (100 + percent) >= 2 * F.col("n") * percent)
    right = some.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "left")])
    larger = (F.col("n") < F.col("n_b")) | (F.col("n") == F.col("n_b")) & (F.col("node") < F.col("node_b"))
    alike = (F.col("n") * 100 >= F.col("n_b") * percent) & (F.least("left", "left_b") * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent)
    met = strong.join(right, "shingle").where((F.col("root") != F.col("root_b")) & larger & alike)
    pairs = written(met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct(), "pairs")
    discard(prefixes, some, common)
    return pairs


def resolved(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, bands: int, rows: int, stars: int) -> DataFrame:
    """(id, text_key, n_shingles, node, component_id) for each row; tables on the way are deleted when the next one is written."""
    rows_ = written(sketched(df, id_col, text_col, size, bands, rows), "sketches")
    # a set's rows carry the same bands, so any one of them will do
    nodes = written(rows_.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("bucket"))
    # hubs are aggregates that combine before the shuffle, and large buckets are split by the join: none of them meets in a task
    many = written(keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket"), "many")
    shared = written(keyed_join(keyed, many, "bucket", "inner"), "shared")
    hubs = [f"hub{k}" for k in range(stars)]
    stars_of = written(shared.groupBy("bucket").agg(*[_hub(k).alias(name) for k, name in enumerate(hubs)]), "stars")
    buckets = written(keyed_join(shared, stars_of, "bucket", "inner", BROADCAST_DIGESTS), "buckets")
    discard(many, shared, stars_of)
    plain = nodes.select("node", "id")

    met = written(buckets.select("node").distinct(), "met")
    involved = written(keyed_join(plain, met, "node", "left_semi", BROADCAST_DIGESTS).select("node", F.col("id").alias(id_col)), "involved")
    texts = keyed_join(df.select(id_col, text_col), involved.select(id_col), id_col, "left_semi")
    if not involved.where(F.col(id_col).isNull()).isEmpty():
        texts = texts.unionByName(df.select(id_col, text_col).where(F.col(id_col).isNull()))
    sets = written(keyed_join(shingle_sets(texts, id_col, text_col, size), met, "node", "left_semi", BROADCAST_DIGESTS).dropDuplicates(["node"]), "sets")

    tried = written(_pairs(buckets, hubs), "pairs")
    roots = written(components(confirmed(tried, sets, percent)), "roots")
    known = written(keyed_join(buckets.select("bucket", "node"), roots, "node", "left", BROADCAST_DIGESTS).withColumn("root", F.coalesce("root", "node")), "known")
    discard(involved, met, tried, buckets)
    apart = written(known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "apart")
    loose = written(keyed_join(known, apart, "bucket", "left_semi").select("node", "root").distinct(), "loose")
    discard(known, apart)
    rest = _rest(sets, loose, percent)
    found = written(confirmed(rest, sets, percent), "links")
    discard(loose, rest, sets)
    if not found.isEmpty():
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)), "roots")

    named = written(keyed_join(plain, roots, "node", "left", BROADCAST_DIGESTS).withColumn("root", F.coalesce("root", "node")), "named")
    # a component of one node keeps its own id, so only the others have to be looked up
    least = written(named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("id").alias("component_id")), "least")
    discard(nodes)
    of_node = keyed_join(named, least, "root", "left", BROADCAST_DIGESTS).select("node", F.when(F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    found = rows_.select("id", "text_key", "n_shingles", "node").join(of_node, "node", "left")
    return found.select("id", "text_key", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, stars: int = STARS
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of `df`: component_id is the least id linked with it, directly or not."""
    kept = F.coalesce(F.col("component_id") == F.col("id"), F.col("component_id").isNull())
    return resolved(df, id_col, text_col, size, percent, bands, rows, stars).select("id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, stars: int = STARS
) -> DataFrame:
    """The rows of `df` without those that have a near-duplicate with a smaller id.

    Rows with the same id and set become one; where texts of one id differ, each is judged by its own set. Rows without id stay.
    """
    copy = ~F.coalesce(F.col("component_id") == F.col("id"), F.lit(True))
    found = written(resolved(df, id_col, text_col, size, percent, bands, rows, stars).where("id is not null").select(F.col("id").alias(id_col), "text_key", "node", copy.alias("copy")), "decided")
    repeated = written(found.groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    gone = written(keyed_join(found.where("copy").select(id_col), repeated, id_col, "left_anti"), "copies")
    if repeated.isEmpty():
        return keyed_join(df, gone, id_col, "left_anti")
    # of a repeated id, the rows of one text, the least by its digest, stand for each set
    of_set = F.coalesce("node", "text_key")
    stays = keyed_join(found.where("not copy"), repeated, id_col, "left_semi").groupBy(id_col, of_set.alias("set")).agg(F.min("text_key").alias("text_key"))
    stays = written(stays.select(id_col, "text_key"), "stays")
    many = keyed_join(df, repeated, id_col, "left_semi").withColumn("text key", _text_key(text_col)).dropDuplicates([id_col, "text key"])
    once = many.join(stays.withColumnsRenamed({"text_key": "text key"}), [id_col, "text key"], "left_semi").select(df.columns)
    return keyed_join(keyed_join(df, repeated, id_col, "left_anti"), gone, id_col, "left_anti").unionByName(once)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by shingles of four words."""
    found = near_duplicates(documents(spark, sf_dir), size=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


# All pairs through shared shingles: exact, for small tables.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[k:k+3], ' ') for k in range(1, len(w) - 2)]) END AS s FROM words),
sized AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, md5(array_to_string(list_sort(s), chr(10))) AS node, s FROM shingled),
nodes AS (SELECT node, min(doc_id) AS doc_id, any_value(n_shingles) AS n, any_value(s) AS s FROM sized WHERE n_shingles > 0 GROUP BY node),
items AS (SELECT doc_id, n, unnest(s) AS s FROM nodes),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT z.doc_id, z.n_shingles, coalesce(r.component_id, z.doc_id) AS component_id, z.doc_id = coalesce(r.component_id, z.doc_id) AS kept
FROM sized z LEFT JOIN nodes n ON z.node = n.node AND z.n_shingles > 0 LEFT JOIN roots r ON r.doc_id = n.doc_id"""
