r"""Language-model scoring: a weighted backoff automaton of smoothed n-grams, walked once from left to right by each text.

Tokens are the words `[^\x20\x09-\x0D]+` of the whole text, A-Z lower-cased, and one end. A text begins in the state of a start
mark. States are the contexts (up to `order` - 1 tokens) that the training texts hold; an arc is an n-gram that they hold and
leads to the longest suffix that is a state; a state without an arc for the token takes its failure arc to the next shorter context:

    arc      log10 P(w | h),  P(w | h) = (c(h w) + WEIGHT * P(w | h')) / (c(h) + WEIGHT),  h' = h without its first token
    failure  log10 (WEIGHT / (c(h) + WEIGHT)),  at the empty context P(w) = (c(w) + ADD) / (N + ADD * (V + 1))

so the probabilities of all known words and of one unknown word add up to 1 in every state, and no n-gram is left out for being rare.

The automaton of a large corpus fits no machine, so it is never built whole. Documents lie in blocks of about BLOCK_BYTES by a hash of
id and text. A block names each distinct n-gram of its texts once, with its count in them; shards, ranges of n-gram hashes, add
the counts up and answer each block with totals in the order asked; the block then builds the part of the automaton that its
own texts can reach, which gives the same walk as the whole. An n-gram that very many documents hold costs one entry a
block. Only two numbers reach the driver. N-grams are compared by 64-bit hashes.

Defined results: a null text is empty, and an empty text is the end alone; rows whose `train` is false or null are scored, but not
counted; repeated rows are counted and scored one by one; without training rows every token is unknown; an empty table gives an
empty result. A text of any length lies in one block, with a few dozen bytes of working memory for each of its words. Only the id and
text columns and `train` are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .language_id import held_out
from .tables import documents, small_batches

ORDER = 2
WEIGHT = 16.0
ADD = 0.1
#: Bytes of text in a block, and of text for which there is one shard of n-grams.
BLOCK_BYTES, SHARD_BYTES = 10 << 20, 8 << 20
#: Tokens whose distinct hashes are found together when words are counted.
COUNTED = 4_000_000

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_STEP, _LEVEL = np.uint64(0xD6E8FEB86659FD93), 0x9FB21C651E98DF25


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start mark, words and end of each text, one text after the other, and where each text begins."""
    data, offsets = wordhash.utf8(column)
    n = len(offsets) - 1
    parts = [wordhash.hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) + (i,) for i, j in wordhash.chunks(offsets)]
    words = np.concatenate([h for h, _, _ in parts]) if parts else np.zeros(0, np.uint64)
    rows = np.concatenate([r + i for _, r, i in parts]) if parts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n) + 2)]).astype(np.int64)
    out = np.empty(starts[-1], np.uint64)
    out[np.arange(len(words)) + 2 * rows + 1] = words
    out[starts[:-1]], out[starts[1:] - 1] = START, END
    return out, starts


def grams(stream: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to `order`: the n-gram hash at every place of the stream, and the places where an n-gram of one text ends in a word or an end."""
    room = np.arange(len(stream)) - np.repeat(starts[:-1], np.diff(starts))  # tokens of the text before this place
    key = stream
    for n in range(1, order + 1):
        if n > 1:
            key = np.concatenate([np.zeros(1, np.uint64), wordhash.mix(key[:-1] * _STEP + stream[1:] + np.uint64(n * _LEVEL % (1 << 64)))])
        yield key, np.flatnonzero(room >= max(n - 1, 1))


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values))


#: Counts from here on are sent as longs of their own, the others, nearly all, as bytes.
LARGE = 127


def _packed(counts: np.ndarray, cut: np.ndarray) -> dict[str, pa.ListArray]:
    """Lists of counts, as bytes and, in the same order, longs for those that are LARGE."""
    large = counts >= LARGE
    return {"counts": _lists(np.minimum(counts, LARGE).astype(np.int8), cut), "large": _lists(counts[large], np.concatenate([[0], np.cumsum(large)])[cut])}


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks])


def _unpacked(table: pa.Table) -> np.ndarray:
    counts = _flat(table, "counts").astype(np.int64)
    counts[counts == LARGE] = _flat(table, "large")
    return counts


def _asked(keys: np.ndarray, counts: np.ndarray, block: int, n_shards: int) -> pa.Table:
    """(shard, block, keys, counts): what a block asks each shard that has a key of it."""
    shard = (keys >> np.uint64(65 - n_shards.bit_length())).astype(np.int32)  # a range of hashes; there are a power of two
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])[: len(keys)])
    edges = np.append(first, len(keys))
    return pa.table({"shard": shard[first], "block": np.full(len(first), block, np.int32), "keys": _lists(keys.view(np.int64), edges), **_packed(counts.astype(np.int64), edges)})


ASKED = "shard int, block int, keys array<long>, counts array<tinyint>, large array<long>"
ANSWERED = "block int, shard int, counts array<tinyint>, large array<long>"


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a shard, their total counts, and the place of every entry's key."""
    keys, place = np.unique(_flat(table, "keys").view(np.uint64), return_inverse=True)
    return keys, np.bincount(place, _unpacked(table), len(keys)).astype(np.int64), place


def totals(df: DataFrame, text_col: str, n_shards: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of all texts of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> list[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _asked(keys, counts, 0, n_shards).to_batches()

        for batch in batches:
            stream, starts = tokens(batch.column(0))
            held.append(np.delete(stream, starts[:-1]))
            size += len(stream)
            if size >= COUNTED:
                yield from counted()
                held, size = [], 0
        if size:
            yield from counted()

    def add(table: pa.Table) -> pa.Table:
        _, counts, _ = _sums(table)
        return pa.table({"n": [int(counts.sum())], "v": [len(counts)]})

    small_batches(df.sparkSession)
    found = df.select(text_col).mapInArrow(run, ASKED).groupBy("shard").applyInArrow(add, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(found[0] or 0), int(found[1] or 0)


class Automaton:
    """States, arcs and failure arcs that the texts of one block can reach.

    A node stands for an n-gram of the block. `arcs[n - 1]` has, for each place of the stream, the node of the n-gram that ends
    there, or -1 if no training text holds it; for n = 1 always a node. A node is an arc, with its weight and the state it leads to,
    and, if it is shorter than the order, a state with a failure arc.
    """

    def __init__(self, stream: np.ndarray, starts: np.ndarray, total_of, order: int, weight: float, n_tokens: int, n_distinct: int):
        start_count = int(total_of(np.array([END]))[0])  # as many starts as ends
        self.root, self.start = 0, 1  # nodes 0 and 1 are the empty context and the start mark
        scale = n_tokens + ADD * (n_distinct + 1)
        unknown = ADD / scale
        # of each node, in order of levels: count, probability as an arc, state after it, failure weight and state, tokens of context
        counts, chance = [np.array([0, start_count])], [np.array([1.0, 1.0])]
        after, fail, depth = [np.array([0, 0])], [np.array([0, 0])], [np.array([0, 1])]
        self.arcs, made = [], 2
        before = None
        for n, (key, places) in enumerate(grams(stream, starts, order), 1):
            distinct, first, inverse = np.unique(key[places], return_index=True, return_inverse=True)
            count, at = total_of(distinct), places[first]
            if n == 1:
                known, suffix = count > 0, np.zeros(len(distinct), np.int64)
                p = (count + ADD) / scale
                node = np.arange(made, made + len(distinct))
                self.known = np.zeros(len(stream), bool)
                self.known[places] = known[inverse]
            else:
                known = count > 0
                suffix, context = before[at], before[at - 1]
                if n == 2:
                    context = np.where(at - 1 == starts[np.searchsorted(starts, at, side="right") - 1], self.start, context)
                lower, held = np.concatenate(chance)[suffix], np.concatenate(counts)[context]
                p = (count + weight * lower) / (held + weight)
                node = np.where(known, np.cumsum(known) - 1 + made, -1)
            kept = known if n > 1 else np.ones(len(distinct), bool)
            counts.append(count[kept])
            chance.append(p[kept])
            fail.append(suffix[kept])
            after.append(np.where(known, node, self.root)[kept] if n < order else suffix[kept])
            depth.append(np.full(int(kept.sum()), n))
            made += int(kept.sum())
            arc = np.full(len(stream), -1, np.int64)
            arc[places] = node[inverse]
            self.arcs.append(arc)
            before = arc
        count = np.concatenate(counts)
        self.start_state = self.start if order > 1 and start_count else self.root
        self.weight = np.log10(np.concatenate(chance))
        self.after, self.fail, self.depth = (np.concatenate(x) for x in (after, fail, depth))
        self.failure = np.log10(weight / (count + weight))
        base = np.log10(np.concatenate([(count[2:] + ADD) / scale, [unknown]]))
        self.base = base[np.where(self.arcs[0] >= 0, self.arcs[0] - 2, -1)]

    def walk(self, start: int, end: int) -> float:
        """log10 probability of the text whose tokens lie in this range of the stream: one traversal that carries the state."""
        weight, after, fail, depth, failure = (memoryview(x) for x in (self.weight, self.after, self.fail, self.depth, self.failure))
        total, state = 0.0, self.start_state
        for arcs in zip(*[a[start + 1 : end].tolist() for a in self.arcs], strict=True):
            while (arc := arcs[depth[state]]) < 0:
                total += failure[state]
                state = fail[state]
            total += weight[arc]
            state = after[arc]
        return total


def scored(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, weight: float = WEIGHT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for each row of `df`, learned from the rows where `train` holds."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(size // block_bytes + 1, spark.sparkContext.defaultParallelism)
    n_shards = 1 << int(max(size // SHARD_BYTES, 4)).bit_length()
    n_tokens, n_distinct = totals(docs.where("train"), "text", n_shards)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int")
    # both uses of the blocks read one shuffle
    blocks = docs.withColumn("block", block).repartition(n_blocks, "block")
    id_type = df.schema[id_col].dataType.simpleString()

    def ask(table: pa.Table) -> pa.Table:
        stream, starts = tokens(table["text"])
        learned = np.repeat(table["train"].to_numpy(), np.diff(starts))
        found = [(key[at], learned[at]) for key, at in grams(stream, starts, order)]
        keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([c for _, c in found]), len(keys))
        return _asked(keys, counts, table["block"][0].as_py(), n_shards)

    def answer(table: pa.Table) -> pa.Table:
        _, sums, place = _sums(table)
        cut = np.concatenate([[0], np.cumsum(pc.list_value_length(table["keys"]).to_numpy())])
        return pa.table({"block": table["block"], "shard": table["shard"], **_packed(sums[place], cut)})

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        stream, starts = tokens(texts["text"])
        told = told.sort_by("shard")
        keys = np.unique(np.concatenate([key[at] for key, at in grams(stream, starts, order)]))
        sums = _unpacked(told)
        automaton = Automaton(stream, starts, lambda asked: _looked_up(keys, sums, asked), order, weight, n_tokens, n_distinct)
        at = starts[:-1] + 1  # behind the start mark
        add = lambda x: np.add.reduceat(np.append(x, 0), np.stack([at, starts[1:]], 1).ravel())[::2]
        score = [automaton.walk(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        columns = {"id": texts["id"], "train": texts["train"], "n_tokens": np.diff(starts) - 1, "n_known": add(automaton.known.astype(np.int64)), "train_tokens": np.full(len(texts), n_tokens)}
        return pa.table(columns | {"base_score": add(automaton.base), "score": np.array(score)})

    asked = blocks.groupBy("block").applyInArrow(ask, ASKED)
    told = asked.groupBy("shard").applyInArrow(answer, ANSWERED)
    schema = f"id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)


def _looked_up(keys: np.ndarray, sums: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Totals of keys; 0 for those that aren't there."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, sums[at], 0)


def op11_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by the two-word model of those that aren't held out."""
    found = scored(documents(spark, sf_dir), ~held_out("doc_id", 10, 0))
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# crc32 byte by byte; its table by the polynomial's rule.
CRC = """
  crc_table AS (SELECT list(crc ORDER BY byte) AS crc_table FROM (
    SELECT byte, list_reduce(range(8), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, byte) AS crc FROM (SELECT unnest(range(256)) AS byte)))"""


def crc32_sql(digits: str) -> str:
    """crc32 of a text of ASCII characters; the query names `crc_table`."""
    return f"xor(list_reduce(list_transform(string_split({digits}, ''), lambda c: ord(c)::BIGINT), lambda crc, b: xor(crc >> 8, crc_table[(xor(crc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


ORACLE = f"""
WITH {CRC},
texts AS (
  SELECT row_number() OVER () AS row, doc_id, {crc32_sql("doc_id::VARCHAR")} % 10 = 0 AS held_out,
    ['<s>'] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') || ['</s> '] AS w
  FROM documents, crc_table),
tokens AS (SELECT row, held_out, unnest(range(2, len(w) + 1)) AS p, w[p - 1] AS h, w[p] AS w FROM texts),
learned AS (SELECT * FROM tokens WHERE NOT held_out),
ones AS (SELECT w, count(*) AS c FROM learned GROUP BY w),
twos AS (SELECT h, w, count(*) AS c FROM learned GROUP BY h, w),
contexts AS (SELECT h, count(*) AS c FROM learned GROUP BY h),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM ones),
weighed AS (
  SELECT t.row, o.c AS known, (coalesce(o.c, 0) + {ADD}::DOUBLE) / (n + {ADD}::DOUBLE * (v + 1)) AS p, coalesce(b.c, 0) AS paired, coalesce(x.c, 0) AS context
  FROM tokens t CROSS JOIN size LEFT JOIN ones o ON t.w = o.w LEFT JOIN twos b ON t.h = b.h AND t.w = b.w LEFT JOIN contexts x ON t.h = x.h),
sums AS (
  SELECT row, count(*) AS n_tokens, count(known) AS n_known, sum(log10(p)) AS base_score, sum(log10((paired + {WEIGHT}::DOUBLE * p) / (context + {WEIGHT}::DOUBLE))) AS score FROM weighed GROUP BY row)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, base_score, score FROM texts JOIN sums USING (row), size"""
