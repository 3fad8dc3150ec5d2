r"""Spelling variant grouping: automaton shards hold the segments of every word, and all words are scanned for them.

Words are the maximal runs `[A-Za-zÀ-ÿ]+` of whole texts, only A-Z lower-cased, of at least LEAST_LENGTH code points and LEAST_COUNT
occurrences. Two words are near if they differ by one code point inserted, deleted or replaced. One edit leaves one half of a word as it is,
so a word of p code points is cut in halves, and a word of p or p + 1 code points is near it only if it begins with the first half or
ends with the second. A frame (p, a, b) names a segment: a code points at the begin and b at the end, of words of p. A word is sent
to the shards of the frames that fit its length, four at most; a shard holds its frames' segments in one Aho-Corasick automaton, scans
every word sent to it, and keeps those hits whose offset and length fit the frame. Of these, what lies outside the segment is compared
exactly, by looking up the rest without each of its code points, so a segment that many words share makes no pairs by itself.

Where more than MOST words meet in a frame, the rest is halved again and both halves make finer frames, as often as it takes:
nothing is capped, and no shard holds a group that grows with the words. Counts are added in Spark; per task
words are counted in arrays first, and runs are told apart there by 64-bit hashes.

A word's form is its near word of the largest count (ties: the least in code-point order) if that is at least RATIO times the word's own; roots
are found by doubling steps along forms, whose counts grow by RATIO, so that chains are short.

Defined results: null texts and texts without such a run have no words; a row without id loses no code points in `op12_spelling`; repeated rows
count each time; an empty table gives an empty result. A text of any length is read in pieces, a run as a whole. Only the id and text columns are
read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .lm_scoring import CRC
from .tables import discard, documents, keyed_join, small_batches, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Runs lose a code point where this number divides the crc32 of id and run.
NOISE = 199
#: Words in a frame above which it is cut finer, and rows in a shard on average.
MOST, SHARD_ROWS = 20_000, 60_000
#: Entries of a task's table of counts before it is sent on.
COUNTED = 1_000_000
#: Runs of more bytes are hashed one by one.
LONG = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF
_BETWEEN = ~_LETTER  # bytes behind which a text may be cut
_BETWEEN[0x80:0xC0] = False
_BETWEEN[_LEAD] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of spans, each going on from the crc32 of what comes before it."""
    state = before ^ np.uint32(0xFFFFFFFF)
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    n_long = int(np.searchsorted(-length[order], -LONG))
    for k in order[:n_long].tolist():
        state[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k])) ^ 0xFFFFFFFF
    order = order[n_long:]
    for j in range(int(length[order[0]]) if len(order) else 0):
        order = order[: int(np.searchsorted(-length[order], -j))]
        now = state[order]
        state[order] = _CRC[(now ^ data[starts[order] + j]) & 0xFF] ^ (now >> 8)
    return state ^ np.uint32(0xFFFFFFFF)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    cut = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.arange(cut[-1]) + np.repeat(starts - cut[:-1], ends - starts)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at])))


def _runs(text: pa.Array, ids: pa.Array, noise: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(hash, count, word) of the distinct runs of at least `least` code points, piece by piece; changed runs come singly."""
    data, offsets = wordhash.utf8(text)
    prefix = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else 0 for i in ids.to_pylist()], np.uint32)
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    for raw, cuts, rows in wordhash.pieces(data, offsets, _BETWEEN):
        piece = _LOWER[raw]
        lead = piece == _LEAD
        solid = _LETTER[piece] | lead
        solid[1:] |= lead[:-1]  # in valid text a first byte is followed by its second
        starts, ends, row = wordhash.word_spans(piece, cuts, solid)
        if not len(starts):
            continue
        leads = np.concatenate([[0], np.cumsum(lead)])
        length = ends - starts - (leads[ends] - leads[starts])
        whole = length >= least
        if noise:
            of = rows[row]
            crc = _crcs(piece, starts, ends, prefix[of])
            less = (crc % noise == 0) & named[of]
            for k in np.flatnonzero(less & (length > least)).tolist():
                run = piece[starts[k] : ends[k]].tobytes().decode()
                at = int(crc[k]) % len(run)
                word = (run[:at] + run[at + 1 :]).encode()
                one = np.frombuffer(word, np.uint8)
                yield wordhash.span_hashes(one, np.array([0]), np.array([len(one)])), np.ones(1, np.int64), pa.array([word.decode()], pa.large_string())
            whole &= ~less
        starts, ends = starts[whole], ends[whole]
        hashes, first, counts = np.unique(wordhash.span_hashes(piece, starts, ends), return_index=True, return_counts=True)
        yield hashes, counts.astype(np.int64), _strings(piece, starts[first], ends[first])


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 0, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least `least_count` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            hashes, first, place = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, c, _ in held])).astype(np.int64)
            words = pa.concat_arrays([w for _, _, w in held]).take(pa.array(first)).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts)], ["word", "n"])

        for batch in batches:
            for part in _runs(batch.column(1), batch.column(0), noise, least_length):
                held.append(part)
                size += len(part[0])
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    small_batches(df.sparkSession)
    pieces = df.select(F.col(id_col).cast("string").alias("id"), text_col).mapInArrow(run, "word string, n long")
    return pieces.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(room: Column, a: Column, b: Column) -> Column:
    left = F.floor(room / 2).cast("int")
    return F.array(F.struct((a + left).alias("a"), b.alias("b")), F.struct(a.alias("a"), (b + room - left).alias("b")))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, p, a, b) with the hash of their frame and its segment."""
    word, a, b = F.col("word"), F.col("a"), F.col("b")
    return rows.withColumn("key", F.xxhash64("p", "a", "b", F.substring(word, F.lit(1), a), F.substring(word, F.length(word) - b + 1, b)))


def framed(words: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, p, a, b, key): every word in all frames where near words of it can meet it, none with more than `most` words that can be cut."""
    p = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("p")
    rows = words.select("word", "n", p).select("*", F.inline(_halves(F.col("p"), F.lit(0), F.lit(0))))
    rows, done, used = written(_keyed(rows), "frames"), [], []
    while True:
        used.append(rows)
        room = F.col("p") - F.col("a") - F.col("b")
        hot = rows.groupBy("key").agg(F.count("*").alias("words"), F.max(room).alias("room")).where((F.col("words") > most) & (F.col("room") > 1))
        hot = written(hot.select("key"), "hot-frames")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(keyed_join(rows, hot, "key", "left_anti"))
        finer = keyed_join(rows, hot, "key", "left_semi").select("word", "n", "p", F.inline(_halves(room, F.col("a"), F.col("b"))))
        rows = written(_keyed(finer), "frames")
        used.append(hot)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, used


def _near(table: pa.Table) -> pa.Table:
    """(word, near, n): near words of a shard's rows, in both directions, n the near word's count."""
    rows = list(zip(*[table[c].to_pylist() for c in ("word", "n", "p", "a", "b")], strict=True))
    automaton, groups = ahocorasick.Automaton(), {}
    rest_of, without = {}, defaultdict(list)  # within a frame and segment: the word with this rest, the words with this rest less the code point at i
    for word, n, p, a, b in rows:
        if len(word) != p:
            continue
        segments = (word[:a], word[p - b :])
        group = groups.setdefault((p, a, b, *segments), len(groups))
        for segment in segments:
            if segment:
                automaton.add_word(segment, len(segment))
        rest = word[a : p - b]
        rest_of[group, rest] = (word, n)
        for i in range(len(rest)):
            without[group, i, rest[:i] + rest[i + 1 :]].append((word, n))
    out = []
    if groups:
        automaton.make_automaton()
        for word, n, p, a, b in rows:
            begins = ends = False
            for end, length in automaton.iter(word):
                begins |= length == a and end == a - 1
                ends |= length == b and end == len(word) - 1
            if not ((begins or not a) and (ends or not b)):
                continue
            group = groups.get((p, a, b, word[:a], word[len(word) - b :]))
            if group is None:
                continue
            rest = word[a : len(word) - b]
            for i in range(len(rest)):
                less = rest[:i] + rest[i + 1 :]
                if len(word) == p:
                    out += [(word, *other) for other in without[group, i, less] if other[0] != word]
                elif (other := rest_of.get((group, less))) and (not i or rest[i] != rest[i - 1]):
                    out += [(word, *other), (other[0], word, n)]
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table({"word": pa.array(columns[0], pa.string()), "near": pa.array(columns[1], pa.string()), "n": pa.array(columns[2], pa.int64())})


def near_words(words: DataFrame, most: int = MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, near, m) for each ordered pair of near words of a written table (word, n); m is the near word's count."""
    rows, used = framed(words, most)
    n_shards = used[0].count() // shard_rows + 1
    found = rows.withColumn("shard", F.pmod("key", F.lit(n_shards))).groupBy("shard").applyInArrow(lambda t: _near(t), "word string, near string, n long")
    # an edit between two frames' segments is found in both
    found = written(found.groupBy("word", "near").agg(F.max("n").alias("m")), "near")
    discard(*used)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form): the end of the chain of forms."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, now = now, written(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def grouped(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of a written table (word, n)."""
    near = near_words(words, most)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    enough = -F.col("best.m") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))
    found = written(found, "forms")
    discard(near)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, some of which lose a code point first."""
    return grouped(written(word_counts(documents(spark, sf_dir), noise=NOISE), "words"))


_RUN_BYTES = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))"

ORACLE = rf"""
WITH RECURSIVE {CRC},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce({_RUN_BYTES}, lambda crc, b: xor(crc >> 8, crc_table[(xor(crc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM counted, crc_table),
changed AS (
  SELECT CASE WHEN h IS NOT NULL AND h % {NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {RATIO} * w.n THEN near END AS form, CASE WHEN m >= {RATIO} * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND k = 1),
chain AS (
  SELECT word, form, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, c.form, c.next, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL"""
