"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D (those bytes never occur inside a multi-byte UTF-8
character, so splitting bytes equals splitting code points). A-Z are lower-cased, nothing else. A word's hash is a
polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed; no Python loop runs over words. Bytes are taken in
pieces of about CHUNK_BYTES, also within a long row, so that working memory is a few MB besides the hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C55 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)  # so that a zero byte counts

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:  # powers for one huge word aren't kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer row stands alone and is never cut."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def _cuts(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of pieces of about CHUNK_BYTES, cut behind separator bytes only, and the row of each piece."""
    edges, rows = [0], []
    for row, end in enumerate(offsets[1:].tolist()):
        while end - edges[-1] > CHUNK_BYTES:
            at, cut = edges[-1] + CHUNK_BYTES // 2, end
            for a in range(at, end, CHUNK_BYTES):  # the first separator from the middle of a piece on
                if len(found := np.flatnonzero(separators[data[a : min(a + CHUNK_BYTES, end)]])):
                    cut = a + int(found[0]) + 1
                    break
            edges.append(cut)
            rows.append(row)
        edges.append(end)
        rows.append(row)
    return np.array(edges, np.int64), np.array(rows, np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each offset) in portions of about CHUNK_BYTES; longer rows are cut behind separator bytes."""
    cuts, of = _cuts(data, offsets, separators)
    for i, j in chunks(cuts):
        yield data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], of[i:j]


def piecewise(data: np.ndarray, offsets: np.ndarray, words: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`words` (hash and row of each word) over rows that are cut into pieces of about CHUNK_BYTES, behind a separator byte, if they are longer."""
    if len(data) <= CHUNK_BYTES:
        return words(data, offsets)
    cuts, of = _cuts(data, offsets, separators)
    parts = [words(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]) + (i,) for i, j in chunks(cuts)]
    return np.concatenate([h for h, _, _ in parts]), of[np.concatenate([r + i for _, r, i in parts])]


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word in the bytes of some rows (offsets start at 0); `solid` marks the bytes of words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[data] if solid is None else solid
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    edge[:] = False
    edge[offsets[1:]] = True
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = _LOWER[data] if lower else data.astype(np.uint64) + np.uint64(1)
    values *= _power(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(data, starts, ends), rows


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    return piecewise(data, offsets, _hashed, _SPACE)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row: (hash, row), by row then hash.

    A row with fewer than `size` words, but at least one, has one shingle of all its words; one without words has none.
    """
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    multiplier = [np.uint64(mult) for mult in _power(0xD6E8FEB86659FD93, size + 1)[1:]]
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n = len(hashes)
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        full += hashes[k : k + len(full)] * multiplier[k]
    keep = rows[: len(full)] == rows[size - 1 : size - 1 + len(full)] if len(full) else np.zeros(0, bool)
    out, out_rows = mix(full[keep]), rows[: len(full)][keep]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            whole[has] += hashes[first[short[has]] + k] * multiplier[k]
        whole = mix(whole ^ mix(counts[short].astype(np.uint64)))
        out, out_rows = np.concatenate([out, whole]), np.concatenate([out_rows, short])
    order = np.lexsort((out, out_rows))
    out, out_rows = out[order], out_rows[order]
    if not len(out):
        return out, out_rows
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (out_rows[1:] != out_rows[:-1])
    return out[new], out_rows[new]
