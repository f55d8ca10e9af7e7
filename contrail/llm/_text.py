"""Vectorised text kernel used inside Spark tasks: Arrow strings as one byte buffer, words found and hashed with numpy.

Everything here works on a bounded run of documents (``runs``), so memory follows the run and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """bool[256], true inside the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Words as runs of non-white bytes; white is 0x20 and 0x09 to 0x0D. Bytes of multi-byte characters are never white.
NOT_WHITE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words as runs of ASCII letters, digits and everything beyond ASCII.
WORDLIKE = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection on uint64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> int:
    return int(mix(np.array([int(x) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def runs(offsets: np.ndarray, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about run_bytes each; a longer document is a run of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + run_bytes, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of table's bytes; documents never join."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = table[buf]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    at = off[:-1][off[:-1] < len(buf)]
    first[at] = m[at]
    at = off[1:][off[1:] > 0] - 1
    last[at] = m[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off[1:], start, "right")


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a step."""
    size = end - start
    h = mix(size.astype(np.uint64) * GOLD + np.uint64(1))
    if not len(size):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
    h = mix(h ^ (eight[start] & keep[np.minimum(size, 8)]))
    at, k = np.flatnonzero(size > 8), 8
    while len(at):
        h[at] = mix((h[at] + GOLD) ^ (eight[start[at] + k] & keep[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    return h


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours in h."""
    n = max(0, len(h) - k + 1)
    acc = np.full(n, mix_one(k), np.uint64)
    for j in range(k):
        acc = mix((acc + GOLD) ^ h[j : j + n])
    return acc


def sorted_shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct k-word shingles of each document, lower-cased A-Z, sorted; a document with fewer
    words has its whole sequence as its one shingle, one without words has none."""
    low = LOWER[buf]
    start, end, doc = words(low, off, NOT_WHITE)
    h = span_hashes(low, start, end)
    n = len(off) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    g = chain(h, k)
    whole = doc[: len(g)] == doc[k - 1 :] if len(g) else np.zeros(0, bool)
    g, at = g[whole], doc[: len(g)][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        g = np.concatenate([g, np.array([chain(h[first[d] : first[d + 1]], count[d])[0] for d in short], np.uint64)])
        at = np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
    bound = np.searchsorted(at, np.arange(n + 1))
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        g[a:b].sort()
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (at[1:] != at[:-1])
        g, at = g[new], at[new]
        bound = np.searchsorted(at, np.arange(n + 1))
    return g, bound


def as_long(x: np.ndarray) -> pa.Array:
    """uint64 bits as a Spark long."""
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())
