"""Removal of repeated passages by longest-previous-factor values in suffix order.

A byte is removed if it lies in a string of SPAN bytes that also starts in a document with a smaller doc_id. For a suffix,
the longest match with an earlier document is met at the nearest suffix before it, or after it, in suffix order that
belongs to a smaller doc_id (previous and next smaller value); where that match is SPAN bytes or more, the suffix's
first SPAN bytes go. The first copy always stays, and everything is judged on the input texts.

A suffix order over all bytes of a corpus is never built whole. Equal strings choose equal anchors: a position is an
anchor if the hash of its GRAM bytes is the least of some SPAN-byte window. Each window contains an anchor, so suffixes
need comparing only among windows around equal anchors:
  1. Anchors go to the task of their hash. Where the whole context of an anchor (every window that contains it) occurs in
     an earlier document, all those windows match. Of equal contexts only the one of the smallest doc_id goes on, and of
     those only the ones that share the left or right half of some window with a different context.
  2. These, mostly at the edges of copied passages, go to the task of the core that the windows of a side share, with the
     bytes around it. There the suffixes at each distance, cut after SPAN bytes and with their common core replaced by its
     hash, are put in order, and the longest previous factors, by previous and next smaller doc_id, decide.
Equal contexts of a batch are combined before they are shuffled, so a passage that is copied everywhere arrives once per
batch; only at its edges, where contexts differ, does each document send its own. Contexts are compared by 80 bits or more
of hash within an anchor, windows by a 64-bit hash of their core and the bytes around it.

Defined cases: null texts are empty. Rows that repeat a doc_id do not match each other, since neither id is smaller. A
null doc_id comes after all others; null ones do not match each other. Texts under SPAN bytes stay whole. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import documents, settle, small
from contrail.llm._text import GOLD, M1, M2, mix, runs, span_hashes, utf8

SPAN, GRAM = 50, 16
#: Windows that contain an anchor at p start in p - LEFT..p; windows from p - HALF on hold [p, p + SPAN - HALF), the others
#: hold [p - HALF, p + GRAM).
LEFT = SPAN - GRAM
HALF = LEFT // 2
LAST = np.int64((1 << 63) - 1)
#: Tasks for each partition of the input.
SPREAD = 4
#: Bytes of text whose anchors, and anchors whose contexts, are held, combined and sent at a time.
PORTION_BYTES, PORTION_ASKS = 8 << 20, 1 << 16


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of x over each width neighbours, by doubling."""
    best, have, pick = x, 1, np.minimum if least else np.maximum
    while have < width:
        step = min(have, width - have)
        best = pick(best[: len(best) - step], best[step:])
        have += step
    return best


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in buf, hashes) of all anchors."""
    n = len(buf)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    eight = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    g = (eight[: n - GRAM + 1] * M1) ^ ((eight[8 : 8 + n - GRAM + 1] + GOLD) * M2)
    g ^= g >> np.uint64(31)
    g *= M2
    g ^= g >> np.uint64(29)
    np.maximum(g, np.uint64(1), out=g)
    window = _slide(g, LEFT + 1, True)
    # Windows that overrun the end of their document do not count.
    inside = np.zeros(len(window) + 1, np.int32)
    first, last = off[:-1], off[1:] - SPAN + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    window[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.concatenate([np.zeros(LEFT, np.uint64), window, np.zeros(len(g) - len(window), np.uint64)])
    p = np.flatnonzero(_slide(padded, LEFT + 1, False)[: len(g)] == g)
    return p, g[p]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): a sort by keys, the first the most significant, and where each run of equal keys begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _firsts(doc: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The smallest doc of each item's group, in the items' own order."""
    out = np.empty(len(doc), np.int64)
    if len(doc):
        out[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(doc))))
    return out


def _pack(doc: np.ndarray, row: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of items whose (doc, row) come in runs, as bytes."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    head = np.array([len(at), len(doc)], np.int64)
    return b"".join([head.tobytes(), doc[at].tobytes(), row[at].tobytes(), np.diff(np.append(at, len(doc))).astype(np.int64).tobytes(), *[np.ascontiguousarray(c).tobytes() for c in columns]])


def _unpack(blobs: list[bytes], *types) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in range(2 + len(types))]
    for b in blobs:
        d, n = np.frombuffer(b, np.int64, 2).tolist()
        at = 16
        doc, row, times = (np.frombuffer(b, np.int64, d, at + 8 * d * i) for i in range(3))
        at += 24 * d
        parts[0].append(np.repeat(doc, times))
        parts[1].append(np.repeat(row, times))
        for i, t in enumerate(types):
            parts[2 + i].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def _blobs(bucket: np.ndarray, n: int, doc: np.ndarray, row: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    keys, out = [], []
    for b in range(n):
        i = order[edge[b] : edge[b + 1]]
        if len(i):
            keys.append(b)
            out.append(_pack(doc[i], row[i], *[c[i] for c in columns]))
    return keys, out


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(int(LAST)))


SENT = ["bucket", "kind", "blob"]
ANCHOR_TYPES = (np.uint32, np.uint32, np.uint16, np.uint16, np.uint16, np.int32)


def _send_anchors(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, (buf, off) = _ids(batch.column(0)), np.asarray(batch.column(1)), utf8(batch.column(2))
        for first, last in runs(off, PORTION_BYTES):
            yield from _anchor_blobs(ids[first:last], rows[first:last], buf[off[first] : off[last]], off[first : last + 1] - off[first], n)


def _anchor_blobs(ids: np.ndarray, rows: np.ndarray, buf: np.ndarray, off: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    parts = []
    for lo, hi in runs(off):
        part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        p, h = anchors(part, o)
        if not len(p):
            continue
        d = np.searchsorted(o[1:], p, "right")
        a, z = o[:-1][d], o[1:][d]
        left, right = np.maximum(a, p - LEFT), np.minimum(z, p + SPAN)
        x = span_hashes(part, left, right) ^ ((p - left).astype(np.uint64) * GOLD)
        # Halves that overrun the document are 0, which no other half is; no window holds them.
        fore = np.where(p + SPAN - HALF <= z, np.maximum(span_hashes(part, p, np.minimum(z, p + SPAN - HALF)) >> np.uint64(48), np.uint64(1)), 0).astype(np.uint16)
        back = np.where(p - HALF >= a, np.maximum(span_hashes(part, np.maximum(a, p - HALF), p + GRAM) >> np.uint64(48), np.uint64(1)), 0).astype(np.uint16)
        parts.append((h, x, fore, back, d + lo, (p - a).astype(np.int32)))
    if not parts:
        return
    h, x, fore, back, d, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
    doc, row = ids[d], rows[d]
    order, starts = _groups(h ^ mix(x))
    first = _firsts(doc, order, starts)
    later = doc > first
    # Of equal contexts of one document, or of one doc_id, all stay; they are few.
    bucket = (mix(h) >> np.uint64(40)).astype(np.int64) % n
    keys, blobs = _blobs(bucket[~later], n, *(c[~later] for c in (doc, row, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(48)).astype(np.uint16), fore, back, pos)))
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], SENT)
    keys, blobs = _blobs(bucket[later], n, doc[later], row[later], pos[later])
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([1] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], SENT)


FOUND = "kind int, doc long, row long, pos int"
#: Kinds of what is found: a context that matches whole; an anchor whose later, or earlier, windows are to be compared; a window that matches.
WHOLE, FORE, BACK, WINDOW = 0, 1, 2, 3


def _out(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    kind = np.concatenate([np.full(len(d), k, np.int32) for k, d, _, _ in parts]) if parts else np.zeros(0, np.int32)
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (1, 2, 3)]
    return pa.table({"kind": pa.array(kind, pa.int32()), "doc": pa.array(cols[0], pa.int64()), "row": pa.array(cols[1], pa.int64()), "pos": pa.array(cols[2], pa.int32())})


def _meet_anchors(key, table):
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    parts = []
    doc, row, pos = _unpack([b for k, b in zip(kinds, blobs, strict=True) if k == 1], np.int32)
    parts.append((WHOLE, doc, row, pos))
    doc, row, h, x, y, fore, back, pos = _unpack([b for k, b in zip(kinds, blobs, strict=True) if k == 0], *ANCHOR_TYPES)
    if len(doc):
        h = h.astype(np.uint64)
        context = (h << np.uint64(32)) | x
        order, starts = _groups(context, y)
        first = _firsts(doc, order, starts)
        later = doc > first
        parts.append((WHOLE, doc[later], row[later], pos[later]))
        i = np.flatnonzero(~later)
        own = mix(context[i] + GOLD) ^ y[i]
        for kind, half in ((FORE, fore), (BACK, back)):
            j = i[half[i] != 0]
            mine = own[half[i] != 0]
            order, starts = _groups((h[j] << np.uint64(16)) | half[j])
            s = mine[order]
            sizes = np.diff(np.append(starts, len(j)))
            several = np.zeros(len(j), bool)
            if len(j):
                mixed = (np.minimum.reduceat(s, starts) != np.maximum.reduceat(s, starts))
                ids = doc[j][order]
                mixed &= np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
                several[order] = np.repeat(mixed, sizes)
            parts.append((kind, doc[j][several], row[j][several], pos[j][several]))
    return _out(parts)


def _smaller(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place of a suffix order, the common prefix (lcp[i] is that of places i - 1 and i) with the nearest place
    before it of a smaller doc, the previous smaller value; 0 where there is none. A place whose candidate is not smaller
    goes on from the candidate's own, so distances double; places without a common prefix left are done."""
    at, common = np.arange(-1, len(doc) - 1), lcp.copy()
    open_ = np.flatnonzero((at >= 0) & (common > 0))
    while True:
        open_ = open_[(common[open_] > 0) & (at[open_] >= 0)]
        open_ = open_[doc[at[open_]] >= doc[open_]]
        if not len(open_):
            return np.where(at >= 0, common, 0)
        near = at[open_]
        at[open_], common[open_] = at[near], np.minimum(common[open_], np.where(at[near] >= 0, common[near], 0))


def longest_previous(doc: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix (uint8[items, bytes]): its longest common prefix with an item of a smaller
    doc. In suffix order that is met at the previous or the next smaller doc; the larger of the two common prefixes, each
    the least of those between neighbours on the way, is the factor's length."""
    n, width = suffix.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = suffix
    packed = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((doc, *packed.T[::-1]))
    lcp = np.zeros(n + 1, np.int64)
    differ = packed[order[1:]] != packed[order[:-1]]
    same = ~differ.any(axis=1)
    lcp[1:n][same] = width
    rest = np.flatnonzero(~same)
    lcp[1:n][rest] = (suffix[order[1:][rest]] != suffix[order[:-1][rest]]).argmax(axis=1)
    ordered = doc[order]
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(_smaller(ordered, lcp[:n]), _smaller(ordered[::-1], lcp[:0:-1])[::-1])
    return out


#: Bytes on either side of the core that all windows of one side of an anchor share.
SIDE = HALF


def _send_contexts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """For each anchor to be compared: a hash of the core of its windows, the bytes around the core, and which windows lie
    in the document. The windows of a side begin at a..b; their core is [b, a + SPAN)."""
    for batch in batches:
        ids, rows, (buf, off) = np.asarray(batch.column(0)), np.asarray(batch.column(1)), utf8(batch.column(2))
        asks = batch.column(3)
        ask_at = asks.offsets.to_numpy().astype(np.int64)
        d = np.searchsorted(ask_at[1:], np.arange(ask_at[0], ask_at[-1]), "right")
        ask = np.asarray(asks.values)[ask_at[0] : ask_at[-1]]
        for i in range(0, len(ask), PORTION_ASKS):
            yield from _context_blobs(ids, rows, buf, off, d[i : i + PORTION_ASKS], ask[i : i + PORTION_ASKS], n)


def _context_blobs(ids: np.ndarray, rows: np.ndarray, buf: np.ndarray, off: np.ndarray, d: np.ndarray, ask: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    p, fore = ask >> 2, (ask & 3) == FORE
    a, b = np.where(fore, p - HALF, p - LEFT), np.where(fore, p, p - HALF - 1)
    size, base = np.diff(off)[d], off[:-1][d]
    lo, hi = np.maximum(a, 0), np.minimum(b, size - SPAN)
    ok = lo <= hi
    d, fore, a, b, size, base, lo, hi = (x[ok] for x in (d, fore, a, b, size, base, lo, hi))
    if not len(d):
        return
    h = span_hashes(buf, base + b, base + a + SPAN) ^ np.where(fore, np.uint64(0), GOLD)
    at = np.arange(SIDE)
    around = np.zeros((len(d), 2 * SIDE), np.uint8)
    for start, col in ((a, 0), (a + SPAN, SIDE)):
        j = start[:, None] + at
        good = (j >= 0) & (j < size[:, None]) & (at < (b - a)[:, None])
        around[:, col : col + SIDE] = np.where(good, buf[np.where(good, base[:, None] + j, 0)], 0)
    bucket = (h >> np.uint64(20)).astype(np.int64) % n
    items = around.view(f"V{2 * SIDE}").ravel()
    keys, blobs = _blobs(bucket, n, ids[d], rows[d], h, a.astype(np.int32), (lo - a).astype(np.uint8), (hi - a).astype(np.uint8), fore.astype(np.uint8), items)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], SENT)


def _meet_contexts(key, table):
    doc, row, h, a, lo, hi, fore, items = _unpack(table.column("blob").to_pylist(), np.uint64, np.int32, np.uint8, np.uint8, np.uint8, f"V{2 * SIDE}")
    around = np.ascontiguousarray(items).view(np.uint8).reshape(len(doc), 2 * SIDE)
    core = h.astype(">u8").view(np.uint8).reshape(len(doc), 8)
    parts = []
    for t in range(HALF + 1):
        # The window that begins t bytes after a is the core with what follows t on the left and the first t on the right.
        for side, width in ((1, HALF), (0, LEFT - HALF - 1)):
            i = np.flatnonzero((fore == side) & (lo <= t) & (t <= hi)) if t <= width else np.zeros(0, np.int64)
            if len(i):
                window = np.concatenate([core[i], around[i, t:width], around[i, SIDE : SIDE + t]], axis=1)
                hit = i[longest_previous(doc[i], window) == window.shape[1]]
                parts.append((WINDOW, doc[hit], row[hit], a[hit] + np.int32(t)))
    return _out(parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        buf, off = utf8(batch.column(1))
        marks = batch.column(2)
        spans, kept = [], []
        for k in range(batch.num_rows):
            text = buf[off[k] : off[k + 1]]
            own = marks[k]
            if not own.is_valid or not len(own.values):
                spans.append([])
                kept.append(text.tobytes())
                continue
            own = np.asarray(own.values)
            p, window = own >> 1, (own & 1) == 1
            lo, hi = np.where(window, p, np.maximum(0, p - LEFT)), np.minimum(len(text), p + SPAN)
            ok = hi - lo >= SPAN
            depth = np.zeros(len(text) + 1, np.int32)
            np.add.at(depth, lo[ok], 1)
            np.add.at(depth, hi[ok], -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (maximal removed runs of bytes) and kept (the bytes that stay)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"), F.xxhash64("text").alias("row"), "text")
    n = max(16, SPREAD * docs.rdd.getNumPartitions())
    sent = base.select("doc", "row", "text").mapInArrow(lambda it: _send_anchors(it, n), "bucket int, kind int, blob binary")
    found = settle(sent.groupBy("bucket").applyInArrow(_meet_anchors, FOUND))
    asked = found.filter(F.col("kind").isin(FORE, BACK))
    asks = asked.groupBy("doc", "row").agg(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 2).bitwiseOR(F.col("kind").cast("long"))).alias("asks"))
    asks = settle(asks)
    # Of the texts only those with such anchors are shuffled, where their keys are few enough to be sent to the scan.
    windows = base.join(small(asks.select("doc", "row")), ["doc", "row"], "left_semi").join(asks, ["doc", "row"])
    sent = windows.select("doc", "row", "text", "asks").mapInArrow(lambda it: _send_contexts(it, n), "bucket int, kind int, blob binary")
    match = sent.groupBy("bucket").applyInArrow(_meet_contexts, FOUND)
    marks = found.filter(F.col("kind") == WHOLE).union(match).select("doc", "row", (F.col("pos").cast("long") * 2 + (F.col("kind") == WINDOW).cast("long")).alias("mark"))
    marks = settle(marks.groupBy("doc", "row").agg(F.collect_set("mark").alias("marks")))
    keys = small(marks.select("doc", "row"))
    # Texts without a match need not be shuffled where the keys are few enough to be sent to them.
    hit = base.join(keys, ["doc", "row"], "left_semi").join(marks, ["doc", "row"]).select("doc_id", "text", "marks")
    clean = base.join(keys, ["doc", "row"], "left_anti").select("doc_id", "text", F.lit(None).cast("array<long>").alias("marks"))
    return hit.union(clean).mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    kept = F.octet_length("kept").cast("long")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
