"""Alignment of two tokenizers over the same texts, by interval coalescing, and how often their tokens go together.

Tokens are byte ranges. All tokens of A and B are sorted by start, the running maximum of their ends is taken, and a group ends
where a start reaches it; so groups are cut where tokens of both end. Within a group the overlapping pairs of an A and a B token
are expanded: they are the links. An id pair's count is the number of documents that hold it linked, over the whole corpus.

Texts are tokenised and aligned once, a run of documents at a time; what is found, with each document's distinct id pairs, is
written to the checkpoint folder. Counts are summed in the tasks before the shuffle, so pairs that every text has cost no more
than others. The most frequent pairs, MOST at most, are brought to the tasks that score links; rarer ones are joined in a
shuffle, where no key is hot as these are rare. The highest count of each A id, at most as many as A has ids, goes along.

Defined cases: texts that are null or empty, or whose bytes are not those that the tokens of A and of B join to (unknown
characters, a U+2581 in the text), have no tokens. Strings of special tokens are plain text. Long texts and words are whole.
Repeated rows are documents of their own; a null doc_id is kept. An empty table gives an empty result. Other columns do not pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import documents, in_arrow, packed, settle
from contrail.llm._text import runs, utf8
from contrail.llm._tokenizers import BYTE_BPE, PIECES, ByteTokens, PieceTokens

#: An id pair in one long is A's id times this and B's.
BASE = 1 << 31
#: Pairs whose counts are brought to the tasks, in 16 bytes each.
MOST = 2_000_000


class Tokens:
    """Tokens of a run of documents: ids, byte ranges that go on from document to document, and the document of each."""

    def __init__(self, ids: list[np.ndarray], sizes: np.ndarray):
        self.count = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        self.end = np.cumsum(sizes[self.ids])
        self.start = self.end - sizes[self.ids]


def both(texts: list[str | None], a: ByteTokens, b: PieceTokens) -> tuple[Tokens, Tokens]:
    """Tokens of space + text by A, and of text by B, which adds the space."""
    left, right = [], []
    for text, pieces in zip(texts, b.ids([t or "" for t in texts]), strict=True):
        ids = a.ids(" " + text) if text else np.zeros(0, np.uint32)
        same = text and (want := b" " + text.encode()) == b"".join([b.bytes[i] for i in pieces]) and want == b"".join([a.bytes[i] for i in ids.tolist()])
        left.append(ids if same else np.zeros(0, np.uint32))
        right.append(np.array(pieces if same else [], np.int64))
    return Tokens(left, np.array([len(x) for x in a.bytes])), Tokens(right, np.array([len(x) for x in b.bytes]))


def coalesce(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, numbered in order."""
    start, end = np.concatenate([a.start, b.start]), np.concatenate([a.end, b.end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.zeros(len(order), np.int64)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return group[: len(a.ids)], group[len(a.ids) :]


def links(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(place in A, place in B) of all tokens whose byte ranges overlap."""
    first, last = np.searchsorted(b.end, a.start, "right"), np.searchsorted(b.start, a.end, "left")
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def numerals(most: int) -> np.ndarray:
    """uint8[3, most, 8]: decimal numbers below most after a comma, a semicolon and a bar, filled up with zeros."""
    out = np.zeros((3, most, 8), np.uint8)
    n = np.arange(most)
    size = np.searchsorted(10 ** np.arange(1, 8), n, "right") + 1
    for k in range(int(size.max(initial=1))):
        some = size > k
        out[:, some, 1 + k] = 0x30 + n[some] // 10 ** (size[some] - 1 - k) % 10
    out[:, :, 0] = np.frombuffer(b",;|", np.uint8)[:, None]
    return out


def _digests(a: Tokens, b: Tokens, ga: np.ndarray, gb: np.ndarray, table: np.ndarray) -> list[str]:
    """By document, sha256 of its groups as `a1,a2|b1;a3|b2,b3`; '' without tokens. table: numerals of all ids."""
    n = len(a.ids) + len(b.ids)
    side = np.concatenate([2 * ga, 2 * gb + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    # Before a token stands a comma in its list, a bar where B's list begins, a semicolon where a group does.
    new = np.ones(n, bool)
    new[1:] = side[1:] != side[:-1]
    signs = table[np.where(new, side % 2 + 1, 0), np.concatenate([a.ids, b.ids])[order]]
    shown = signs != 0
    text = signs[shown].tobytes()
    stop = np.append(0, np.cumsum(shown.sum(axis=1)))[np.append(0, np.cumsum(a.count + b.count))].tolist()
    return ["" if lo == hi else hashlib.sha256(text[lo + 1 : hi]).hexdigest() for lo, hi in zip(stop[:-1], stop[1:], strict=True)]


FOUND = "n_a long, n_b long, n_groups long, n_links long"


def align(docs: DataFrame, a_tokenizer: str = BYTE_BPE, b_tokenizer: str = PIECES, spans: bool = True, pairs: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups and n_links.

    With spans also a_ids, a_ends, a_group and b_ids, b_ends, b_group: ids, byte offsets in space + text where tokens end, and
    the number of the group of each, from 0. Without spans groups_sha256, a digest of the groups.
    With pairs also pairs, the sorted distinct id pairs that are linked (A's id * BASE + B's), and times, their links."""
    own = packed(docs, _id=id_col, _text=text_col).select("_id", F.col("_text").cast("string").alias("_text"))
    sides = ("a_ids", "a_ends", "a_group", "b_ids", "b_ends", "b_group")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = ByteTokens(a_tokenizer), PieceTokens(b_tokenizer)
        table = numerals(max(len(left.bytes), len(right.bytes)))
        for batch in batches:
            _, off = utf8(batch.column(1))
            for lo, hi in runs(off):
                a, b = both(batch.column(1)[lo:hi].to_pylist(), left, right)
                ga, gb = coalesce(a, b)
                at, bt = links(a, b)
                doc = np.repeat(np.arange(hi - lo), a.count)
                first = np.cumsum(a.count) - a.count  # A has tokens in a document where B has, so its groups tell the number
                groups = np.zeros(hi - lo, np.int64)
                some = a.count > 0
                base = np.append(ga, 0)[np.minimum(first, len(ga))]
                groups[some] = ga[first[some] + a.count[some] - 1] - base[some] + 1
                out = [batch.column(0)[lo:hi], *map(pa.array, (a.count, b.count, groups, np.bincount(doc[at], minlength=hi - lo)))]
                if spans:
                    zero = np.append(a.start, 0)[np.minimum(first, len(a.start))]
                    for t, g in ((a, ga), (b, gb)):
                        out += [_lists(t.ids, t.count, pa.int32()), _lists(t.end - np.repeat(zero, t.count), t.count, pa.int64()), _lists(g - np.repeat(base, t.count), t.count, pa.int32())]
                else:
                    out.append(pa.array(_digests(a, b, ga, gb, table), pa.string()))
                if pairs:
                    key = a.ids[at] * BASE + b.ids[bt]
                    order = np.lexsort((key, doc[at]))
                    key, of = key[order], doc[at][order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                    place = np.flatnonzero(new)
                    count = np.bincount(of[place], minlength=hi - lo)
                    out += [_lists(key[place], count, pa.int64()), _lists(np.diff(np.append(place, len(key))), count, pa.int32())]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {own.schema['_id'].dataType.simpleString()}, {FOUND}"
    schema += "".join(f", {c} array<{'long' if c.endswith('ends') else 'int'}>" for c in sides) if spans else ", groups_sha256 string"
    schema += ", pairs array<long>, times array<int>" if pairs else ""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return in_arrow(own, aligned, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair and count, the number of rows of found that hold it among their pairs."""
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))


def scored(found: DataFrame, most: int = MOST) -> DataFrame:
    """found, rows of align() with their pairs, with n_best (links whose pair has the highest count of its A id) and count_sum
    (of the counts of all links) in place of pairs and times."""
    spark = found.sparkSession
    own = [c for c in found.columns if c not in ("pairs", "times", "n_best", "count_sum")]
    found = settle(found.select(*own, "pairs", "times", F.monotonically_increasing_id().alias("_uid")))
    counts = settle(pair_counts(found))
    top = counts.groupBy(F.shiftright("pair", 31).alias("a")).agg(F.max("count").alias("top"))
    highest = np.array(top.collect(), np.int64).reshape(-1, 2)
    best = np.zeros(int(highest[:, 0].max(initial=0)) + 1, np.int64)
    best[highest[:, 0]] = highest[:, 1]
    # The least power of two such that pairs with that count or more are at most `most`.
    sizes = dict(counts.groupBy(F.floor(F.log2("count")).cast("int")).count().collect())
    level, kept = max(sizes, default=0) + 1, 0
    while level and kept + sizes.get(level - 1, 0) <= most:
        level -= 1
        kept += sizes.get(level, 0)
    frequent = counts.filter(F.col("count") >= 1 << level).toArrow().sort_by("pair") if level else counts.toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast((frequent["pair"].to_numpy(), frequent["count"].to_numpy(), best))
    rare = level > 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times_seen, highest_of = known.value
        for batch in batches:
            pair, times = batch.column("pairs"), batch.column("times")
            n = np.diff(pair.offsets.to_numpy())
            key, weight = pair.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(batch)), n)
            at = np.searchsorted(keys, key)
            hit = np.append(keys, -1)[at] == key
            count = np.where(hit, np.append(times_seen, 0)[at], 0)
            total, top_links = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(total, doc, count * weight)
            np.add.at(top_links, doc, np.where(hit & (count == highest_of[key // BASE]), weight, 0))
            out = [*(batch.column(c) for c in own), pa.array(top_links), pa.array(total)]
            if rare:
                left = np.bincount(doc[~hit], minlength=len(batch))
                out += [batch.column("_uid"), _lists(key[~hit], left, pa.int64()), _lists(weight[~hit], left, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*own, "n_best", "count_sum", *(["_uid", "pairs", "times"] if rare else [])])

    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in own) + ", n_best long, count_sum long"
    if not rare:
        return in_arrow(found, score, kinds)
    part = settle(in_arrow(found, score, f"{kinds}, _uid long, pairs array<long>, times array<long>"))
    rows = part.select("_uid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_uid", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    tops = F.broadcast(spark.createDataFrame(highest.tolist(), "a long, top long"))
    joined = rows.join(counts.filter(F.col("count") < 1 << level), "pair").join(tops, F.shiftright("pair", 31) == F.col("a"))
    more = joined.groupBy("_uid").agg(F.sum(F.when(F.col("count") == F.col("top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("count") * F.col("times")).alias("_sum"))
    out = part.join(more, "_uid", "left")
    return out.select(*own, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(align(documents(spark, sf_dir), spans=False, pairs=True))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
