"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

A document is its token ids and one closing id. Documents longer than a sequence are cut from their end into pieces of a
sequence's length, so only the first piece may be shorter. Pieces that fill a sequence are one. Of the rest, each is placed
where the sum of the squared counts of open sequences per residual gap becomes smallest: that keeps gaps of many sizes at hand
instead of many equal ones that nothing fits. A new sequence is opened when the piece fits in none. All pieces of a group are
known, so longer ones go first; ties go to the smaller gap.

Pieces are dealt into groups of about GROUP by their number, each packed by one task, which holds only numbers and lengths. Of
every group at most one in AGAIN of its sequences, the emptiest that are not full, are taken apart, and their pieces go to the
next level, where AGAIN groups become one, until one group is left. So a task's work is bounded at any size of the table, all
pieces are placed, and what the groups waste is used up: on the check tables no level is more than a few sequences above total
tokens / length.

Texts are tokenised once. pieces() yields the ids themselves; settle() writes what the caller keeps of them with a number that
only serves to bring the places back.

Defined cases: null and empty texts are the closing id alone. Long texts and long words are whole. Repeated rows are packed as
often as they occur; a null doc_id is kept. An empty table gives an empty result. Strings of special tokens become these
tokens, as usual for the tokenizer file. Other columns do not pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import documents, in_arrow, packed, settle
from contrail.llm._text import runs, utf8
from contrail.llm._tokenizers import BYTE_BPE, ByteTokens

LENGTH, CLOSING = 2048, 0
GROUP, AGAIN = 8192, 8


def squares_packing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, which is from 1 to capacity; sequences are numbered from 0."""
    gaps = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap; none counts at 0
    holds: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fits = size + np.flatnonzero(gaps[size:])
        if len(fits):
            # Moving a sequence from gap g to g - size adds 2 * (count there - count here + 1), or 1 - 2 * count when it is full.
            grown = 2 * (gaps[fits - size] - gaps[fits] + 1)
            if fits[0] == size:
                grown[0] = 1 - 2 * gaps[size]
            gap = int(fits[grown.argmin()])
            own = holds[gap].pop()
            gaps[gap] -= 1
        else:
            gap, own, made = capacity, made, made + 1
        sequence[at], offset[at] = own, capacity - gap
        if gap > size:
            gaps[gap - size] += 1
            holds[gap - size].append(own)
    return sequence, offset


def pieces(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, tokenizer: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document."""
    own = packed(docs, _id=id_col, _text=text_col).select("_id", F.col("_text").cast("string").alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(tokenizer, special=True)
        for batch in batches:
            _, off = utf8(batch.column(1))
            for lo, hi in runs(off):
                found = [np.append(tokens.ids(t or ""), closing).astype("<u4") for t in batch.column(1)[lo:hi].to_pylist()]
                whole = np.array([len(x) for x in found])
                parts = -(-whole // length)
                doc = np.repeat(np.arange(hi - lo), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = whole - (parts - 1) * length
                start = np.where(piece > 0, first[doc] + (piece - 1) * length, 0)
                size = np.where(piece > 0, length, first[doc])
                ids = [found[d][a : a + n].tobytes() for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return in_arrow(own, cut, f"doc_id {own.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def place(numbered: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """sequence_id and offset of each row of numbered(uid, length), whose uid is its own; lengths are 1 to capacity."""

    def packing(key: tuple, table: pa.Table) -> pa.Table:
        size = table["length"].to_numpy()
        own, offset = squares_packing(size, capacity)
        used = np.bincount(own, size).astype(np.int64)
        again = np.zeros(len(used), bool)
        emptiest = np.argsort(used, kind="stable")[: len(used) // AGAIN if key[2].as_py() else 0]
        again[emptiest[used[emptiest] < capacity]] = True
        # Level, group and sequence in one long: at most 127 levels, 2^35 groups and 2^20 sequences of a group.
        name = (key[1].as_py() << 55) + (key[0].as_py() << 20) + own
        return pa.table({"uid": table["uid"], "length": table["length"], "grp": table["grp"], "sequence_id": pa.array(name), "offset": pa.array(offset), "again": pa.array(again[own])})

    full = numbered.filter(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.filter(F.col("length") < capacity)
    groups, level, done = max(1, -(-rest.count() // group)), 0, [full]
    rest = rest.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp"))
    while True:
        tagged = rest.select("*", F.lit(level).cast("long").alias("level"), F.lit(groups > 1).alias("more"))
        out = settle(tagged.groupBy("grp", "level", "more").applyInArrow(packing, "uid long, length long, grp long, sequence_id long, offset long, again boolean"))
        done.append(out.filter(~F.col("again")).select("uid", "sequence_id", "offset"))
        if groups == 1:
            return reduce(DataFrame.union, done)
        groups, level = -(-groups // AGAIN), level + 1
        rest = out.filter("again").select("uid", "length", F.pmod("grp", F.lit(groups)).alias("grp"))


def pack(found: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """found, rows of pieces() with any columns but at least length, with sequence_id and offset."""
    own = [c for c in found.columns if c not in ("sequence_id", "offset")]
    numbered = settle(found.select(*own, F.monotonically_increasing_id().alias("uid")))
    return numbered.join(place(numbered.select("uid", "length"), capacity, group), "uid").select(*own, "sequence_id", "offset")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (the bytes of the whole sequence) and the doc_ids in it, from pack() of pieces with their ids. A
    sequence has at most as many pieces as tokens."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    grouped = packed_pieces.groupBy("sequence_id").agg(held.alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("held", lambda x: x["doc_id"]).alias("doc_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(found)
