"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Features of a text are the square roots of the shares of its words, hashed to WORD_BUCKETS and scaled to unit length, and
a few statistics of its structure (shares of letters, digits, signs, capitals and lines, word lengths, repetition) and
its size. The model is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j with RANK factors; the pair term is computed in
time linear in the features, as half of the sum over factors of (sum v_if x_i)^2 - sum v_if^2 x_i^2. It is trained with
Adam on the logistic loss.

Learning takes a bounded sample of labelled rows, MOST_ROWS with the smallest hashes of their doc_id (a parameter).
Scoring covers every row and whole texts, in bounded runs.

Defined cases: null and empty texts have only the constant and size features, and are scored like any other. Labels that
are null or not 0 or 1 are not learnt from; neither are label rows without a document. A document with several labels is
learnt from once for each. If there is nothing to learn from, or only one class, every score is the smoothed share of
label 1. Repeated rows are scored each by itself. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import crc_fold, documents, in_arrow, shared
from contrail.llm._text import LOWER, NOT_WHITE, WORDLIKE, byte_table, runs, span_hashes, utf8, words

WORD_BUCKETS, RANK = 2048, 8
MOST_ROWS, EPOCHS, BATCH, RATE, DECAY = 4000, 12, 64, 0.02, 1e-4
THRESHOLD = 0.3
#: Documents turned into a dense block at a time.
BLOCK_ROWS = 256

LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
CAPITAL, DIGIT = byte_table((0x41, 0x5A)), byte_table((0x30, 0x39))
STOP, COMMA = byte_table((0x2E, 0x2E), (0x3F, 0x3F), (0x21, 0x21)), byte_table((0x2C, 0x2C), (0x3A, 0x3B))
SIGN = byte_table((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
LINE, WHITE = byte_table((0x0A, 0x0A)), ~NOT_WHITE
STATISTICS = 15


def block(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """float32[documents, STATISTICS + WORD_BUCKETS]."""
    n = len(off) - 1
    out = np.zeros((n, STATISTICS + WORD_BUCKETS), np.float32)
    size = np.diff(off)
    per = np.maximum(size, 1)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    letters = total(LETTER[buf])
    low = LOWER[buf]
    s, e, d = words(low, off, WORDLIKE)
    bucket = (span_hashes(low, s, e) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    count = np.bincount(d, minlength=n)
    grid = np.bincount(d * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    some = np.maximum(count, 1)
    out[:, STATISTICS:] = np.sqrt(grid / some[:, None])
    shares = [letters / per, total(CAPITAL[buf]) / np.maximum(letters, 1), total(DIGIT[buf]) / per, total(SIGN[buf]) / per, total(STOP[buf]) / per, total(COMMA[buf]) / per, total(WHITE[buf]) / per, total(LINE[buf]) / per]
    shares += [np.minimum(1, np.bincount(d, e - s, minlength=n) / some / 16), np.minimum(1, total(SIGN[buf]) / some), np.minimum(1, total(STOP[buf]) / some), (grid > 0).sum(axis=1) / some, grid.max(axis=1) / some if WORD_BUCKETS else some]
    shares += [np.log1p(size) / 12, np.minimum(1, np.log1p(count) / 12)]
    out[:, :STATISTICS] = np.stack(shares, axis=1)
    return out


def blocks(column: pa.Array) -> Iterator[np.ndarray]:
    buf, off = utf8(column)
    for lo, hi in runs(off):
        for a in range(lo, hi, BLOCK_ROWS):
            b = min(hi, a + BLOCK_ROWS)
            yield block(buf[off[a] : off[b]], off[a : b + 1] - off[a])


class Machine:
    def __init__(self, width: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.bias = np.zeros(1)
        self.w = np.zeros(width)
        self.v = rng.normal(0, 0.02, (width, RANK))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 20) -> Machine:
        rng = np.random.default_rng(seed)
        params = [self.bias, self.w, self.v]
        m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                xb, yb = x[order[i : i + BATCH]].astype(np.float64), y[order[i : i + BATCH]]
                g = (self.score(xb) - yb) / len(yb)
                sums = xb @ self.v
                gv = xb.T @ (g[:, None] * sums) - ((xb * xb).T @ g)[:, None] * self.v
                t += 1
                for p, grad, a, b in zip(params, (np.array([g.sum()]), xb.T @ g + DECAY * self.w, gv + DECAY * self.v), m1, m2, strict=True):
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad * grad - b)
                    p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self


def learn(labelled: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_ROWS) -> Machine:
    """A machine fitted to at most `most` labelled texts, which are columns of labelled or those of texts with the same id;
    features are made in Spark, and only those rows are fetched. Null labels and ids are not counted."""
    good = labelled.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    # A hash threshold leaves about twice the rows wanted, so that their features are made in all tasks before any are ranked.
    u = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    good = good.filter(u < min(1.0, 2.0 * most / max(1, good.count()) + 1e-6) * (1 << 40))
    if texts is not None:
        good = good.join(texts.select(id_col, text_col), id_col)
    chosen = good.select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("label"), u.alias("u"))

    def featured(batches):
        for batch in batches:
            made = [row for x in blocks(batch.column(0)) for row in x]
            packed = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r != 0].tobytes() for r in made]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], ["x", "label", "u"])

    rows = in_arrow(chosen, featured, "x binary, label double, u long").orderBy("u", "label", "x").limit(most).collect()
    width = STATISTICS + WORD_BUCKETS
    machine = Machine(width)
    y = np.array([r.label for r in rows])
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        machine.bias[0] = np.log(share / (1 - share))
        machine.v[:] = 0
        return machine
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        k = len(r.x) // 6
        x[i, np.frombuffer(r.x, np.uint16, k)] = np.frombuffer(r.x, np.float32, k, 2 * k)
    return machine.fit(x, y)


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of docs."""
    model = shared(docs.sparkSession, machine)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))

    def scored(batches):
        m = model()
        for batch in batches:
            got = [m.score(x) for x in blocks(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(got) if got else [], pa.float64())], ["doc_id", "score"])

    return in_arrow(rows, scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.filter(crc_fold() != 0).select("doc_id", "quality")
    # Only labels whose document is there are counted; then those that can be learnt from meet their texts.
    there = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    machine = learn(there, docs.select("doc_id", "text"))
    out = score_quality(docs, machine)
    return out.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
