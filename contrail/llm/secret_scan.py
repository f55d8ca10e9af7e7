"""Secret scan with corpus-wide ownership frequency.

Spans of three base kinds (assignments to names like `token`, access keys, long hex runs) and further candidates (long
mixed runs of high entropy) are found in every text. The value of each is hashed, and for each hash the distinct
repositories and owners that hold it are counted over the whole corpus. A value held by several owners or repositories
is a copied example; one held by a single owner looks live. Base spans are always reported; a further candidate is
reported only if it looks live.

Defined cases: a null text is empty and has no span. A null owner or repository counts as one of its own. Repeated rows
are scanned each by itself and count once for their owner. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import documents, in_arrow, settle
from contrail.llm._text import byte_table, runs, utf8, words

# The base patterns.
ASSIGN = re.compile(
    rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "token")

HEX = byte_table((0x30, 0x39), (0x61, 0x66))
UPPER = byte_table((0x30, 0x39), (0x41, 0x5A))
MIXED = byte_table((0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
#: A further candidate: at least so long, with lower and upper case and digits, and so many bits a character.
LEAST_TOKEN, LEAST_ENTROPY = 20, 3.5
#: A value looks live if at most so many owners and repositories hold it.
MOST_OWNERS, MOST_REPOS = 1, 1

SPAN = "struct<kind:int,start:int,end:int,value:string>"


def entropy(b: bytes) -> float:
    p = np.bincount(np.frombuffer(b, np.uint8)) / len(b)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def _mixed(b: bytes) -> bool:
    return bool(re.search(rb"[a-z]", b) and re.search(rb"[A-Z]", b) and re.search(rb"[0-9]", b)) and entropy(b) >= LEAST_ENTROPY


def spans_of(buf: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int, bytes]]]:
    """{document: [(kind, start byte, end byte, value)]}, by start and kind."""
    found: dict[int, list[tuple[int, int, int, bytes]]] = {}
    raw, at = buf.tobytes(), off.tolist()
    for table, least in ((UPPER, LEAST_ACCESS), (HEX, LEAST_HEX)):
        s, e, d = words(buf, off, table)
        long = e - s >= least
        for a, b, k in zip(s[long].tolist(), e[long].tolist(), d[long].tolist(), strict=True):
            if table is UPPER:
                # A key takes everything from its first AKIA to the end of the run.
                a = raw.find(b"AKIA", a, b)
                if a < 0 or b - a < least:
                    continue
            found.setdefault(k, []).append((1 if table is UPPER else 2, a - at[k], b - at[k], raw[a:b]))
    signs = np.flatnonzero((buf == 0x3A) | (buf == 0x3D))
    for k in np.unique(np.searchsorted(off[1:], signs, "right")).tolist():
        for m in ASSIGN.finditer(raw[at[k] : at[k + 1]]):
            if len(m[2]) >= LEAST_ASSIGN:
                found.setdefault(k, []).append((0, m.start(), m.end(), m[2]))
    s, e, d = words(buf, off, MIXED)
    long = e - s >= LEAST_TOKEN
    for a, b, k in zip(s[long].tolist(), e[long].tolist(), d[long].tolist(), strict=True):
        a0, b0 = a - at[k], b - at[k]
        if all(y <= a0 or b0 <= x for _, x, y, _ in found.get(k, ())) and _mixed(raw[a:b]):
            found.setdefault(k, []).append((3, a0, b0, raw[a:b]))
    return {k: sorted(v, key=lambda x: (x[1], x[0])) for k, v in found.items()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for batch in batches:
        buf, off = utf8(batch.column(0))
        out: list[list] = [[] for _ in range(batch.num_rows)]
        for lo, hi in runs(off):
            part = buf[off[lo] : off[hi]]
            local = off[lo : hi + 1] - off[lo]
            for k, spans in spans_of(part, local).items():
                # Bytes that begin a character, to turn byte offsets into code points.
                heads = np.concatenate([[0], np.cumsum((part[local[k] : local[k + 1]] & 0xC0) != 0x80)])
                out[lo + k] = [{"kind": c, "start": int(heads[a]), "end": int(heads[b]), "value": hashlib.sha256(v).hexdigest()} for c, a, b, v in spans]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], pa.array(out, kind)], [*batch.schema.names[1:], "found"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id and spans, array<struct<kind, start, end, value, owners, repos, live>> in code
    points, by start and kind; value is the SHA-256 of the secret."""
    slim = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = in_arrow(slim, _scan, f"doc_id {kind}, repo string, owner string, found array<{SPAN}>")
    rows = settle(rows.withColumn("row_key", F.monotonically_increasing_id()))
    one = rows.select("row_key", "repo", "owner", F.explode("found").alias("s")).select("row_key", "repo", "owner", "s.*")
    # Distinct holders first, with map-side combining, so a value copied everywhere is a few rows when it is counted.
    holders = one.select("value", F.struct("repo").alias("r"), F.struct("owner").alias("o")).distinct()
    held = holders.groupBy("value").agg(F.countDistinct("o").alias("owners"), F.countDistinct("r").alias("repos"))
    live = (F.col("owners") <= MOST_OWNERS) & (F.col("repos") <= MOST_REPOS)
    judged = one.join(held, "value").withColumn("live", live).filter((F.col("kind") < 3) | F.col("live"))
    back = judged.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repos", "live"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,owners:bigint,repos:bigint,live:boolean>>")
    return rows.select("row_key", "doc_id").join(back, "row_key", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def _joined(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )
