"""Exact Jaccard self-join on sets of word n-grams, size-aware: fixed-size subsets for small sets, inverted lists for
large ones, and the classes of near-copies that its links form.

Two sets of sizes n and m with Jaccard similarity of at least t share c(n, m) = ceil(t (n + m) / (1 + t)) elements.
  * Small sets (size up to a boundary) list all their subsets of every size c(n, m) that a small partner may ask for;
    two small sets link only if they list a common subset.
  * A large set scans the inverted lists of its rarest n - ceil(t n) + 1 elements, of which any partner must hold one
    among its own; partners just below the boundary are entered in these lists too.
  * The boundary is the size at which listing subsets begins to cost more rows than scanning lists, taken from the
    counts of set sizes.
"Rarest" is by a table of bucket counts over all sets (a sketch of fixed size), so elements of widely shared passages
come last and hardly ever get a list. Every candidate is verified on the sets themselves.

Only the classes are needed, so copies are never expanded into all pairs: equal sets are one class from the start; each
list first compares its members with its most central member only (the one with the fewest elements that no other set
lists), the classes so far are formed, and then only members of different classes are compared. Of lists with the same
members one is enough. That join has filters that lose nothing (sizes, position in the list order, parity bitmaps of two to
four bits an element), so that hardly a pair leaves it that is not a link or within a hundredth of one. No link between
different classes is lost, so classes are exact.

Defined cases: null or empty texts have the empty set, which links with nothing; a text with fewer words than n has its
whole word sequence as its one element. Rows that repeat a doc_id appear once each and are in one class, which has the
links of all their texts. Rows without a doc_id take no part and have a null class. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import documents, in_arrow, packed, settle, small
from contrail.llm._text import GOLD, as_long, mix, runs, sorted_shingles, utf8
from contrail.llm.components import connected_components

#: Buckets of the frequency table, and pieces in which the tables of tasks are added up.
BUCKETS, PIECES = 1 << 20, 16
#: Sizes up to this may be handled by subsets.
MOST_SMALL = 40
#: Lists of up to so many members are short.
SHORT_LIST = 6
#: One in so many elements is counted for the cost of scanning lists.
SEEN = 64
WORD_BITS = 64
BITMAP_WORDS = 4
WORDS = ("w0", "w1", "w2", "w3")


def need(n: int, m: int, num: int, den: int) -> int:
    """Least intersection of sets of sizes n and m with Jaccard similarity num / den or more."""
    return -(-num * (n + m) // (num + den))


def prefix(n, num: int, den: int):
    """Elements of the prefix: n - ceil(t n) + 1."""
    return n + (-num * n // den) + 1


def subset_sizes(n: int, top: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets a small set lists for partners up to size top."""
    return sorted({need(n, m, num, den) for m in range(-(-num * n // den), min(top, n * den // num) + 1) if m > 0 and need(n, m, num, den) <= min(n, m)})


def boundary(sizes: dict[int, int], scan: float, num: int, den: int) -> int:
    """The size up to which sets are small, at least cost in rows made and lists scanned. scan: other members that an
    element of a small set meets in its list. Of equal costs the larger boundary is taken."""
    best = (float("inf"), 0)
    for top in range(MOST_SMALL + 1):
        cost = sum(k * (sum(comb(n, c) for c in subset_sizes(n, top, num, den)) if n <= top else prefix(n, num, den) * (1 + scan)) for n, k in sizes.items())
        best = min(best, (cost, -top))
    return -best[1]


def met(told: DataFrame, num: int, den: int) -> float:
    """Members of other sets that an element in the prefix of a small set meets on average in its inverted list. Lists are
    counted for a fixed share of the elements; prefixes hold the rarest elements, so of the sampled ones, by rising count,
    only the share that prefixes take counts. The figure only serves the choice of the boundary."""
    seen = told.filter("kind = 'seen'").groupBy("s1").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("small"))
    rows = sorted((r.members, r.small, r.lists) for r in seen.groupBy("members").agg(F.sum("small").alias("small"), F.count(F.lit(1)).alias("lists")).collect())
    left = sum(small for _, small, _ in rows) * prefix(MOST_SMALL, num, den) / MOST_SMALL
    wanted, total = left, 0.0
    for members, small, _ in rows:
        total += (members - 1) * min(small, left)
        left -= min(small, left)
    return total / wanted if wanted else 0.0


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind 'set': doc_id, n, two hashes of the whole set, parity bitmaps), (kind 'seen': a sampled element as s1, with
    n = 1 if its set is small), then (kind 'freq': piece, counts)."""
    counts = np.zeros(BUCKETS, np.int64)
    task = TaskContext.get().partitionId()
    names = ["kind", "doc_id", "n", "s1", "s2", "w0", "w1", "w2", "w3", "map", "blob"]
    longs = pa.list_(pa.int64())
    for batch in batches:
        ids, (buf, off) = batch.column(0), utf8(batch.column(1))
        for lo, hi in runs(off):
            h, bound = sorted_shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
            n = np.diff(bound)
            counts += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            maps = np.zeros((hi - lo, BITMAP_WORDS), np.uint64)
            if len(full):
                at = bound[:-1][full]
                s1[full], s2[full] = np.add.reduceat(mix(h + GOLD), at), np.add.reduceat(mix(h ^ GOLD), at)
                bit = (h >> np.uint64(32)) % np.uint64(WORD_BITS * BITMAP_WORDS)
                one = np.uint64(1) << (bit % np.uint64(WORD_BITS))
                for w in range(BITMAP_WORDS):
                    maps[full, w] = np.bitwise_xor.reduceat(np.where(bit // np.uint64(WORD_BITS) == w, one, np.uint64(0)), at)
            size = hi - lo
            fine = [fine_map(h[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            edge = np.concatenate([[0], np.cumsum([len(f) for f in fine])]).astype(np.int32)
            fine = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), as_long(np.concatenate(fine)))
            yield pa.RecordBatch.from_arrays([pa.array(["set"] * size, pa.string()), ids.slice(lo, size), pa.array(n, pa.int64()), as_long(s1), as_long(s2), *[as_long(maps[:, w]) for w in range(BITMAP_WORDS)], fine, pa.nulls(size, pa.binary())], names)
            at = np.flatnonzero((h >> np.uint64(24)) % np.uint64(SEEN) == 0)
            own = (n <= MOST_SMALL)[np.searchsorted(bound[1:], at, "right")]
            yield pa.RecordBatch.from_arrays([pa.array(["seen"] * len(at), pa.string()), pa.nulls(len(at), pa.int64()), pa.array(own.astype(np.int64)), as_long(h[at]), *[pa.nulls(len(at), pa.int64())] * 5, pa.nulls(len(at), longs), pa.nulls(len(at), pa.binary())], names)
    step = BUCKETS // PIECES
    blobs = [zlib.compress(counts[i * step : (i + 1) * step].tobytes(), 1) for i in range(PIECES)]
    yield pa.RecordBatch.from_arrays([pa.array(["freq"] * PIECES), pa.array([task] * PIECES, pa.int64()), pa.array(range(PIECES), pa.int64()), *[pa.nulls(PIECES, pa.int64())] * 6, pa.nulls(PIECES, longs), pa.array(blobs, pa.binary())], names)


def fine_map(h: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set as words, of two to four times as many bits as it has elements, a power of two. The bits in
    which two maps differ are no more than the elements in which the sets do. A map folds to half its size by xor."""
    bits = max(64, 1 << (int(max(1, len(h)) - 1).bit_length() + 1))
    odd = np.bincount((h >> np.uint64(12)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def apart(x: str, y: str) -> str:
    """SQL for a lower bound of the size of the symmetric difference, from two fine maps; the longer one is folded."""
    fold = lambda a, b: f"if(size({a}) <= size({b}), {a}, transform(sequence(0, size({b}) - 1), i -> aggregate(sequence(0, size({a}) div size({b}) - 1), 0L, (s, j) -> s ^ get({a}, int(i + j * size({b}))))))"
    return f"aggregate(zip_with({fold(x, y)}, {fold(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"


def least(num: int, den: int) -> str:
    """SQL for need() of x.n and y.n."""
    return f"(({num}L * (x.n + y.n) + {num + den - 1}) div {num + den})"


def _added(key, table):
    total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in table.column("blob").to_pylist())
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def bucket_counts(freq: DataFrame) -> np.ndarray:
    """The summed table of fixed size; tables of tasks are added in two steps."""
    two = freq.select("piece", "blob", F.pmod("task", F.lit(256)).alias("part")).groupBy("piece", "part").applyInArrow(_added, "piece long, blob binary")
    one = two.groupBy("piece").applyInArrow(_added, "piece long, blob binary").collect()
    pieces = {r.piece: np.frombuffer(zlib.decompress(r.blob), np.int64) for r in one}
    return np.concatenate([pieces[i] for i in range(PIECES)]) if pieces else np.zeros(BUCKETS, np.int64)


def _postings(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, top: int, rank) -> Iterator[pa.RecordBatch]:
    """(token, doc_id, n, pos): rarest elements of large sets with their position in list order; subsets of small sets
    with pos -1. Sets just below the boundary have both."""
    rank, edge = rank.value, -(-num * (top + 1) // den)
    sizes = {n: subset_sizes(n, top, num, den) for n in range(1, top + 1)}
    for batch in batches:
        ids, (buf, off) = np.asarray(batch.column(0)), utf8(batch.column(1))
        for lo, hi in runs(off):
            h, bound = sorted_shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
            n = np.diff(bound)
            key = (rank[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
            tokens, doc, pos = [], [], []
            for d in np.flatnonzero((n > 0) & (n <= top)).tolist():
                own = mix(h[bound[d] : bound[d + 1]] + GOLD)
                for c in sizes[len(own)]:
                    out = len(own) - c
                    whole = own.sum(dtype=np.uint64)
                    if out == 0:
                        left = np.array([whole])
                    else:
                        drop = np.array(list(combinations(range(len(own)), out)))
                        left = whole - own[drop].sum(axis=1, dtype=np.uint64)
                    tokens.append(mix(left + np.uint64(c)) | np.uint64(0xFF << 56))
                    doc.append(np.full(len(left), d))
                    pos.append(np.full(len(left), -1))
            for d in np.flatnonzero(n >= max(edge, 1)).tolist():
                p = int(prefix(int(n[d]), num, den))
                own = key[bound[d] : bound[d + 1]]
                own = np.sort(np.partition(own, p - 1)[:p]) if p < len(own) else np.sort(own)
                tokens.append(own)
                doc.append(np.full(len(own), d))
                pos.append(np.arange(len(own)))
            if tokens:
                doc = np.concatenate(doc)
                yield pa.RecordBatch.from_arrays([as_long(np.concatenate(tokens)), pa.array(ids[lo:hi][doc], pa.int64()), pa.array(n[doc], pa.int32()), pa.array(np.concatenate(pos), pa.int32())], ["token", "doc_id", "n", "pos"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = utf8(batch.column(1))
        for lo, hi in runs(off):
            h, bound = sorted_shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
            blobs = [h[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["doc_id", "set"])


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("xs"), batch.column("ys"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and den * both >= num * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def fine_maps(told: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, n, map) of the ids."""
    sets = told.filter("kind = 'set'").select("doc_id", F.col("n").cast("int").alias("n"), "map")
    return sets.join(small(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def ends(pairs: DataFrame) -> DataFrame:
    return settle(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())


def verified(pairs: DataFrame, told: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs(a, b) whose sets reach the similarity. The fine maps leave few pairs; only the texts that those name leave
    their scan."""
    maps = settle(fine_maps(told, ends(pairs)))
    x, y = maps.alias("x"), maps.alias("y")
    pairs = pairs.join(x, F.expr("a = x.doc_id")).join(y, F.expr("b = y.doc_id"))
    pairs = settle(pairs.filter(F.expr(f"{apart('x.map', 'y.map')} <= x.n + y.n - 2 * {least(num, den)}")).select("a", "b"))
    texts = docs.join(small(ends(pairs)), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sets = settle(in_arrow(texts.select("doc_id", "text"), lambda it: _sets(it, k), "doc_id long, set binary"))
    rows = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("xs")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("ys")), "b")
    return in_arrow(rows.select("a", "b", "xs", "ys"), lambda it: _compare(it, num, den), "a long, b long")


def near_copies(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", top: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; component_id is the smallest doc_id that links reach. top
    sets the boundary between small and large sets (0: inverted lists for all), which is otherwise chosen by cost."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told = described(docs, k)
    repeated = told.filter("kind = 'set' and n > 0 and doc_id is not null").groupBy("doc_id").agg(F.countDistinct("n", "s1", "s2").alias("sets")).filter("sets > 1")
    if repeated.isEmpty():
        return _classes(docs, told, k, num, den, top)
    # Rows that repeat a doc_id with other words get ids of their own, and are one class in the end.
    rows = settle(docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    own = rows.select(F.col("row").alias("doc_id"), "text")
    found = settle(_classes(own, described(own, k), k, num, den, top).withColumnsRenamed({"doc_id": "row", "component_id": "class"}).join(rows.select("row", F.col("doc_id").alias("id")), "row"))
    # A doc_id, marked by its sign so that it is no row, meets the classes of its rows; rows without words stay alone.
    linked = found.filter("n_shingles > 0")
    meet = linked.select(F.col("class").alias("a"), F.col("id").alias("i")).distinct()
    first = meet.groupBy("i").agg(F.min("a").alias("b"))
    joined = connected_components(settle(meet.join(first, "i").select("a", "b").distinct()))
    linked = linked.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("class", F.coalesce("component", "class"))
    name = linked.groupBy("class").agg(F.min("id").alias("component_id"))
    full = linked.join(name, "class").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
    empty = found.filter("n_shingles = 0")
    # A row without words has the class of its doc_id where another row of it has one.
    empty = empty.select("id", "n_shingles").join(full.groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("c")), "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("c", "id").alias("component_id"))
    return full.unionByName(empty).unionByName(_without_id(told))


def described(docs: DataFrame, k: int) -> DataFrame:
    return settle(in_arrow(docs, lambda it: _describe(it, k), "kind string, doc_id long, n long, s1 long, s2 long, w0 long, w1 long, w2 long, w3 long, map array<long>, blob binary"))


def _without_id(told: DataFrame) -> DataFrame:
    return told.filter("kind = 'set' and doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))


def _classes(docs: DataFrame, told: DataFrame, k: int, num: int, den: int, top: int | None) -> DataFrame:
    """near_copies of rows whose ids have one set each."""
    spark = docs.sparkSession
    table = bucket_counts(told.filter("kind = 'freq'").select(F.col("n").alias("piece"), F.col("doc_id").alias("task"), "blob"))
    rank = spark.sparkContext.broadcast(np.minimum(np.floor(8 * np.log2(table + 1.0)), 254).astype(np.uint8))
    sets = told.filter("kind = 'set'")
    if top is None:
        sizes = {r.n: r["count"] for r in sets.filter(F.col("n").between(1, MOST_SMALL)).groupBy("n").count().collect()}
        top = boundary(sizes, met(told, num, den), num, den)

    # Equal sets are one class; its smallest doc_id stands for it.
    real = sets.filter("n > 0 and doc_id is not null")
    first = settle(real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first"), *[F.min_by(w, "doc_id").alias(w) for w in WORDS]))
    heads = first.select(F.col("first").alias("doc_id"), *WORDS)

    lists = settle(in_arrow(docs.filter("doc_id is not null"), lambda it: _postings(it, k, num, den, top, rank), "token long, doc_id long, n int, pos int"))
    # Only lists with two members matter, and of equal sets only the first.
    shared = lists.groupBy("token").count().filter("count > 1").select("token")
    lists = settle(lists.join(shared, "token").join(small(heads.select("doc_id")), "doc_id", "left_semi"))
    fits = f"least(x.n, y.n) * {den}L >= greatest(x.n, y.n) * {num}L and not (x.pos >= 0 and greatest(x.n, y.n) <= {top})"
    # The member that shares most of its prefix is the most central one.
    alone = lists.groupBy("doc_id", "n").agg(F.expr(f"n - ({num}L * n + {den - 1}) div {den} + 1 - count_if(pos >= 0)").alias("alone")).select("doc_id", "alone")
    by = lists.join(small(alone), "doc_id")
    hubs = by.groupBy("token").agg(F.min(F.struct("alone", "doc_id", "n", "pos")).alias("h"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("token", "h.*")
    star = lists.alias("y").join(hubs.alias("x"), F.expr(f"x.token = y.token and x.doc_id <> y.doc_id and {fits}"))
    star = settle(star.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct())
    edges = settle(verified(star, told, docs, k, num, den))

    classes = connected_components(edges)
    members = lists.join(small(classes.withColumnRenamed("node", "doc_id")), "doc_id", "left").withColumn("class", F.coalesce("component", "doc_id")).drop("component")
    members = settle(members)
    seen = members.groupBy("token").agg(
        F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("x1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x2")
    )
    # Of the lists with more than one class, one of each set of members.
    open_lists = settle(seen.filter("lo < hi").groupBy(F.expr("pos < 0").alias("subset"), "size", "x1", "x2").agg(F.min("token").alias("token")).select("token", "size"))
    members = members.join(small(open_lists), "token")
    differ = " + ".join(f"bit_count(x.w{w} ^ y.w{w})" for w in range(BITMAP_WORDS))
    most = f"x.n + y.n - 2 * {least(num, den)}"
    near = (
        f"x.token = y.token and x.doc_id < y.doc_id and x.class <> y.class and {fits}"
        f" and (x.pos < 0 or least(x.pos, y.pos) + 1 + least(x.n - x.pos, y.n - y.pos) - 1 >= {least(num, den)}) and {differ} <= {most}"
    )
    # Short lists have few pairs a member whatever they are; in long ones the members carry their fine maps to the join.
    short = settle(members.filter(F.col("size") <= SHORT_LIST).join(heads, "doc_id"))
    long = members.filter(F.col("size") > SHORT_LIST).join(heads, "doc_id")
    long = settle(long.join(fine_maps(told, settle(long.select("doc_id").distinct())).drop("n"), "doc_id"))
    pairs = lambda rows, on: rows.alias("x").join(rows.alias("y"), F.expr(on)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    rest = pairs(short, near).union(pairs(long, f"{near} and {apart('x.map', 'y.map')} <= {most}")).distinct()
    rest = settle(rest.join(star, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        classes = connected_components(edges.union(settle(verified(rest, told, docs, k, num, den))))

    label = first.join(classes.withColumnRenamed("node", "first"), "first", "left").select("n", "s1", "s2", F.coalesce("component", "first").alias("component"))
    out = sets.join(label, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-copies: of each class the smallest doc_id stays, with all its columns. Rows that repeat a
    doc_id stay or go together."""
    found = near_copies(docs, k, num, den, id_col, text_col)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return packed(docs, _id=id_col).join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))
