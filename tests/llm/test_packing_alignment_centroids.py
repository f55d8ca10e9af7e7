import bisect
import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from contrail.llm import centroids, packing, token_alignment
from contrail.llm._tokenizers import BYTE_BPE, PIECES, WHITE_RUN, ByteTokens, PieceTokens

ODD = ["", " ", "a", "\u0000x", "<|endoftext|> and <s></s> <unk>", "▁ mark", "naïve 你好 🙂 ퟿", " " * (3 * WHITE_RUN) + "x", "x" * 20000, "\n\n\t  tab", "I'll they've  don't", "   ", "é" * 999, None]
DIGEST = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts_of(path):
    t = pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def slow(special):
    t = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    t.encode_special_tokens = not special
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# ---- tokenizers


@pytest.mark.parametrize("special", [False, True])
def test_ids_are_those_of_the_tokenizer_file(small_dir, special):
    ours, theirs = ByteTokens(special=special), slow(special)
    for text in [*[t or "" for t in ODD], *[t or "" for _, t in texts_of(small_dir)[:200]]]:
        assert ours.ids(text).tolist() == theirs(text), text[:60]
    assert (50256 in ours.ids(ODD[4]).tolist()) == special


def test_bytes_of_tokens_join_to_the_text():
    a, b = ByteTokens(), PieceTokens()
    for text in [t for t in ODD if t and "▁" not in t]:
        assert b"".join(a.bytes[i] for i in a.ids(" " + text).tolist()) == (" " + text).encode()
        assert b"".join(b.bytes[i] for i in b.ids([text])[0]) == (" " + text).encode(), text[:60]


# ---- packing


def plain_squares(lengths, capacity):
    """The rule, by trying every open sequence."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    gaps = collections.Counter()
    made = 0
    for i in order:
        tried = []
        for g in sorted(g for g in gaps if gaps[g] and g >= lengths[i]):
            after = gaps.copy()
            after[g] -= 1
            if g > lengths[i]:
                after[g - lengths[i]] += 1
            tried.append((sum(n * n for n in after.values()), g, after))
        if tried:
            gaps = min(tried, key=lambda x: x[:2])[2]
        else:
            made += 1
            if capacity > lengths[i]:
                gaps[capacity - lengths[i]] += 1
    return made, collections.Counter({g: n for g, n in gaps.items() if n})


@pytest.mark.parametrize("seed", range(6))
def test_each_piece_goes_where_the_squares_are_smallest(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, (40, 60, 15)[seed % 3], 300)
    own, offset = packing.squares_packing(lengths, 60)
    used = np.bincount(own, lengths).astype(int)
    assert (len(used), collections.Counter((60 - used[used < 60]).tolist())) == plain_squares(lengths.tolist(), 60)
    for s in range(len(used)):
        at = np.sort(offset[own == s])
        assert at.tolist() == np.concatenate([[0], np.cumsum(lengths[own == s][np.argsort(offset[own == s])])[:-1]]).tolist() and used[s] <= 60


def cut(ids, length):
    first = (len(ids) - 1) % length + 1
    edges = [0, *range(first, len(ids) + 1, length)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def check_packing(rows, found, length):
    encode = slow(True)
    want = collections.Counter()
    for d, text in rows:
        ids = [*encode(text), 0]
        for p, (a, b) in enumerate(cut(ids, length)):
            want[(d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        end = 0
        for offset, size in sorted(v):
            assert offset == end
            end += size
        assert end <= length
    return len(by)


def test_packing_of_the_table(spark, small_dir):
    found = packing.query(spark, small_dir).collect()
    made = check_packing(texts_of(small_dir), found, 2048)
    assert made <= -(-sum(r.length for r in found) // 2048) + 2


def test_packing_in_levels_and_odd_rows(spark, messy, messy_rows, nothing):
    from pyspark.sql import functions as F

    found = packing.pieces(messy, length=64).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    out = packing.pack(found, 64, group=20).collect()
    made = check_packing([r[:2] for r in messy_rows], out, 64)
    assert made <= 1.01 * sum(r.length for r in out) / 64 + 2
    assert packing.pack(packing.pieces(nothing)).count() == 0
    odd = [(i, t) for i, t in enumerate(ODD)]
    found = packing.pieces(spark.createDataFrame(odd, "doc_id long, text string")).select("*", F.crc32("ids").alias("ids_crc32"))
    check_packing(odd, packing.pack(found).collect(), 2048)


def test_sequences_hold_the_ids_of_their_pieces(spark, tiny):
    found = packing.pack(packing.pieces(spark.read.parquet(f"{tiny}/documents.parquet")))
    parts = collections.defaultdict(list)
    for r in found.collect():
        parts[r.sequence_id].append((r.offset, bytes(r.ids), r.doc_id))
    got = {r.sequence_id: (bytes(r.ids), r.doc_ids) for r in packing.sequences(found).collect()}
    assert got == {s: (b"".join(x[1] for x in sorted(v)), [x[2] for x in sorted(v)]) for s, v in parts.items()}


# ---- alignment


def plain_alignment(rows):
    encode, model = slow(False), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    a_bytes, b_bytes = ByteTokens().bytes, PieceTokens().bytes
    documents, counts = [], collections.Counter()
    for _, text in rows:
        a, b = (encode(" " + text), model.encode(text)) if text else ([], [])
        if b"".join(a_bytes[i] for i in a) != b"".join(b_bytes[i] for i in b) or text and b"".join(a_bytes[i] for i in a) != (" " + text).encode():
            a, b = [], []
        ends = [np.cumsum([len(of[i]) for i in ids], dtype=int).tolist() for ids, of in ((a, a_bytes), (b, b_bytes))]
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = bisect.bisect_right(ends[0], e), bisect.bisect_right(ends[1], e)
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            spans = [(([0, *ends[0]])[x], ends[0][x], a[x]) for x in range(i, i2)], [(([0, *ends[1]])[x], ends[1][x], b[x]) for x in range(j, j2)]
            links += [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
            i, j = i2, j2
        documents.append((a, b, groups, links))
        counts.update(set(links))
    top = collections.Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    for (d, _), (a, b, groups, links) in zip(rows, documents, strict=True):
        yield d, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""


def test_alignment_of_the_table(spark, small_dir):
    got = collections.Counter(tuple(r[c] for c in ("doc_id", *DIGEST)) for r in token_alignment.query(spark, small_dir).collect())
    assert got == collections.Counter(plain_alignment(texts_of(small_dir)))


@pytest.mark.parametrize("most", [token_alignment.MOST, 400, 20, 0])
def test_rare_pairs_in_a_shuffle_and_odd_rows(spark, messy, messy_rows, most):
    rows = [r[:2] for r in messy_rows] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = messy.select("doc_id", "text", "row", "score").unionByName(spark.createDataFrame(rows[len(messy_rows) :], "doc_id long, text string"), allowMissingColumns=True)
    out = token_alignment.scored(token_alignment.align(docs, spans=False, pairs=True), most)
    assert collections.Counter(tuple(r[c] for c in ("doc_id", *DIGEST)) for r in out.collect()) == collections.Counter(plain_alignment(rows))


def test_spans_of_groups_and_no_rows(spark, nothing):
    text = "naïve tokenization, 你好 <s>"
    (r,) = token_alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    a, b = ByteTokens(), PieceTokens()
    whole = (" " + text).encode()
    for ids, ends, table in ((r.a_ids, r.a_ends, a.bytes), (r.b_ids, r.b_ends, b.bytes)):
        assert [whole[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)] == [table[i] for i in ids]
    cuts = lambda ends, group: [e for e, g, after in zip(ends, group, [*group[1:], -1], strict=True) if g != after]
    assert cuts(r.a_ends, r.a_group) == cuts(r.b_ends, r.b_group) == sorted(set(r.a_ends) & set(r.b_ends)) and r.n_groups == max(r.a_group) + 1
    assert token_alignment.scored(token_alignment.align(nothing, spans=False, pairs=True)).count() == 0


# ---- centroids


def plain_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, [int(x) for x in np.floor(256.0 * np.array(v, float))]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for c, vs in own.items():
            middle[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    return collections.Counter((i, c, d, inertia[c], inertia.total(), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, c, d in found)


def tuples(frame):
    return collections.Counter(tuple(r[c] for c in ("vec_id", *centroids.ADDED)) for r in frame.collect())


def test_clusters_of_the_table(spark, tiny):
    t = pq.read_table(f"{tiny}/embeddings.parquet").to_pydict()
    assert tuples(centroids.query(spark, tiny)) == plain_clusters(list(zip(t["vec_id"], t["embedding"], strict=True)))


def test_clusters_and_their_twin(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small_dir}/embeddings.parquet'")
    got = con.execute(centroids.SQL).fetchall()
    assert tuples(centroids.query(spark, small_dir)) == collections.Counter(got)


def test_search_finds_the_nearest_and_measures_few():
    r = np.random.default_rng(4)
    for spread in (0, 400, 10_000_000):
        middle = r.integers(-200, 200, (90, 16)) + r.integers(-spread, spread + 1, (90, 1))
        x = middle[r.integers(0, 90, 3000)] + r.integers(-30, 30, (3000, 16))
        middle[7] = middle[3]  # a tie
        x[:5], x[5:9] = middle[3], 0
        d = ((x[:, None] - middle[None]) ** 2).sum(axis=2)
        own, best, measured = centroids.nearest(x, middle)
        assert (own == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert spread == 0 or measured < 0.25 * len(x) * len(middle)


def test_odd_vectors(spark):
    r = np.random.default_rng(5)
    v = lambda: [float(x) for x in r.normal(0, 1, 64)]
    same = v()
    rows = [(i, v()) for i in range(60)] + [(100 + i, same) for i in range(300)] + [(1, v()), (1, v()), (2, None), (3, []), (4, v()[:63]), (5, [*v(), 0.5]), (6, [None, *v()[1:]]), (7, [float("nan"), *v()[1:]]), (8, [float("-inf"), *v()[1:]]), (None, v()), (9, [0.0] * 64), (10, [-0.0] * 64), (11, [-1e-9] * 64)]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<double>, cluster string")
    assert tuples(centroids.cluster(df)[0]) == plain_clusters(rows)
    few = spark.createDataFrame(rows[:7], "vec_id long, embedding array<double>")
    assert tuples(centroids.cluster(few)[0]) == plain_clusters(rows[:7])
    assert centroids.cluster(df.filter("vec_id = 3"))[0].columns == ["vec_id", "embedding", *centroids.ADDED]
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert {r.distance for r in centroids.cluster(huge, centroids=1, rounds=0)[0].collect()} <= {0, 64 * centroids.LARGEST**2, 64 * (2 * centroids.LARGEST) ** 2}
    assert centroids.cluster(df.limit(0))[0].count() == 0
