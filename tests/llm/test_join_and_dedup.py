import random

import brute
import duckdb
import numpy as np
import pytest

from contrail.llm import exact_dedup, ngram_join, suffix_dedup
from contrail.llm.components import connected_components


def rows_of(path):
    return duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall()


def edited(seed, n, vocabulary, most_words):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(1, most_words))]
        for _ in range(r.randrange(1, 6)):
            v = list(w)
            for _ in range(r.randrange(0, 3)):
                v[r.randrange(len(v))] = f"w{r.randrange(vocabulary)}"
            if r.random() < 0.3:
                v.append(f"w{r.randrange(vocabulary)}")
            out.append((len(out), " ".join(v)))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (1, 80, 100)])
def test_near_copies_are_those_of_brute_force(spark, k, num, den):
    rows = edited(5, 120, 40, 60) + [(10000, None), (10001, ""), (10002, " \n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == brute.near_copies(rows, k, num, den)


def test_near_copies_of_the_table(spark, tiny):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.query(spark, tiny).collect()}
    assert got == brute.near_copies(rows_of(tiny), 3, 90, 100)


def test_needed_overlap_and_subsets_lose_no_pair():
    for num, den in ((90, 100), (80, 100)):
        for n in range(1, 30):
            for m in range(n, 30):
                if den * n >= num * m:
                    c = ngram_join.need(n, m, num, den)
                    assert den * c >= num * (n + m - c) and not (den * (c - 1) >= num * (n + m - c + 1))
                    if c <= n:
                        assert c in ngram_join.subset_sizes(n, 30, num, den) and c in ngram_join.subset_sizes(m, 30, num, den)


def test_fine_maps_never_overstate_the_difference(spark):
    r = np.random.default_rng(3)
    rows = []
    for n, m, both in ((100, 90, 80), (1000, 1100, 990), (64, 70, 60), (3000, 2000, 100), (1, 1, 0), (1, 1, 1), (100, 2000, 90), (260, 250, 225)):
        x = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        rows.append((n, m, both, ngram_join.fine_map(x[:n]).view(np.int64).tolist(), ngram_join.fine_map(x[n - both :]).view(np.int64).tolist()))
    d = spark.createDataFrame(rows, "n int, m int, both int, a array<long>, b array<long>")
    for g in d.selectExpr("n", "m", "both", f"{ngram_join.apart('a', 'b')} as d", f"{ngram_join.apart('b', 'a')} as e").collect():
        most = g.n + g.m - 2 * g.both
        assert g.d == g.e <= most and g.d >= (0.6 * most if abs(g.n - g.m) < 200 else 0)


@pytest.mark.parametrize("top", [0, 3, 14, 24, None])
def test_near_copies_with_any_boundary(spark, top):
    r = random.Random(9)
    rows = edited(7, 70, 30, 24)
    # One family of many copies with edits, some of which link only to each other.
    base = [f"b{i}" for i in range(60)]
    for _ in range(60):
        v = list(base)
        for _ in range(r.randrange(0, 5)):
            v[r.randrange(len(v))] = f"x{r.randrange(400)}"
        rows.append((len(rows), " ".join(v)))
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100, top=top).collect()}
    assert got == brute.near_copies(rows, 3, 80, 100)


def test_the_boundary_follows_the_cost_of_lists():
    sizes = {n: 100 for n in range(1, 41)}
    tops = [ngram_join.boundary(sizes, scan, 90, 100) for scan in (0.0, 5.0, 50.0, 5000.0)]
    assert tops == sorted(tops) and 9 <= tops[0] < tops[-1]


def test_rows_that_repeat_an_id_keep_all_links(spark):
    a, c = [" ".join(f"{x}{i}" for i in range(60)) for x in "ac"]
    rows = [(1, a), (1, c), (2, a + " tail"), (3, c + " tail"), (4, "other words stand here alone"), (4, None), (5, "other words stand here alone"), (6, ""), (6, "lone and far from all others"), (None, a), (1, a)]
    got = sorted((g.doc_id or 0, g.n_shingles, g.component_id or 0) for g in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect())
    assert got == sorted([(1, 58, 1), (1, 58, 1), (1, 58, 1), (2, 59, 1), (3, 59, 1), (4, 3, 4), (4, 0, 4), (5, 3, 4), (6, 0, 6), (6, 4, 6), (0, 58, 0)])


def test_keep_one_keeps_columns_and_survives_odd_rows(messy, nothing):
    out = ngram_join.keep_one(messy)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == messy.columns
    assert ids.count(1) == 2 and 2 not in ids and 3 not in ids and 9 not in ids and ids.count(None) == 2
    assert {4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15} <= set(ids)
    assert ngram_join.near_copies(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_exact_dedup_is_its_sql(spark, tiny):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tiny}/documents.parquet'")
    want = {r[0]: tuple(r) for r in con.sql("select doc_id, keep_id, group_size, kept, text_sha256 from (" + exact_dedup.SQL + ") x").fetchall()}
    got = {r.doc_id: (r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.query(spark, tiny).collect()}
    assert got == want


@pytest.mark.parametrize("block", [3, 7, 2048])
def test_exact_dedup_of_texts_of_many_blocks(spark, block):
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.choice([0, 1, 5, 6, 7, 20, 21]))) for _ in range(200)] + ["a  b", "a\tb", "a b", None]
    rows = list(enumerate(texts))
    norm = lambda t: __import__("re").sub(brute.WHITE, " ", t or "")
    first = {}
    for i, t in rows:
        first.setdefault(norm(t), i)
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert len(got) == len(rows)
    assert all(g.keep_id == first[norm(texts[g.doc_id])] and g.kept == (g.keep_id == g.doc_id) and g.group_size == sum(norm(t) == norm(texts[g.doc_id]) for t in texts) for g in got)


def test_exact_dedup_of_odd_rows(messy, nothing):
    got = exact_dedup.exact_dedup(messy).collect()
    assert len(got) == messy.count() and sum(g.kept for g in got) == len({g.text_sha256 for g in got})
    assert [g.group_size for g in got if g.doc_id in (1, 2)] == [4, 4, 4] and sum(g.kept for g in got if g.doc_id == 1) == 1
    assert {g.keep_id for g in got if g.doc_id in (4, 5)} == {4} and [g.keep_id for g in got if g.doc_id == 6] == [6]
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_longest_previous_factors():
    r = np.random.default_rng(2)
    for _ in range(60):
        n, width = int(r.integers(1, 70)), int(r.choice([3, 8, 11]))
        doc, suffix = r.integers(0, 8, n), r.integers(0, 2, (n, width)).astype(np.uint8)
        got = suffix_dedup.longest_previous(doc, suffix)
        common = lambda a, b: width if (a == b).all() else int((a != b).argmax())  # noqa: B023, E731
        for i in range(n):
            assert got[i] == max((common(suffix[i], suffix[j]) for j in range(n) if doc[j] < doc[i]), default=0)
    # One long run of equal suffixes, ids falling and rising.
    for doc in (np.arange(5000), np.arange(5000)[::-1].copy(), np.zeros(5000, np.int64)):
        assert (suffix_dedup.longest_previous(doc, np.ones((5000, 8), np.uint8)) == np.where(doc > doc.min(), 8, 0)).all()


def passages(seed, alphabet):
    r = random.Random(seed)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randrange(20, 160))) for _ in range(12)]
    out = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(0, 6)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            parts.append(r.choice([p, p[a:], p[:a], "".join(r.choice(alphabet) for _ in range(r.randrange(60)))]))
        out.append((i * 3 % 119 if i < 119 else 400, "".join(parts)))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é"])
def test_repeats_are_those_of_brute_force(spark, alphabet):
    rows = [*passages(4, alphabet), (1000, None), (1001, ""), (1002, "a" * 500), (1003, "a" * 49), (1004, "a" * 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    import hashlib

    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(d).collect()}
    assert got == brute.removed(rows)


def test_repeats_of_the_table(spark, tiny):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, tiny).collect()}
    assert got == brute.removed(rows_of(tiny))


def test_repeats_of_odd_rows(messy, nothing):
    got = suffix_dedup.remove_repeats(messy).collect()
    assert len(got) == messy.count()
    by = {}
    for g in got:
        by.setdefault(g.doc_id, []).append(g)
    texts = {r.doc_id: (r.text or "").encode() for r in messy.collect() if r.doc_id is not None}
    assert all(not g.spans for g in by[1]) and all(len(g.kept) == 0 for g in by[2]) and all(bytes(g.kept) == texts[i] for i in (4, 5, 6, 7, 8, 10, 11, 12) for g in by[i])
    assert bytes(by[9][0].kept) == texts[9][len(texts[8]) :] and texts[9].startswith(texts[8]) and sorted(len(g.kept) for g in by[None]) == [0, 0]
    assert suffix_dedup.remove_repeats(nothing).count() == 0
