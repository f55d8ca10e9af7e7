"""The pipeline, stage by stage, against brute force; each stage is judged on its own input."""

import brute
import duckdb
import numpy as np

import corpus_pipeline as cp
from contrail.llm import decontaminate, language_id, mixing, shard
from contrail.llm._spark import crc_fold, settle


def test_stages_of_the_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    items = duckdb.sql(f"select item_id, text from '{tiny}/benchmark.parquet'").fetchall()
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = settle(stage(spark, docs, tiny))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "sharding":
            assert docs.columns == columns and all(after[i] == before[i] for i in after) or name == "language_id"
        if name == "language_id":
            assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
            given = spark.createDataFrame(list(before.values()))
            found = {r.doc_id: r for r in language_id.identify(given, given.filter(crc_fold() != 0)).collect()}
            for i, r in after.items():
                p, own = found[i], before[i].lang
                assert r.asDict() == before[i].asDict() | {"lang": p.lang_pred if own is None or p.score >= language_id.LEAD else own}
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in brute.near_copies([(i, r.text) for i, r in before.items()], 5, 80, 100).items() if c == i}
        elif name == "decontamination":
            gone = set(before) - set(after)
            bad = {d for d, _ in brute.contaminated([(i, r.text) for i, r in before.items()], items, decontaminate.WINDOW, decontaminate.needed, decontaminate.LEAST_ITEM_WORDS)}
            assert gone == bad
        elif name == "mixing":
            want = {r.doc_id for r in mixing.mix(spark.createDataFrame(list(before.values()))).collect() if r.sampled}
            assert set(after) == want and 0 < len(after) < len(before)
        else:
            p = shard.places(np.arange(len(before)), len(before))
            assert {i: (r.shard, r.slot) for i, r in after.items()} == {i: (p[k] % 8, p[k] // 8) for k, i in enumerate(sorted(before))}


def test_run_is_the_stages(spark, tiny):
    out = cp.run(spark, tiny)
    assert out.columns[-3:] == ["law", "shard", "slot"] and 0 < out.count() < 200


def test_stages_of_odd_rows(spark, messy, nothing, tiny):
    for d in (messy, nothing):
        for _, stage in cp.STAGES:
            before = {(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()}
            d = settle(stage(spark, d, tiny))
            assert {(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()} <= before
        rows = d.collect()
        assert not rows if not before else sorted((r.shard, r.slot) for r in rows) == sorted(set((r.shard, r.slot) for r in rows))
