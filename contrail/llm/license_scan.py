"""Licence scan by a positional rare-token index.

Licence templates are short token sequences. Template words have a weight, their inverse document frequency counted over
the whole corpus, and the two key words of highest weight of every template have postings (template, position). In a file
all of these are looked up, so no notice hides another; each occurrence votes for the relative positions (file position
minus template position) its postings allow. Where two different words of a template agree on a relative position, the template's
mandatory key phrase is verified there, word for word, and the file gets the template's label with the weight share of
the words that stand in place. Every key phrase that stands in a file is found, as its own rarest words vote for it.

Three base phrases are reported as well, wherever their words stand consecutively.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Defined cases: null and
empty texts have no words, no labels and score 0. Repeated rows are scanned each by itself. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import documents, in_arrow
from contrail.llm._text import LOWER, WORDLIKE, runs, span_hashes, utf8, words

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, template, mandatory key phrase)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("mit", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
#: So many of a template's key words, the rarest, have postings, and so many different ones must agree.
LEAST_VOTES = 2


def word_list(text: str) -> list[str]:
    return text.split()


def hashes(found: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(found).encode(), np.uint8)
    s, e, _ = words(buf, np.array([0, len(buf)]), WORDLIKE)
    return span_hashes(buf, s, e)


VOCABULARY = sorted({w for _, t, k in TEMPLATES for w in word_list(t) + word_list(k)} | {w for p in BASE for w in word_list(p)})


def _vocabulary(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents as (lo, hi, number of words of each, and of each licence word its document, position, number)."""
    sorted_hash = hashes(VOCABULARY)
    order = np.argsort(sorted_hash)
    sorted_hash = sorted_hash[order]
    buf, off = utf8(column)
    for lo, hi in runs(off):
        low = LOWER[buf[off[lo] : off[hi]]]
        s, e, d = words(low, off[lo : hi + 1] - off[lo], WORDLIKE)
        h = span_hashes(low, s, e)
        count = np.bincount(d, minlength=hi - lo)
        at = np.minimum(np.searchsorted(sorted_hash, h), len(sorted_hash) - 1)
        hit = np.flatnonzero(sorted_hash[at] == h)
        first = np.concatenate([[0], np.cumsum(count)])
        yield lo, hi, count, d[hit], hit - first[d[hit]], order[at[hit]]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(len(VOCABULARY), np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for _, _, _, doc, _, word in _vocabulary(batch.column(0)):
            pair = np.unique(doc * len(VOCABULARY) + word)
            total += np.bincount(pair % len(VOCABULARY), minlength=len(VOCABULARY))
    yield pa.RecordBatch.from_arrays([pa.array([*range(len(VOCABULARY)), -1], pa.int32()), pa.array([*total, n], pa.int64())], ["word", "docs"])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """({word: documents with it}, documents) of the licence vocabulary, over all of docs."""
    rows = in_arrow(docs.select(text_col), _frequencies, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    found = {r.word: r.docs for r in rows}
    return {w: found.get(i, 0) for i, w in enumerate(VOCABULARY)}, found.get(-1, 0)


class Index:
    """Postings and weights of the templates."""

    def __init__(self, df: dict[str, int], n: int):
        self.number = {w: i for i, w in enumerate(VOCABULARY)}
        self.weight = np.array([np.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in VOCABULARY])
        self.templates = [([self.number[w] for w in word_list(t)], [self.number[w] for w in word_list(k)]) for _, t, k in TEMPLATES]
        self.key_at = [next(i for i in range(len(t)) if t[i : i + len(k)] == k) for t, k in self.templates]
        self.total = [sum(self.weight[w] for w in t) for t, _ in self.templates]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (seq, key) in enumerate(self.templates):
            rarest = sorted(set(key), key=lambda w: (-self.weight[w], w))[:LEAST_VOTES]
            for i, w in enumerate(seq):
                if w in rarest:
                    self.postings.setdefault(w, []).append((t, i))
        self.base = [([self.number[w] for w in word_list(p)], label) for p, label in BASE.items()]

    def scan(self, at: np.ndarray, word: np.ndarray):
        """(base places [(start, label)], {label: share}) of one document's licence words."""
        have = dict(zip(at.tolist(), word.tolist(), strict=True))
        base = [(i, label) for i in have for p, label in self.base if have[i] == p[0] and all(have.get(i + j) == w for j, w in enumerate(p))]
        votes: dict[tuple[int, int], set[int]] = {}
        for i, w in have.items():
            for t, j in self.postings.get(w, ()):
                votes.setdefault((t, i - j), set()).add(w)
        found: dict[str, float] = {}
        for (t, shift), voters in votes.items():
            seq, key = self.templates[t]
            k = shift + self.key_at[t]
            if len(voters) >= LEAST_VOTES and all(have.get(k + j) == w for j, w in enumerate(key)):
                share = sum(self.weight[w] for j, w in enumerate(seq) if have.get(shift + j) == w) / self.total[t]
                found[TEMPLATES[t][0]] = max(found.get(TEMPLATES[t][0], 0.0), share)
        return base, found


def _scan(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    index = index.value
    starts = {p[0] for p, _ in index.base} | set(index.postings)
    worth = np.array([w in starts for w in range(len(VOCABULARY))])
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for lo, hi, count, doc, at, word in _vocabulary(batch.column(0)):
            size = hi - lo
            out = {"n_words": count.tolist(), "n_base": [0] * size, "first_word": [None] * size, "last_word": [None] * size, "base_labels": [""] * size, "labels": [""] * size, "score": [0.0] * size}
            bound = np.searchsorted(doc, np.arange(size + 1))
            for d in np.unique(doc[worth[word]]).tolist():
                base, found = index.scan(at[bound[d] : bound[d + 1]], word[bound[d] : bound[d + 1]])
                places = [i for i, _ in base]
                own = {label for _, label in base}
                if places:
                    out["n_base"][d], out["first_word"][d], out["last_word"][d] = len(places), min(places), max(places)
                out["base_labels"][d] = ",".join(sorted(own))
                out["labels"][d] = ",".join(sorted(own | set(found)))
                out["score"][d] = min(1.0, max([1.0 * bool(own) * 0.5, *found.values()]))
            for k, v in out.items():
                cols[k] += v
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)]], ["doc_id", *cols])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. The score is
    the weight share of the best template found, and at least 0.5 if a base phrase was."""
    df, n = document_frequencies(docs, text_col)
    index = docs.sparkSession.sparkContext.broadcast(Index(df, n))
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, lambda it: _scan(it, index), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
