"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cell weights are raked: scaled in turn so that the weighted
tokens of each source, each language and each topic reach their target shares, until all three hold. A cell cannot give
more tokens than it has, so the expected tokens are then raked with that bound: a document is sampled with the
probability min(1, factors of its source, language and topic), the factors scaled in turn until tokens * probability has
the target shares and the budget. The draw is a hash of the document's id, so it is reproducible and needs no state.

Not every budget allows all targets: a category of 0.2 % of the tokens with a target of 0.8 % ends any sample at a quarter
of the tokens. The budget holds (BUDGET where none is given): categories that are too small for it are taken whole and the
others' shares are scaled up. With keep_targets the targets hold instead, and the budget is the largest share up to it that
allows them. The share of the tokens and the largest gap to a target share are in the metadata of the column probability, and
are logged if the targets or the budget are missed.

Cells are formed from the categories of the targets and one more, `other`, for the rest and for nulls. Where targets are
left out, every category that occurs has the observed token share to the power TEMPER as its own, or what it has if that is
less than the budget asks for. Only the sums of the
cells reach the driver; without targets these are as many as combinations of a source, a language and a topic that occur,
so a table with very many sources should be given targets for them, or a coarser column. Target shares of categories
without tokens are dropped and the rest scaled up. If zero cells keep the targets from being met at any budget, the last
sweep is used.

The topic of a text is the nearest of TOPICS centres of hashed words of its language: words are counted in FEATURES buckets,
damped and weighted by rarity, and the centres are fitted by spherical k-means on all rows with words: each round is a pass of
tasks over their bags of words, and only sums by centre reach the driver. Vectors are whole numbers, so that the sums, and with
them the topics, do not depend on how rows are dealt. Each language has centres of its own, as words of different languages are
further apart than those of any two topics, and topics that were languages in disguise could not have targets beside them.
Languages with fewer than LANGUAGE_ROWS rows, or a share of the rows below LANGUAGE_SHARE, and texts without one, share centres. Topics are numbered by size within the language; a
text without words has topic `other`. A column with topics may be given instead. The text is read once for its words and
topic; what is found is written to the checkpoint folder.

Defined cases: null and empty texts have no tokens; they have probability 0 and are never sampled. Repeated rows share
one draw. Rows with a null doc_id are drawn by their text. Other columns stay as they are in mix; a column named like an
added one is replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrail.llm._spark import BROADCAST_ROWS, documents, in_arrow, packed, settle
from contrail.llm._text import LOWER, NOT_WHITE, runs, span_hashes, utf8, words

DIMENSIONS = ("source", "lang", "topic")
OTHER = "other"
#: Share of all tokens to sample.
BUDGET = 0.6
TEMPER = 0.7
SWEEPS, CLOSE = 200, 1e-9
#: A budget allows the targets if no share of the sample is further off; halvings in the search for it.
MET, HALVINGS = 1e-6, 12
SEED = 20
PLACES = 9

Targets = Mapping[str, Mapping[str, float]]


#: Topics, and buckets of words.
TOPICS, FEATURES = 6, 1024
ROUNDS, STARTS = 30, 4
#: A round that brings rows closer to their centres by a smaller share than this is the last of a start.
CLOSER = 1e-3
#: Rows, and share of all rows, from which on a language has centres of its own.
LANGUAGE_ROWS, LANGUAGE_SHARE = 30, 0.0075


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of each text, counts of words by bucket) of runs of texts. Words are runs of characters other than
    [\\x20\\x09-\\x0D]; A-Z are lower-cased for the buckets."""
    buf, off = utf8(texts)
    for lo, hi in runs(off):
        low = LOWER[buf[off[lo] : off[hi]]]
        start, end, d = words(low, off[lo : hi + 1] - off[lo], NOT_WHITE)
        bucket = (span_hashes(low, start, end) % np.uint64(FEATURES)).astype(np.int64)
        yield np.bincount(d, minlength=hi - lo), np.bincount(d * FEATURES + bucket, minlength=(hi - lo) * FEATURES).reshape(hi - lo, FEATURES)


#: A text's words: its buckets in order, with their counts.
BAG = np.dtype([("bucket", "<u2"), ("n", "<u4")])
#: The same as a vector.
VECTOR = np.dtype([("bucket", "<u2"), ("v", "<u2")])
#: Unit vectors and centres are whole multiples of 1 / SCALE. Products of two, and sums of BLOCK_ROWS, stay below 2 ** 24, so they are
#: exact as floats in any order.
SCALE = 4000.0
#: Rows that are made vectors at once.
BLOCK_ROWS = 512


def _bag_array(counts: np.ndarray) -> pa.Array:
    d, bucket = np.nonzero(counts)
    bag = np.empty(len(d), BAG)
    bag["bucket"], bag["n"] = bucket, counts[d, bucket]
    off = (np.searchsorted(d, np.arange(len(counts) + 1)) * BAG.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(bag.tobytes())])


def _scaled(row: np.ndarray, bucket: np.ndarray, n: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Components of unit vectors, times SCALE and rounded, of counts n of buckets in rows."""
    v = np.log1p(n) * weight[bucket]
    norm = np.maximum(np.sqrt(np.bincount(row, v * v, rows)), 1e-12)
    return np.rint(v / norm[row] * SCALE)


def _dense(row: np.ndarray, bucket: np.ndarray, v: np.ndarray, rows: int) -> np.ndarray:
    x = np.zeros(rows * FEATURES, np.float32)
    x[row * FEATURES + bucket] = v
    return x.reshape(rows, FEATURES)


def _records(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(records of all rows of a column of bytes, offsets of the rows)."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // kind.itemsize
    return np.frombuffer(column.buffers()[2], kind, int(off[-1])), off


class Topics:
    """Weights of the buckets, and centres by language (None: of the rest); no centres where nothing could be learnt."""

    def __init__(self, weight: np.ndarray, centres: dict[str | None, np.ndarray]):
        self.weight, self.centres = weight, centres

    def of(self, counts: np.ndarray, langs: list[str | None]) -> np.ndarray:
        out = np.zeros(len(counts), np.int64)
        if self.centres:
            rows: dict[str | None, list[int]] = {}
            for i, lang in enumerate(langs):
                rows.setdefault(lang if lang in self.centres else None, []).append(i)
            for lang, at in rows.items():
                d, bucket = np.nonzero(counts[at])
                x = _dense(d, bucket, _scaled(d, bucket, counts[at][d, bucket], self.weight, len(at)), len(at))
                out[at] = (x @ self.centres[lang].T.astype(np.float32)).argmax(axis=1)
        return out


class _Rows:
    """The vectors of all rows, written once, by group: a language with centres of its own, or None for the rest. Each question is
    one pass of tasks over all rows, and what they find is added up by group and centre."""

    def __init__(self, bags_: DataFrame, weight: np.ndarray, groups: dict[str | None, int]):
        rest = groups.get(None)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    bag, off = _records(batch.column(1), BAG)
                    bag, row = bag[off[0] :], np.repeat(np.arange(len(batch)), np.diff(off))
                    made = np.empty(len(bag), VECTOR)
                    made["bucket"], made["v"] = bag["bucket"], _scaled(row, bag["bucket"].astype(np.int64), bag["n"], weight, len(batch))
                    at = ((off - off[0]) * VECTOR.itemsize).astype(np.int32)
                    vectors = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(made.tobytes())])
                    own = pa.array([groups.get(x, rest) for x in batch.column(2).to_pylist()], pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0), vectors, own], ["u", "vector", "g"])

        self.vectors = settle(in_arrow(bags_, over, "u long, vector binary, g int"))

    def _pass(self, asked: dict[int, np.ndarray], function, schema: str) -> DataFrame:
        """function takes what it found of a group so far, asked[group], and hashes, bytes and dense vectors of more of its rows."""
        known = self.vectors.sparkSession.sparkContext.broadcast(asked)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, given = {}, known.value
            for batch in batches:
                if not len(batch):
                    continue
                every, off = _records(batch.column(1), VECTOR)
                u, own = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                for g in given:
                    # Centres of the rest are those of all rows where no row is left.
                    mine = np.flatnonzero(own == g) if g >= 0 else np.arange(len(batch))
                    for lo in range(0, len(mine), BLOCK_ROWS):
                        at = mine[lo : lo + BLOCK_ROWS]
                        many = off[at + 1] - off[at]
                        row = np.repeat(np.arange(len(at)), many)
                        held = every[np.arange(len(row)) + np.repeat(off[at] - np.cumsum(many) + many, many)]
                        x = _dense(row, held["bucket"].astype(np.int64), held["v"], len(at))
                        state[g] = function(state.get(g), given[g], u[at], lambda i, at=at: every[off[at[i]] : off[at[i] + 1]].tobytes(), x)
            out = [r for g in sorted(state) for r in function.rows(g, state[g])]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=function.schema)

        return in_arrow(self.vectors, over, schema)

    def sums(self, asked: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """{group: (rows of each centre, their sum, and the sum of their closeness by start)} of groups with centres [start, centre,
        bucket]."""
        found: dict[int, tuple] = {g: (np.zeros(c.shape[:2], np.int64), np.zeros(c.shape), np.zeros(c.shape[0], np.int64)) for g, c in asked.items()}
        for r in _summed(self._pass(asked, _Nearest(), "g int, s int, j int, n long, fit long, total binary"), ["g", "s", "j"]).collect():
            found[r.g][0][r.s, r.j], found[r.g][1][r.s, r.j] = r.n, np.frombuffer(r.total, np.int64)
            found[r.g][2][r.s] += r.fit
        return found

    def furthest(self, asked: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """{group: vector of the row furthest from all its centres [centre, bucket]}."""
        rows = self._pass(asked, _Furthest(), "g int, near double, u long, vector binary").groupBy("g").agg(F.min(F.struct("near", "u", "vector")).alias("r")).collect()
        return {r.g: self._of(r.r.vector) for r in rows}

    def least(self, groups: list[int], count: int) -> dict[int, np.ndarray]:
        """{group: vectors of the rows with the least hashes}, where k-means starts."""
        w = Window.partitionBy("g").orderBy("u", "vector")
        rows = self._pass({g: np.array([count]) for g in groups}, _Least(), "g int, u long, vector binary").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= count).collect()
        return {g: np.array([self._of(r.vector) for r in sorted((r for r in rows if r.g == g), key=lambda r: r.k)]) for g in groups}

    @staticmethod
    def _of(blob: bytes) -> np.ndarray:
        vector = np.frombuffer(blob, VECTOR)
        return _dense(np.zeros(len(vector), np.int64), vector["bucket"].astype(np.int64), vector["v"], 1)[0].astype(float)


class _Nearest:
    schema = pa.schema([("g", pa.int32()), ("s", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("fit", pa.int64()), ("total", pa.binary())])

    def __call__(self, state, centres, u, blob, x):
        starts, k, _ = centres.shape
        n, total, fit = state or (np.zeros((starts, k), np.int64), np.zeros((starts * k, FEATURES)), np.zeros((starts, k), np.int64))
        near = (x @ centres.reshape(starts * k, -1).T.astype(np.float32)).reshape(len(x), starts, k)
        own, row = near.argmax(axis=2), np.arange(len(x))
        one = np.zeros((len(x), starts * k), np.float32)
        for s in range(starts):
            one[row, s * k + own[:, s]] = 1.0
            n[s] += np.bincount(own[:, s], minlength=k)
            fit[s] += np.bincount(own[:, s], near[row, s, own[:, s]], k).astype(np.int64)
        total += one.T @ x
        return n, total, fit

    @staticmethod
    def rows(g, state):
        n, total, fit = state
        return [{"g": g, "s": s, "j": j, "n": int(n[s, j]), "fit": int(fit[s, j]), "total": total[s * n.shape[1] + j].astype(np.int64).tobytes()} for s in range(n.shape[0]) for j in range(n.shape[1])]


class _Furthest:
    schema = pa.schema([("g", pa.int32()), ("near", pa.float64()), ("u", pa.int64()), ("vector", pa.binary())])

    def __call__(self, state, centres, u, blob, x):
        near = (x @ centres.T.astype(np.float32)).max(axis=1)
        return min(([state] if state else []) + [(float(near[i]), int(u[i]), blob(i)) for i in np.flatnonzero(near == near.min())])

    @staticmethod
    def rows(g, state):
        return [dict(zip(("g", "near", "u", "vector"), (g, *state), strict=True))]


class _Least:
    schema = pa.schema([("g", pa.int32()), ("u", pa.int64()), ("vector", pa.binary())])

    def __call__(self, state, count, u, blob, x):
        order = np.argsort(u, kind="stable")
        last = u[order[min(len(u), int(count[0])) - 1]]
        return sorted((state or []) + [(int(u[i]), blob(i)) for i in np.flatnonzero(u <= last)])[: int(count[0])]

    @staticmethod
    def rows(g, state):
        return [{"g": g, "u": u, "vector": v} for u, v in state]


def _summed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the same keys added up; those of a key are one for each task at most."""
    names, schema = df.columns, df.schema

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("total").to_pylist())
        made = {c: table.column(c)[0].as_py() if c in keys else total.tobytes() if c == "total" else sum(table.column(c).to_pylist()) for c in names}
        return pa.Table.from_pylist([made], schema=table.schema)

    return df.groupBy(*keys).applyInArrow(add, schema)


def _rounded(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Directions of sums as centres; one without rows stays as it was."""
    norm = np.sqrt((sums * sums).sum(axis=-1, keepdims=True))
    return np.where(norm > 0, np.rint(sums / np.maximum(norm, 1e-12) * SCALE), before)


def learn_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Topics:
    """Topics of all rows with words. Their bags are written once; each round of k-means is a pass over them. Rows where k-means
    starts are those of the least hashes of their ids, and rows that are far apart, which noise can be too."""
    schema = pa.schema([("u", pa.int64()), ("bag", pa.binary()), ("lang", pa.string())])

    def packed_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, counts in bags(batch.column(1)):
                part = batch.slice(at, len(n))
                at += len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), _bag_array(counts), part.column(2)], schema=schema).filter(pa.array(n > 0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total[np.frombuffer(blob.as_buffer(), BAG)["bucket"]] += 1
        yield pa.RecordBatch.from_pylist([{"k": 0, "total": total.tobytes()}], schema=pa.schema([("k", pa.int32()), ("total", pa.binary())]))

    key = F.coalesce(F.xxhash64(F.col(id_col).cast("string")), F.lit(0))
    every = settle(in_arrow(docs.select(key.alias("u"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), packed_bags, "u long, bag binary, lang string"))
    rows = every.count()
    if not rows:
        return Topics(np.zeros(FEATURES), {})
    held = np.frombuffer(_summed(in_arrow(every.select("bag"), frequencies, "k int, total binary"), ["k"]).first().total, np.int64)
    weight = np.log((rows + 1) / (held + 1)) + 1e-3
    least = max(LANGUAGE_ROWS, LANGUAGE_SHARE * rows)
    own = {r.lang: r["count"] for r in every.filter(F.col("lang").isNotNull()).groupBy("lang").count().filter(F.col("count") >= least).collect()}
    rest = rows - sum(own.values())
    groups = {lang: i for i, lang in enumerate(sorted(own))}
    # Where no row is left for the rest, its centres are those of all rows.
    last = len(groups) if rest else -1
    table, count = _Rows(every, weight, groups | ({None: last} if rest else {})), {groups[k]: v for k, v in own.items()} | {last: rest or rows}
    size = {g: min(TOPICS, n) for g, n in count.items()}

    near = table.sums({g: np.zeros((1, 1, FEATURES)) for g in count})
    apart = {g: _rounded(near[g][1][0], np.zeros((1, FEATURES))) for g in count}
    for i in range(TOPICS):
        found = table.furthest({g: a for g, a in apart.items() if i < size[g]})
        apart = {g: a if g not in found else found[g][None] if i == 0 else np.concatenate([a, found[g][None]]) for g, a in apart.items()}
    hashed = table.least(sorted(count), STARTS * TOPICS)
    centres = {g: np.array([apart[g], *(hashed[g][at : at + k] for at in range(0, min(len(hashed[g]) - k + 1, STARTS * k), k))]) for g, k in size.items()}

    # All starts of all groups go on together; those that gain no more are left out of further rounds.
    live = {g: list(range(len(c))) for g, c in centres.items()}
    fit = {g: np.zeros(len(c), np.int64) for g, c in centres.items()}
    sizes = {g: np.zeros(c.shape[:2], np.int64) for g, c in centres.items()}
    for step in range(ROUNDS + 1):
        for g, (n, total, close) in table.sums({g: centres[g][s] for g, s in live.items() if s}).items():
            s = np.array(live[g])
            going = (close > fit[g][s] * (1 + CLOSER)) & (step < ROUNDS)
            sizes[g][s], fit[g][s] = n, close
            centres[g][s[going]] = _rounded(total[going], centres[g][s[going]])
            live[g] = s[going].tolist()
        if not any(live.values()):
            break
    best = {g: int(fit[g].argmax()) for g in centres}
    chosen = {g: centres[g][b][np.argsort(-sizes[g][b], kind="stable")] for g, b in best.items()}
    return Topics(weight, {lang: chosen[g] for lang, g in groups.items()} | {None: chosen[last]})


def form(topics, text: str = "text", lang: str = "lang") -> Column:
    """struct<tokens, topic> of a text; only text and language go to Python, in Arrow batches. topics: a broadcast of the
    attributes of Topics."""

    @F.arrow_udf("struct<tokens:bigint,topic:string>")
    def of(texts: pa.Array, langs: pa.Array) -> pa.Array:
        tokens, names, known, found = [np.zeros(0, np.int64)], [], langs.to_pylist(), Topics.__new__(Topics)
        found.__dict__.update(topics.value)
        for n, counts in bags(texts):
            at = len(names)
            tokens.append(n)
            names += [f"t{k}" if some else OTHER for k, some in zip(found.of(counts, known[at : at + len(n)]).tolist(), n.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), pa.array(names, pa.string())], ["tokens", "topic"])

    return of(F.col(text), F.col(lang).cast("string"))


def _margins(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]]):
    """(cells with tokens, their shares, and by dimension the category of each and the target shares)."""
    keys = [k for k, v in sorted(cells.items()) if v > 0]
    mass = np.array([cells[k] for k in keys], float)
    mass /= mass.sum() or 1.0
    index, goal = [], []
    for d, target in enumerate(targets):
        names = sorted({k[d] for k in keys})
        index.append(np.array([names.index(k[d]) for k in keys], int))
        want = np.array([max(0.0, target.get(x, 0.0)) for x in names])
        if want.sum() <= 0:
            want = np.bincount(index[d], mass, len(names))
        goal.append(want / (want.sum() or 1.0))
    return keys, mass, index, goal


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]]) -> tuple[dict[tuple[str, ...], float], int, float]:
    """({cell: weight}, sweeps, largest gap of a marginal share) with sum(tokens * weight) = 1. Weights are positive for
    cells with tokens whose categories all have targets, else 0."""
    keys, mass, index, goal = _margins(cells, targets)
    if not keys:
        return dict.fromkeys(cells, 0.0), 0, 0.0
    fitted = mass.copy()
    gap, sweep = np.inf, 0
    while sweep < SWEEPS and gap > CLOSE:
        for at, want in zip(index, goal, strict=True):
            have = np.bincount(at, fitted, len(want))
            fitted = fitted * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[at]
        sweep += 1
        gap = max(np.abs(np.bincount(at, fitted, len(want)) - want).max() for at, want in zip(index, goal, strict=True))
    total = sum(cells.values())
    return {k: 0.0 for k in cells} | {k: float(f / m / total) for k, f, m in zip(keys, fitted, mass, strict=True)}, sweep, float(gap)


def probabilities(cells: dict[tuple[str, ...], float], weights: dict[tuple[str, ...], float], budget: float) -> dict[tuple[str, ...], float]:
    """{cell: min(1, c * weight)} with c such that the expected tokens are the budget, or all that have weight."""
    live = [k for k in cells if cells[k] > 0 and weights[k] > 0]
    full: set = set()
    c = 0.0
    while True:
        rest = [k for k in live if k not in full]
        left = budget - sum(cells[k] for k in full)
        spread = sum(cells[k] * weights[k] for k in rest)
        if not rest or spread <= 0:
            break
        c = max(0.0, left) / spread
        over = {k for k in rest if c * weights[k] >= 1}
        if not over:
            break
        full |= over
    return {k: (1.0 if k in full else round(c * weights[k], PLACES) if k in live else 0.0) for k in cells}


def _scale(part: np.ndarray, most: np.ndarray, at: np.ndarray, want: np.ndarray) -> np.ndarray:
    """part with one factor a category, such that min(part, most) sums to want; at least most where that is too little."""
    ratio = np.divide(most, part, out=np.full_like(part, np.inf), where=part > 0)
    o = np.lexsort((ratio, at))
    a, ends = at[o], np.searchsorted(at[o], np.arange(len(want) + 1))
    # With the cells of a category in order of most / part: what those before give at most, what this and the later ones have.
    clipped, free = np.cumsum(most[o]) - most[o], np.cumsum(part[o][::-1])[::-1]
    clipped, free = clipped - clipped[ends[:-1]][a], free - np.append(free, 0.0)[ends[1:]][a]
    factor = np.divide(want[a] - clipped, free, out=np.full_like(free, np.inf), where=free > 0)
    fits = np.flatnonzero(factor <= ratio[o])
    first, where = np.unique(a[fits], return_index=True)
    found = np.full(len(want), np.inf)
    found[first] = np.maximum(factor[fits[where]], 0.0)
    return np.where(np.isinf(found[at]), np.maximum(part, np.where(part > 0, most, 0.0)), part * np.where(np.isinf(found), 1.0, found)[at])


def _bounded(mass, start, index, goal, share: float) -> tuple[np.ndarray, float]:
    """(tokens of each cell, before they are cut to mass, largest gap of a marginal share) of a sample of that share."""
    part, gap, sweep = start * share, np.inf, 0
    while sweep < SWEEPS and gap > CLOSE:
        for at, want in zip(index, goal, strict=True):
            part = _scale(part, mass, at, want * share)
        sweep += 1
        gap = max(np.abs(np.bincount(at, np.minimum(part, mass), len(want)) / share - want).max() for at, want in zip(index, goal, strict=True))
    return part, float(gap)


def _reachable(want: np.ndarray, have: np.ndarray, share: float) -> np.ndarray:
    """Target shares of a sample of that share: categories with too few tokens are taken whole, the others scaled up."""
    full = np.zeros(len(want), bool)
    while True:
        rest = np.where(full, 0.0, want).sum()
        out = np.where(full, have, want * max(0.0, share - have[full].sum()) / (rest or 1.0))
        over = ~full & (out > have)
        if not over.any():
            return out / share
        full |= over


def fit(cells: dict[tuple[str, ...], float], weights: dict[tuple[str, ...], float], targets: list[dict[str, float]], budget: float | None = None, keep_targets: bool = False) -> tuple[dict[tuple[str, ...], float], float, float]:
    """({cell: probability}, share of the tokens sampled, largest gap of a share of the sample to its target). The budget is
    kept, BUDGET where none is given; with keep_targets it is the largest up to that which allows the targets."""
    keys, mass, index, goal = _margins(cells, targets)
    start = np.array([weights[k] * cells[k] for k in keys])
    share = BUDGET if budget is None else min(1.0, budget)
    if not keys or start.sum() <= 0 or share <= 0:
        return dict.fromkeys(cells, 0.0), 0.0, 0.0
    have = [np.bincount(at, mass, len(want)) for at, want in zip(index, goal, strict=True)]
    if keep_targets:
        met = MET + max(np.abs(np.bincount(at, start, len(want)) - want).max() for at, want in zip(index, goal, strict=True))
        share = min(share, *(float((h[g > 0] / g[g > 0]).min()) for h, g in zip(have, goal, strict=True)))
        part, gap = _bounded(mass, start, index, goal, share)
        if gap > met:
            low, high = 0.0, share
            for _ in range(HALVINGS):
                share = (low + high) / 2
                tried, gap = _bounded(mass, start, index, goal, share)
                low, high, part = (share, high, tried) if gap <= met else (low, share, part)
            share = low or share
            part, _ = _bounded(mass, start, index, goal, share)
    else:
        part, _ = _bounded(mass, start, index, [_reachable(g, h, share) for g, h in zip(goal, have, strict=True)], share)
    total = sum(cells.values())
    chance = probabilities(cells, dict.fromkeys(cells, 0.0) | {k: float(p / m) for k, p, m in zip(keys, part, mass, strict=True)}, share * total)
    taken = np.array([cells[k] * chance[k] for k in keys]) / total
    gap = max(np.abs(np.bincount(at, taken, len(want)) / taken.sum() - want).max() for at, want in zip(index, goal, strict=True))
    return chance, float(taken.sum()), float(gap)


def tempered(seen: dict[str, float], budget: float | None = None) -> dict[str, float]:
    """Target shares of categories with their tokens: to the power TEMPER, but no more than they have at that budget."""
    names = [k for k in sorted(seen) if seen[k] > 0]
    have, want = np.array([seen[k] for k in names], float), np.array([seen[k] ** TEMPER for k in names], float)
    share = BUDGET if budget is None else min(1.0, budget)
    return dict(zip(names, _reachable(want / want.sum(), have / have.sum(), share).tolist(), strict=True)) if names and share > 0 else {}


def draw(id_col: str, text_col: str, seed: int) -> Column:
    """A reproducible number in [0, 1) for a document: 52 bits of an MD5."""
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(
    docs: DataFrame, targets: Targets | None = None, budget: float | None = None, seed: int = SEED, topics: Topics | None = None, columns: list[str] | None = None, keep_targets: bool = False,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
) -> DataFrame:
    """docs (all columns, or those named) with tokens, source_cell, lang_cell, topic_cell, weight, probability and sampled.
    targets has the target token shares of `source`, `lang` and `topic`; budget is the share of all tokens to sample, by
    default BUDGET; with keep_targets less, if the targets ask for it. topics are learnt from docs if not given."""
    spark = docs.sparkSession
    topics = spark.sparkContext.broadcast(vars(topics or learn_topics(docs, id_col, text_col, lang_col)))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(OTHER))
    made = {"source_cell": cell(source_col), "lang_cell": cell(lang_col), "topic_cell": F.col("_form.topic") if topic_col is None else cell(topic_col)}
    added = ("tokens", *made, "weight", "probability", "sampled")
    own = [c for c in columns or docs.columns if c not in added]
    found = docs.withColumn("_form", form(topics, text_col, lang_col)).withColumn("_u", draw(id_col, text_col, seed))
    # Added columns have names of their own until those of docs that they replace are gone.
    found = found.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("_form.tokens").alias("tokens"), *[v.alias(k) for k, v in made.items()], "_u")
    if targets:
        found = found.withColumns({f"{n}_cell": F.when(F.col(f"{n}_cell").isin(list(targets[n])), F.col(f"{n}_cell")).otherwise(OTHER) for n in DIMENSIONS if n in targets})
    found = settle(found)
    sums = found.groupBy(*made).agg(F.sum("tokens").alias("tokens")).collect()
    cells = {(r[0], r[1], r[2]): float(r[3]) for r in sums}
    goals = []
    for d, name in enumerate(DIMENSIONS):
        seen: dict[str, float] = {}
        for k, v in cells.items():
            seen[k[d]] = seen.get(k[d], 0.0) + v
        goals.append(dict(targets[name]) if targets and name in targets else tempered(seen, None if keep_targets else budget))
    weights, _, _ = rake(cells, goals)
    chance, share, gap = fit(cells, weights, goals, budget, keep_targets)
    if cells and (gap > MET or share < min(1.0, BUDGET if budget is None else budget) - MET):
        logging.getLogger(__name__).warning("sampled %.4f of the tokens (budget %s), largest gap to a target share %.6f", share, BUDGET if budget is None else budget, gap)
    table = spark.createDataFrame([(*k, weights[k], chance[k]) for k in sorted(cells)] or [("", "", "", 0.0, 0.0)], "source_cell string, lang_cell string, topic_cell string, weight double, probability double")
    out = found.join(F.broadcast(table) if len(cells) <= BROADCAST_ROWS else table, list(made), "left")
    out = out.withColumn("probability", F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("sampled", F.col("_u") < F.col("probability"))
    out = out.withMetadata("probability", {"share": share, "gap": gap})
    return out.select("row.*", *added)


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, with their own columns."""
    own = {k: options.pop(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("lang_col", "lang"))}
    rows = packed(docs, doc_id=own["id_col"], text=own["text_col"], source=own["source_col"], lang=own["lang_col"])
    return mix(rows, columns=["row"], **options).filter("sampled").select("row.*")


#: Target token shares of languages in the query; sources and topics are tempered.
TARGETS = {"lang": {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.12, OTHER: 0.02}}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), TARGETS, columns=["doc_id"]).select("doc_id", "source_cell", "lang_cell", "topic_cell", "tokens", "weight", "probability", "sampled")
