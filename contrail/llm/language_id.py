"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed greedily: each phrase is the longest
match of what follows anywhere in the language's text, read off the automaton. The fewer phrases, the more the document
resembles that language; the language with the fewest normalised phrases wins. Phrases are normalised to bits per byte,
phrases * log2(reference length) / document length.

Labelled text is a bounded sample of whole rows, with parameters for its bounds (Bounds): for each language, rows of up to
`row` bytes by the hash of their doc_id until `language` bytes are reached; a language without such a row has its shortest
one, whatever its size. With many languages `total` is shared out, but each has `least`. There may be any number of
languages. Documents
are parsed whole, all documents of a batch and all languages in step, one byte of each at a time, so a step is a few numpy
operations. The transitions of all automata lie in one table of about three places each, whatever the alphabet.

Bytes are folded to classes first: letters a-z without case, every byte of a multi-byte character by itself, digits, white
space and other characters one class each.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is everything if no labelled text
exists. Ties go to the first language by name. Labelled rows with a null language, text or doc_id are not learnt from. Repeated rows
are learnt from as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrail.llm._spark import crc_fold, documents, in_arrow, packed, shared
from contrail.llm._text import LOWER, utf8

UNKNOWN = "und"

class Bounds(NamedTuple):
    """Of the learning sample, in bytes: of a language, of a row, of all languages together, and least of a language."""

    language: int = 48_000
    row: int = 3_000
    total: int = 800_000
    least: int = 4_000


#: A label is corrected if the language found leads the second by so much, relatively.
LEAD = 0.15
#: Bytes of documents parsed together, beside the longest.
PARSE_BYTES = 24 << 20
#: Places of the transition table for each transition.
ROOM = 3


def byte_classes() -> np.ndarray:
    """Class of each byte; 0 is other characters, 1 white space, 2 digits."""
    c = np.zeros(256, np.uint8)
    c[[0x20, *range(0x09, 0x0E)]] = 1
    c[0x30:0x3A] = 2
    c[0x61:0x7B] = np.arange(3, 29)
    c[0x80:] = np.arange(29, 29 + 128)
    return c[LOWER]


CLASSES = byte_classes()


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start. Every substring, and nothing else, can be
    walked from the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
        last = new
    return step


class Model:
    """Automata of all languages in one sparse table. A state is a number s; its transition by class c is in place s + c,
    which holds s and the next state, so that a place of another state is told from its own. State 0 has no transition."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        coded = {k: [CLASSES[np.frombuffer(t, np.uint8)] for t in samples[k]] for k in self.langs}
        used = np.unique(np.concatenate([np.ones(1, np.uint8), *[x for v in coded.values() for x in v]]))
        # Classes that no language has share the last column.
        self.column = np.full(256, len(used), np.uint8)
        self.column[used] = np.arange(len(used))
        self.width = len(used) + 1
        flat = {k: [int(c) for x in coded[k] for c in (*self.column[x], self.column[1])] for k in self.langs}  # samples are joined by a space
        automata = [suffix_automaton(flat[k]) for k in self.langs]
        self.bits = [np.log2(max(2, len(flat[k]))) for k in self.langs]
        self.table, self.start = self._packed(automata)
        self.again = np.array([[self._step(s, c) for s in self.start] for c in range(self.width)], np.int64)

    def _packed(self, automata: list[list[dict[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(table, start states): states with most transitions are placed first, each at a random place where its classes
        fall on free ones."""
        size = ROOM * sum(len(row) + 1 for a in automata for row in a) + 2 * self.width
        free, taken, r = bytearray(b"\1" * (size + self.width)), bytearray(size), random.Random(0)
        taken[0] = 1
        number = [[0] * len(a) for a in automata]
        for a, s in sorted(((a, s) for a, states in enumerate(automata) for s in range(len(states))), key=lambda x: -len(automata[x[0]][x[1]])):
            row = automata[a][s]
            at = r.randrange(1, size)
            while taken[at] or not all(free[at + c] for c in row):
                at = r.randrange(1, size)
            taken[at] = 1
            number[a][s] = at
            for c in row:
                free[at + c] = 0
        place = [number[a][s] + c for a, states in enumerate(automata) for s, row in enumerate(states) for c in row]
        value = [number[a][s] << 32 | number[a][t] for a, states in enumerate(automata) for s, row in enumerate(states) for t in row.values()]
        table = np.zeros(size + self.width, np.int64)
        table[place] = value
        return table, np.array([n[0] for n in number], np.int64)

    def _step(self, state: int, column: int) -> int:
        v = int(self.table[state + column])
        return v & 0xFFFFFFFF if v >> 32 == state else 0

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """int64[documents, languages]: phrases of each document in each language."""
        n, m = len(off) - 1, len(self.langs)
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        first, size = off[:-1][order], size[order]
        code = self.column[CLASSES[buf]]
        again = np.where(self.again == 0, self.start, self.again)
        state, count = np.tile(self.start, (n, 1)), np.zeros((n, m), np.int32)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if n else 0), "left")
        for t, k in enumerate(live.tolist()):
            c = code[first[:k] + t]
            s = state[:k]
            v = self.table[s + c[:, None]]
            miss = v >> 32 != s
            # Where the match cannot go on, a phrase ends before this byte and the next begins with it; a byte that the
            # language lacks is a phrase by itself, after which none is open (the state is the start).
            count[:k] += miss | (s == self.start)
            v &= 0xFFFFFFFF
            np.copyto(v, again[c], where=miss)
            state[:k] = v
        out = np.zeros((n, m), np.int64)
        out[order] = count
        return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bounds: Bounds = Bounds()) -> dict[str, list[bytes]]:
    """The bounded learning sample, as {language: texts}."""
    size = F.octet_length(text_col).alias("size")
    good = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    whole = F.when(size <= bounds.row, 1)
    counts = {r[0]: r[1:] for r in good.groupBy(lang_col).agg(F.count(whole), F.sum(F.when(size <= bounds.row, size)), F.min(size)).collect()}
    if not counts:
        return {}
    most = max(bounds.least, min(bounds.language, bounds.total // len(counts)))
    # A hash threshold thins each language to about twice the bytes wanted, and rows to spare, before any are ranked, so no
    # window is large.
    plan = [(lang, min(1.0, 2.0 * most / max(1, b or 0) + 16.0 / max(1, n)), bounds.row if n else least) for lang, (n, b, least) in counts.items()]
    plan = docs.sparkSession.createDataFrame(plan, good.select(F.col(lang_col).alias("lang"), F.lit(0.0).alias("share"), F.lit(0).alias("longest")).schema)
    u = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("u")
    near = good.select(F.col(lang_col).alias("lang"), u, F.encode(text_col, "UTF-8").alias("text"), size).join(F.broadcast(plan), "lang").filter((F.col("u") < F.col("share") * (1 << 20)) & (F.col("size") <= F.col("longest")))
    order = Window.partitionBy("lang").orderBy("u", "text")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out: dict[str, list[bytes]] = {}
    for r in near.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most).orderBy("lang", "u", "text").collect():
        out.setdefault(r.lang, []).append(bytes(r.text))
    return out


def _parse(batches: Iterator[pa.RecordBatch], model, text: str | None) -> Iterator[pa.RecordBatch]:
    m = model()
    for batch in batches:
        langs, scores = [], []
        buf, off = utf8(batch.column(0) if text is None else batch.column("row").field(text))
        letters = batch.column(1).to_numpy(zero_copy_only=False)
        lo, n = 0, len(off) - 1
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + PARSE_BYTES, "right")) - 1))
            rate = m.phrases(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) * np.array(m.bits) / np.maximum(1, np.diff(off[lo : hi + 1]))[:, None]
            best = rate.argmin(axis=1)
            low = rate[np.arange(hi - lo), best]
            other = rate.copy()
            other[np.arange(hi - lo), best] = np.inf
            second = other.min(axis=1) if rate.shape[1] > 1 else np.full(hi - lo, 8.0)
            ok = letters[lo:hi].astype(bool)
            langs += [m.langs[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)]
            scores.append(np.where(ok, np.clip(1 - low / np.maximum(second, 1e-9), 0, 1), 0.0))
            lo = hi
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(2, batch.num_columns)], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names[2:], "lang_pred", "score"])


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ("doc_id",), bounds: Bounds = Bounds()) -> DataFrame:
    """The carried columns of docs with lang_pred and score, the relative lead of the best language over the second. Where a
    struct `row` that has the text is carried, text_col being `row.<name>`, the text goes to Python once."""
    found = sample(labelled, id_col, text_col.removeprefix("row."), lang_col, bounds)
    kept = docs.select(*carry)
    if not found:
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    model = shared(docs.sparkSession, Model(found))
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    inside = text_col.removeprefix("row.") if "row" in carry and text_col.startswith("row.") else None
    rows = docs.select(F.col(text_col).alias("_0") if inside is None else F.lit(0).alias("_0"), letter.alias("_1"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return in_arrow(rows, lambda it: _parse(it, model, inside), f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, labelled: DataFrame, lead: float = LEAD) -> DataFrame:
    """docs whose language is found, with all their columns. Rejected are texts without a letter; text of any language,
    however noisy, stays. lang becomes the language found where it is null and where the one found has that lead, so what
    later stages do by language follows the text."""
    found = identify(packed(docs), labelled, text_col="row.text", carry=("row",)).filter(F.col("lang_pred") != UNKNOWN)
    own = F.col("row.lang")
    lang = F.when(own.isNull() | ((F.col("score") >= lead) & (own != F.col("lang_pred"))), F.col("lang_pred")).otherwise(own)
    return found.select(*[lang.alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, docs.filter(crc_fold() != 0))
    return out.select("doc_id", (crc_fold() == 0).alias("held_out"), "lang_pred", "score")
