"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import numpy as np

WHITE = r"[\x20\x09-\x0d]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, k):
    w = [x for x in re.split(WHITE, lower(text)) if x]
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def near_copies(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for t in s:
            lists[t].append(i)
    both = collections.Counter()
    for v in lists.values():
        for a in range(len(v)):
            for b in range(a):
                both[(v[b], v[a])] += 1
    for (a, b), c in both.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contaminated(rows, items, window, needed, least):
    """(doc, item) pairs with an alignment in which some window of words agrees in enough places."""
    out, number = set(), collections.defaultdict(itertools.count().__next__)
    coded = lambda t: np.array([number[x] for x in re.split(WHITE, (t or "").lower()) if x], np.int64)
    items = [(i, p) for i, p in ((i, coded(t)) for i, t in items) if len(p) >= least]
    for d, text in rows:
        w = coded(text)
        for i, p in items:
            if len(np.intersect1d(w, p)) < needed(min(len(p), window)):
                continue
            width, n = min(len(p), window), len(p)
            # Row t: whether item word t stands at each alignment; padded, so that heads and tails may be missing.
            wide = np.concatenate([np.full(n - 1, -1), w, np.full(n - 1, -1)])
            same = np.array([wide[t : t + len(w) + n - 1] == p[t] for t in range(n)], np.int64)
            total = np.concatenate([np.zeros((1, same.shape[1]), np.int64), np.cumsum(same, axis=0)])
            if (total[width:] - total[:-width]).max(initial=0) >= needed(width):
                out.add((d, i))
    return out


def phrases(text, reference):
    """Greedy longest matches of a sequence in a reference sequence."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and bytes(text[i:j]) in reference:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def removed(rows, span=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - span + 1):
            if first.get(b[j : j + span], i) < i:
                gone[j : j + span] = b"\1" * span
        for j in range(len(b) - span + 1):
            first.setdefault(b[j : j + span], i)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    t, found, names = text or "", [], ["assign", "access", "hex"]
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    found.sort()
    digest = hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()
    return (*[sum(x[1] == k for x in found) for k in range(3)], digest)


BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = []
    for phrase, label in BASE.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))
