"""Plain versions of the operators for small fixtures."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, items digest, contaminated)} by looking at every place."""
    out, patterns = {}, []
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        patterns += [(str(name), w[i : i + k]) for i in range(len(w) - k + 1 if w else 0)]
    by_first = {}
    for name, p in patterns:
        by_first.setdefault(p[0], []).append((name, p))
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for i, first in enumerate(w):
            for name, p in by_first.get(first, ()):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(name)
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(ids, linked):
    """Smallest id reachable over ``linked(a, b)``, all pairs tried."""
    best = {i: i for i in ids}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    order = list(ids)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                best[y] = x
    return {i: root(i) for i in ids}


def jaccard_components(docs, width: int = 5):
    sets = {i: shingle_set(t, width) for i, t in docs}

    def linked(a, b):
        return bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])

    return {i: (len(sets[i]), c) for i, c in components(sorted(sets), linked).items()}
