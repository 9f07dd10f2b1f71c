"""Plain, slow versions of the operators, written from their definitions."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def contamination(docs, items):
    """docs: (doc_id, text); items: (item_id, text). Rows of (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = alnum_words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    found |= ids
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text):
    w = space_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(docs):
    """(doc_id, n_shingles, component_id, n_links) by testing every pair."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = list(range(len(sets)))
    links = [0] * len(sets)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(d, len(s), least[find(i)], links[i]) for i, (d, s) in enumerate(sets)]


def repeats(docs, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = {}
    for _, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out
