"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, k):
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k, num, den):
    """doc_id -> (size of the set, least doc_id that links reach) of pairs (doc_id, text)."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def hit_windows(text, windows):
    w = WORD.findall((text or "").translate(LOWER))
    return {(i, n) for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows}


def windows(items, n=10):
    out = set()
    for t in items:
        w = WORD.findall((t or "").translate(LOWER))
        out |= {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()
    return out


def mixed(docs, seed=7, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Copies of each (doc_id, source, text)."""
    size = [len(SPACED.findall(t or "")) for _, _, t in docs]
    per = Counter()
    for (_, s, _), n in zip(docs, size, strict=True):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(size), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * per[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: most * per[s] for s in full}
        left -= sum(most * per[s] for s in full)
        free -= full
    out = []
    for d, s, _ in docs:
        rate = target[s] / per[s] if per[s] else 0.0
        u = int(hashlib.md5(f"{d}:{seed}".encode()).hexdigest()[:13], 16) / 16**13
        out.append(math.floor(rate) + (u < rate - math.floor(rate)))
    return out
