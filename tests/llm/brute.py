"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").translate(UPPER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact_dedup(rows):
    """rows (doc_id, text) -> (doc_id, keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(low(t))))
    return out


def decontaminate(rows, items, size=13):
    wins = []
    for item, t in items:
        w = ALNUM.findall(low(t))
        k = min(size, len(w))
        wins += [(item, w[s:s + k]) for s in range(len(w) - k + 1)] if w else []
    out = []
    for i, t in rows:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text, k=5):
    w = TOKEN.findall(low(text))
    if not w:
        return set()
    return {tuple(w[s:s + k]) for s in range(max(1, len(w) - k + 1))}


def jaccard(rows, k=5, percent=80):
    """rows (doc_id, text) -> (doc_id, n_shingles, component_id)."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    low_id = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low_id[root(x)] = min(i, low_id.get(root(x), i))
    return [(i, len(sets[x]), low_id.get(root(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)]


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target}, by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = float(most * sizes[s])
        open_ -= above
    return out
