"""Toxicity classifier with a counterfactual regulariser.

A word's logit is the sum of the weights of its hashed subwords (the word, its
first six and its first four bytes); a text's logit is a bias plus the
weighted sum of its two largest word logits, so a toxic remark in a long text
is not averaged away and one chance word does not decide. Weights start at damped log-odds of the labelled documents and
are trained by gradient descent on the logistic loss. For every labelled
sentence that names a group, the term is swapped for another of the list and
the squared change of the sentence's score, the sum of its word logits, is
added to the loss, so a group's mere mention cannot carry a score (pooled
logits would not show a term that stands beside two toxic words).

Defined cases: null, empty and wordless texts get the bias's score; without
labelled rows of both classes every score is 0; repeated rows are scored
each; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import ALNUM, _MASK, eights, mix, slices, span_hashes, word_spans
from .quality import scored

BITS = 18
EPOCHS = 60
RATE = 0.3
DECAY = 0.02
PULL = 4.0
THRESHOLD = 0.3
#: Documents that a start weight must outweigh.
DAMP = 4.0
#: Shares of the largest and the second largest word logit in a text's.
SHARES = (0.25, 0.75)
#: Labelled documents that must hold a subword for it to get a weight.
SUPPORT = 4

#: Group terms that are swapped for one another.
IDENTITY_TERMS = (
    "women men muslims christians jews hindus buddhists atheists gay lesbian bisexual transgender straight "
    "black white asian african latino european immigrants refugees foreigners disabled deaf blind old young"
).split()

_SENTENCE_END = np.isin(np.arange(256), [10, 33, 46, 63])


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower-case the accented Latin letters too (À-Þ, two bytes each)."""
    second = np.flatnonzero(buf[:-1] == 0xC3) + 1
    second = second[(buf[second] >= 0x80) & (buf[second] <= 0x9E) & (buf[second] != 0x97)]
    if len(second):
        buf = buf.copy()
        buf[second] += 0x20
    return buf


def subwords(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets ``[word, 3]`` of each word's subwords."""
    shift = np.uint64(64 - bits)
    head = eights(buf)[starts]
    size = np.minimum(ends - starts, 8)
    six, four = head & _MASK[np.minimum(size, 6)], head & _MASK[np.minimum(size, 4)]
    return np.stack([mix(span_hashes(buf, starts, ends)) >> shift, mix(six + np.uint64(1 << 62)) >> shift,
                     mix(four + np.uint64(1 << 63)) >> shift], 1).astype(np.int64)


def top_two(logits: np.ndarray, first: np.ndarray):
    """Per row ``(index of the largest, of the second)``, -1 where there is
    none; rows are ``first[i]:first[i + 1]``."""
    n = len(first) - 1
    out = np.full((2, n), -1)
    left = logits.copy()
    full = np.flatnonzero(np.diff(first) > 0)
    row = np.repeat(np.arange(n), np.diff(first))
    for k in range(2):
        rows = full if k == 0 else np.flatnonzero(np.diff(first) > 1)
        if not len(rows):
            break
        most = np.full(n, np.inf)
        most[full] = np.maximum.reduceat(left, first[full])
        hit = np.flatnonzero(left == most[row])
        at, which = np.unique(row[hit], return_index=True)
        use = np.isin(at, rows)
        out[k, at[use]] = hit[which][use]
        left[out[k, at[use]]] = -np.inf
    return out


def pooled(logits: np.ndarray, first: np.ndarray):
    """Per row the weighted sum of the two largest logits, and their places;
    in a row of one word it counts twice."""
    places = top_two(logits, first)
    places[1] = np.where(np.diff(first) == 1, places[0], places[1])
    padded = np.append(logits, 0.0)
    return np.array(SHARES) @ padded[places], places


def counterfactuals(texts, terms=IDENTITY_TERMS, seed: int = 5):
    """Sentences of the texts that name a group, and the same with another."""
    rng = np.random.default_rng(seed)
    found, swapped = [], []
    known = {t.encode() for t in terms}
    for _, _, buf, off in slices(pa.array(texts, pa.string())):
        starts, ends, first = word_spans(buf, off, ALNUM)
        whole = buf.tobytes()
        for i in range(len(off) - 1):
            for w in range(first[i], first[i + 1]):
                if whole[starts[w]:ends[w]] in known:
                    stops = np.flatnonzero(_SENTENCE_END[buf[off[i]:off[i + 1]]]) + off[i]
                    at = int(np.searchsorted(stops, starts[w]))
                    a = int(stops[at - 1]) + 1 if at else int(off[i])
                    b = int(stops[at]) if at < len(stops) else int(off[i + 1])
                    mine = whole[starts[w]:ends[w]]
                    other = terms[int(rng.integers(len(terms)))].encode()
                    found.append(whole[a:b].decode("utf-8", "replace"))
                    swapped.append((whole[a:starts[w]] + (other if other != mine else terms[0].encode())
                                    + whole[ends[w]:b]).decode("utf-8", "replace"))
    return found, swapped


def _matrix(texts):
    """Subword buckets of all words, and each text's first word."""
    parts, firsts, base = [], [np.zeros(1, np.int64)], 0
    for _, _, buf, off in slices(pa.array(texts, pa.string())):
        buf = folded(buf)
        starts, ends, first = word_spans(buf, off, ALNUM)
        parts.append(subwords(buf, starts, ends))
        firsts.append(first[1:] + base)
        base += len(starts)
    return (np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)), np.concatenate(firsts)


def fit(texts, labels, terms=IDENTITY_TERMS, pull: float = PULL) -> bytes:
    """Model: a float per bucket, then the bias."""
    if len(set(labels)) < 2:
        return np.append(np.zeros(1 << BITS), -np.inf).astype(np.float32).tobytes()
    y = np.asarray(labels, float)
    words, first = _matrix(texts)
    row = np.repeat(np.arange(len(y)), np.diff(first))
    held = np.zeros((2, 1 << BITS))
    for j in range(3):
        pairs = np.unique(row * (1 << BITS) + words[:, j])
        r, f = pairs >> BITS, pairs & ((1 << BITS) - 1)
        for k in (0, 1):
            held[k] += np.bincount(f[y[r] == k], minlength=1 << BITS)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    ratio = n[0] / n[1]
    start = np.log((held[1] * ratio + DAMP) / (held[0] + DAMP))
    supported = held.sum(axis=0) >= SUPPORT
    weights, bias = np.where(supported, start / 3, 0.0), -2.0
    found, swapped = counterfactuals(texts, terms)
    one, one_first = _matrix(found)
    two, two_first = _matrix(swapped)
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    speed = np.full(1 << BITS, 1e-8)
    bias_speed = 1e-8

    def back(grad, places, g):
        for k in range(2):
            ok = places[k] >= 0
            for j in range(3):
                np.add.at(grad, words[places[k][ok], j], g[ok] * SHARES[k])

    for _ in range(EPOCHS):
        z, places = pooled(weights[words].sum(axis=1), first)
        p = 1 / (1 + np.exp(-(z + bias)))
        g = (p - y) * share
        grad = DECAY * weights / len(y)
        back(grad, places, g)
        if len(found):
            both = [(m, np.repeat(np.arange(len(found)), np.diff(f))) for m, f in ((one, one_first), (two, two_first))]
            za, zb = (np.bincount(r, weights[m].sum(axis=1), len(found)) for m, r in both)
            change = pull * 2 * (za - zb) / len(found)
            for (m, r), side in zip(both, (change, -change)):
                for j in range(3):
                    np.add.at(grad, m[:, j], side[r])
        grad *= supported
        speed += grad * grad
        weights = weights - RATE * grad / np.sqrt(speed)
        bias_speed += g.sum() ** 2
        bias -= RATE * g.sum() / np.sqrt(bias_speed)
    return np.append(weights, bias).astype(np.float32).tobytes()


def scores(buf: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    buf = folded(buf)
    starts, ends, first = word_spans(buf, off, ALNUM)
    logits = weights[subwords(buf, starts, ends)].sum(axis=1, dtype=np.float64)
    z, _ = pooled(logits, first)
    return 1 / (1 + np.exp(-(z + np.float64(weights[-1]))))


def score_toxicity(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text",
                   keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, *keep, score, predicted)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda buf, off: scores(buf, off, np.frombuffer(shared.value, np.float32)),
                  doc_id, text, keep, threshold, lower=True)
