"""Quality classifier by supervised subword embeddings.

A text's features are its words, its word pairs (a repeated word is one
shared pair) and its character 3-grams, case and symbols kept, each hashed to
one of ``2**BITS`` learned vectors. The vectors are averaged per document and
a softmax output over the two classes follows; vectors and output are trained
together by numpy stochastic gradient descent on a bounded sample with equally
weighted classes. For scoring, averaging and the output's linear part are
swapped: each bucket's vector is multiplied with the output once, so a task
needs one number per bucket and sums those of a text.

Defined cases: null and empty texts have no features and get the score of the
output's bias; without labelled rows of both classes every score is 0.5;
repeated rows are scored each; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import NOT_SPACE, eights, mix, slices, span_hashes, word_spans

BITS = 16
DIMENSIONS = 16
EPOCHS = 6
BATCH = 32
RATE = 0.4
THRESHOLD = 0.3

_TRIGRAM = np.uint64(0xFFFFFF)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def features(buf: np.ndarray, off: np.ndarray, bits: int = BITS):
    """Three ``(buckets, first, end)`` families: per row the buckets
    ``first[i]:end[i]`` are its words, word pairs and character 3-grams."""
    shift = np.uint64(64 - bits)
    starts, ends, first = word_spans(buf, off, NOT_SPACE)
    words = span_hashes(buf, starts, ends)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(5))
    pairs = np.where(words[:-1] == words[1:], np.uint64(0x5BD1E9955BD1E995), pairs)
    pairs = np.append(pairs, np.zeros(len(words) - len(pairs), np.uint64))  # as many as words; the last is in no row
    grams = ((eights(buf)[:len(buf)] & _TRIGRAM) + np.uint64(1)) * _MULTIPLIER
    last = np.maximum(first[1:] - 1, first[:-1])
    return ((mix(words) >> shift, first[:-1], first[1:]), (pairs >> shift, first[:-1], last),
            (grams >> shift, off[:-1], np.maximum(off[1:] - 2, off[:-1])))


def train(rows, labels, bits: int = BITS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = 7):
    """``(vectors, output, bias)`` by SGD; ``rows`` are per document the
    distinct buckets and their shares of the document's features."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels)
    vectors = rng.uniform(-1, 1, (1 << bits, dimensions)) / dimensions
    output, bias = np.zeros((dimensions, 2)), np.zeros(2)
    weight = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))[y]
    steps = epochs * ((len(y) + BATCH - 1) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            part = order[at:at + BATCH]
            means = np.stack([rows[i][1] @ vectors[rows[i][0]] for i in part])
            z = means @ output + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[part][:, None]
            back = p @ output.T
            output -= rate * means.T @ p
            bias -= rate * 0.1 * p.sum(axis=0)
            for j, i in enumerate(part):  # buckets of one row are distinct
                vectors[rows[i][0]] -= rate * rows[i][1][:, None] * back[j] * dimensions
    return vectors, output, bias


def distinct_rows(texts) -> list:
    """Per text ``(distinct buckets, shares)``."""
    out = []
    for _, _, buf, off in slices(pa.array(texts, pa.string()), lower=False):
        families = features(buf, off)
        for i in range(len(off) - 1):
            got = np.concatenate([f[a[i]:b[i]] for f, a, b in families])
            u, n = np.unique(got, return_counts=True)
            out.append((u.astype(np.int64), n / max(1, len(got))))
    return out


def fit(texts, labels) -> bytes:
    """Folded model: a float per bucket, then the bias."""
    if len(set(labels)) < 2:
        return np.zeros((1 << BITS) + 1, np.float32).tobytes()
    vectors, output, bias = train(distinct_rows(texts), labels)
    toward = output[:, 1] - output[:, 0]
    return np.append(vectors @ toward, bias[1] - bias[0]).astype(np.float32).tobytes()


def scores(buf: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of class 1 per row."""
    total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1, np.int64)
    for f, a, b in features(buf, off):
        sums = np.concatenate([[0.0], np.cumsum(weights[f.astype(np.int64)], dtype=np.float64)])
        total += sums[b] - sums[a]
        count += b - a
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + weights[-1])))


def score_quality(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text",
                  keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, *keep, score, predicted)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda buf, off: scores(buf, off, np.frombuffer(shared.value, np.float32)),
                  doc_id, text, keep, threshold, lower=False)


def scored(docs: DataFrame, score, doc_id: str, text: str, keep, threshold: float, lower: bool) -> DataFrame:
    """Apply ``score(bytes, offsets)`` to every whole text."""
    def run(batches):
        for b in batches:
            for lo, hi, buf, off in slices(b.column(1), lower=lower):
                n = hi - lo
                s = np.asarray(score(buf, off), np.float64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), *(b.column(2 + x).slice(lo, n) for x in range(len(keep))),
                     pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", *keep, "score", "predicted"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text_"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text_")
    return source.mapInArrow(run, f"{fields}, score double, predicted int")
