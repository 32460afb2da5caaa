"""The three models' predictions against plain loops, text by text."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import ALNUM, TOKEN

from tablewright.llm import language_id, quality, toxicity
from tablewright.llm.arrowtext import mix, slices, span_hashes

ACCENTED = {c: chr(ord(c) + 32) for c in map(chr, range(0xC0, 0xDF)) if c != "×"}


def some_texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "über", "ÜBER", "a", "naïve", "x" * 40, "日本", "12", "women", "don't", "#!", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return texts + ["", "a", "ab", "  ", "the the the", " ", None, "word " * 5000, "日", "The.\nÀ"]


def word_hash(word: bytes) -> int:
    buf = np.frombuffer(word, np.uint8)
    return int(span_hashes(buf, np.array([0]), np.array([len(buf)]))[0])


def mixed(value: int) -> int:
    return int(mix(np.array([value % 2**64], np.uint64))[0])


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def of_module(module, texts, weights, lower):
    return np.concatenate([module.scores(b, o, weights) for _, _, b, o in slices(pa.array(texts, pa.string()), 2000, lower)])


def plain_quality(text, weights, bits=quality.BITS):
    raw = (text or "").encode()
    words = [word_hash(w.encode()) for w in TOKEN.findall(text or "")]
    found = [mixed(w) >> (64 - bits) for w in words]
    for a, b in zip(words, words[1:]):
        found.append((0x5BD1E9955BD1E995 if a == b else mixed(a * 3 + b * 5)) >> (64 - bits))
    for i in range(len(raw) - 2):
        gram = int.from_bytes(raw[i:i + 3], "little")
        found.append(((gram + 1) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits))
    return sigmoid(sum(float(weights[f]) for f in found) / max(1, len(found)) + float(weights[-1]))


def test_quality_prediction():
    weights = np.random.default_rng(2).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = some_texts()
    assert np.allclose(of_module(quality, texts, weights, False), [plain_quality(t, weights) for t in texts], atol=1e-9)


def plain_toxicity(text, weights, bits=toxicity.BITS):
    low = "".join(ACCENTED.get(c, c) for c in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    logits = []
    for w in ALNUM.findall(low):
        raw = w.encode()
        parts = [mixed(word_hash(raw))] + [mixed(int.from_bytes(raw[:k], "little") + top) for k, top in ((6, 1 << 62), (4, 1 << 63))]
        logits.append(sum(float(weights[p >> (64 - bits)]) for p in parts))
    top = sorted(logits, reverse=True)[:2]
    if len(top) == 1:
        top *= 2
    return sigmoid(sum(s * x for s, x in zip(toxicity.SHARES, top)) + float(weights[-1]))


def test_toxicity_prediction():
    weights = np.random.default_rng(3).normal(size=(1 << toxicity.BITS) + 1).astype(np.float32)
    texts = some_texts(seed=4)
    assert np.allclose(of_module(toxicity, texts, weights, True), [plain_toxicity(t, weights) for t in texts], atol=1e-6)


def plain_languages(text: bytes, logs, penalty):
    """``(proportions, chosen set)`` of one text by plain loops."""
    k, n = len(logs), max(len(text) - language_id.GRAM + 1, 1)
    grams = [int.from_bytes(text[i:i + language_id.GRAM], "little") for i in range(n)]
    shift = 64 - language_id.BITS
    buckets = [(g * 0x9E3779B97F4A7C15 % 2**64) >> shift for g in grams]
    runs = [[sum(float(logs[j][b]) for b in buckets[a:a + language_id.RUN]) for j in range(k)]
            for a in range(0, n, language_id.RUN)]

    def em(allowed, rounds):
        theta = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(rounds):
            total = [0.0] * k
            for r in runs:
                top = max(r)
                like = [theta[j] * math.exp(r[j] - top) for j in range(k)]
                s = max(sum(like), 1e-300)
                total = [t + x / s for t, x in zip(total, like)]
            theta = [t / len(runs) for t in total]
        value = sum(math.log(max(sum(theta[j] * math.exp(r[j] - max(r)) for j in range(k)), 1e-300)) + max(r) for r in runs)
        return theta, value

    theta, _ = em(range(k), language_id.ROUNDS)
    order = sorted(range(k), key=lambda j: -theta[j])
    alone = [sum(r[j] for r in runs) for j in range(k)]
    best, chosen = max(alone), {alone.index(max(alone))}
    cost = penalty * math.log(len(runs) + 1.0) / 2
    for size in range(2, k + 1):
        _, value = em(order[:size], 6)
        if value - (size - 1) * cost > best:
            best, chosen = value - (size - 1) * cost, set(order[:size])
    return theta, chosen


def test_language_inference():
    rng = np.random.default_rng(5)
    logs = np.log(rng.dirichlet(np.full(1 << language_id.BITS, 0.3), 5) + 1e-7).astype(np.float32)
    texts = ["".join(random.Random(i).choice("abcdefgh éñ") for _ in range(n)) for i, n in enumerate([1, 2, 3, 4, 5, 40, 300, 900])]
    for _, _, buf, off in slices(pa.array(texts, pa.string())):
        rows, share, theta = language_id.infer(language_id.gram_buckets(buf, off), off, logs)
        assert rows.tolist() == list(range(len(texts)))
        for i, text in enumerate(texts):
            want, chosen = plain_languages(text.encode(), logs, language_id.PENALTY)
            assert np.allclose(theta[:, i], want, atol=1e-6)
            assert set(np.flatnonzero(share[:, i] > 0).tolist()) <= chosen


def test_a_text_in_four_languages_names_all_four(spark):
    from pyspark.sql import functions as F
    from tablewright.llm.store import read
    docs = read(spark, "/root/testdata/sf0.1", "documents").where("length(text) > 1600")
    model = language_id.learned(read(spark, "/root/testdata/sf0.1", "documents"), F.lit(False))
    names = sorted(r[0] for r in docs.where("lang is not null").select("lang").distinct().collect())
    assert len(names) == 4
    parts = [docs.where(F.col("lang") == n).orderBy("doc_id").first()["text"][:1500] for n in names]
    got = language_id.identify(spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string"), model).first()
    assert sorted(got["langs"]) == names
