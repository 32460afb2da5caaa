"""Whitening and hard negatives against plain numpy and Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.selectExpr("*", "1 as n", "'x' as component", "2 as `row`", "3 as leaf", "4 as id", "5 as vec", "6 as score")


def some_rows(n, dim=6, seed=1, clusters=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 3))) for i in range(n)]


def clean(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(v is not None and math.isfinite(v) for v in r[1])]


# --------------------------------------------------------------- whitening --

def plain_whitening(rows, dim, k=8):
    rows = clean(rows, dim)
    x = np.floor(1024 * np.array([r[1] for r in rows])) + 100000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return [r[0] for r in rows], y @ turn / np.sqrt(values), values / np.trace(y.T @ y / n), ((n * x - total) ** 2).sum(axis=1)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_matches_numpy(spark, parts):
    rows = some_rows(150, 10)
    bad = [(1000, None, 1), (1001, [1.0] * 9 + [None], 1), (1002, [NAN] + [0.0] * 9, 1), (1003, [INF] * 10, 1), (1004, [], 1),
           (1005, [1.0], 1), (1006, [1e30] * 10, 1)]
    got = whitening.whiten(frame(spark, rows + bad, parts), vector="embedding").collect()
    ids, want, explained, deviation = plain_whitening(rows, 10)
    assert len(got) == len(ids) * 8
    table = {(r.vec_id, r.component): r for r in got}
    mine = np.array([[table[i, c].whitened for c in range(1, 9)] for i in ids])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * signs - want).max() < 1e-9
    assert {r.n for r in got} == {len(ids)} and max(r.identity_error for r in got) < 1e-10
    assert [table[i, 1].deviation for i in ids] == [int(d) for d in deviation]
    assert np.allclose([table[ids[0], c].explained for c in range(1, 9)], explained, rtol=1e-10)


def test_whitening_edge_tables(spark):
    same = [(1, [1.0, 2.0], 0)] * 5
    for rows in ([], same, same[:1], [(1, None, 1)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert whitening.whiten(df, vector="embedding").collect() == []
    line = [(i, [float(i), 2.0 * i], 0) for i in range(6)] * 2 + [(None, [9.0, 18.0], 0)]
    got = whitening.whiten(frame(spark, line), vector="embedding").collect()
    assert len(got) == 13 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_deviation_beyond_a_long_is_null():
    x = np.array([[0.0], [2.0 ** 39]])
    assert whitening.deviations(x, 10 ** 4, [10 ** 4]) == [10 ** 8, None]
    assert whitening.deviations(np.array([[3.0], [5.0]]), 2, [8]) == [4, 4]


def test_rank_one_updates_keep_the_decomposition():
    rng = np.random.default_rng(3)
    for trial in range(200):
        d = int(rng.integers(1, 16))
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        values = np.sort(rng.choice([0, 0, 1, 1 + 1e-14, 2, 1e-9, 1e6], d))
        v = q[:, 0] * 3 if trial % 3 == 0 else rng.normal(size=d) * rng.choice([1, 1e-3, 100])
        rho = rng.random() * 5
        want = q @ np.diag(values) @ q.T + rho * np.outer(v, v)
        got, turn = whitening.rank_one(values, q, v, rho)
        scale = max(1.0, np.abs(want).max())
        assert np.abs(turn.T @ turn - np.eye(d)).max() < 1e-11
        assert np.abs(turn @ np.diag(got) @ turn.T - want).max() < 1e-11 * scale
        assert (np.diff(got) >= 0).all()


def test_spectra_merge_to_the_whole_spectrum():
    rows = np.random.default_rng(5).normal(size=(300, 12)) * 100 + 1e5
    parts = [whitening.Spectrum(12) for _ in range(4)]
    for k, row in enumerate(rows):
        parts[k % 4 if k < 299 else 0].add(row)
    whole = whitening.Spectrum.load(parts[0].dump())
    for part in parts[1:]:
        whole.merge(part)
    y = rows - rows.mean(axis=0)
    assert whole.n == 300
    assert np.abs(whole.basis @ np.diag(whole.values) @ whole.basis.T - y.T @ y).max() < 1e-6 * np.abs(y.T @ y).max()


# --------------------------------------------------------- hard negatives --

def plain_mining(rows, dim, positives=5, negatives=10, every=100):
    last = float("inf")
    rows = [(r[0], [math.floor(256 * v) for v in r[1]], r[2]) for r in clean(rows, dim) if r[2] is not None]
    out = []
    for a, anchor in enumerate(rows):
        if anchor[0] is None or anchor[0] % every:
            continue
        score = [sum(x * y for x, y in zip(anchor[1], r[1])) for r in rows]
        order = sorted((b for b in range(len(rows)) if b != a),
                       key=lambda b: (-score[b], last if rows[b][0] is None else rows[b][0]))
        for p in [b for b in order if rows[b][2] == anchor[2]][:positives]:
            fits = [b for b in order if rows[b][2] != anchor[2] and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(anchor[0], rows[p][0], k, rows[b][0], score[p], score[b]) for k, b in enumerate(fits[:negatives], 1)]
    return sorted(out, key=repr)


def mined(df, every=100, **options):
    found = hard_negatives.mine(df, F.expr(f"id % {every} = 0"), vector="embedding", **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 20, "sample": 200, "block_rows": 16},
                                     {"leaf_rows": 8, "sample": 64, "block_rows": 7}, {"sample": 4}])
def test_mining_matches_plain_python(spark, options):
    rows = some_rows(300, 5, seed=2)
    rows += [(1000, None, 1), (1001, [1.0] * 4 + [None], 1), (1002, [NAN] * 5, 1), (1003, [INF] * 5, 1), (1004, [1.0] * 5, None),
             (1005, [1.0] * 4, 1), (1006, [], 1)]
    rows += rows[:40] + [(None, rows[3][1], 1), (None, rows[4][1], 2)] + [(7, rows[9][1], 2)] * 30  # repeated rows, ties, no id
    assert mined(frame(spark, rows), 20, **options) == plain_mining(rows, 5, every=20)


def test_mining_edge_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)) == []  # no anchor
    assert mined(spark.createDataFrame([(100, [1.0, 2.0], 0)], SCHEMA)) == []  # nothing beside the anchor
    rows = [(100, [1.0], 0), (1, [1.0], 0), (2, [0.5], 1), (3, [0.95], 1), (4, [-1.0], 1), (5, [0.0], 0)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain_mining(rows, 1) != []


def test_mining_refuses_scores_beyond_a_long(spark):
    rows = [(100, [2.0 ** 38] * 2, 0), (1, [1.0, 1.0], 0)]
    with pytest.raises(ValueError, match="exact in a long"):
        mined(spark.createDataFrame(rows, SCHEMA))


def test_tree_drops_only_leaves_off_the_annulus():
    rng = random.Random(4)
    x = np.array([[rng.randint(-300, 300) + 2000 * (k % 8 == j) for j in range(8)] for k in range(2000)])
    length2 = int((x * x).sum(axis=1).max())
    up = hard_negatives.lifted(x, length2)
    root, n = hard_negatives.build(up[::10], 60)
    leaf, path = hard_negatives.descend(root, up)
    assert n > 20 and len(set(leaf.tolist())) > 20
    ranges = {}
    for k, node in enumerate(hard_negatives.nodes(root)):
        s = len(node.points)
        low, high = np.full((s, s), np.inf), np.full((s, s), -np.inf)
        for at, _, away, child in path:
            if at == k:
                for j in set(child.tolist()):
                    low[:, j], high[:, j] = away[child == j].min(axis=0), away[child == j].max(axis=0)
        ranges[k] = (low, high)
    index = hard_negatives.Index(root, ranges, length2, None, None, None, None)
    anchors = x[:50]
    score = anchors @ x.T
    least, most = np.sort(score, axis=1)[:, -40], np.sort(score, axis=1)[:, -5]
    reached = {(a, f) for f, at in index.leaves(anchors, least, most) for a in at.tolist()}
    needed = {(a, int(leaf[b])) for a in range(50) for b in np.flatnonzero((score[a] >= least[a]) & (score[a] <= most[a]))}
    assert needed <= reached
    assert len(reached) < 0.5 * 50 * n  # and most leaves are dropped
