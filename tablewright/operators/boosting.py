"""Gradient boosting: several classes on the softmax loss, numbers on squares.

For classes every round grows one small regression tree per class, together: the
trees of a round follow the residuals ``y_k - p_k`` of shared scores, whose
softmax is the class probabilities (Friedman 2001); MLlib boosts two classes.
For numbers the rounds are those of MLlib's ``GBTRegressor``: the first tree
follows the target, each further one twice the residuals and counts by the
learning rate.

Features are cut once into at most ``BINS`` bins at approximate quantiles, and
trees see the bins only. So rows of equal bins move alike, and where features
are so few that their bins make at most ``MOST_SUMS`` numbers, one pass adds the
rows up by bins, exactly, and the trees grow on these sums; otherwise they grow on
the rows. A level of all trees of a round is one pass: tasks add up residuals,
numbers and weights per (tree, node, feature, bin) in Arrow batches; these
sums, bounded by trees, nodes and bins whatever the rows, are combined on the
executors, and the best cuts and the leaves' values are taken from them on the
driver. Rows (or sums) keep their scores as of a written table that is renewed
every ``RENEW`` rounds; a pass adds the trees since.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path
from .kernel import as_matrix

BINS = 32
RENEW = 10
#: Numbers (8 bytes) that a task holds at most to add rows up by their bins.
MOST_SUMS = 1 << 20
#: Rows that a task adds up at a time.
SLICE = 1 << 16
MAX_DEPTH = 3


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Tree:
    """A tree as a heap: node i has children 2i+1 and 2i+2. ``feature`` is -1
    where a node is a leaf; rows above ``cut``, and NaN, go right."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size), np.zeros(size)

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after ``levels`` levels (a leaf above stays)."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(levels):
            f = self.feature[at]
            right = ~(x[rows, f] <= self.cut[at])
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at

    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def to_list(self):
        return [self.feature.tolist(), self.cut.tolist(), self.value.tolist()]

    @classmethod
    def from_list(cls, parts) -> "Tree":
        out = cls.__new__(cls)
        out.feature, out.cut, out.value = (np.array(p) for p in parts)
        return out


def added(scores: np.ndarray, x: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    """Scores with the trees of further rounds."""
    scores = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[tree.nodes(x, tree.depth())]
    return scores


class _Boosted(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Scores: their start and the trees' values."""
    trees = Param(Params._dummy(), "trees", "rounds of trees, as JSON", TypeConverters.toString)
    prior = Param(Params._dummy(), "prior", "each score without trees", TypeConverters.toListFloat)
    gains = Param(Params._dummy(), "gains", "gain of each feature", TypeConverters.toListFloat)
    losses = Param(Params._dummy(), "losses", "training loss before each round and at last", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", trees="[]", prior=[], gains=[], losses=[])

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    @property
    def featureImportances(self) -> DenseVector:
        gains = np.array(self.getOrDefault(self.gains))
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def rounds(self) -> list[list[Tree]]:
        return [[Tree.from_list(t) for t in r] for r in json.loads(self.getOrDefault(self.trees))]

    def scores(self, x: np.ndarray) -> np.ndarray:
        prior = np.array(self.getOrDefault(self.prior))
        return added(np.tile(prior, (len(x), 1)), x, self.rounds())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rounds, prior, answer = self.rounds(), np.array(self.getOrDefault(self.prior)), self._answer

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            rows = as_matrix(x)
            return pa.array(answer(added(np.tile(prior, (len(rows), 1)), rows, rounds)))

        x = vector_to_array(F.col(self.getFeaturesCol()))
        return dataset.withColumn(self.getPredictionCol(), predicted(x))


class SoftmaxBoostedModel(_Boosted):
    """``prediction`` is the class of the highest score (the smallest on ties)."""

    @staticmethod
    def _answer(scores: np.ndarray) -> np.ndarray:
        return scores.argmax(axis=1).astype(float)


class SquareBoostedModel(_Boosted):
    """``prediction`` is the score."""

    @staticmethod
    def _answer(scores: np.ndarray) -> np.ndarray:
        return scores[:, 0]


class Softmax:
    """Classes: ``t`` of a state row has its numbers of rows per class."""

    def __init__(self, k: int):
        self.k = k

    def followed(self, scores, n, t):
        """What the trees follow, its weights, and the loss."""
        p = softmax(scores)
        loss = -(t * np.log(np.maximum(p, 1e-300))).sum()
        return t - n[:, None] * p, n[:, None] * p * (1 - p), loss

    def step(self, residual, weight):
        return (self.k - 1) / self.k * residual / weight if weight > 1e-12 else 0.0


class Square:
    """Numbers: ``t`` has the sum of the targets. The loss is without what
    depends on the targets alone."""
    k = 1

    def followed(self, scores, n, t):
        f = scores[:, 0]
        return t - n[:, None] * scores, n[:, None], float((n * f * f - 2 * t[:, 0] * f).sum())

    def step(self, residual, weight):
        return residual / weight


class SoftmaxBoosting(Estimator, HasFeaturesCol, HasLabelCol):
    """Boosted trees for labels 0 .. K-1."""
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of labels", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, classes=2, maxIter=100, stepSize=0.1, maxDepth=MAX_DEPTH, featuresCol="features",
                 labelCol="label"):
        super().__init__()
        self._setDefault(classes=2, maxIter=100, stepSize=0.1, maxDepth=MAX_DEPTH, featuresCol="features",
                         labelCol="label")
        self._set(**self._input_kwargs)

    keeps_rows = True

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostedModel:
        k, rate = self.getOrDefault(self.classes), self.getOrDefault(self.stepSize)
        y = F.col(self.getLabelCol()).cast("int")
        rows = dataset.where(y.isNotNull()).select(
            vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
            F.array(*[(y == j).cast("double") for j in range(k)]).alias("t"))
        known, cuts = _known(rows, [F.sum(F.col("t")[j]).alias(f"n{j}") for j in range(k)])
        prior = np.log(np.array([max(known[f"n{j}"], 1e-9) / known["n"] for j in range(k)]))
        rounds = [(rate, 1.0)] * self.getOrDefault(self.maxIter)
        done, gains, losses = _boost(rows, cuts, Softmax(k), prior, rounds, self.getOrDefault(self.maxDepth))
        model = SoftmaxBoostedModel()
        model._set(featuresCol=self.getFeaturesCol(), prior=prior.tolist(), gains=gains.tolist(),
                   losses=[v / known["n"] for v in losses],
                   trees=json.dumps([[t.to_list() for t in trees] for trees in done]))
        return model


class SquareBoosting(Estimator, HasFeaturesCol, HasLabelCol):
    """Boosted trees for numbers, by the rounds of MLlib's ``GBTRegressor``."""
    keeps_rows = True
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, maxIter=100, stepSize=0.1, maxDepth=MAX_DEPTH, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=MAX_DEPTH, featuresCol="features", labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SquareBoostedModel:
        y = F.col(self.getLabelCol()).cast("double")
        rows = dataset.where(y.isNotNull()).select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), y.alias("y"))
        known, cuts = _known(rows, [F.avg("y").alias("mean"), F.stddev_pop("y").alias("spread")])
        # targets in units of their spread around their mean; the first tree's values move back
        mean, unit = known["mean"], known["spread"] or 1.0
        rows = rows.select("x", F.array((F.col("y") - mean) / unit).alias("t"))
        rate = 2 * self.getOrDefault(self.stepSize)
        rounds = [(1.0, 1.0)] + [(rate, 4.0)] * (self.getOrDefault(self.maxIter) - 1)
        done, gains, losses = _boost(rows, cuts, Square(), np.zeros(1), rounds, self.getOrDefault(self.maxDepth))
        for trees in done:
            trees[0].value *= unit
        model = SquareBoostedModel()
        model._set(featuresCol=self.getFeaturesCol(), prior=[mean], gains=gains.tolist(),
                   losses=[unit ** 2 * (v / known["n"] + bool(known["spread"])) for v in losses],
                   trees=json.dumps([[t.to_list() for t in trees] for trees in done]))
        return model


def _known(rows: DataFrame, facts) -> tuple:
    """``(number of rows and further facts, cuts)``: one aggregate."""
    one = rows.select(F.size("x")).first()
    if one is None:
        raise ValueError("There is no row to boost on.")
    return _facts_and_cuts(rows, one[0], [F.count(F.lit(1)).alias("n"), *facts])


def _cuts(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature, the highest left out: one
    aggregate for all."""
    return _facts_and_cuts(rows, width, [])[1]


def _facts_and_cuts(rows: DataFrame, width: int, facts) -> tuple:
    steps = [i / BINS for i in range(1, BINS)]
    present = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(width)]
    got = rows.agg(*facts, *[e for i, v in enumerate(present) for e in (
        F.percentile_approx(v, steps, 10_000).alias(f"q{i}"), F.max(v).alias(f"top{i}"))]).first()
    cuts = []
    for i in range(width):
        points = np.unique(np.array(got[f"q{i}"] or [], float))
        cuts.append(points[points < got[f"top{i}"]] if len(points) else points)
    return got, cuts


def _boost(rows: DataFrame, cuts, loss, prior, rounds, depth: int) -> tuple:
    """``(trees of all rounds, gains of the features, loss before each round and at
    last)`` for rows ``x, t``; ``rounds`` has each round's rate and the factor of its gains."""
    k = loss.k
    cells = math.prod(len(c) + 1 for c in cuts)
    state = _summed(rows, cuts, cells, k) if cells * (k + 1) <= MOST_SUMS else \
        rows.select("x", F.lit(1.0).alias("n"), "t")
    state, path = _renewed(state.withColumn("scores", F.lit(prior.tolist())))
    done, recent = [], []
    gains, losses = np.zeros(len(cuts)), []
    for rate, factor in rounds:
        trees, gained = [Tree(depth) for _ in range(k)], np.zeros(len(cuts))
        for level in range(depth):
            found = _histograms(state, recent, trees, level, cuts, loss)
            if level == 0:
                losses.append(float(found[-1, -1][0]))
            _grow(trees, level, found, cuts, gained, lambda *sums: rate * loss.step(*sums))
        gains += factor * gained
        done.append(trees)
        recent.append(trees)
        if len(recent) == RENEW:
            old = path
            state, path = _renewed(_with_scores(state, recent))
            remove_path(rows.sparkSession, old)
            recent = []
    losses.append(_loss_of(state, recent, loss))
    remove_path(rows.sparkSession, path)
    return done, gains, losses


def _summed(rows: DataFrame, cuts, cells: int, k: int) -> DataFrame:
    """The rows added up by the bins of their features: a bin stands for its
    upper cut (the last one and NaN, which go right at every cut, for infinity)."""
    strides = np.cumprod([1] + [len(c) + 1 for c in cuts[:-1]])

    def part(batches):
        sums, waiting, many = np.zeros((k + 1, cells)), [], 0

        def flush():
            at, t = (np.concatenate(parts) for parts in zip(*waiting))
            sums[0] += np.bincount(at, minlength=cells)
            for j in range(k):
                sums[j + 1] += np.bincount(at, t[:, j], minlength=cells)
            waiting.clear()

        for b in batches:
            x, t = as_matrix(b.column(0)), as_matrix(b.column(1))
            if not len(x):
                continue
            at = np.zeros(len(x), np.int64)
            for f, c in enumerate(cuts):
                at += np.searchsorted(c, x[:, f], "left") * strides[f]
            waiting.append((at, t))
            many += len(x)
            if many >= max(cells, SLICE):
                flush()
                many = 0
        if waiting:
            flush()
        held = np.flatnonzero(sums[0])
        for at in range(0, len(held), SLICE):
            mine = held[at:at + SLICE]
            ends = np.arange(0, (len(mine) + 1) * k, k, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine), pa.array(sums[0, mine]),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[1:, mine].T.ravel()))], names=["cell", "n", "t"])

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    added_up = rows.coalesce(tasks).mapInArrow(part, "cell long, n double, t array<double>").groupBy("cell").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("t"))).alias("t"))
    edge = [F.element_at(F.lit([*c.tolist(), math.inf]),
                         (F.floor(F.col("cell") / int(stride)) % (len(c) + 1) + 1).cast("int"))
            for c, stride in zip(cuts, strides)]
    return added_up.select(F.array(*edge).alias("x"), "n", "t")


def _renewed(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a written table, so that lineage ends there, and its path."""
    path = scratch_path(df.sparkSession, "boosting")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _arrays(b: pa.RecordBatch):
    return as_matrix(b.column(0)), b.column(1).to_numpy(), as_matrix(b.column(2)), as_matrix(b.column(3))


def _sums(state: DataFrame, part) -> dict:
    """``{(class, node): sums}`` of all tasks' ``part(batches)``."""
    def run(batches):
        got = part(batches)
        if got:
            yield pa.RecordBatch.from_pydict(
                {"k": pa.array([k for k, _ in got], pa.int32()), "node": pa.array([n for _, n in got], pa.int32()),
                 "sums": pa.array([v.tolist() for v in got.values()], pa.list_(pa.float64()))})

    found = (state.mapInArrow(run, "k int, node int, sums array<double>").groupBy("k", "node")
             .agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).collect())
    return {(r["k"], r["node"]): r["sums"].toArray() for r in found}


def _histograms(state: DataFrame, recent, trees, level: int, cuts, loss) -> dict:
    """Per tree and open node, residuals, numbers and weights by feature and bin; under
    (-1, -1) the loss."""
    width, bins = len(cuts), max((len(c) for c in cuts), default=0) + 1

    def part(batches):
        out = {}
        total = 0.0
        for b in batches:
            x, n, t, scores = _arrays(b)
            if not len(n):
                continue
            residual, weight, lost = loss.followed(added(scores, x, recent), n, t)
            total += lost
            place = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
            place = np.where(np.isnan(x), bins - 1, place) + np.arange(width) * bins
            for j, tree in enumerate(trees):
                at = tree.nodes(x, level)
                for node in np.unique(at):
                    if node < 2 ** level - 1:
                        continue
                    mine = at == node
                    flat = place[mine].ravel()
                    both = np.concatenate([np.bincount(flat, np.repeat(v[mine], width), minlength=width * bins)
                                           for v in (residual[:, j], n, weight[:, j])])
                    out[j, int(node)] = out[j, int(node)] + both if (j, int(node)) in out else both
        if out:
            out[-1, -1] = np.array([total])
        return out

    return _sums(state, part)


def _grow(trees, level: int, found: dict, cuts, gains: np.ndarray, step) -> None:
    """The best cut of every open node: the largest fall in squared residuals; the
    values of what it cuts, or of the node, are the ``step`` of residuals and weights."""
    width, bins = len(cuts), max((len(c) for c in cuts), default=0) + 1
    for (j, node), both in sorted(found.items()):
        if j < 0:
            continue
        residual, number, weight = both.reshape(3, width, bins)
        if not level and width:
            trees[j].value[node] = step(residual[0].sum(), weight[0].sum())
        left_r, left_n = residual.cumsum(axis=1)[:, :-1], number.cumsum(axis=1)[:, :-1]
        all_r, all_n = residual.sum(axis=1, keepdims=True), number.sum(axis=1, keepdims=True)
        right_r, right_n = all_r - left_r, all_n - left_n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_r ** 2 / left_n + right_r ** 2 / right_n - all_r ** 2 / all_n
        known = np.arange(bins - 1) < np.array([len(c) for c in cuts])[:, None]
        gain = np.where(known & (left_n >= 1) & (right_n >= 1), gain, -1.0)
        if not gain.size:
            continue
        f, at = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, at] > 1e-12 * max(1.0, float(all_n[0, 0])):
            trees[j].feature[node], trees[j].cut[node] = f, cuts[f][at]
            trees[j].value[node] = 0.0
            for side, part in enumerate((slice(0, at + 1), slice(at + 1, bins))):
                trees[j].value[2 * node + 1 + side] = step(residual[f, part].sum(), weight[f, part].sum())
            gains[f] += gain[f, at]


def _loss_of(state: DataFrame, recent, loss) -> float:
    def part(batches):
        total = None
        for b in batches:
            x, n, t, scores = _arrays(b)
            if len(n):
                total = (total or 0.0) + loss.followed(added(scores, x, recent), n, t)[2]
        return {} if total is None else {(-1, -1): np.array([total])}

    return float(_sums(state, part)[-1, -1][0])


def _with_scores(state: DataFrame, recent) -> DataFrame:
    def run(batches):
        for b in batches:
            x, n, t, scores = _arrays(b)
            new = added(scores, x, recent) if len(n) else scores
            ends = np.arange(len(n) + 1, dtype=np.int32) * (new.shape[1] if len(n) else 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(new.ravel()))],
                names=["x", "n", "t", "scores"])

    return state.mapInArrow(run, "x array<double>, n double, t array<double>, scores array<double>")
