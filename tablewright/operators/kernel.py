r"""Kernel machines by random Fourier features (Rahimi and Recht 2007).

``cos(w.x + b)`` over D random directions w approximates the radial kernel
``exp(-gamma |x - y|^2)`` by inner products, so a linear learner on these
features learns non-linear borders and curves with memory that does not grow
with the rows. Directions follow from a seed: a saved map is a few numbers.

* :class:`FourierFeatures` is the map as a pipeline stage.
* :class:`EpsilonSVR` fits ``|w|^2 / 2 + C sum max(0, |f(x) - y| - epsilon)``
  for numbers.
* :class:`KernelSVC` fits ``|w|^2 / 2 + C sum max(0, 1 - s f(x))`` for classes,
  one against the rest (``s`` is 1 or -1; two classes are one such problem).
  The classes share each pass over the rows.

Both keep the rows as they are, packed in blocks, and map them anew in every
pass, a slice that fits a core's cache at a time: the mapped rows would be a
hundred times as large, and are never written or cached. Tasks send the loss,
its gradient and its curvature (D + 1 squared numbers, whatever the rows),
which are summed on the executors; Newton steps follow on the driver. A pass
also tries shorter steps, so nearly every pass is a step. Above
:data:`MOST_CURVED` components the curvature would outgrow a task, and L-BFGS
steps need the gradient only. The corner of the loss is rounded over a width
that shrinks to a small share of the targets' spread, or of the margin; rows
beyond the corner have no gradient at any width. MLlib's rule for a smaller
objective (a scale per row) is kept: all terms are divided by the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_COMPONENTS = 300
# Fixed value: the half-width of the tube in which errors cost nothing.
DEFAULT_EPSILON = 0.1
#: Rows mapped at once: their features stay in a core's cache.
SLICE = 512
#: Rows of a packed block.
BLOCK = 4096
#: Largest angle that single precision holds to five digits after the point.
FAR = 128.0
#: Components up to which a pass sends the curvature (8 MB).
MOST_CURVED = 1000
#: Shares of a Newton step that the pass after it tries.
SHARES = np.array([1.0, 0.5, 0.25, 0.125, 2.0 ** -4, 2.0 ** -6, 2.0 ** -8, 2.0 ** -11])


def directions(width: int, components: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, phases)`` of the map: the same for the same arguments."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return (math.sqrt(2 * gamma) * rng.standard_normal((width, components)),
            rng.uniform(0, 2 * math.pi, components))


def mapped(x: np.ndarray, weights: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = x @ weights
    z += phases
    np.cos(z, out=z)
    z *= math.sqrt(2 / len(phases))
    return z


class Map:
    """Cosines of a map and a last column of ones, without the factor
    ``sqrt(2 / D)``: :attr:`scale` has it, and 1 for the ones. Angles are taken
    in single precision, but for rows so far out that it would blur them."""

    def __init__(self, weights: np.ndarray, phases: np.ndarray):
        self.turn = np.column_stack([weights, np.zeros(len(weights))])
        self.phases = np.append(phases, 0.0)
        self.scale = np.append(np.full(len(phases), math.sqrt(2 / len(phases))), 1.0)
        self.small = self.turn.astype(np.float32), self.phases.astype(np.float32)
        self.reach = float(np.abs(weights).sum(axis=0).max(initial=0.0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        far = np.abs(x).max(axis=1, initial=0.0) * self.reach > FAR
        z = np.where(far[:, None], 0, x).astype(np.float32) @ self.small[0]
        z += self.small[1]
        out = np.cos(z, out=z).astype(float)
        if far.any():
            out[far] = np.cos(x[far] @ self.turn + self.phases)
        return out

    def scores(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """``points`` (a row of D weights and an intercept each) applied to all rows."""
        at = (points * self.scale).T
        return np.concatenate([self(x[i:i + SLICE]) @ at for i in range(0, len(x), SLICE)] or [np.zeros((0, len(points)))])


def scale_gamma(data: DataFrame, features_col: str = "features") -> float:
    """``1 / (width * variance of all entries)``, the usual default; 1 / width
    where all entries are equal. One aggregate."""
    return _scale(data.agg(_moments(features_col)).first()["s"])


def _moments(features_col: str) -> Column:
    return Summarizer.metrics("count", "mean", "variance").summary(F.col(features_col)).alias("s")


def _scale(got) -> float:
    mean, n = got["mean"].toArray(), got["count"]
    spread = got["variance"].toArray() * (n - 1) / n if n else got["variance"].toArray()
    spread = float(np.mean(spread + mean * mean) - np.mean(mean) ** 2)
    return 1.0 / (len(mean) * (spread if spread > 1e-12 else 1.0))


def as_matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Map(Params):
    """What defines a map."""
    width = Param(Params._dummy(), "width", "length of the input vectors", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "number of random directions", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel exp(-gamma |x - y|^2)", TypeConverters.toFloat)

    def _directions(self):
        return directions(self.getOrDefault(self.width), self.getOrDefault(self.components),
                          self.getOrDefault(self.gamma), self.getOrDefault("seed"))


class FourierFeatures(Transformer, _Map, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable,
                      DefaultParamsWritable):
    """Vector column -> vector column of random Fourier features."""

    @keyword_only
    def __init__(self, *, width=1, components=DEFAULT_COMPONENTS, gamma=1.0, seed=42, inputCol="features",
                 outputCol="kernel_features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(components=DEFAULT_COMPONENTS, gamma=1.0, seed=42, inputCol="features",
                         outputCol="kernel_features")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, phases = self._directions()

        @F.arrow_udf("array<double>")
        def features(x: pa.Array) -> pa.Array:
            out = np.zeros((len(x), len(phases)))
            rows = as_matrix(x)
            for at in range(0, len(rows), SLICE):
                out[at:at + SLICE] = mapped(rows[at:at + SLICE], weights, phases)
            ends = np.arange(0, (len(x) + 1) * len(phases), len(phases), dtype=np.int32)[:len(x) + 1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        x = vector_to_array(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(features(x)))


class EpsilonSVRModel(Model, _Map, HasFeaturesCol, HasPredictionCol, HasSeed, DefaultParamsReadable,
                      DefaultParamsWritable):
    """Predictions ``w . map(x) + b``."""
    weights = Param(Params._dummy(), "weights", "a weight per direction", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "added to all", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", seed=42, weights=[], intercept=0.0)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def predicted(self, features_col: str) -> Column:
        turn, phases = self._directions()
        machine = np.array([[*self.getOrDefault(self.weights), 0.0]])
        to, b = Map(turn, phases), self.getOrDefault(self.intercept)

        @F.arrow_udf("double")
        def scores(x: pa.Array) -> pa.Array:
            return pa.array(to.scores(as_matrix(x), machine)[:, 0] + b)

        return scores(vector_to_array(F.col(features_col)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), self.predicted(self.getFeaturesCol()))


class KernelSVCModel(Model, _Map, HasFeaturesCol, HasPredictionCol, HasSeed, DefaultParamsReadable,
                     DefaultParamsWritable):
    """The class of the highest score (the smallest on ties); of two classes the
    second where its score is above 0."""
    machines = Param(Params._dummy(), "machines", "D weights and an intercept per score, one after the other",
                     TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", seed=42, machines=[])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        to = Map(*self._directions())
        machines = np.array(self.getOrDefault(self.machines)).reshape(-1, len(to.phases))

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            got = to.scores(as_matrix(x), machines)
            return pa.array((got.argmax(axis=1) if len(machines) > 1 else got[:, 0] > 0).astype(float))

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(F.col(self.getFeaturesCol()))))


def tube_loss(residual: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The loss outside the tube and its slope; the corner rounded over ``width``."""
    loss, slope = _rounded(np.abs(residual) - epsilon, width)
    return loss, slope * np.sign(residual)


def _rounded(over: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """``max(0, over)`` with its corner rounded over ``width``, and its slope."""
    over = np.maximum(over, 0)
    corner = np.minimum(over, width)
    return corner * (over - corner / 2) / width, corner / width


@dataclass(frozen=True)
class Tube:
    """The loss of a number ``y``, whose ``middle`` the scores leave out."""
    epsilon: float
    middle: float
    width: float

    def __call__(self, scores: np.ndarray, y: np.ndarray):
        return tube_loss(scores + self.middle - y[:, None], self.epsilon, self.width)


@dataclass(frozen=True)
class Hinge:
    """The loss of a class against the rest."""
    label: int
    width: float

    def __call__(self, scores: np.ndarray, y: np.ndarray):
        side = np.where(y == self.label, 1.0, -1.0)[:, None]
        loss, slope = _rounded(1 - side * scores, self.width)
        return loss, -side * slope


def minimise(value_and_gradient, start: np.ndarray, max_iter: int, tolerance: float = 1e-6, memory: int = 10,
             floor: float = 1e-12):
    """L-BFGS with a backtracking search, until a step gains no more than ``tolerance``
    of the value (of ``floor`` at least); ``(point, value, calls)``."""
    x = start
    f, g = value_and_gradient(x)
    calls, past = 1, []
    for _ in range(max_iter):
        d, kept = -g, []
        for s, y, r in reversed(past):
            a = r * (s @ d)
            d = d - a * y
            kept.append(a)
        if past:
            s, y, _ = past[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, float(np.sqrt(g @ g)))
        for (s, y, r), a in zip(past, reversed(kept)):
            d = d + s * (a - r * (y @ d))
        slope = float(g @ d)
        if slope > -1e-16:
            break
        step = 1.0
        for _ in range(20):
            new = x + step * d
            f_new, g_new = value_and_gradient(new)
            calls += 1
            if f_new <= f + 1e-4 * step * slope:
                break
            # the minimum of the parabola through what is known, within bounds
            step *= min(0.5, max(0.1, -slope * step / (2 * (f_new - f - slope * step))))
        else:
            break
        s, y = new - x, g_new - g
        gain = f - f_new
        x, f, g = new, f_new, g_new
        if s @ y > 1e-12 * (y @ y):
            past = [*past[-(memory - 1):], (s, y, 1.0 / (s @ y))]
        if gain <= tolerance * max(abs(f), floor):
            break
    return x, f, calls


def newton_steps(start: np.ndarray, max_iter: int, tolerance: float, floor: float = 1e-12) -> Generator:
    """Newton steps that ask for what they need: yields ``(point, back)``, is sent
    the values at ``point + (1 - share) * back`` for all :data:`SHARES` and
    gradient and curvature at ``point``; returns ``(point, value, calls)``, when a
    step gained no more than ``tolerance`` of the value (of ``floor`` at least)."""
    still = np.zeros_like(start)
    x = start
    values, g, h = yield x, still
    f, calls = float(values[0]), 1
    for _ in range(max_iter):
        # the lift keeps directions that no row curves finite
        lift = (1e-10 * np.trace(h) / len(x) + 1e-12) * np.eye(len(x))
        d = np.linalg.solve(h + lift, -g)
        if not g @ d < -1e-16:
            break
        values, g_new, h_new = yield x + d, -d
        calls += 1
        best = int(values.argmin())
        if not values[best] < f:
            break
        x = x + SHARES[best] * d
        if best:
            values, g_new, h_new = yield x, still
            calls += 1
            best = 0
        gain, f, g, h = f - float(values[best]), float(values[best]), g_new, h_new
        if gain <= tolerance * max(abs(f), floor):
            break
    return x, f, calls


def newton(along, start: np.ndarray, max_iter: int, tolerance: float = 1e-6):
    """:func:`newton_steps` of one function; ``along(point, back)`` answers them in one pass."""
    return newton_together(lambda asked: {k: along(*at) for k, at in asked.items()}, [start], max_iter, tolerance)[0]


def newton_together(along, starts: list, max_iter: int, tolerance: float = 1e-6, floor: float = 1e-12) -> list:
    """Newton steps of several functions, each pass one of every function that goes
    on: ``along({number: (point, back)})`` gives what each has to be sent."""
    steps = [newton_steps(start, max_iter, tolerance, floor) for start in starts]
    asked, done = {k: next(each) for k, each in enumerate(steps)}, {}
    while asked:
        answers, asked = along(asked), {}
        for k, answer in answers.items():
            try:
                asked[k] = steps[k].send(answer)
            except StopIteration as end:
                done[k] = end.value
    return [done[k] for k in range(len(starts))]


def fit_machines(blocks: DataFrame, to: Map, losses: list, widths, n: int, reg: float, max_iter: int,
                 unit: float = 1.0, floor: float = 1e-12) -> np.ndarray:
    """A row of D weights and an intercept per loss of ``losses``, functions of a
    corner's width: the least of ``reg |w|^2 / 2`` and the mean loss. Weights
    are sought in units of ``unit``, over ``widths`` of corner and tolerance."""
    free = np.append(np.ones(len(to.phases) - 1), 0.0)
    curved = len(free) - 1 <= MOST_CURVED
    ridge = reg * unit * free

    def along(asked: dict, of, curved: bool) -> dict:
        ends = {k: np.array([w + (1 - share) * back for share in SHARES] if back.any() else [w])
                for k, (w, back) in asked.items()}
        got = _loss(blocks, to, [of[k] for k in ends], [at * unit for at in ends.values()], n, curved)
        return {k: (f / unit + 0.5 * reg * unit * (at * at * free).sum(axis=1), g + ridge * at[0],
                    h * unit + np.diag(ridge) if curved else None)
                for (k, at), (f, g, h) in zip(ends.items(), got)}

    def alone(of):
        def value(w):
            f, g, _ = along({0: (w, np.zeros_like(w))}, [of], False)[0]
            return float(f[0]), g
        return value

    points = np.zeros((len(losses), len(free)))
    # curvatures of a pass together hold no more numbers than the largest single one
    group = max(1, (MOST_CURVED + 1) ** 2 // len(free) ** 2)
    for first in range(0, len(losses), group):
        mine = range(first, min(first + group, len(losses)))
        for width, tolerance in widths:
            of = [losses[k](width) for k in mine]
            if curved:
                found = newton_together(lambda asked: along(asked, of, True), [points[k] for k in mine], max_iter,
                                        tolerance, floor)
            else:
                found = [minimise(alone(each), points[k], max_iter, tolerance, floor=floor) for k, each in zip(mine, of)]
            points[mine.start:mine.stop] = [point for point, _, _ in found]
    return points * unit


class EpsilonSVR(Estimator, _Map, HasFeaturesCol, HasLabelCol, HasSeed):
    """Support-vector regression with the epsilon-insensitive loss."""
    keeps_rows = True
    regParam = Param(Params._dummy(), "regParam", "1 / (C n)", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half-width of the free tube", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "most steps per width of the corner", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, components=DEFAULT_COMPONENTS, gamma=None, regParam=1e-4, epsilon=DEFAULT_EPSILON,
                 maxIter=50, seed=42, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(components=DEFAULT_COMPONENTS, regParam=1e-4, epsilon=DEFAULT_EPSILON, maxIter=50, seed=42,
                         featuresCol="features", labelCol="label")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> EpsilonSVRModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        y = F.col(label).cast("double")
        known = dataset.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array(F.col(features)))).alias("width"),
                            F.percentile_approx(y, [0.25, 0.5, 0.75], 1000).alias("q"),
                            F.avg(F.abs(y)).alias("scale"), _moments(features)).first()
        gamma = self.getOrDefault(self.gamma) if self.isDefined(self.gamma) else _scale(known["s"])
        params = {"width": known["width"], "components": self.getOrDefault(self.components), "gamma": gamma,
                  "seed": self.getSeed()}
        low, middle, high = known["q"]
        epsilon = self.getOrDefault(self.epsilon)
        spread = max(high - low, epsilon, 1e-9 * (known["scale"] or 1.0), 1e-12)
        blocks = packed(dataset, features, label)
        try:
            # Weights are in units of the targets' spread around their median.
            point = fit_machines(blocks, Map(*directions(*params.values())),
                                 [lambda width: Tube(epsilon, middle, width * spread)],
                                 ((0.5, 1e-4), (0.05, 1e-4), (0.005, 1e-6)), known["n"],
                                 self.getOrDefault(self.regParam), self.getOrDefault(self.maxIter), spread)[0]
        finally:
            blocks.unpersist()
        model = EpsilonSVRModel()
        model._set(**params, featuresCol=features, weights=point[:-1].tolist(), intercept=float(point[-1] + middle))
        return model


class KernelSVC(Estimator, _Map, HasFeaturesCol, HasLabelCol, HasSeed):
    """Support-vector classification of labels 0 .. K-1."""
    keeps_rows = True
    regParam = Param(Params._dummy(), "regParam", "1 / (C n)", TypeConverters.toFloat)
    classes = Param(Params._dummy(), "classes", "number of labels", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "most steps per width of the corner", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, classes=2, components=DEFAULT_COMPONENTS, gamma=None, regParam=1e-4, maxIter=100, seed=42,
                 featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(classes=2, components=DEFAULT_COMPONENTS, regParam=1e-4, maxIter=100, seed=42,
                         featuresCol="features", labelCol="label")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> KernelSVCModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        known = dataset.agg(_moments(features)).first()["s"]
        gamma = self.getOrDefault(self.gamma) if self.isDefined(self.gamma) else _scale(known)
        params = {"width": len(known["mean"]), "components": self.getOrDefault(self.components), "gamma": gamma,
                  "seed": self.getSeed()}
        k = self.getOrDefault(self.classes)
        blocks = packed(dataset, features, label)
        try:
            # The loss of no weights is 1: a gain below 1e-6 of it ends the last width.
            points = fit_machines(blocks, Map(*directions(*params.values())),
                                  [lambda width, j=j: Hinge(j, width) for j in (range(k) if k > 2 else [1])],
                                  ((2.0, 1e-2), (0.2, 1e-2), (0.02, 1e-4)), known["count"],
                                  self.getOrDefault(self.regParam), self.getOrDefault(self.maxIter), floor=0.01)
        finally:
            blocks.unpersist()
        model = KernelSVCModel()
        model._set(**params, featuresCol=features, machines=points.ravel().tolist())
        return model


def packed(dataset: DataFrame, features: str, label: str) -> DataFrame:
    """The rows in blocks, as the bytes of their numbers: cached, and read by a pass
    without taking rows apart. A task per core holds them, since a pass is short
    and its tasks cost more than its rows where there are few."""
    rows = dataset.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.coalesce(dataset.sparkSession.sparkContext.defaultParallelism)

    def pack(batches):
        for b in batches:
            x, y = as_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            cuts = range(0, len(y), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(v[at:at + BLOCK], float).tobytes() for at in cuts], pa.binary())
                 for v in (x, y)], names=["x", "y"])

    return rows.mapInArrow(pack, "x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)


def _loss(blocks: DataFrame, to: Map, losses: list, points: list, n: int, curved: bool) -> list:
    """Per loss, its mean over all rows at every one of its points, and the gradient
    and, if ``curved``, the curvature at the first: tasks send one vector
    each, which are summed before the shuffle and on the executors. Only rows in
    the rounded corner have a curvature."""
    size, columns = len(to.phases), np.cumsum([0] + [len(p) for p in points])
    at_points = np.concatenate(points).T * to.scale[:, None]

    def part(batches):
        values, gradients = np.zeros(columns[-1]), np.zeros((len(losses), size))
        curvatures = np.zeros((len(losses), size, size) if curved else 0)
        for b in batches:
            for x_bytes, y_bytes in zip(b.column(0), b.column(1)):
                block_y = np.frombuffer(y_bytes.as_buffer())
                block_x = np.frombuffer(x_bytes.as_buffer()).reshape(len(block_y), -1)
                for at in range(0, len(block_y), SLICE):
                    y, z = block_y[at:at + SLICE], to(block_x[at:at + SLICE])
                    scores = z @ at_points
                    for k, loss in enumerate(losses):
                        mine = slice(columns[k], columns[k + 1])
                        value, slope = loss(scores[:, mine], y)
                        values[mine] += value.sum(axis=0)
                        slope = slope[:, 0]
                        gradients[k] += slope @ z
                        if curved:
                            steep = np.abs(slope)
                            corner = z[(steep > 0) & (steep < 1)]
                            curvatures[k] += corner.T @ corner / loss.width
        gradients *= to.scale
        if curved:
            curvatures *= np.outer(to.scale, to.scale)
        total = np.concatenate([values, gradients.ravel(), curvatures.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))], names=["part"])

    got = (blocks.mapInArrow(part, "part array<double>").agg(Summarizer.sum(array_to_vector("part")).alias("s"))
           .first()["s"].toArray()) / n
    values, gradients = got[:columns[-1]], got[columns[-1]:][:len(losses) * size].reshape(-1, size)
    curvatures = got[columns[-1] + gradients.size:].reshape(-1, size, size) if curved else [None] * len(losses)
    return [(values[columns[k]:columns[k + 1]], gradients[k], curvatures[k]) for k in range(len(losses))]


__all__ = ["FourierFeatures", "EpsilonSVR", "EpsilonSVRModel", "KernelSVC", "KernelSVCModel", "directions", "mapped",
           "scale_gamma", "tube_loss", "minimise", "newton", "newton_together"]
