"""Incremental linear models trained by one stochastic-gradient pass.

A ``partial_fit``-style call makes one pass over the new rows, split into
shards (parameter averaging, Zinkevich et al. 2010):

1. every row goes to a shard by a hash of its content; there is one shard per
   ``SHARD_ROWS`` rows, so shards depend on the rows alone, not on files,
   partitions or the cluster;
2. a task runs its shards' rows in hash order through mini-batch SGD (vectorised
   over ``BATCH`` rows) from the current weights, which are broadcast, and emits one
   weight vector and one row count per shard. Rows stay sparse all the way: a
   one-hot feature costs an index and a value, however many categories it has;
3. the shards' vectors are averaged on the executors, weighted by rows
   (``Summarizer``, combined before the shuffle); one row comes back.

Losses follow the usual defaults: hinge for classes (one-vs-all beyond two
classes, step size ``1 / (alpha (t0 + t))``), squared error for regression
(step ``eta0 / t^0.25``); L2 penalty ``alpha``. A batch's step is damped by its
rows' squared length, which keeps it stable at any number of features. The
result is that of neither one sequential pass nor another shard size; it is
the same for the same rows. Prediction is a JVM-side dot product for up to
``EXPRESSION_WEIGHTS`` weights, and a sparse product with broadcast weights in
Arrow batches beyond.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ALPHA = 1e-4
DEFAULT_ETA0 = 0.01
DEFAULT_POWER_T = 0.25
#: Rows of a shard (about), and of a vectorised step.
SHARD_ROWS = 20_000
BATCH = 16
#: Weights up to which a model is written out as a column expression.
EXPRESSION_WEIGHTS = 2000


@dataclass
class SGDState:
    task_type: str
    classes: list | None
    coef: list                # k rows × d
    intercept: list           # k
    t: float = 1.0
    alpha: float = DEFAULT_ALPHA
    eta0: float = DEFAULT_ETA0
    power_t: float = DEFAULT_POWER_T
    n_seen: int = 0
    passes: int = 0
    extra: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "SGDState":
        return SGDState(**json.loads(text))


def new_state(task_type: str, n_features: int, classes=None, alpha: float = DEFAULT_ALPHA) -> SGDState:
    k = 1 if task_type != "classification" or len(classes) <= 2 else len(classes)
    return SGDState(task_type, list(classes) if classes is not None else None,
                    [[0.0] * n_features for _ in range(k)], [0.0] * k, alpha=float(alpha))


def _optimal_init(alpha: float) -> float:
    typw = math.sqrt(1.0 / math.sqrt(alpha))
    eta0 = typw / max(1.0, 1.0)
    return 1.0 / (eta0 * alpha)


class Rows:
    """Rows of a vector column in compressed form: ``values[at[i]:at[i + 1]]`` of
    row i stand at ``indices[at[i]:at[i + 1]]``."""

    def __init__(self, indices: np.ndarray, values: np.ndarray, at: np.ndarray):
        self.indices, self.values, self.at = indices, values, at

    @classmethod
    def of(cls, indices: pa.Array, values: pa.Array) -> "Rows":
        """From the parts of a vector column; a dense vector has no indices."""
        n = len(values)
        at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(values).to_numpy(zero_copy_only=False))])
        at = at.astype(np.int64)
        flat = values.flatten().to_numpy(zero_copy_only=False)
        place = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
        if indices.null_count < n:
            row = np.repeat(np.arange(n), np.diff(at))
            sparse = ~indices.is_null().to_numpy(zero_copy_only=False)[row]
            place[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
        return cls(place, flat, at)

    def part(self, lo: int, hi: int) -> "Rows":
        a, b = self.at[lo], self.at[hi]
        return Rows(self.indices[a:b], self.values[a:b], self.at[lo:hi + 1] - a)

    def __len__(self) -> int:
        return len(self.at) - 1

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Products with weight rows: a row per row, a column per weight row."""
        row = np.repeat(np.arange(len(self)), np.diff(self.at))
        return np.stack([np.bincount(row, self.values * w[self.indices], minlength=len(self)) for w in weights], axis=1)


class _Pass:
    """SGD over one shard's rows, from the state's weights. The weights are
    ``scale * coef``, so that a step touches only the features it has."""

    def __init__(self, state: dict, coef: np.ndarray):
        self.classification = state["task_type"] == "classification"
        self.classes = state["classes"]
        self.alpha, self.eta0, self.power_t = state["alpha"], state["eta0"], state["power_t"]
        self.t0 = _optimal_init(self.alpha) if self.classification else 0.0
        self.coef, self.scale = coef.copy(), 1.0
        self.bias = np.array(state["intercept"], dtype=float)
        self.t, self.n = float(state["t"]), 0

    def weights(self) -> np.ndarray:
        return self.coef * self.scale

    def targets(self, ys) -> np.ndarray:
        if not self.classification:
            return np.asarray(ys, dtype=float)[:, None]
        ys = np.asarray(ys, dtype=object)
        known = np.array(self.classes, dtype=object)
        if len(self.coef) == 1:
            return np.where(ys == known[-1], 1.0, -1.0)[:, None]
        return np.where(ys[:, None] == known[None, :], 1.0, -1.0)

    def step(self, x: Rows, y: np.ndarray) -> None:
        for at in range(0, len(x), BATCH):
            xb, yb = x.part(at, min(at + BATCH, len(x))), y[at:at + BATCH]
            p = self.scale * xb.times(self.coef) + self.bias
            if self.classification:
                eta = 1.0 / (self.alpha * (self.t0 + self.t - 1.0))
                loss = np.where(p * yb <= 1.0, -yb, 0.0)
            else:
                eta = self.eta0 / math.pow(self.t, self.power_t)
                loss = p - yb
            m = len(xb)
            rate = eta / (1.0 + eta * ((xb.values * xb.values).sum() + m))
            self.scale *= max(0.0, 1.0 - rate * self.alpha * m)
            if self.scale < 1e-6:
                self.coef, self.scale = self.coef * self.scale, 1.0
            row = np.repeat(np.arange(m), np.diff(xb.at))
            for k in range(len(self.coef)):
                np.subtract.at(self.coef[k], xb.indices, rate / self.scale * loss[row, k] * xb.values)
            self.bias -= rate * loss.sum(axis=0)
            self.t += m
            self.n += m


def _shard_pass(state: dict, coef):
    """Executor-side: shards arrive one after another, each in hash order."""
    def row(shard, at: _Pass, unseen):
        flat = np.concatenate([at.weights().ravel(), at.bias, [at.t]])
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat)), pa.array([at.n], pa.int64()),
             pa.array([unseen], pa.string())], names=["weights", "n", "unseen"])

    def run(batches):
        known = set(state["classes"] or [])
        current, at, unseen = None, None, None
        for b in batches:
            shards = b.column(0).to_numpy()
            whole = Rows.of(b.column(1), b.column(2))
            edges = np.flatnonzero(np.diff(shards)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(shards)]):
                if hi == lo:
                    continue
                if shards[lo] != current:
                    if at is not None:
                        yield row(current, at, unseen)
                    current, at, unseen = shards[lo], _Pass(state, coef.value), None
                ys = b.column(3).slice(lo, hi - lo).to_pylist()
                if at.classification:
                    strange = set(ys) - known | ({unseen} if unseen is not None else set())
                    unseen = min(strange) if strange else None
                at.step(whole.part(lo, hi), at.targets(ys))
        if at is not None:
            yield row(current, at, unseen)
    return run


def _vector_parts(features_col: str) -> list[Column]:
    """Indices (null where the vector is dense) and values of a vector column."""
    v = F.unwrap_udt(F.col(features_col))
    return [F.when(v["type"] == 0, v["indices"]).alias("i"), v["values"].alias("x")]


def sgd_pass(state: SGDState, data: DataFrame, features_col: str = "features",
             label_col: str = "__label", shard_rows: int = SHARD_ROWS, by=None) -> SGDState:
    """One averaged SGD pass over ``data`` (vector features, raw label). ``by``
    names the raw columns whose hash deals and orders the rows (default: the
    vector and the label)."""
    rows = data.select(*_vector_parts(features_col),
                       F.col(label_col).cast("string" if state.task_type == "classification" else "double")
                       .alias("y"), *([F.xxhash64(*[F.col(f"`{c}`") for c in by]).alias("h")] if by else []))
    if not by:
        rows = rows.withColumn("h", F.xxhash64("i", "x", "y"))
    total = data.count()
    if not total:
        return state
    shards = math.ceil(total / shard_rows)
    dealt = rows.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "i", "x", "y", "h")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "y").select("shard", "i", "x", "y")
    small = asdict(replace(state, coef=[]))
    coef = data.sparkSession.sparkContext.broadcast(np.array(state.coef, dtype=float))
    parts = dealt.mapInArrow(_shard_pass(small, coef), "weights array<double>, n long, unseen string")
    out = parts.agg(
        Summarizer.mean(array_to_vector("weights"), F.col("n").cast("double")).alias("mean"),
        F.sum("n").alias("n"), F.min("unseen").alias("unseen"))
    got = out.first()
    if got["unseen"] is not None:
        raise ValueError(f"The label {got['unseen']!r} did not occur when the model was first fitted.")
    mean = got["mean"].toArray()
    k, d = np.array(state.coef).shape
    return SGDState(state.task_type, state.classes, mean[:k * d].reshape(k, d).tolist(), mean[k * d:k * d + k].tolist(),
                    float(mean[-1]), state.alpha, state.eta0, state.power_t, state.n_seen + got["n"],
                    state.passes + 1, dict(state.extra))


def _dot(arr: Column, weights, bias: float) -> Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(arr, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) + F.lit(float(bias))


def _scores(state: SGDState, features_col: str) -> Column:
    """An array of one score per weight row."""
    if sum(map(len, state.coef)) <= EXPRESSION_WEIGHTS:
        arr = vector_to_array(F.col(features_col))
        return F.array(*[_dot(arr, w, b) for w, b in zip(state.coef, state.intercept)])
    weights, bias = np.array(state.coef, dtype=float), np.array(state.intercept, dtype=float)
    shared = SparkSession.getActiveSession().sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def scores(indices: pa.Array, values: pa.Array) -> pa.Array:
        out = Rows.of(indices, values).times(shared.value) + bias if len(values) else np.zeros((0, len(bias)))
        ends = np.arange(len(values) + 1, dtype=np.int32) * len(bias)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.ravel()))

    return scores(*_vector_parts(features_col))


def predict_expr(state: SGDState, features_col: str = "features") -> Column:
    """Prediction as a column of the feature vector."""
    scores = _scores(state, features_col)
    if state.task_type != "classification":
        return scores[0]
    if len(state.coef) == 1:
        return F.when(scores[0] > 0, F.lit(state.classes[1])).otherwise(F.lit(state.classes[0]))
    idx = F.array_position(scores, F.array_max(scores))
    return F.element_at(F.array(*[F.lit(c) for c in state.classes]), idx.cast("int"))


def importance_values(state: SGDState) -> list[float]:
    """|coefficients| of the first row (the first class against the rest)."""
    return [abs(v) for v in state.coef[0]]
