r"""Embedding whitening by incremental eigendecomposition.

Entries become integers ``x = floor(1024 c) + 100000``. The eigenvectors of
their covariance are found in three distributed steps:

1. Every task folds its rows one by one into the spectrum of their centred
   scatter matrix: the row's distance from the running mean is a rank-one
   update ``D + rho z z'`` whose eigenvalues are the roots of the secular
   equation ``1 + rho sum z_j^2 / (d_j - t) = 0``. Entries of z that are
   negligible, and runs of equal d (rotated until one entry of z is left), are
   deflated: their eigenpairs stay as they are.
2. Spectra of different tasks are combined in a tree of tasks: each eigenpair of
   one is a rank-one update of the other, and so is the distance of their means.
3. A Rayleigh-Ritz step over all rows refines the basis Q so found: the rows,
   centred before multiplying, give ``Q' V Q``, whose small eigenproblem turns Q
   into the eigenvectors to double precision whatever errors the updates left.

What a task sends is a mean and a ``dim x dim`` matrix, whatever its rows, and
the driver receives one of these. The whitened columns' own covariance is then
taken in a pass over all rows.

Defined cases: rows whose vector is null, empty, or holds null, non-finite or
(in magnitude) 2**40 or larger entries are dropped, and so are rows of another
length than most have; a null id is an id like others; repeated rows count
each time; an empty table, a single row and equal rows only have no component,
so no rows; a component whose eigenvalue is below 1e-12 of the trace is none.
``deviation`` is exact; where it does not fit a long it is null. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .vectors import as_doubles, common_length, matrix, usable

SCALE, SHIFT = 1024.0, 100000
COMPONENTS = 8
#: Task results that one combining task takes.
FAN = 16
EPS = np.finfo(float).eps
#: Share of the trace below which an eigenvalue counts as zero.
RANK_TOLERANCE = 1e-12
_PART = "part long, blob binary"


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """Entries as ``floor(1024 c) + 100000``, exact in doubles."""
    return np.floor(SCALE * matrix(column, dim)) + SHIFT


# ---------------------------------------------------------------- spectra --

def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """``d_j - t_i`` (rows i, columns j) at the roots ``t`` of
    ``1 + sum z2_j / (d_j - t)``, for rising distinct d and positive z2.

    Each root is sought from its nearer pole, by two-pole rational steps that
    fall back to halving their bracket."""
    n = len(d)
    ends = np.append(d[1:], d[-1] + z2.sum())
    middle = 0.5 * (d + ends)
    above = 1 + (z2 / (d - middle[:, None])).sum(axis=1) > 0  # the root is left of the middle
    origin = np.where(above, d, ends)
    origin[-1] = d[-1]
    delta = d - origin[:, None]
    gap = ends - d
    low = np.where(origin == d, 0.0, -0.5 * gap)
    high = np.where(origin == d, np.where(above, 0.5, 1.0) * gap, 0.0)
    low[-1], high[-1] = (0.0, 0.5 * gap[-1]) if above[-1] else (0.5 * gap[-1], gap[-1])
    t = 0.5 * (low + high)
    left = np.tri(n, dtype=bool)
    first, second = d - origin, ends - origin
    for _ in range(80):
        away = delta - t[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            term = z2 / away
            slope = term / away
            f = 1 + term.sum(axis=1)
            noise = 4 * EPS * n * (1 + np.abs(term).sum(axis=1))
            low = np.where(f < 0, t, low)
            high = np.where(f > 0, t, high)
            p, q = first - t, second - t
            rise_left = np.where(left, slope, 0).sum(axis=1)
            rise = slope.sum(axis=1)
            a = (p + q) * f - p * q * rise
            b = p * q * f
            c = f - p * rise_left - q * (rise - rise_left)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = t + step
        done = (np.abs(f) <= noise) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        inside = np.isfinite(new) & (new > low) & (new < high)
        t = np.where(done, t, np.where(inside, new, 0.5 * (low + high)))
    return delta - t[:, None], origin + t


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (rising) of ``basis diag(values) basis' + rho v v'``, rho >= 0."""
    z = basis.T @ v
    length = float(np.sqrt(z @ z))
    if rho <= 0 or length == 0:
        return values, basis
    z, rho = z / length, rho * length * length
    scale = max(float(values[-1]), rho)

    # Runs of equal values: a reflection leaves one entry of z in each.
    edges = np.flatnonzero(np.diff(values) > 8 * EPS * scale) + 1
    if len(edges) + 1 < len(values):
        basis, z = basis.copy(), z.copy()
        for lo, hi in zip(np.append(0, edges), np.append(edges, len(values))):
            size = np.sqrt(z[lo:hi] @ z[lo:hi])
            if hi - lo > 1 and size > 0:
                w = z[lo:hi].copy()
                w[-1] += size if w[-1] >= 0 else -size
                basis[:, lo:hi] -= np.outer(basis[:, lo:hi] @ w, w) * (2 / (w @ w))
                z[hi - 1] = -size if z[hi - 1] >= 0 else size
                z[lo:hi - 1] = 0
    live = np.flatnonzero(rho * np.abs(z) > 8 * EPS * scale)
    if not len(live):
        return values, basis

    d, zl = values[live], z[live]
    away, roots = secular_roots(d, rho * zl * zl)  # away[i, j] = d_j - t_i
    # The z that has these roots exactly (Loewner), so that vectors are orthogonal.
    with np.errstate(divide="ignore"):
        poles = np.log(np.abs(d - d[:, None]) + np.eye(len(d)))
        fitted = np.exp(0.5 * (np.log(np.abs(away)).sum(axis=0) - poles.sum(axis=0)))
    turned = np.copysign(fitted, zl) / away
    turned /= np.sqrt((turned * turned).sum(axis=1))[:, None]
    values, basis = values.copy(), basis.copy()
    values[live] = roots
    basis[:, live] = basis[:, live] @ turned.T
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Number, mean, and eigenpairs of the centred scatter matrix of rows."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.basis = np.zeros(dim), np.eye(dim)

    def add(self, row: np.ndarray) -> None:
        away = row - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: "Spectrum") -> None:
        n = self.n + other.n
        for value, vector in zip(other.values, other.basis.T):
            self.values, self.basis = rank_one(self.values, self.basis, vector, float(value))
        away = other.mean - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, away, self.n * other.n / n)
        self.mean, self.n = self.mean + away * (other.n / n), n

    def dump(self) -> bytes:
        return np.concatenate([[float(self.n)], self.mean, self.values, self.basis.ravel()]).tobytes()

    @classmethod
    def load(cls, blob: bytes) -> "Spectrum":
        flat = np.frombuffer(blob)
        dim = int(round((-2 + np.sqrt(4 + 4 * (len(flat) - 1))) / 2))
        out = cls(dim)
        out.n, out.mean, out.values = int(flat[0]), flat[1:dim + 1].copy(), flat[dim + 1:2 * dim + 1].copy()
        out.basis = flat[2 * dim + 1:].reshape(dim, dim).copy()
        return out


def _merged(blobs) -> bytes:
    whole = None
    for blob in blobs:
        part = Spectrum.load(blob)
        if whole is None:
            whole = part
        else:
            whole.merge(part)
    return whole.dump()


def _summed(blobs) -> bytes:
    whole = None
    for blob in blobs:
        part = np.frombuffer(blob)
        whole = part.copy() if whole is None else whole + part
    return whole.tobytes()


# -------------------------------------------------------------- Spark jobs --

def _folded(df: DataFrame, fold, name: str) -> DataFrame:
    """``(part, blob)``: ``fold(batches)``, bytes or None, of every task's rows."""
    def run(batches):
        blob = fold(batches)
        if blob is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int64()), "blob": pa.array([blob], pa.binary())})

    parts = df.mapInArrow(run, _PART).withColumn("part", F.spark_partition_id().cast("long"))
    return written(parts, name)


def _combined(parts: DataFrame, combine, name: str) -> bytes | None:
    """The tasks' blobs combined on the executors, FAN to one, level by level;
    the driver receives the last."""
    def run(batches):
        def groups():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        group, held = None, []
        for part, blob in groups():
            if held and part // FAN != group:
                yield packed(group, held)
                held = []
            group = part // FAN
            held.append(blob)
        if held:
            yield packed(group, held)

    def packed(group, held):
        return pa.RecordBatch.from_pydict({"part": pa.array([group], pa.int64()),
                                           "blob": pa.array([combine(held)], pa.binary())})

    while True:
        top = parts.agg(F.max("part").alias("top")).first()["top"]
        if top is None:
            return None
        if top == 0:
            return bytes(parts.first()["blob"])
        grouped = (parts.repartition(top // FAN + 1, F.expr(f"part div {FAN}"))
                   .sortWithinPartitions("part"))
        parts = written(grouped.mapInArrow(run, _PART), name)


def _sums(df: DataFrame, vector: str, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of their integers."""
    def sums(batches):
        n, total = 0, np.zeros(dim, np.int64)
        for b in batches:
            n += b.num_rows
            total += integers(b.column(0), dim).astype(np.int64).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(dim + 1), pa.int32()),
                                              "total": pa.array([n, *total.tolist()], pa.int64())})

    found = (df.select(as_doubles(vector)).mapInArrow(sums, "at int, total long")
             .groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    total = {r["at"]: int(r["total"]) for r in found}
    return total.get(0, 0), [total.get(j + 1, 0) for j in range(dim)]


def decompose(df: DataFrame, vector: str, dim: int, n: int, sums: list[int]):
    """``(values falling, basis, trace)`` of the covariance of usable rows."""
    source = df.select(as_doubles(vector))

    def spectrum(batches):
        whole = Spectrum(dim)
        for b in batches:
            for row in integers(b.column(0), dim):
                whole.add(row)
        return whole.dump() if whole.n else None

    found = Spectrum.load(_combined(_folded(source, spectrum, "whiten-spectra"), _merged, "whiten-combined"))
    basis = np.linalg.qr(found.basis)[0]
    mean = _mean(n, sums)

    def projected(batches):
        out = np.zeros((dim, dim))
        for b in batches:
            y = (integers(b.column(0), dim) - mean) @ basis
            out += y.T @ y
        return out.tobytes()

    ritz = _combined(_folded(source, projected, "whiten-ritz"), _summed, "whiten-ritz-sums")
    ritz = np.frombuffer(ritz).reshape(dim, dim) / n
    values, turn = np.linalg.eigh(0.5 * (ritz + ritz.T))
    return values[::-1], (basis @ turn)[:, ::-1], float(np.trace(ritz))


def _mean(n: int, sums: list[int]) -> np.ndarray:
    """S / n, rounded once."""
    return np.array([s // n + (s % n) / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum of ``(n x - S)**2``, null beyond a long."""
    most = (n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)) ** 2 * x.shape[1]
    if most < 2 ** 63:
        away = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    whole = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [w if w < 2 ** 63 else None for w in whole]


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "vector", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)`` for every usable row and component."""
    kind = df.schema[vec_id].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    dim = common_length(df, vector)
    n, sums, values, turn, explained = 0, [], np.zeros(0), None, []
    if dim:
        df = df.where(usable(vector) & (F.size(vector) == dim))
        n, sums = _sums(df, vector, dim)
        values, basis, trace = decompose(df, vector, dim, n, sums)
        values = values[:components]
        values = values[values > RANK_TOLERANCE * trace]
    k = len(values)
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    turn = basis[:, :k] / np.sqrt(values)
    explained = values / trace
    mean = _mean(n, sums)

    def moments(batches):
        out = np.zeros((k + 1, k))
        for b in batches:
            w = (integers(b.column(0), dim) - mean) @ turn
            out[:k] += w.T @ w
            out[k] += w.sum(axis=0)
        return out.tobytes()

    found = _combined(_folded(df.select(as_doubles(vector)), moments, "whiten-moments"), _summed, "whiten-moment-sums")
    found = np.frombuffer(found).reshape(k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())

    def whitened(batches):
        for b in batches:
            rows = b.num_rows
            x = integers(b.column(1), dim)
            w = (x - mean) @ turn
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, n, np.int64)),
                 pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                 pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(F.col(f"`{vec_id}`").alias("vec_id"), as_doubles(vector)).mapInArrow(whitened, schema)
