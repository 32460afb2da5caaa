r"""Hard-negative mining over a multiway hyperplane tree.

Rows are vectors of integers ``floor(256 x)``; a row's score for an anchor is
their inner product. For every anchor the positives are its first rows of the
same label, and for every positive the negatives are the first rows of another
label whose score lies in a window below the positive's. Exactly, over all rows:

1. One more coordinate gives all rows the same length M, so that score and
   distance from an anchor (which gets 0 there) order alike:
   ``distance^2 = M^2 + |anchor|^2 - 2 score``, and a window of scores is an
   annulus of distances.
2. The tree's split points are rows of a bounded sample. A node has up to WAYS
   of them, picked far apart; a row goes to the nearest (a cell bounded by
   hyperplanes). The number of leaves follows the number of rows, up to what the
   sample allows. All rows are dealt to leaves, and for each two siblings i, j
   the node stores the least and greatest distance from split point i of the
   rows below j, over all rows.
3. An anchor's annulus removes, from the top, sibling j whenever for some i the
   triangle inequality with the range (i, j) puts all rows of j off the annulus.
   First bounds come from the anchor's scores within the sample: its rows are
   rows of the table, so the k-th best among them can only be improved on.
4. The anchors that reach a leaf are scored against its rows exactly, by integer
   matrix products, in blocks of bounded rows. A block returns an anchor's first
   few, which are ranked once more over all blocks.

Defined cases: rows with a null label or vector, with an empty vector or with a
null, non-finite or (in magnitude) 2**40 or larger component take no part, nor
rows of another length than most have; a null id is never an anchor, and comes last
among ties as positive or negative; rows of one id are rows of their own, the
others of them being possible positives, and each an anchor if the id is one;
ties in score and id give equal rows in any order; an empty table, or one
without anchors, gives an empty result. Vectors so long that scores leave a long
raise an error. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .vectors import as_doubles, common_length, lists, matrix, usable

SCALE = 256.0
#: Rows of the sample that the tree's split points and first bounds come from.
SAMPLE = 4096
WAYS = 16
#: Rows of a leaf that the tree is built for, and of one block.
LEAF_ROWS = 2048
BLOCK_ROWS = 16384
#: Anchors scored at once.
ANCHORS = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score that a negative may have.
LEAST, MOST = 30, 90
#: Exact integers in doubles; distances are compared with this relative slack.
EXACT = 2 ** 53
SLACK = 1e-9

_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# -------------------------------------------------------------------- tree --

@dataclass
class Node:
    """Split points (augmented) and, per child, the node or leaf below it."""
    points: np.ndarray
    below: list  # Node, or the leaf's number


def lifted(x: np.ndarray, length2: float) -> np.ndarray:
    """Rows with the coordinate that makes their squared length ``length2``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(length2 - (x * x).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def build(sample: np.ndarray, leaves: int) -> tuple[Node, int]:
    """Tree of about ``leaves`` leaves over the sample, and their number."""
    count = 0

    def grow(rows: np.ndarray, wanted: int):
        nonlocal count
        distinct = np.unique(rows, axis=0)
        ways = min(WAYS, wanted, len(distinct))
        if ways < 2:
            count += 1
            return count - 1
        # Far apart: each next split point is the row farthest from those chosen,
        # out of three times as many rows as are needed, evenly taken.
        pool = distinct[np.unique(np.linspace(0, len(distinct) - 1, 3 * ways).astype(int))]
        chosen, far = [0], distances(pool, pool[:1])[:, 0]
        while len(chosen) < min(ways, len(pool)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(pool, pool[chosen[-1:]])[:, 0])
        points = pool[chosen]
        home = distances(rows, points).argmin(axis=1)
        share = [max(1, round(wanted * float((home == j).mean()))) for j in range(len(points))]
        return Node(points, [grow(rows[home == j], share[j]) if (home == j).any() else grow(points[j:j + 1], 1)
                             for j in range(len(points))])

    root = grow(sample, leaves)
    return (root if isinstance(root, Node) else Node(sample[:1], [root])), count


def nodes(root: Node) -> list[Node]:
    """All nodes, each before those below it."""
    out = [root]
    for node in out:
        out.extend(b for b in node.below if isinstance(b, Node))
    return out


def descend(root: Node, rows: np.ndarray):
    """``(leaf of each row, [(node's number, rows there, their distances from
    its split points, child of each)])``."""
    number = {id(n): k for k, n in enumerate(nodes(root))}
    leaf, path, todo = np.zeros(len(rows), np.int32), [], [(root, np.arange(len(rows)))]
    for node, at in todo:
        away = distances(rows[at], node.points)
        child = away.argmin(axis=1)
        path.append((number[id(node)], at, away, child))
        for j, below in enumerate(node.below):
            mine = at[child == j]
            if isinstance(below, Node):
                if len(mine):
                    todo.append((below, mine))
            else:
                leaf[mine] = below
    return leaf, path


def reached(root: Node, ranges: dict, anchors: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, slack: float):
    """Yield ``(leaf, anchors)``: those that may have rows in the leaf whose
    distance lies in their annulus ``[nearest, farthest]``. ``ranges`` has, per
    node's number, the least and greatest distance of split point i from the rows
    below j (inverted where there are none)."""
    number = {id(n): k for k, n in enumerate(nodes(root))}
    todo = [(root, np.arange(len(anchors)))]
    for node, at in todo:
        low, high = ranges[number[id(node)]]
        away = distances(anchors[at], node.points)[:, :, None]
        least = np.maximum(away - high, low - away).max(axis=1)
        most = (away + high).min(axis=1)
        stays = (least <= farthest[at, None] + slack) & (most >= nearest[at, None] - slack) & (low <= high).all(axis=0)
        for j, below in enumerate(node.below):
            mine = at[stays[:, j]]
            if len(mine):
                if isinstance(below, Node):
                    todo.append((below, mine))
                else:
                    yield below, mine


# ------------------------------------------------------------------ scoring --

def products(a: np.ndarray, b: np.ndarray, length2: int) -> np.ndarray:
    """Exact integer inner products of rows whose squared length is at most
    ``length2`` (so is every partial sum's magnitude)."""
    if length2 < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_of(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` allowed rows: higher scores, then smaller ids."""
    at = np.flatnonzero(allowed)
    if len(at) > 4 * k:
        cut = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= cut]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative, for scores of positives."""
    return -((-LEAST * positive) // 100), (MOST * positive) // 100


@dataclass
class Index:
    """What tasks need of the tree: bounded by SAMPLE rows."""
    root: Node
    ranges: dict
    length2: int
    rows: np.ndarray  # the sample: row numbers, ids, labels, vectors
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @property
    def slack(self) -> float:
        return SLACK * (1 + 2 * np.sqrt(float(self.length2)))

    def distance(self, anchors: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distances that stand for scores of the anchors."""
        own = (anchors.astype(np.float64) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(self.length2 + own - 2.0 * score.astype(np.float64), 0))

    def leaves(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray):
        """``(leaf, anchors)`` for scores in [least, most]; _NONE and _LAST are
        no bounds."""
        far = np.where(least == _NONE, np.inf, self.distance(anchors, np.where(least == _NONE, 0, least)))
        near = np.where(most == _LAST, 0, self.distance(anchors, np.where(most == _LAST, 0, most)))
        flat = np.column_stack([anchors.astype(np.float64), np.zeros(len(anchors))])
        return reached(self.root, self.ranges, flat, near, far, self.slack)


# --------------------------------------------------------------- Spark jobs --

def _rows(df: DataFrame, vec_id: str, vector: str, label: str, dim: int) -> DataFrame:
    """``(row, id, label, vec)`` of the rows that take part, written."""
    def floored(batches):
        for b in batches:
            x = np.floor(SCALE * matrix(b.column(3), dim)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists(x, pa.int64())],
                                             names=["row", "id", "label", "vec"])

    part = df.where(F.col(f"`{label}`").isNotNull() & usable(vector) & (F.size(vector) == dim))
    part = part.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("id"),
                       F.col(f"`{label}`").cast("long").alias("label"), as_doubles(vector).alias("vec"))
    return written(part.mapInArrow(floored, "row long, id long, label long, vec array<long>"), "negatives-rows")


def _sampled(rows: DataFrame, dim: int, size: int):
    """A bounded sample by the hash of ids: top-k per task, ``size`` rows to the
    driver."""
    table = (rows.orderBy(F.xxhash64("id", "row"), "row").limit(size)).toArrow()
    order = np.argsort(table["row"].to_numpy())
    table = table.take(pa.array(order))
    ids = table["id"].fill_null(_LAST).to_numpy()
    return (table["row"].to_numpy(), ids, table["label"].to_numpy(),
            matrix(table["vec"].combine_chunks(), dim) if table.num_rows else np.zeros((0, dim), np.int64))


def _ranges(rows: DataFrame, root: Node, length2: int, dim: int) -> tuple[DataFrame, dict]:
    """Rows with their leaf, written; and the distance ranges of all nodes over
    all rows. A task sends one row per pair of siblings at most."""
    sizes = [len(n.points) for n in nodes(root)]

    def dealt(batches):
        low = [np.full((s, s), np.inf) for s in sizes]
        high = [np.full((s, s), -np.inf) for s in sizes]
        for b in batches:
            leaf, path = descend(root, lifted(matrix(b.column(3), dim), length2))
            for k, _, away, child in path:
                for j in np.unique(child):
                    mine = away[child == j]
                    low[k][:, j] = np.minimum(low[k][:, j], mine.min(axis=0))
                    high[k][:, j] = np.maximum(high[k][:, j], mine.max(axis=0))
            n = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(leaf), n(b.num_rows, pa.int32()), n(b.num_rows, pa.int32()),
                 n(b.num_rows, pa.int32()), n(b.num_rows, pa.float64()), n(b.num_rows, pa.float64())], names=names)
        for k, s in enumerate(sizes):
            i, j = np.nonzero(low[k] <= high[k])
            if len(i):
                n = pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [n(len(i), pa.int64()), n(len(i), pa.int64()), n(len(i), pa.int64()),
                     n(len(i), pa.list_(pa.int64())), n(len(i), pa.int32()), pa.array(np.full(len(i), k, np.int32)),
                     pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                     pa.array(low[k][i, j]), pa.array(high[k][i, j])], names=names)

    names = ["row", "id", "label", "vec", "leaf", "node", "i", "j", "low", "high"]
    schema = ("row long, id long, label long, vec array<long>, leaf int, node int, i int, j int, "
              "low double, high double")
    both = written(rows.mapInArrow(dealt, schema), "negatives-leaves")
    found = both.where("node is not null").groupBy("node", "i", "j").agg(F.min("low").alias("low"),
                                                                       F.max("high").alias("high"))
    ranges = {k: (np.full((s, s), np.inf), np.full((s, s), -np.inf)) for k, s in enumerate(sizes)}
    for r in found.collect():  # at most WAYS per split point of the sample
        ranges[r["node"]][0][r["i"], r["j"]] = r["low"]
        ranges[r["node"]][1][r["i"], r["j"]] = r["high"]
    return both.where("node is null").select("row", "id", "label", "vec", "leaf"), ranges


def _searched(leaves: DataFrame, blocks: DataFrame, asked: DataFrame, dim: int, length2: int, same_label: bool,
              k: int) -> DataFrame:
    """``(anchor, slot, id, score)``: for every row of ``asked`` and each slot of
    its score bounds the first ``k`` rows of each block of its leaf with the same
    (or another) label and a score in the bounds, the anchor itself left out.
    A block's rows come before its anchors; both are held in bounded numbers."""
    nothing = F.lit(None).cast("array<long>")
    held = leaves.join(F.broadcast(blocks), "leaf").select(
        "leaf", F.expr("cast(pmod(xxhash64(row), blocks) as int)").alias("block"), F.lit(0).alias("kind"), "row",
        "id", "label", "vec", nothing.alias("least"), nothing.alias("most"))
    sent = asked.join(F.broadcast(blocks), "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"),
        F.col("anchor").alias("row"), F.lit(None).cast("long").alias("id"), "label", "vec", "least", "most")
    mixed = held.unionByName(sent).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")

    def answers(b, block):
        rows, labels = b.column(3).to_numpy(), b.column(5).to_numpy()
        least, most = b.column(7).to_pylist(), b.column(8).to_pylist()
        out = []
        for lo in range(0, b.num_rows, ANCHORS):
            hi = min(lo + ANCHORS, b.num_rows)
            score = products(matrix(b.column(6).slice(lo, hi - lo), dim), block[3], length2)
            for q, mine in enumerate(score, lo):
                ok = (block[2] == labels[q]) == same_label
                ok &= block[0] != rows[q]
                for slot, (low, high) in enumerate(zip(least[q], most[q])):
                    at = first_of(mine, block[1], ok & (mine >= low) & (mine <= high), k) if low <= high else ()
                    if len(at):
                        out.append((np.full(len(at), rows[q]), np.full(len(at), slot), block[1][at], mine[at]))
        if out:
            a, s, i, v = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(s.astype(np.int32)), pa.array(i, mask=i == _LAST), pa.array(v)],
                names=["anchor", "slot", "id", "score"])

    def searched(batches):
        key, parts, block = None, [], None
        for b in batches:
            leaf, part, kind = (b.column(c).to_numpy() for c in (0, 1, 2))
            change = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, b.num_rows]):
                if lo == hi:
                    continue
                piece = b.slice(lo, hi - lo)
                if (leaf[lo], part[lo]) != key:
                    key, parts, block = (leaf[lo], part[lo]), [], None
                if kind[lo] == 0:
                    parts.append((piece.column(3).to_numpy(), piece.column(4).fill_null(_LAST).to_numpy(),
                                  piece.column(5).to_numpy(), matrix(piece.column(6), dim)))
                elif parts:
                    if block is None:
                        block = [np.concatenate(x) for x in zip(*parts)]
                    yield from answers(piece, block)

    return mixed.mapInArrow(searched, "anchor long, slot int, id long, score long")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` per ``by`` with their ``rank``; every task keeps its own
    first ``k`` before the shuffle."""
    over = f"row_number() over (partition by {', '.join(by)} order by score desc, id asc nulls last)"
    return found.withColumn("rank", F.expr(over)).where(F.col("rank") <= k)


_ASKED = "anchor long, leaf int, label long, vec array<long>, least array<long>, most array<long>"


def _asked(anchors: DataFrame, index, dim: int, bounds) -> DataFrame:
    """Rows for :func:`_searched`: one per anchor and leaf that its annuli reach.
    ``bounds(index, batch, scores, own)`` gives the least and greatest scores of
    the anchors' slots (no answer is wanted where least is above greatest), from
    the scores of the sample's rows and which of these is the anchor itself."""
    def asked(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, ANCHORS):
                b = whole.slice(lo, ANCHORS)
                x = matrix(b.column(2), dim)
                sample = index.value
                own = sample.rows == b.column(0).to_numpy()[:, None]
                least, most = bounds(sample, b, products(x, sample.vectors, sample.length2), own)
                reach: dict = {}
                for slot in range(least.shape[1]):
                    mine = np.flatnonzero(least[:, slot] <= most[:, slot])
                    for leaf, at in sample.leaves(x[mine], least[mine, slot], most[mine, slot]):
                        reach.setdefault(leaf, np.zeros(least.shape, bool))[mine[at], slot] = True
                for leaf, wanted in reach.items():
                    at = np.flatnonzero(wanted.any(axis=1))
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pick), pa.array(np.full(len(at), leaf, np.int32)), b.column(1).take(pick),
                         b.column(2).take(pick), lists(np.where(wanted[at], least[at], 1), pa.int64()),
                         lists(np.where(wanted[at], most[at], 0), pa.int64())],
                        names=["anchor", "leaf", "label", "vec", "least", "most"])

    return anchors.mapInArrow(asked, _ASKED)


def mine(df: DataFrame, anchor: Column | None = None, vec_id: str = "vec_id", vector: str = "vector",
         label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
         sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)`` for all anchors: the rows where ``anchor``, a condition on
    ``id``, holds (all rows with an id, if None)."""
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dim = common_length(df.where(F.col(f"`{label}`").isNotNull()), vector)
    if not dim:
        return spark.createDataFrame([], schema)
    rows = _rows(df, vec_id, vector, label, dim)
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(
        "aggregate(vec, cast(0 as decimal(38,0)), (s, x) -> cast(s + cast(x as decimal(19,0)) * x as decimal(38,0)))"
    )).alias("length2")).first()
    n, length2 = known["n"], int(known["length2"])
    if length2 >= 2 ** 63:
        raise ValueError("Scores of such long vectors are not exact in a long.")

    taken = _sampled(rows, dim, sample)
    root, _ = build(lifted(taken[3], length2), min(max(1, n // leaf_rows), max(1, len(taken[0]) // WAYS)))
    leaves, ranges = _ranges(rows, root, length2, dim)
    index = spark.sparkContext.broadcast(Index(root, ranges, length2, *taken))
    blocks = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    blocks = written(blocks, "negatives-blocks")  # one row per leaf

    chosen = leaves.where(F.col("id").isNotNull() if anchor is None else anchor & F.col("id").isNotNull())
    chosen = written(chosen.select(F.col("row").alias("anchor"), "label", "vec", F.col("id").alias("anchor_id")),
                     "negatives-anchors")

    def same_label(sample, b, score, own):
        """The k-th best of the sample is a bound from below."""
        same = (sample.labels == b.column(1).to_numpy()[:, None]) & ~own
        if score.shape[1] < positives:
            least = np.full((len(score), 1), _NONE)
        else:
            at = score.shape[1] - positives
            least = np.partition(np.where(same, score, _NONE), at, axis=1)[:, at:at + 1]
        return least, np.full(least.shape, _LAST)

    first = _searched(leaves, blocks, _asked(chosen, index, dim, same_label), dim, length2, True, positives)
    first = _ranked(first, ["anchor"], positives).select("anchor", "rank", F.col("id").alias("positive_id"), "score")
    first = written(first, "negatives-positives")
    pairs = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    pairs = chosen.join(pairs, "anchor").select(
        "anchor", "label", "vec", F.transform("p", lambda x: x["score"]).alias("scores"))

    def in_window(sample, b, score, own):
        """Windows of the positives; the k-th best of the sample within one is
        a bound from below. An empty window wants nothing."""
        known = b.column(3).to_pylist()
        width = max(map(len, known), default=0)
        there = np.array([[j < len(s) for j in range(width)] for s in known], bool).reshape(len(known), width)
        least, most = window(np.array([s + [0] * (width - len(s)) for s in known], np.int64).reshape(there.shape))
        other = sample.labels != b.column(1).to_numpy()[:, None]
        at = score.shape[1] - negatives
        for j in range(width if at >= 0 else 0):
            inside = other & (score <= most[:, j:j + 1])
            tenth = np.partition(np.where(inside, score, _NONE), at, axis=1)[:, at]
            least[:, j] = np.maximum(least[:, j], tenth)
        return np.where(there, least, 1), np.where(there, most, 0)

    second = _searched(leaves, blocks, _asked(pairs, index, dim, in_window), dim, length2, False, negatives)
    second = _ranked(second, ["anchor", "slot"], negatives)
    names = chosen.select(F.col("anchor").alias("of_anchor"), "anchor_id")
    known = first.select(F.col("anchor").alias("of_first"), F.col("rank").alias("of_rank"), "positive_id",
                         F.col("score").alias("positive_score"))
    same = (F.col("anchor") == F.col("of_first")) & (F.col("slot") + 1 == F.col("of_rank"))
    return (second.join(known, same).join(names, F.col("anchor") == F.col("of_anchor"))
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
