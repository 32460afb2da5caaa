"""Row positions under an explicit order, and deleting rows by position.

Spark rows have no position, so every positional operator takes an
``order_by`` that must be a unique key. Positions are computed the way
``zipWithIndex`` does it, but on the key columns only:

1. range-partition and sort the keys (a distributed sort, balanced by
   sampled bounds — no single task sees all rows);
2. tag each row with its partition id and its index inside the partition
   (``monotonically_increasing_id``) and ``checkpoint()`` the result into
   the shared checkpoint folder, so recomputation after an executor loss
   reads the same rows in the same places;
3. count rows per partition (one row per partition reaches the driver),
   turn the counts into offsets, and add the offset of the row's partition
   (a broadcast of one row per partition — bounded by the partition count).

Never a ``row_number()`` over an unpartitioned window, which would run in
one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require_columns
from ..session import ensure_checkpoint_dir

_SPEC = re.compile(r"\s*(?:\d+\s*(?:-\s*\d+\s*)?)?(?:,\s*(?:\d+\s*(?:-\s*\d+\s*)?)?)*")
_ITEM = re.compile(r"(\d+)\s*(?:-\s*(\d+))?")


def parse_row_spec(spec: str) -> list[tuple[int, int]]:
    """``"0, 3, 5-8"`` → merged inclusive ranges ``[(0, 0), (3, 3), (5, 8)]``.

    Blank items are skipped, repeats collapse; an empty spec, ``end <
    start`` or a non-number (a negative number included) is an error.
    """
    if not _SPEC.fullmatch(spec or ""):
        raise ValueError(f"Row positions must be numbers and ranges such as '0, 3, 5-8', not {spec!r}.")
    steps: dict[int, int] = {}
    for first, last in _ITEM.findall(spec or ""):
        low, high = int(first), int(last or first)
        if high < low:
            raise ValueError(f"The row range {low}-{high} runs backwards.")
        steps[low] = steps.get(low, 0) + 1
        steps[high + 1] = steps.get(high + 1, 0) - 1
    if not steps:
        raise ValueError("No row position was given.")
    # Covered stretches: from where the number of open items leaves zero to
    # where it comes back to it.
    merged, depth, begin = [], 0, 0
    for at in sorted(steps):
        begin = at if depth == 0 and steps[at] else begin
        was, depth = depth, depth + steps[at]
        if was and not depth:
            merged.append((begin, at - 1))
    return merged


def _order(cols):
    return [F.col(f"`{c}`").asc_nulls_first() for c in cols]


def row_positions(df: DataFrame, order_by, name: str = "position") -> tuple[DataFrame, int]:
    """``(keys + position, row_count)``: 0-based position of every key in order.

    The returned frame reads from a checkpoint, so it is stable across
    actions and executor loss.
    """
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    require_columns(df, cols)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tagged = (df.select(*[F.col(f"`{c}`") for c in cols]).orderBy(*_order(cols))
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__rid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = sorted((r[0], r[1]) for r in tagged.groupBy("__pid").count().collect())
    offsets, running = [], 0
    for pid, cnt in counts:
        offsets.append((pid, running))
        running += cnt
    if not offsets:
        offsets = [(0, 0)]
    off = spark.createDataFrame(offsets, "__pid int, __off long")
    within = F.col("__rid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    positioned = tagged.join(F.broadcast(off), "__pid").select(
        *[F.col(f"`{c}`") for c in cols], (F.col("__off") + within).alias(name))
    return positioned, running


def delete_rows(df: DataFrame, spec: str, order_by) -> DataFrame:
    """Drop the rows at the 0-based positions / inclusive ranges in ``spec``.

    Positions beyond the last row are an error naming the first of them, and
    so are rows that share a key, since a position would not name one of them.
    """
    ranges = parse_row_spec(spec)
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    positioned, n = row_positions(df, cols, "__pos")
    for a, b in ranges:
        if b >= n:
            raise ValueError(f"There is no row {max(a, n)}: positions end at {n - 1}.")
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | F.col("__pos").between(a, b)
    keys = [F.col(f"`{c}`") for c in cols]
    # Rows that share a key stand next to each other, so a key that is both to go
    # and elsewhere has a row of the other kind beside it: only keys at the ends of
    # the ranges are looked at, and those that stand twice inside one.
    doomed = positioned.where(hit).select(*keys)
    ends = sorted({p for a, b in ranges for p in (a - 1, a, b, b + 1)})
    edge = positioned.where(F.col("__pos").isin(ends)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"),
                                                                        F.max(hit).alias("__hit"))
    inside = doomed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.lit(True).alias("__hit"))
    if not edge.unionByName(inside).where("__n > 1 and __hit").isEmpty():
        raise ValueError(f"Rows to delete share their key {cols}; order by columns that tell all rows apart.")
    cond = None
    for c in cols:
        term = df[f"`{c}`"].eqNullSafe(doomed[f"`{c}`"])
        cond = term if cond is None else cond & term
    return df.join(doomed, cond, "left_anti")
