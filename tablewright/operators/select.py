"""Exact order statistics without sorting everything or gathering a group.

* :func:`kth_hash_per_group` — for every group, the k-th smallest of a
  32-character hex hash (used by the seeded hold-out and stratified splits). It
  narrows the answer one 3-hex-digit prefix at a time: count rows per
  ``(group, next prefix)`` (at most 4,096 buckets per group, combined before the
  shuffle; the first round only counts, so no row is sorted; rows meet the state after that, by broadcast, or by group and prefix
  where groups are many), find the bucket that holds rank k with a running sum over those
  buckets, keep only that bucket, until it holds a single hash. No task ever
  holds a whole group, however skewed the groups are, and the state per group is
  a table in the shared folder, whatever the number of groups.
* :func:`numbered` — positions among rows that tie.
* :func:`exact_medians` — exact medians of several columns at once. A sketch of
  every column brackets each rank; the next scan counts what lies below, inside
  and on the ends of the brackets and sketches their insides, until a bracket holds
  so few values that its sketch is exact: two or three scans of one output row,
  whatever the number of columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

PREFIX_DIGITS = 3          # hex digits per narrowing round (4,096 buckets)
BROADCAST_CLASSES = 10_000  # groups of one small row each that a task may hold
GRID = 1000                # steps of a sketch that are read off
ACCURACY = 10_000          # of approximate percentiles: rank error below rows / ACCURACY


def cut_lineage(df: DataFrame) -> DataFrame:
    """Keep a per-group frame in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kth_hash_per_group(df: DataFrame, hash_col: str, group_cols: list[str],
                       k: DataFrame) -> DataFrame:
    """For each group in ``k`` (columns ``group_cols + ["__k"]``, 1-based), the
    ``__k``-th smallest ``hash_col`` among that group's rows as ``__thr``, the
    number of rows that have it as ``__ties``, and how many of them belong to
    the first ``__k`` as ``__need``.

    Groups with ``__k < 1`` or fewer than ``__k`` rows get no row.
    """
    rows = df.select(*group_cols, F.col(hash_col).alias("__h"))
    state = cut_lineage(k.where(F.col("__k") >= 1).select(
        *group_cols, F.lit("").alias("__prefix"), F.col("__k").alias("__rem")))
    few = state.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES

    def with_state(frame, st, prefix):
        """Rows whose group and prefix are the state's. A broadcast where groups
        are few; else a join on both, in which a group has a key per prefix."""
        st = st.select(*[F.col(c).alias(f"__s_{c}") for c in group_cols], F.col("__prefix").alias("__s_prefix"),
                       "__rem")
        cond = prefix == F.col("__s_prefix")
        for c in group_cols:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
        return (frame.join(F.broadcast(st) if few else st, cond)
                .drop(*[f"__s_{c}" for c in group_cols]).withColumnRenamed("__s_prefix", "__prefix"))

    plen = 0
    while plen < 32:
        digits = min(PREFIX_DIGITS, 32 - plen)
        bucket = F.substring("__h", plen + 1, digits)
        count = F.count(F.lit(1)).alias("count")
        if plen:
            cand = with_state(rows, state, F.substring("__h", 1, plen))
            hist = cand.groupBy(*group_cols, "__prefix", "__rem", bucket.alias("__b")).agg(
                count, F.min("__h").alias("__lo"), F.max("__h").alias("__hi"))
        else:
            # Every row counts, so only the sums meet the state. Least and greatest texts
            # would be a sort of all rows; the next round takes them of one bucket's.
            hist = with_state(rows.groupBy(*group_cols, bucket.alias("__b")).agg(count), state, F.lit("")).withColumns(
                {"__lo": F.lit("0"), "__hi": F.lit("f")})
        w = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("__cum", F.sum("count").over(w))
        picked = hist.where((F.col("__cum") - F.col("count") < F.col("__rem"))
                            & (F.col("__cum") >= F.col("__rem")))
        state = cut_lineage(picked.select(
            *group_cols, F.concat("__prefix", "__b").alias("__prefix"),
            (F.col("__rem") - (F.col("__cum") - F.col("count"))).alias("__rem"),
            F.col("count").alias("__ties"), "__lo", "__hi"))
        plen += digits
        if state.where(F.col("__lo") != F.col("__hi")).isEmpty():  # one hash in every bucket
            break
    return state.select(*group_cols, F.col("__lo").alias("__thr"), "__ties", F.col("__rem").alias("__need"))


def numbered(df: DataFrame, group_cols: list[str], order_col: str, name: str) -> DataFrame:
    """``df`` with 1-based positions per group in ``order_col`` order, rows of
    equal ``order_col`` in any order. Rows are dealt by range, so a large group
    is numbered by many tasks; a window runs over one row per (task, group)."""
    ensure_checkpoint_dir(df.sparkSession)
    dealt = (df.repartitionByRange(*group_cols, order_col).sortWithinPartitions(*group_cols, order_col)
             .withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
             .checkpoint(eager=True))
    sizes = dealt.groupBy("__task", *group_cols).agg(F.count(F.lit(1)).alias("__size"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*group_cols).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(w), F.lit(0)))
    sizes = sizes.select(F.col("__task").alias("__t"), *[F.col(c).alias(f"__n_{c}") for c in group_cols],
                         "__first", "__before")
    cond = F.col("__task") == F.col("__t")
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__n_{c}"))
    return dealt.join(sizes, cond).select(
        *df.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(name))


def _grid(c):
    """Approximate values at all GRID steps between the least and the greatest."""
    return F.percentile_approx(c, [j / GRID for j in range(GRID + 1)], ACCURACY)


def _bracket(grid, rank: int, n: int) -> tuple[float, float]:
    """Steps of a grid of ``n`` values between which the ``rank``-th lies, but for
    the grid's error."""
    at, slack = rank / n * GRID, 1 + (2 * GRID // ACCURACY if n > ACCURACY // 4 else 0)
    return grid[max(0, math.floor(at) - slack)], grid[min(GRID, math.ceil(at) + slack)]


def exact_ranks(df: DataFrame, ranks) -> tuple[dict, dict]:
    """``({column: n}, {(column, k): value})``: exact k-th smallest present
    values (1-based); ``ranks(n)`` lists the ranks wanted of ``n`` values.

    One scan sketches all columns; every further one counts what lies around the
    brackets so found and sketches what lies inside. Two scans do for some hundred
    thousand rows and three for some hundred million."""
    cols = list(df.columns)
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    x = {c: F.when(~F.isnan(v), v) for c, v in x.items()}
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(x[c]).alias(f"n{i}"), _grid(x[c]).alias(f"grid{i}"))]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    # per open rank: the bracket guessed, and the values that it is known to lie within
    found, open_ranks = {}, {}
    for i, c in enumerate(cols):
        grid = row[f"grid{i}"]
        for k in ranks(counts[c]) if counts[c] else ():
            open_ranks[c, k] = (*_bracket(grid, k, counts[c]), grid[0], grid[GRID])
    while open_ranks:
        brackets = sorted({(c, *at) for (c, _), at in open_ranks.items()})
        checks = []
        for i, (c, a, b, lo, hi) in enumerate(brackets):
            v, inside = x[c], (x[c] > a) & (x[c] < b)
            checks += [F.count_if(v < a).alias(f"below{i}"), F.count_if(v == a).alias(f"at_a{i}"),
                       F.count_if(inside).alias(f"inside{i}"), F.count_if(v == b).alias(f"at_b{i}"),
                       F.max(F.when((v < a) & (v >= lo), v)).alias(f"under{i}"),
                       F.min(F.when((v > b) & (v <= hi), v)).alias(f"over{i}"),
                       _grid(F.when(inside, v)).alias(f"grid{i}")]
        row = df.agg(*checks).first()
        place = {bracket: i for i, bracket in enumerate(brackets)}
        for c, k in list(open_ranks):
            a, b, lo, hi = open_ranks[c, k]
            i = place[c, a, b, lo, hi]
            m, grid = row[f"inside{i}"], row[f"grid{i}"]
            first = row[f"below{i}"] + row[f"at_a{i}"]  # rows up to a
            upto = first + m + (row[f"at_b{i}"] if b > a else 0)
            if k <= row[f"below{i}"]:
                open_ranks[c, k] = (lo, row[f"under{i}"], lo, row[f"under{i}"])
            elif k > upto:
                open_ranks[c, k] = (row[f"over{i}"], hi, row[f"over{i}"], hi)
            elif k <= first or k > first + m:
                found[c, k] = float(a if k <= first else b)
                del open_ranks[c, k]
            elif m <= GRID:  # so few values that the grid holds every one
                found[c, k] = float(next(grid[j] for j in range(GRID + 1) if math.ceil(j / GRID * m) == k - first))
                del open_ranks[c, k]
            else:
                open_ranks[c, k] = (*_bracket(grid, k - first, m), grid[0], grid[GRID])
    return counts, found


def exact_medians(df: DataFrame, columns: list[str]) -> dict:
    """Exact medians of several numeric columns (mean of the middle two for even counts)."""
    if not columns:
        return {}
    counts, found = exact_ranks(df.select(*[F.col(f"`{c}`") for c in columns]),
                                lambda n: sorted({(n + 1) // 2, n // 2 + 1}))
    return {c: (found[c, (counts[c] + 1) // 2] + found[c, counts[c] // 2 + 1]) / 2.0 if counts[c] else None
            for c in columns}


def exact_median(df: DataFrame, column: str) -> float | None:
    """Exact median of one numeric column (see :func:`exact_medians`)."""
    return exact_medians(df, [column])[column]
