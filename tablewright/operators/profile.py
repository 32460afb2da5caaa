"""Column quality profile, top values and value distributions.

The profile of any number of columns unpivots them to narrow (column, value)
rows, counts those by value (combined per task before the shuffle) and sums
the counts per column. Top-k lists are ``groupBy(value).count()`` (map-side combined, so
a value holding a third of the rows is a single partial row per task)
followed by ``orderBy(...).limit(k)``, which Spark runs as a per-task
top-k merge (TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (as_text, col_type, is_empty_for_profile,
                         is_float_type, is_na_for_profile, is_numeric_type, is_zero,
                         nan_to_null, require_columns, strip)

# Display caps for the distributions.
PROFILE_TOP_VALUES = 20
HISTOGRAM_BINS = 20
TOP_CATEGORIES = 15


def column_profile(df: DataFrame, columns=None, approx_unique: bool = False) -> DataFrame:
    """One row per column: ``column, dtype, rows, zero_ratio, empty_ratio,
    na_ratio, unique_count``.

    * ``zero_ratio`` is taken over present values (null is neither zero nor not);
    * ``empty_ratio`` counts null and blank text; ``na_ratio`` counts null
      and NA spellings; both are over all rows;
    * ratios are 0.0 on an empty table; ``unique_count`` ignores null.
    ``approx_unique=True`` swaps the exact distinct count for HyperLogLog++.
    """
    cols = list(columns) if columns else list(df.columns)
    require_columns(df, cols)
    names = df.sparkSession.createDataFrame(
        [(i, c, col_type(df, c).simpleString()) for i, c in enumerate(cols)], "__i int, column string, dtype string")
    entries = []
    for i, name in enumerate(cols):
        dt, c = col_type(df, name), F.col(f"`{name}`")
        value = nan_to_null(c, dt)
        if is_float_type(dt):
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)  # both zeros are one value
        entries.append(F.struct(F.lit(i).alias("i"), value.cast("string").alias("v"), is_zero(c, dt).alias("z"),
                                is_empty_for_profile(c, dt).alias("e"), is_na_for_profile(c, dt).alias("n")))
    # one narrow row per cell, counted by value before the shuffle
    values = (df.select(F.explode(F.array(*entries)).alias("s")).select("s.*")
              .groupBy("i", "v", "z", "e", "n").agg(F.count(F.lit(1)).alias("k")))

    def share(flag):
        held = F.sum(F.when(F.col(flag), F.col("k")).otherwise(0))
        known = F.sum(F.when(F.col(flag).isNotNull(), F.col("k")).otherwise(0))
        return F.coalesce(F.try_divide(held, known), F.lit(0.0))

    unique = F.approx_count_distinct("v") if approx_unique else F.count("v")
    per_column = values.groupBy("i").agg(
        F.sum("k").alias("rows"), share("z").alias("zero_ratio"), share("e").alias("empty_ratio"),
        share("n").alias("na_ratio"), unique.alias("unique_count"))
    zero = {"rows": 0, "zero_ratio": 0.0, "empty_ratio": 0.0, "na_ratio": 0.0, "unique_count": 0}
    return names.join(per_column, F.col("__i") == F.col("i"), "left").select(
        "column", "dtype", *[F.coalesce(c, F.lit(v).cast("long" if v == 0 and isinstance(v, int) else "double")).alias(c)
                             for c, v in zero.items()])


def top_values(df: DataFrame, column: str, n: int = PROFILE_TOP_VALUES) -> DataFrame:
    """Most frequent stripped text values: ``value, count``.

    Null shows as ``<NA>``, blank as ``<EMPTY>``. Ties are ordered by value.
    """
    require_columns(df, [column])
    dt = col_type(df, column)
    label = F.coalesce(strip(as_text(F.col(f"`{column}`"), dt)), F.lit("<NA>"))
    label = F.when(label == F.lit(""), F.lit("<EMPTY>")).otherwise(label)
    return (df.select(label.alias("value")).groupBy("value").count()
            .orderBy(F.col("count").desc(), F.col("value").asc()).limit(n))


def top_categories(df: DataFrame, column: str, n: int = TOP_CATEGORIES) -> DataFrame:
    """Most frequent raw values (not stripped) of a column: ``value, count``; null is ``<NULL>``."""
    require_columns(df, [column])
    dt = col_type(df, column)
    label = F.coalesce(as_text(F.col(f"`{column}`"), dt), F.lit("<NULL>"))
    return (df.select(label.alias("value")).groupBy("value").count()
            .orderBy(F.col("count").desc(), F.col("value").asc()).limit(n))


def histogram_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width edges over [lo, hi]; a constant column widens to ±0.5."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [float(e) for e in np.linspace(lo, hi, bins + 1, endpoint=True)]


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts of non-null values in ``bins`` equal-width bins over [min, max].

    Output ``bin, bin_start, bin_end, count`` with every bin present (empty
    ones count 0); the last bin is closed on the right. Two jobs: a
    one-row min/max aggregate, then one grouped count (at most ``bins``
    groups). Bin assignment follows the usual rule — index from the scaled
    offset, then corrected against the exact edges — so values on an edge
    land in the same bin as a NumPy histogram.
    """
    require_columns(df, [column])
    dt = col_type(df, column)
    if not is_numeric_type(dt):
        raise ValueError(f"Histogram needs a numeric column; {column} is {dt.simpleString()}.")
    x = nan_to_null(F.col(f"`{column}`"), dt).cast("double")
    values = df.select(x.alias("x")).where(F.col("x").isNotNull())
    lo, hi = values.agg(F.min("x"), F.max("x")).first()
    spark = df.sparkSession
    schema = "bin int, bin_start double, bin_end double"
    if lo is None:
        edges = histogram_edges(0.0, 1.0, bins)
    else:
        edges = histogram_edges(float(lo), float(hi), bins)
    first, last = edges[0], edges[-1]
    edge_arr = F.array(*[F.lit(e) for e in edges])
    raw = (((F.col("x") - F.lit(first)) / F.lit(last - first)) * F.lit(bins)).cast("int")
    raw = F.when(raw == F.lit(bins), F.lit(bins - 1)).otherwise(raw)
    lower = F.element_at(edge_arr, raw + 1)
    idx = F.when(F.col("x") < lower, raw - 1).otherwise(raw)
    upper = F.element_at(edge_arr, idx + 2)
    idx = F.when((F.col("x") >= upper) & (idx != F.lit(bins - 1)), idx + 1).otherwise(idx)
    counts = values.select(idx.alias("bin")).groupBy("bin").count()
    # The bin table has exactly ``bins`` rows: a fixed, tiny broadcast side.
    frame = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], schema)
    return (F.broadcast(frame).join(counts, "bin", "left")
            .select("bin", "bin_start", "bin_end",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


__all__ = ["column_profile", "top_values", "top_categories", "histogram",
           "histogram_edges", "PROFILE_TOP_VALUES", "HISTOGRAM_BINS", "TOP_CATEGORIES"]
