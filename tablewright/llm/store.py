"""Written tables and fixed-size filters that the operators share."""

from __future__ import annotations

import gc
import threading

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path
from .arrowtext import seed

#: Bits of a token filter: about BITS_PER_TOKEN per token, between 2**20 and
#: 2**28 (32 MB, the bound of what is broadcast).
LEAST_BITS, MOST_BITS, BITS_PER_TOKEN = 20, 28, 24
FILTER_HASHES = 4
#: Bytes of a Parquet row group and of an Arrow batch while tables are written:
#: a task holds a few of either.
ROW_GROUP = 16 << 20
BATCH = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_open = threading.local()


class scratch:
    """Deletes the tables that :func:`written` makes inside, but for those named
    by :meth:`keep`, so that an operator's disk is that of its widest step. Kept
    tables belong to the scope around, if there is one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.kept = spark, [], []

    def keep(self, *frames: DataFrame) -> None:
        self.kept += frames

    def __enter__(self) -> "scratch":
        _open.scopes = [*getattr(_open, "scopes", []), self]
        return self

    def __exit__(self, kind, *_) -> None:
        _open.scopes = _open.scopes[:-1]
        kept = [t for t in self.tables if any(t[0] is k for k in self.kept)]
        for frame, path in self.tables:
            if not any(path == k[1] for k in kept):
                remove_path(self.spark, path)
        if _open.scopes:
            _open.scopes[-1].tables += kept
        self.tables = []
        gc.collect()
        self.spark._jvm.System.gc()  # lets Spark drop the shuffle files of finished jobs


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back:
    a lineage cut that outlives executors and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, BATCH)
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(_BATCH_SETTING, before)
    table = spark.read.schema(df.schema).parquet(path)
    if getattr(_open, "scopes", None):
        _open.scopes[-1].tables.append((table, path))
    return table


def token_filter(tokens: DataFrame, column: str) -> np.ndarray:
    """Bloom filter over a long column, sized by the number of its rows.

    The bits are set on the executors and OR-ed there; the driver receives at
    most ``2**MOST_BITS / 64`` words. With more tokens the filter lets more
    through and drops nothing; whoever uses it joins with the tokens afterwards.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_TOKEN * tokens.count()).bit_length()))

    def positions(batches):
        import pyarrow as pa
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate([seed(h, j) >> np.uint64(64 - bits)
                                           for j in range(FILTER_HASHES)])).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"word": at >> 6, "bit": at & 63})

    words = (tokens.select(F.col(column).cast("long"))
             .mapInArrow(positions, "word long, bit long")
             .groupBy("word")
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("w")).toArrow())
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["w"].to_numpy()
    return table.view(np.uint64)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter holds (with rare false yes)."""
    bits = np.uint64(64 - (len(table).bit_length() - 1 + 6))
    at = np.arange(len(h))
    for j in range(FILTER_HASHES):
        p = seed(h[at], j) >> bits
        at = at[(table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    out = np.zeros(len(h), bool)
    out[at] = True
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
