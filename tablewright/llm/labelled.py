"""Bounded samples of labelled texts, for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows per class that a classifier is fitted on.
MOST_ROWS = 3000


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int = MOST_ROWS,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, y)``: at most ``most`` rows per class of the labelled,
    usable documents, those of the smallest id hashes.

    The ids are chosen among the labels alone, by a top-k per class (k rows
    leave a task), so the texts meet a list of ``2 * most`` ids at most; that
    bound is what is broadcast."""
    known = labels.where(usable & F.col(label).isNotNull()).select(F.col(doc_id).alias("of_id"),
                                                                   F.col(label).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).select("of_id", "y", F.xxhash64("of_id").alias("h")).distinct()
        part = part.orderBy("h", "of_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = source.join(F.broadcast(chosen), F.col("doc_id") == F.col("of_id"))
    return joined.select("doc_id", "text", "y")


def fitted(rows: DataFrame, fit) -> bytes:
    """``fit(texts, labels) -> bytes``, run in one task over the bounded
    sample (in id order, so a retry fits the same model)."""
    def run(batches):
        texts, ys, ids = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            ys += b.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], ys[i], texts[i]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit([texts[i] for i in order], [ys[i] for i in order])],
                                                            pa.binary())})

    return bytes(rows.repartition(1).mapInArrow(run, "model binary").first()[0])
