"""Structured Streaming forms of the operators.

The cleaning operators (zero-fill, combine/split columns, bad-row filter,
time range without the strict checks, 0/1 flags, feature normalisation)
and prediction are row-wise, so they apply unchanged to a streaming
DataFrame. This module adds:

* :func:`clean_stream` — read a folder of files as a stream, apply a list
  of row-wise steps, and write the result to a parquet folder with a
  checkpoint (exactly-once file sink; restarts resume from the
  checkpoint);
* :func:`train_on_stream` — continue an incremental model on every
  micro-batch (``foreachBatch``). After each batch the model is saved
  under ``<model_dir>/batch=<id>`` and marked finished; a restarted query
  goes on from the newest finished batch and skips a replayed one, so
  every row counts once.
"""

from __future__ import annotations

import re
from typing import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import train as trainer

#: Marker table of a finished batch.
FINISHED = "finished"

Step = Callable[[DataFrame], DataFrame]


def apply_steps(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    for step in steps:
        df = step(df)
    return df


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Files arriving in ``folder`` (optionally only names matching ``glob``) as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def clean_stream(stream: DataFrame, steps: Iterable[Step], output_path: str,
                 checkpoint_path: str, once: bool = True):
    """Start a streaming query writing the cleaned rows as parquet.

    ``once`` processes everything available and stops (batch-like
    backfill); otherwise the query keeps running and is returned.
    """
    query = (apply_steps(stream, steps).writeStream.format("parquet")
             .option("path", output_path).option("checkpointLocation", checkpoint_path)
             .outputMode("append"))
    query = query.trigger(availableNow=True) if once else query
    handle = query.start()
    if once:
        handle.awaitTermination()
    return handle


def finished_batches(spark: SparkSession, model_dir: str) -> list[int]:
    """Ids of the batches below ``model_dir`` whose model was saved whole."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{model_dir}/batch=*/{FINISHED}/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(re.search(r"batch=(\d+)/", str(f.getPath())).group(1)) for f in found)


def train_on_stream(stream: DataFrame, model: trainer.TrainedModel, model_dir: str,
                    checkpoint_path: str, once: bool = True):
    """Continue ``model`` (incremental) on every micro-batch of ``stream``.

    On start the newest finished batch in ``model_dir`` takes the place of
    ``model``. Returns ``(query, holder)``; ``holder["model"]`` is the latest
    model and ``holder["batches"]`` the finished batches, earlier runs included.
    """
    if not model.incremental:
        raise ValueError(f"{model.model_name} cannot follow a stream: it does not learn incrementally.")
    spark, root = stream.sparkSession, model_dir.rstrip("/")
    finished = finished_batches(spark, root)
    if finished:
        model = trainer.load_model(spark, f"{root}/batch={finished[-1]}", continuable=True)
    holder = {"model": model, "batches": finished}

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if batch_id in holder["batches"]:
            return
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if batch.isEmpty():
                return
            current = holder["model"]
            updated = trainer.continue_training(current, batch, current.features, current.target)
            # the marker is written last: a batch without it is trained again
            trainer.save_model(updated, f"{root}/batch={batch_id}")
            spark.range(1).write.mode("overwrite").parquet(f"{root}/batch={batch_id}/{FINISHED}")
        finally:
            batch.unpersist()
        holder["model"] = updated
        holder["batches"].append(batch_id)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if once else writer
    handle = writer.start()
    if once:
        handle.awaitTermination()
    return handle, holder
