"""Session helpers: a SparkSession with the settings the operators assume,
and the shared folder (``spark.checkpoint.dir``) used for lineage cuts and
intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator relies on. Timestamps are compared as wall-clock
# values, so the session zone is pinned; AQE re-plans joins and coalesces
# shuffle partitions at run time; skew join splits hot partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app_name: str = "tablewright",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with :data:`DEFAULT_CONF` applied.

    ``master`` is only set when given, so cluster submissions keep the
    master chosen by ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(key, settings[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach
    (HDFS, S3, a network mount). Where it is unset, a local run gets a
    temporary folder; on a cluster that is an error, since executors would
    write where the others cannot read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"Set spark.checkpoint.dir to a folder that all executors of {master} share.")
        root = tempfile.mkdtemp(prefix="tablewright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/tablewright-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below :func:`run_dir` for an intermediate table."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    system, at = _at(spark, path)
    system.delete(at, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    system, at = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no frame needs them."""
    remove_path(spark, run_dir(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable (reads the session setting)."""
    shared_dir(spark)


def spread(df, *by: str):
    """Deal rows over ``spark.sql.shuffle.partitions`` tasks by a hash of ``by``:
    the same at every size, so that iterative learners use the whole cluster
    however the input's files are cut."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


__all__ = ["DEFAULT_CONF", "get_spark", "shared_dir", "run_dir", "scratch_path",
           "path_exists", "list_names", "remove_path", "remove_scratch", "ensure_checkpoint_dir", "spread"]
