"""Running sums over an ordered table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``df`` with ``<value>_upto`` per value: the sum over the rows of its
    ``group`` up to and with the row, in ``order``.

    Rows are dealt by range of (group, order), so a hot group spans many
    tasks, and written once with their task's number. Each task sums its own
    rows; what lies before a task in its group is a window over one row per
    (task, group). ``order`` must be total for a defined result of tied rows.
    """
    keys = [*group, *order]
    dealt = written(df.repartitionByRange(*keys).withColumn("task", F.spark_partition_id()), "ranges")
    names = ", ".join(f"`{g}`" for g in group)
    parts = ", ".join(["task", names]) if group else "task"
    sums = dealt.groupBy("task", *group).agg(*[F.sum(v).alias(f"{v}_part") for v in values])
    over = f"(partition by {names or 'null'} order by task rows between unbounded preceding and 1 preceding)"
    sums = sums.select("task", *group, *[F.expr(f"coalesce(sum({v}_part) over {over}, 0)").alias(f"{v}_before")
                                         for v in values])
    sums = written(sums, "range-sums").withColumnsRenamed({g: f"of_{g}" for g in group}).withColumnRenamed(
        "task", "of_task")
    same = F.col("task") == F.col("of_task")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    ordered = ", ".join(f"`{o}`" for o in order)
    inner = f"(partition by {parts} order by {ordered} rows unbounded preceding)"
    local = dealt.select("*", *[F.expr(f"sum(`{v}`) over {inner}").alias(f"{v}_local") for v in values])
    joined = local.join(sums, same)
    return joined.select(*df.columns, *[(F.col(f"{v}_local") + F.col(f"{v}_before")).alias(f"{v}_upto")
                                        for v in values])
