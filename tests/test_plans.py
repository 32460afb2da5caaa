"""Plan checks: the operators stay JVM-side, push filters, avoid nested loops."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"

# queries whose plans must contain no Python evaluation at all
JVM_ONLY = ["merge_workflow", "merge_inner", "merge_left", "merge_right", "merge_outer", "merge_suffixes",
            "coalesce_first_non_empty", "coalesce_keys", "append", "merge_preaggregated", "merge_risk",
            "missing_flags", "zero_flags", "bad_flags", "column_profile", "top_values", "top_categories",
            "zero_fill", "drop_bad_rows", "zero_pad", "combine_columns", "split_column", "time_range",
            "time_range_text", "group_nulls", "agg_sum", "agg_nunique", "multi_rule_aggregate",
            "binary_flag", "aggregate_to_binary", "drop_columns", "head_preview", "tail_preview",
            "normalize_features", "training_frame", "holdout_split", "stratified_split",
            "classification_metrics", "regression_metrics", "histogram", "delete_rows"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_plan(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas"):
        assert marker not in plan, f"{name} runs Python: {marker}"
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_time_range_pushdown(spark):
    plan = _plan(entry.queries()["time_range"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_scan_prunes_columns(spark):
    plan = _plan(entry.queries()["agg_nunique"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in plan


@pytest.mark.parametrize("name,table,columns", [
    ("merge_outer", "orders", 2), ("merge_outer", "lineitem", 2), ("merge_workflow", "lineitem", 1),
    ("merge_preaggregated", "lineitem", 1)])
def test_merge_scans_each_side_once(spark, name, table, columns):
    """The plan that runs scans a side once; hot keys were looked up before."""
    import re
    plan = _plan(entry.queries()[name](spark, SF))
    assert len(re.findall(rf"{table}[.]parquet.*?ReadSchema: struct<([^>]*)>", plan)) == 1


def _rows_read(spark, run) -> dict:
    """Input rows of all jobs that ``run`` starts, from Spark's event log."""
    import json
    import subprocess
    import sys
    import tempfile
    folder = tempfile.mkdtemp(prefix="tw-events-")
    code = f"""
import sys
sys.path.insert(0, {str(entry.__file__.rsplit('/', 1)[0])!r})
from tablewright.session import get_spark
spark = get_spark("local[4]", shuffle_partitions=4, spark__ui__enabled="false", spark__eventLog__enabled="true",
                  spark__eventLog__compress="false", spark__eventLog__rolling__enabled="false",
                  spark__eventLog__dir="file://{folder}")
{run}
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    import os
    total, jobs = 0, 0
    for line in open(os.path.join(folder, os.listdir(folder)[0])):
        event = json.loads(line)
        if event["Event"] == "SparkListenerTaskEnd":
            total += event["Task Metrics"]["Input Metrics"]["Records Read"]
        jobs += event["Event"] == "SparkListenerJobStart"
    return {"rows": total, "jobs": jobs}


def test_merge_reads_each_side_twice_at_most(spark):
    """Once for its keys, once for the merge."""
    n = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "lineitem"))
    got = _rows_read(spark, f"""
import __spark_entry__ as entry
entry.queries()["merge_outer"](spark, {SF!r}).write.format("noop").mode("overwrite").save()
""")
    assert got["rows"] <= 2 * n + 10


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "big_order" in df.columns
