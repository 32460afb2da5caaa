import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean, position, profile


def test_drop_columns_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        clean.drop_columns(df, [])
    with pytest.raises(ValueError):
        clean.drop_columns(df, ["zz"])
    assert clean.drop_columns(df, ["a"]).columns == ["b"]


def test_zero_fill_types(spark):
    df = spark.createDataFrame([(" n/a ", None, None, "x"), ("a", 1.5, True, "0")], "s string, x double, b boolean, t string")
    out = clean.zero_fill(df, ["s", "x", "b"]).collect()
    assert out[0]["s"] == "0" and out[0]["x"] == 0.0 and out[0]["b"] is False
    assert out[1]["s"] == "a" and out[1]["x"] == 1.5
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp_ntz")
    with pytest.raises(ValueError):
        clean.zero_fill(ts, ["t"])
    with pytest.raises(ValueError):
        clean.zero_fill(df, [])


def test_combine_columns(spark):
    df = spark.createDataFrame([("5", 7.0), (None, 1e7), ("-3", None)], "a string, b double")
    out = [r.c for r in clean.combine_columns(df, "c", "a", "b", "/", 3, 0).collect()]
    assert out == ["005/7.0", "000/10000000.0", "-03/"]
    with pytest.raises(ValueError):
        clean.combine_columns(df, "  ", "a", "b")


def test_split_column_keeps_source(spark):
    df = spark.createDataFrame([("a-b-c",), (None,)], "v string")
    out = clean.split_column(df, "v", "l", "r", "-", 2).collect()
    assert (out[0]["v"], out[0]["l"], out[0]["r"]) == ("a-b-c", "a-b", "c")
    assert (out[1]["l"], out[1]["r"]) == ("", "")
    with pytest.raises(ValueError):
        clean.split_column(df, "v", "", "r", "-", 1)


@pytest.mark.parametrize("threshold,kept", [(0, 0), (0.5, 1), (1, 2)])
def test_drop_bad_rows_thresholds(spark, threshold, kept):
    df = spark.createDataFrame([("a", 1.0), ("", 2.0), ("0", None)], "s string, x double")
    assert clean.drop_bad_rows(df, ["s", "x"], threshold).count() == kept


def test_drop_bad_rows_errors(spark):
    df = spark.createDataFrame([("a", 1.0)], "s string, x double")
    with pytest.raises(ValueError):
        clean.drop_bad_rows(df, [], 0.5)
    with pytest.raises(ValueError):
        clean.drop_bad_rows(df, ["s"], 1.1)
    assert clean.drop_bad_rows(df, None, 0.6).count() == 1


def test_time_range_text(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-05 10:00",), ("not a date",), (None,), ("12:30",)], "t string")
    assert clean.time_range(df, "t").count() == 5                       # no bounds: all rows
    assert clean.time_range(df, "t", "2024-01-02").count() == 1
    assert clean.time_range(df, "t", None, "2024-01-05").count() == 1    # date-only end = midnight
    with pytest.raises(ValueError):
        clean.time_range(df, "t", "2024-01-06", "2024-01-01")            # reversed bounds: empty
    bad = spark.createDataFrame([("x",), ("y",)], "t string")
    with pytest.raises(ValueError):
        clean.time_range(bad, "t", "2024-01-01")


def test_time_range_pushes_filter(spark, tmp_dir):
    spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in range(1, 10)], "ts timestamp_ntz") \
        .write.parquet(f"{tmp_dir}/t")
    df = spark.read.parquet(f"{tmp_dir}/t")
    out = clean.time_range(df, "ts", "2024-01-03", "2024-01-05", strict=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual" in plan
    assert out.count() == 3


def test_parse_row_spec():
    assert position.parse_row_spec("0, 3, 5-8") == [(0, 0), (3, 3), (5, 8)]
    assert position.parse_row_spec("1,1,1-2") == [(1, 2)]
    for bad in [",", "8-5", "-1", ""]:
        with pytest.raises(ValueError):
            position.parse_row_spec(bad)


def test_delete_rows(spark):
    df = spark.range(0, 50).withColumn("v", F.col("id") * 2).repartition(4)
    out = position.delete_rows(df, "0, 3, 5-8, 49", "id")
    assert sorted(r.id for r in out.collect()) == [i for i in range(50) if i not in {0, 3, 5, 6, 7, 8, 49}]
    with pytest.raises(ValueError, match="no row 50"):
        position.delete_rows(df, "48-60", "id")


def test_row_positions_across_partitions(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7)
    pos, n = position.row_positions(df, "k")
    assert n == 1000
    assert all(r.k == r.position for r in pos.collect())


def test_head_tail(spark):
    df = spark.range(0, 100).repartition(5)
    assert [r.id for r in clean.head(df, "id", 3).collect()] == [0, 1, 2]
    assert [r.id for r in clean.tail(df, "id", 3).collect()] == [97, 98, 99]


def test_histogram_matches_numpy(spark):
    vals = [0.1, 0.35, 0.7, 1.0, 2.2, 2.2, 5.0, 9.99, 10.0, -3.0]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = [r["count"] for r in profile.histogram(df, "x").orderBy("bin").collect()]
    expected, _ = np.histogram(np.array(vals), bins=20)
    assert got == list(expected)
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    rows = profile.histogram(const, "x").orderBy("bin").collect()
    assert rows[0].bin_start == 2.5 and rows[-1].bin_end == 3.5 and sum(r["count"] for r in rows) == 2


def test_profile_ratios(spark):
    df = spark.createDataFrame([("0",), (None,), ("",), ("na",), ("x",)], "v string")
    p = profile.column_profile(df, ["v"]).first()
    assert p.rows == 5
    assert p.zero_ratio == pytest.approx(1 / 4)     # over present values
    assert p.empty_ratio == pytest.approx(2 / 5)    # null and ''
    assert p.na_ratio == pytest.approx(2 / 5)       # null and 'na'
    assert p.unique_count == 4
    empty = profile.column_profile(df.where("false"), ["v"]).first()
    assert (empty.rows, empty.zero_ratio, empty.empty_ratio) == (0, 0.0, 0.0)


def test_top_values_labels(spark):
    df = spark.createDataFrame([(" a ",), ("a",), (None,), ("",), ("",)], "v string")
    got = {r.value: r["count"] for r in profile.top_values(df, "v").collect()}
    assert got == {"a": 2, "<EMPTY>": 2, "<NA>": 1}
    cats = {r.value: r["count"] for r in profile.top_categories(df, "v").collect()}
    assert cats == {" a ": 1, "a": 1, "<NULL>": 1, "": 2}


def test_spread_is_the_same_at_every_size(spark):
    from tablewright.session import spread
    want = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in (10, 100_000):
        assert spread(spark.range(0, n, 1, 1), "id").rdd.getNumPartitions() == want


def test_row_spec_merges_and_refuses():
    assert position.parse_row_spec(" 9 , 1-3,2-5 ,7,6,") == [(1, 7), (9, 9)]
    assert position.parse_row_spec("4,0") == [(0, 0), (4, 4)]
    for bad in ["1;2", "a", "1-2-3", "1.5", "- 3", "3-"]:
        with pytest.raises(ValueError):
            position.parse_row_spec(bad)


def test_delete_rows_refuses_shared_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="share their key"):
        position.delete_rows(df, "0", "k")
    assert [r.v for r in position.delete_rows(df, "2", "k").collect()] != []
    assert sorted(r.v for r in position.delete_rows(df, "0", ["k", "v"]).collect()) == ["b", "c"]


TIMES = {"2024-01-05": (1, 5, 0), "01/05/2024": (1, 5, 0), "13/05/2024": (5, 13, 0), "2024/01/05 10:11": (1, 5, 10),
         "Jan 5, 2024": (1, 5, 0), "January 5 2024 3:04 PM": (1, 5, 15), "5-January-2024": (1, 5, 0),
         "20240105": (1, 5, 0), "2024.01.05": (1, 5, 0), "1/5/2024 12:00 am": (1, 5, 0), "2024/01/05T10:00": (1, 5, 10)}


def test_times_in_usual_spellings(spark):
    from pyspark.sql import types as T
    rows = list(TIMES) + ["x", "", None, "12", "Monday", "2024-13-01"]
    df = spark.createDataFrame([(v,) for v in rows], "t string")
    got = {r.t: r.p for r in df.select("t", clean.parse_time(F.col("t"), T.StringType()).alias("p")).collect()}
    for text, (month, day, hour) in TIMES.items():
        assert (got[text].year, got[text].month, got[text].day, got[text].hour) == (2024, month, day, hour), text
    assert all(got[v] is None for v in rows[len(TIMES):])
    assert clean.time_range(df, "t", "2024/01/05", "5 Jan 2024").count() == 7
    with pytest.raises(ValueError, match="time bound"):
        clean.time_range(df, "t", "some day")
