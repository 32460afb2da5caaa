import math

import pytest
from pyspark.sql import functions as F

from tablewright.functions import (as_text, is_bad, is_missing, is_zero,
                                   split_at_occurrence, strip, zfill)

TEXT = [None, "", " pad ", "  ", "\tNA\n", "None", "nan", "0", " 0 ", "0.0", "x"]


def _text_df(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def test_text_predicates(spark):
    df = _text_df(spark, TEXT)
    dt = df.schema["v"].dataType
    rows = df.select("i", "v", is_missing(F.col("v"), dt).alias("m"), is_zero(F.col("v"), dt).alias("z"),
                     is_bad(F.col("v"), dt).alias("b"), strip(F.col("v")).alias("s")).orderBy("i").collect()
    got = {r.i: (r.m, r.z, r.b, r.s) for r in rows}
    assert got[0] == (True, None, True, None)          # null
    assert got[1][0] is True and got[1][2] is True       # ''
    assert got[2] == (False, False, False, "pad")        # NBSP stripped like str.strip
    assert got[3][0] is True                             # blank
    assert got[4][0] is True                             # '\tNA\n'
    assert got[5][0] is True                             # 'None'
    assert got[6] == (False, False, False, "nan")        # 'nan' text is not missing
    assert got[7] == (False, True, True, "0")
    assert got[8] == (False, True, True, "0")            # ' 0 '
    assert got[9] == (False, False, False, "0.0")        # '0.0' is not zero
    for i, v in enumerate(TEXT):
        if v is not None:
            assert got[i][3] == v.strip()


def test_numeric_predicates(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 0.0), (2, -0.0), (3, None), (4, 2.5)], "i int, x double")
    dt = df.schema["x"].dataType
    got = {r.i: (r.m, r.z, r.b) for r in df.select(
        "i", is_missing(F.col("x"), dt).alias("m"), is_zero(F.col("x"), dt).alias("z"),
        is_bad(F.col("x"), dt).alias("b")).collect()}
    assert got[0] == (True, None, True)
    assert got[1] == (False, True, True)
    assert got[2] == (False, True, True)
    assert got[3] == (True, None, True)
    assert got[4] == (False, False, False)


def test_boolean_zero(spark):
    df = spark.createDataFrame([(False,), (True,), (None,)], "b boolean")
    dt = df.schema["b"].dataType
    assert [r[0] for r in df.select(is_zero(F.col("b"), dt)).collect()] == [True, False, None]


@pytest.mark.parametrize("value,width,expected", [
    ("-5", 3, "-05"), ("+5", 3, "+05"), ("5", 3, "005"), ("12345", 3, "12345"), ("", 3, "000")])
def test_zfill(spark, value, width, expected):
    assert value.zfill(width) == expected
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(zfill(F.col("v"), width)).first()[0] == expected


SPLITS = ["a-b-c", "", "abc", "a--b", "-a", "a-", None]


# Parts of SPLITS + ["aaaa", "a.b|c", "x\\Ey\\Ez"], written out by hand.
_WHOLE = [("a-b-c", ""), ("", ""), ("abc", ""), ("a--b", ""), ("-a", ""), ("a-", ""), ("", ""),
          ("aaaa", ""), ("a.b|c", ""), ("x\\Ey\\Ez", "")]
EXPECTED_PARTS = {
    ("-", 1): [("a", "b-c"), ("", ""), ("abc", ""), ("a", "-b"), ("", "a"), ("a", ""), ("", ""), *_WHOLE[7:]],
    ("-", 2): [("a-b", "c"), ("", ""), ("abc", ""), ("a-", "b"), ("-a", ""), ("a-", ""), ("", ""), *_WHOLE[7:]],
    ("--", 1): [*_WHOLE[:3], ("a", "b"), *_WHOLE[4:]],
    (".", 1): [*_WHOLE[:8], ("a", "b|c"), _WHOLE[9]],
    ("|", 1): [*_WHOLE[:8], ("a.b", "c"), _WHOLE[9]],
    ("aa", 1): [*_WHOLE[:7], ("", "aa"), *_WHOLE[8:]],
    ("\\E", 1): [*_WHOLE[:9], ("x", "y\\Ez")],
}


@pytest.mark.parametrize("delim,n", [("-", 1), ("-", 2), ("--", 1), (".", 1), ("|", 1), ("aa", 1), ("\\E", 1)])
def test_split_matches_python(spark, delim, n):
    values = SPLITS + ["aaaa", "a.b|c", "x\\Ey\\Ez"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    left, right = split_at_occurrence(F.col("v"), delim, n)
    got = [(r[0], r[1]) for r in df.select(left, right).collect()]
    assert got == EXPECTED_PARTS[delim, n]


def test_split_errors():
    with pytest.raises(ValueError):
        split_at_occurrence(F.col("v"), "", 1)
    with pytest.raises(ValueError):
        split_at_occurrence(F.col("v"), "-", 0)


def test_as_text_matches_python(spark):
    values = [1e7, 1e16, 1.5e16, 1e-5, 0.1, 0.0001, 123456789.125, -2.5e-7, 0.0, 1863.84]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(as_text(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == [repr(v) for v in values]
    b = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in b.select(as_text(F.col("b"), b.schema["b"].dataType)).collect()] == ["True", "False", None]
    assert not math.isnan(1.0)
