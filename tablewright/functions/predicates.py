"""Missing / zero / bad predicates as Spark column expressions.

Every predicate is a pure ``Column`` built from built-in functions, so it
stays inside whole-stage codegen and can be pushed through projections.
They take the column's Spark data type because the meaning depends on it
(numbers and booleans can be zero; only floats can hold NaN; only text can
be blank or spell "n/a").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text spellings that count as missing, compared after
# stripping whitespace and lower-casing.
NA_TEXT_VALUES = ("na", "n/a", "null", "none")

# Whitespace removed by "strip": every character for which Python's
# str.isspace() holds (29 code points, including NBSP and U+001C..U+001F).
# Spark's plain trim() only removes spaces, so we pass this set to btrim.
WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric in the pandas sense: numbers *and* booleans."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def strip(c: Column) -> Column:
    """Python ``str.strip()`` on a text column."""
    return F.btrim(c, F.lit(WHITESPACE))


def nan_to_null(c: Column, dt: T.DataType) -> Column:
    """NaN and null both mean "missing"; keep only null (NaN sorts highest in Spark)."""
    if is_float_type(dt):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c)
    return c


def is_null(c: Column, dt: T.DataType) -> Column:
    """Null, or NaN for floating columns."""
    if is_float_type(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_missing(c: Column, dt: T.DataType) -> Column:
    """Null/NaN, blank text, or one of :data:`NA_TEXT_VALUES` (never null)."""
    if is_string_type(dt):
        s = strip(c)
        return c.isNull() | (s == F.lit("")) | F.lower(s).isin(*NA_TEXT_VALUES)
    return is_null(c, dt)


def is_zero(c: Column, dt: T.DataType) -> Column:
    """Numeric zero, boolean false, or text that strips to ``"0"``.

    Three-valued on purpose: a null input gives null, so an average of the
    flag is taken over present values only (the profile's zero ratio).
    Text ``"0.0"`` or ``"00"`` is not zero.
    """
    if isinstance(dt, T.BooleanType):
        return ~c
    if is_float_type(dt):
        return F.when(F.isnan(c), F.lit(None).cast("boolean")).otherwise(c == 0)
    if is_numeric_type(dt):
        return c == 0
    if is_string_type(dt):
        return strip(c) == F.lit("0")
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))


def is_bad(c: Column, dt: T.DataType) -> Column:
    """Zero or missing (never null)."""
    return F.coalesce(is_zero(c, dt), F.lit(False)) | is_missing(c, dt)


def is_empty_for_profile(c: Column, dt: T.DataType) -> Column:
    """Profile "empty": null counts as empty, NA spellings do not."""
    if is_string_type(dt):
        return c.isNull() | (strip(c) == F.lit(""))
    return is_null(c, dt)


def is_na_for_profile(c: Column, dt: T.DataType) -> Column:
    """Profile "na": null or an NA spelling; the empty string does not count."""
    if is_string_type(dt):
        return c.isNull() | F.lower(strip(c)).isin(*NA_TEXT_VALUES)
    return is_null(c, dt)


def zero_of_type(dt: T.DataType) -> Column:
    """The literal zero for a column type, used by zero-fill and target repair."""
    if is_string_type(dt):
        return F.lit("0")
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, T.NumericType):
        return F.lit(0).cast(dt)
    raise ValueError(f"Cannot fill zeros into a column of type {dt.simpleString()}.")


def require_columns(df: DataFrame, columns, what: str = "column") -> None:
    """Raise ``ValueError`` before any job when a named column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Unknown {what}: {', '.join(map(str, missing[:5]))}")
