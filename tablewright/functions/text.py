"""Text helpers as Spark column expressions: value-to-text the way pandas
prints it, zero padding, and splitting at the n-th delimiter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import is_float_type, is_string_type


def as_text(c: Column, dt: T.DataType) -> Column:
    """Render a value as pandas ``astype("string")`` would.

    * doubles in ``[1e-4, 1e16)`` print in positional form (Spark writes
      ``1.0E7`` where Python writes ``10000000.0``);
    * booleans print ``True`` / ``False``;
    * everything else uses Spark's cast, which already agrees.
    Null stays null.
    """
    if is_string_type(dt):
        return c
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if is_float_type(dt):
        raw = c.cast("string")
        positional = F.regexp_replace(F.rtrim(raw.cast("decimal(38,21)").cast("string"), F.lit("0")), r"\.$", ".0")
        # Outside [1e-4, 1e16) Python keeps scientific form, written
        # "1.5e+16" / "1e-05" where Spark writes "1.5E16" / "1.0E-5".
        mantissa, exponent = F.substring_index(raw, "E", 1), F.substring_index(raw, "E", -1)
        digits = F.ltrim(exponent, F.lit("-"))
        scientific = F.concat(F.when(F.endswith(mantissa, F.lit(".0")), F.substring_index(mantissa, ".", 1)).otherwise(mantissa),
                              F.lit("e"), F.when(F.startswith(exponent, F.lit("-")), F.lit("-")).otherwise(F.lit("+")),
                              F.when(F.length(digits) < 2, F.lit("0")).otherwise(F.lit("")), digits)
        in_range = (F.abs(c) >= F.lit(1e-4)) & (F.abs(c) < F.lit(1e16))
        return (F.when(F.isnan(c), F.lit(None).cast("string"))
                .when(~raw.contains("E"), raw)
                .when(in_range, positional)
                .otherwise(scientific))
    return c.cast("string")


# Text that is a number, blanks around it allowed.
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE_TEXT = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def to_number(c: Column) -> Column:
    """Text as a double; null where it is not a number as a whole. A cast alone
    would take suffixes such as the ``d`` of ``5d``."""
    endless = F.when(F.startswith(F.trim(c), F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(c.rlike(NUMBER_TEXT), F.regexp_replace(c, r"\s", "").try_cast("double")).when(
        c.rlike(INFINITE_TEXT), endless)


def zfill(c: Column, width: int) -> Column:
    """Python ``str.zfill``: pad with zeros after a leading sign, never truncate."""
    if width <= 0:
        return c
    n = F.char_length(c)
    signed = c.rlike(r"^[+-]")
    return (F.when(n >= F.lit(width), c)
            .when(signed, F.concat(F.substring(c, 1, 1),
                                   F.lpad(F.substring(c, 2, 1 << 30), width - 1, "0")))
            .otherwise(F.lpad(c, width, "0")))


def regex_literal(text: str) -> str:
    """Escape every non-word character so ``text`` matches literally in a Java regex."""
    out = []
    for ch in text:
        if ch.isalnum() or ch == "_" or ord(ch) > 127:
            out.append(ch)
        else:
            out.append("\\" + ch)
    return "".join(out)


def split_at_occurrence(c: Column, delimiter: str, occurrence: int) -> tuple[Column, Column]:
    """Split text at the ``occurrence``-th (1-based, non-overlapping) delimiter.

    Returns ``(left, right)``. Fewer delimiters than ``occurrence`` gives
    ``(whole, "")``; null is treated as ``""``. Built on ``split`` with a
    limit so the right part keeps every later delimiter.
    """
    if not delimiter:
        raise ValueError("Splitting needs a delimiter that is not empty.")
    if occurrence < 1:
        raise ValueError(f"Delimiters are counted from 1, not {occurrence}.")
    text = F.coalesce(c, F.lit(""))
    parts = F.split(text, regex_literal(delimiter), occurrence + 1)
    has_right = F.size(parts) > F.lit(occurrence)
    left = F.when(has_right, F.array_join(F.slice(parts, 1, occurrence), delimiter)).otherwise(text)
    right = F.when(has_right, F.element_at(parts, occurrence + 1)).otherwise(F.lit(""))
    return left, right
