"""Column-expression helpers shared by every operator."""

from .predicates import (NA_TEXT_VALUES, WHITESPACE, col_type, is_bad,
                         is_empty_for_profile, is_float_type, is_missing,
                         is_na_for_profile, is_null, is_numeric_type,
                         is_string_type, is_temporal_type, is_zero,
                         nan_to_null, require_columns, strip, zero_of_type)
from .text import as_text, regex_literal, split_at_occurrence, to_number, zfill

__all__ = [
    "NA_TEXT_VALUES", "WHITESPACE", "col_type", "is_bad", "is_empty_for_profile",
    "is_float_type", "is_missing", "is_na_for_profile", "is_null",
    "is_numeric_type", "is_string_type", "is_temporal_type", "is_zero",
    "nan_to_null", "require_columns", "strip", "zero_of_type", "as_text",
    "regex_literal", "split_at_occurrence", "to_number", "zfill",
]
