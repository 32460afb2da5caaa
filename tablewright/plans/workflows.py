"""Composite plans: the merge and aggregate workflows as single lazy plans.

Each workflow chains operators into one DataFrame, so Catalyst sees the
whole thing: it prunes the columns the aggregate does not read before the
scan, pushes filters below the join, and AQE picks the join strategy from
measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.aggregate import aggregate, binary_flag, normalize_rules
from ..operators.merge import coalesce_merged, merge


def merge_workflow(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                   how: str = "inner", aggregate_specs=None, coalesce: bool = False,
                   strategy: str = "first_non_empty", skew: str = "auto") -> DataFrame:
    """[aggregate the right side by its key] → merge → [coalesce pairs and keys].

    Append never aggregates keys away nor coalesces.
    """
    unique = ""
    if aggregate_specs:
        right, unique = aggregate(right, right_key, aggregate_specs), "right"
    merged = merge(left, right, left_key, right_key, how, skew=skew, unique=unique)
    if coalesce and how != "append":
        merged = coalesce_merged(merged, strategy, left_key, right_key)
    return merged


def aggregate_workflow(df: DataFrame, group_key: str, specs, binary: dict | None = None) -> DataFrame:
    """Aggregate by key, then optionally turn one rule output into a 0/1 flag.

    ``binary`` = ``{"source_column", "threshold", "output_column"}``; the
    source must be one of the rule outputs.
    """
    rules = normalize_rules(specs)
    out = aggregate(df, group_key, rules)
    if binary:
        source = binary["source_column"]
        if source not in {r.output_column.strip() for r in rules}:
            raise ValueError(f"The flag's source {source!r} is not the output of any rule.")
        out = binary_flag(out, source, binary.get("threshold", 0), binary.get("output_column") or None)
    return out
