"""A named-dataset catalog on top of Spark temp views.

Results are registered under readable names; a taken name gets ``_2``,
``_3``, ... Default names follow the workflow that produced the result.
"""

from __future__ import annotations

import itertools
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession


def unique_name(base: str, existing) -> str:
    """``base``, or it with the smallest free number from 2 upwards."""
    taken = set(existing)
    if base not in taken:
        return base
    return next(name for name in (f"{base}_{n}" for n in itertools.count(2)) if name not in taken)


def _stem(name: str) -> str:
    return posixpath.splitext(posixpath.basename(name))[0]


def merged_name(join_type: str, left: str, right: str) -> str:
    return f"Merged {join_type.title()} {_stem(left)} + {_stem(right)}"


def aggregated_name(dataset: str, output_name: str = "") -> str:
    return output_name.strip() or f"Aggregated {_stem(dataset)}"


def predicted_name(dataset: str | None) -> str:
    return f"Predicted {_stem(dataset or 'Dataset')}"


def range_name(dataset: str | None, time_column: str, start: str, end: str, given: str = "") -> str:
    return given.strip() or f"{_stem(dataset or 'Dataset')} {time_column} {start.strip() or 'Start'} To {end.strip() or 'End'}"


def _view_name(name: str) -> str:
    return "ds_" + re.sub(r"[^0-9A-Za-z_]", "_", name)


class Catalog:
    """Datasets by display name, each also queryable as a temp view."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}
        self._views: dict[str, str] = {}

    def names(self) -> list[str]:
        return list(self._frames)

    def register(self, df: DataFrame, base: str, replace: bool = False) -> str:
        name = base if replace else unique_name(base, self._frames)
        self._frames[name] = df
        if name not in self._views:
            self._views[name] = unique_name(_view_name(name), self._views.values())
        df.createOrReplaceTempView(self.view(name))
        return name

    def view(self, name: str) -> str:
        """SQL name of a dataset's temp view; no two datasets share one."""
        self.get(name)
        return self._views[name]

    def register_merge(self, df: DataFrame, how: str, left: str, right: str) -> str:
        return self.register(df, merged_name(how, left, right))

    def register_aggregate(self, df: DataFrame, dataset: str, output_name: str = "") -> str:
        return self.register(df, aggregated_name(dataset, output_name))

    def register_prediction(self, df: DataFrame, dataset: str | None) -> str:
        return self.register(df, predicted_name(dataset))

    def register_range(self, df: DataFrame, dataset: str | None, time_column: str, start: str = "",
                       end: str = "", given: str = "") -> str:
        return self.register(df, range_name(dataset, time_column, start, end, given))

    def get(self, name: str) -> DataFrame:
        if name not in self._frames:
            raise ValueError(f"There is no dataset named {name!r}.")
        return self._frames[name]

    def columns(self, name: str) -> list[str]:
        return [str(c) for c in self.get(name).columns]

    def drop(self, name: str) -> None:
        if self._frames.pop(name, None) is not None:
            self.spark.catalog.dropTempView(self._views.pop(name))
