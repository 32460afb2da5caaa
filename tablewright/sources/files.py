"""Load and save tables by file extension, and load many files at once.

The extension check (case-insensitive) happens before any job. Loading
many files reads each lazily as its own dataset named by its file name;
one failing file does not stop the others.
"""

from __future__ import annotations

import posixpath
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .csv import read_csv, write_csv

#: Files whose types are inferred at the same time.
CONCURRENT_LOADS = 8
# Accepted extensions.
CSV_EXTENSIONS = (".csv",)


def _ext(path: str) -> str:
    return posixpath.splitext(path.rstrip("/").lower())[1]


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder, with type inference."""
    ext = _ext(path)
    if ext in CSV_EXTENSIONS:
        return read_csv(spark, path)
    raise ValueError(f"Cannot read {path!r}: only {', '.join(CSV_EXTENSIONS)} files are read.")


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write CSV (a directory of part files)."""
    ext = _ext(path)
    if ext in CSV_EXTENSIONS:
        write_csv(df, path, mode)
        return
    raise ValueError(f"Cannot write {path!r}: only {', '.join(CSV_EXTENSIONS)} files are written.")


def dataset_name(path: str) -> str:
    return posixpath.basename(path.rstrip("/"))


def load_many(spark: SparkSession, paths) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """``({file name: DataFrame}, {file name: error})``; a later file with the
    same name replaces an earlier one."""
    paths = list(paths)

    def load(path):
        try:
            return load_table(spark, path), None
        except Exception as exc:  # noqa: BLE001 - reported per file
            return None, str(exc)

    loaded: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    with ThreadPoolExecutor(max_workers=CONCURRENT_LOADS) as pool:
        for path, (df, error) in zip(paths, pool.map(load, paths)):
            name = dataset_name(path)
            if df is None:
                errors[name] = error
            else:
                loaded[name] = df
                errors.pop(name, None)
    return loaded, errors
