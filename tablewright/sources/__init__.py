"""Sources and sinks: CSV, extension dispatch, dataset catalog."""

from .catalog import Catalog, unique_name
from .csv import read_csv, write_csv
from .files import load_many, load_table, save_table

__all__ = ["Catalog", "unique_name", "read_csv", "write_csv", "load_many", "load_table",
           "save_table"]
