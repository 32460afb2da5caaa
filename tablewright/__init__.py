"""tablewright — table preparation and modelling as Spark DataFrame plans.

Operators are functions ``DataFrame -> DataFrame`` built from built-in
column expressions (so Catalyst optimises and codegens them) and
``pyspark.ml``. Driver-side code only validates arguments and holds small,
bounded results (fitted statistics, model weights, hot-key lists).
"""

from .session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
