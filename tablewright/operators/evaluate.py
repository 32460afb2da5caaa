"""Evaluation metrics as aggregations.

Classification metrics come from the confusion counts
``groupBy(truth, prediction).count()`` — at most classes² rows however
large the input — combined into support-weighted precision, recall and
F1 (0 where a ratio has a zero denominator). Regression metrics are one
global aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import require_columns
from .select import cut_lineage


def classification_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: ``accuracy, precision, recall, f1`` (weighted by true-class support).

    Labels are compared as text, so a numeric truth and a text prediction
    of the same label match.
    """
    require_columns(df, [truth, prediction])
    pairs = df.select(F.col(f"`{truth}`").cast("string").alias("y"),
                      F.col(f"`{prediction}`").cast("string").alias("p"))
    # classes² rows at most: brought back once so the three uses below do not
    # re-run the (possibly expensive) scoring plan
    conf = cut_lineage(pairs.groupBy("y", "p").count())
    support = conf.groupBy(F.col("y").alias("c")).agg(F.sum("count").alias("support"))
    predicted = conf.groupBy(F.col("p").alias("c")).agg(F.sum("count").alias("predicted"))
    hits = conf.where(F.col("y").eqNullSafe(F.col("p"))).select(
        F.col("y").alias("c"), F.col("count").alias("tp"))
    per_class = (support.join(predicted, "c", "full").join(hits, "c", "left")
                 .na.fill(0, ["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per_class = per_class.withColumn("prec", prec).withColumn("rec", rec).withColumn(
        "f1", F.when(F.col("prec") + F.col("rec") > 0,
                     2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(F.lit(0.0)))
    n = F.sum("support")
    return per_class.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"))


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: ``mae, rmse, r2``. R² is 1.0 for a perfect fit of a constant
    truth and 0.0 for an imperfect one."""
    require_columns(df, [truth, prediction])
    y = F.col(f"`{truth}`").cast("double")
    p = F.col(f"`{prediction}`").cast("double")
    s = df.select(y.alias("y"), p.alias("p")).agg(
        F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
        F.avg((F.col("y") - F.col("p")) ** 2).alias("mse"),
        F.sum((F.col("y") - F.col("p")) ** 2).alias("ss_res"),
        (F.var_pop("y") * F.count("y")).alias("ss_tot"))
    r2 = (F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot"))
           .when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return s.select("mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def metrics_dict(row_df: DataFrame) -> dict[str, float]:
    """The one-row metrics frame as a small dict (a single row reaches the driver)."""
    row = row_df.first()
    return {k: float(v) if v is not None else float("nan") for k, v in row.asDict().items()}
