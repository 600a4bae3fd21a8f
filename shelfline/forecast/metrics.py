"""Forecast errors per series, and their plain average over the series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfline.functions import safe_ratio

TINY = 1e-8
AVERAGE = "Average"


def forecast_metrics(evaluated: DataFrame, prediction: str, with_average: bool = True) -> DataFrame:
    """MAE, RMSE, R2 and MAPE; ``guarded_share`` is the share of days whose MAPE divisor was raised to 1e-8."""
    y, p = F.col("y"), F.col(prediction)
    err = y - p
    tiny = F.abs(y) < TINY
    base = F.when(tiny, F.lit(TINY)).otherwise(y)
    known = evaluated.where(y.isNotNull() & p.isNotNull())
    sums = known.groupBy("unique_id").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - safe_ratio(F.sum(err * err), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        (F.avg(F.abs(err / base)) * 100.0).alias("mape_pct"),
        F.avg(tiny.cast("double")).alias("guarded_share"), F.count(F.lit(1)).alias("days"))
    if not with_average:
        return sums
    mean = sums.agg(F.lit(AVERAGE).alias("unique_id"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "r2", "mape_pct",
                                                                                     "guarded_share")],
                    F.sum("days").alias("days"))
    return sums.unionByName(mean)


def model_errors(evaluated: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean absolute error of every model and series."""
    long = evaluated.where(F.col("y").isNotNull()).unpivot(["unique_id", "ds", "y"], list(models), "model", "prediction")
    return long.groupBy("model", "unique_id").agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"))


def nested_evaluation(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first half, second half) of each series' hold-out: learn the blend on one, score it on the other."""
    from pyspark.sql import Window

    half = F.ntile(2).over(Window.partitionBy("unique_id").orderBy("ds"))
    marked = evaluated.withColumn("_half", half)
    return marked.where("_half = 1").drop("_half"), marked.where("_half = 2").drop("_half")
