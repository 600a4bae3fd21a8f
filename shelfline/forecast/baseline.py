"""Seasonal baselines: what an ensemble has to beat, and a model-free input for blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from shelfline.config import SeriesConfig
from shelfline.forecast.profile import build_profile
from shelfline.functions import iso_week, safe_ratio

# Whole weeks back, all longer than the horizon, so every value is known at the cut-off.
BASELINE_LAGS = (728, 735, 742)
BASELINES = tuple(f"seasonal_{n}" for n in BASELINE_LAGS) + ("week_mean",)


def seasonal_baselines(history: DataFrame, future: DataFrame, cfg: SeriesConfig,
                       lags: Sequence[int] = BASELINE_LAGS) -> DataFrame:
    """Values of the same weekday about two years earlier, and the mean of the ISO week.

    ``history`` and ``future`` are dense and follow on each other. Where a lag
    reaches before the history, the week mean stands in.
    """
    line = Window.partitionBy("unique_id").orderBy("ds")
    past = history.select("unique_id", "ds", "y", F.lit(False).alias("_f"))
    ahead = future.select("unique_id", "ds").distinct().select("*", F.lit(None).cast("double").alias("y"),
                                                               F.lit(True).alias("_f"))
    lagged = past.unionByName(ahead).select(
        "unique_id", "ds", "_f", iso_week(F.col("ds")).alias("woy_week"),
        *[F.lag("y", n).over(line).alias(f"seasonal_{n}") for n in lags]).where("_f").drop("_f")
    means = build_profile(history, cfg).select("unique_id", "woy_week", F.col("woy_profile_mean").alias("week_mean"))
    joined = lagged.join(means, ["unique_id", "woy_week"], "left")
    return joined.select("unique_id", "ds", *[F.coalesce(f"seasonal_{n}", "week_mean").alias(f"seasonal_{n}")
                                              for n in lags], "week_mean")


def regime_scaled(history: DataFrame, baselines: DataFrame, future: DataFrame, cfg: SeriesConfig,
                  models: Sequence[str] = BASELINES) -> DataFrame:
    """Baselines per scenario: on flagged days scaled by the flagged-to-unflagged mean ratio of the series."""
    flag = F.col(cfg.regime_col) == 1
    effect = history.groupBy("unique_id").agg(safe_ratio(
        F.avg(F.when(flag, F.col("y"))), F.avg(F.when(~flag, F.col("y"))), 1.0).alias("_effect"))
    joined = future.join(baselines, ["unique_id", "ds"]).join(effect, "unique_id")
    factor = F.when(flag, F.col("_effect")).otherwise(1.0)
    return joined.select("scenario", "unique_id", "ds", *[(F.col(m) * factor).alias(m) for m in models])
