"""The wide result: one row per day, one column per target."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from shelfline.config import SeriesConfig
from shelfline.forecast.series import wide_series
from shelfline.functions import clip, half_even
from shelfline.sources.files import check_contract, write_by, write_csv


def to_submission(forecast: DataFrame, column: str, cfg: SeriesConfig, by_scenario: bool = False) -> DataFrame:
    """Date and targets, not below 0, rounded half-even to cents."""
    index = ["scenario", "ds"] if by_scenario else ["ds"]
    wide = wide_series(forecast, column, cfg, index)
    lead = ["scenario"] if by_scenario else []
    return wide.select(*lead, F.col("ds").alias("Date"),
                       *[half_even(clip(F.col(c), low=0.0), 2).alias(c) for c in cfg.targets])


def export(submission: DataFrame, path: str, cfg: SeriesConfig, first_day: date | None = None) -> str:
    """Write the submission as one CSV file in date order. It must hold every day of the horizon once."""
    check_contract(submission, first_day, cfg.horizon)
    return write_csv(submission, path, order=["Date"], single_file=True)


def export_scenarios(submissions: DataFrame, path: str) -> str:
    """One folder per scenario."""
    return write_by(submissions, path, "scenario")


def history_and_forecast(history: DataFrame, forecast: DataFrame, column: str, cfg: SeriesConfig) -> DataFrame:
    """Past and predicted values side by side in wide form."""
    past = wide_series(history, "y", cfg).withColumn("kind", F.lit("history"))
    ahead = to_submission(forecast, column, cfg).withColumnRenamed("Date", "ds").withColumn("kind", F.lit("forecast"))
    return past.unionByName(ahead).select("kind", F.col("ds").alias("Date"), *cfg.targets)
