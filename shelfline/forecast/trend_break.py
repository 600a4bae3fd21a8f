"""A trend that may bend at a known date, with seasonal terms and the regime flag.

Fitted in logs, so seasonal effects multiply the level. Every series gets its own
coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.config import SeriesConfig, TrendBreakConfig
from shelfline.forecast.blend import mix_scenarios
from shelfline.functions import clip
from shelfline.session import stored

BAND = ("yhat_lower", "yhat_upper")


def design(cfg: TrendBreakConfig, flag: Column, ds: Column | str = "ds") -> Column:
    """Model terms of a day: level, trend, trend after the break, regime, yearly and weekly waves."""
    ds = F.col(ds) if isinstance(ds, str) else ds
    years = F.datediff(ds, F.lit(cfg.break_date)) / F.lit(365.25)
    terms = [F.lit(1.0), years, F.greatest(years, F.lit(0.0)), flag.cast("double")]
    days = F.datediff(ds, F.lit("1970-01-01").cast("date")).cast("double")
    for period, order in ((365.25, cfg.yearly_order), (7.0, cfg.weekly_order)):
        for k in range(1, order + 1):
            angle = days * F.lit(2 * math.pi * k / period)
            terms += [F.sin(angle), F.cos(angle)]
    return F.array(*terms)


def _level(coefficients: str, terms: Column) -> Column:
    return F.aggregate(F.zip_with(coefficients, terms, lambda b, x: b * x), F.lit(0.0), lambda a, v: a + v)


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of the terms and the value, for each series in a batch."""
    for batch in batches:
        found = [(series, np.column_stack([np.stack(rows["terms"].to_numpy()), rows["log_y"]])) for series, rows in batch.groupby("unique_id")]
        yield pd.DataFrame({"unique_id": [series for series, _ in found], "products": [(x.T @ x).ravel() for _, x in found]})


def _solver(reg_param: float):
    """Ridge coefficients from a series' sums of products: a system as large as the model has terms."""

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        def one(packed: np.ndarray) -> np.ndarray:
            count = math.isqrt(len(packed))
            products = np.reshape(packed, (count, count))
            left, right = products[:-1, :-1], products[:-1, -1]
            penalty = np.diag(np.r_[0.0, np.full(count - 2, reg_param * left[0, 0])])
            return np.linalg.lstsq(left + penalty, right, rcond=None)[0]

        return sums.map(one)

    return solve


def fit(history: DataFrame, series_cfg: SeriesConfig, cfg: TrendBreakConfig) -> DataFrame:
    """Coefficients per series, and the residual quantiles that make the band.

    Tasks reduce their days to sums of products, which are then added up; no task needs all days of a series.
    """
    edge = (1.0 - cfg.band) / 2.0
    days = history.where(F.col("y") > 0).select(
        "unique_id", F.log("y").alias("log_y"), design(cfg, F.col(series_cfg.regime_col)).alias("terms"))
    summed = days.mapInPandas(_products, "unique_id string, products array<double>") \
        .select("unique_id", F.posexplode("products").alias("pos", "part")).groupBy("unique_id", "pos").agg(F.sum("part").alias("total"))
    packed = summed.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("pos", "total")))["total"].alias("sums"))
    solved = stored(packed.select("unique_id", _solver(cfg.reg_param)("sums").alias("coefficients")), "trend")
    left = days.join(solved, "unique_id").withColumn("residual", F.col("log_y") - _level("coefficients", F.col("terms")))
    band = left.groupBy("unique_id").agg(F.percentile("residual", F.array(F.lit(edge), F.lit(1.0 - edge))).alias("band"))
    return solved.join(band, "unique_id").select(
        "unique_id", "coefficients", F.least(F.get("band", F.lit(0)), F.lit(0.0)).alias("low"),
        F.greatest(F.get("band", F.lit(1)), F.lit(0.0)).alias("high"))


def predict(fitted: DataFrame, future: DataFrame, series_cfg: SeriesConfig, cfg: TrendBreakConfig) -> DataFrame:
    """Point forecast and band for every row of the future frame."""
    terms = design(cfg, F.col(series_cfg.regime_col))
    joined = future.join(fitted, "unique_id").withColumn("_level", _level("coefficients", terms))
    at = lambda shift: clip(F.exp(F.col("_level") + shift), low=0.0)
    return joined.select("scenario", "unique_id", "ds", at(F.lit(0.0)).alias(cfg.output),
                         at(F.col("low")).alias(BAND[0]), at(F.col("high")).alias(BAND[1]))


def with_mix(forecasts: DataFrame, probability: float, cfg: TrendBreakConfig, scenarios: Sequence[str]) -> DataFrame:
    """All scenarios plus their mix; point and band are mixed alike."""
    columns = [cfg.output, *BAND]
    return forecasts.select("scenario", "unique_id", "ds", *columns).unionByName(
        mix_scenarios(forecasts, scenarios[0], scenarios[1], probability, columns))
