"""The supervised feature matrix: lags, rolling statistics, calendar, regime and week profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.config import WEEKS, LagAgg, SeriesConfig
from shelfline.forecast.calendar import DATE_FEATURES, DateFeature, calendar_columns, harmonic_columns, onehot_columns
from shelfline.forecast.profile import PROFILE_COLUMNS
from shelfline.forecast.series import placed
from shelfline.functions import iso_week

#: Rows of a series whose lags one task makes at once.
CHUNK_ROWS = 4096
_FNS = {"mean": F.avg, "max": F.max, "min": F.min}


def lag_names(cfg: SeriesConfig) -> list[str]:
    return [f"lag{n}" for n in cfg.lags] + [r.name for r in cfg.rolling]


def week_names(cfg: SeriesConfig) -> list[str]:
    waves = [f"woy_{f}_{k}" for k in cfg.harmonics for f in ("sin", "cos")]
    hot = [f"woy_oh_{w:02d}" for w in range(1, WEEKS + 1)] if cfg.week_onehot else []
    return ["woy_week", *waves, *hot, *PROFILE_COLUMNS]


def known_names(cfg: SeriesConfig, features: Mapping[str, DateFeature] | None = None) -> list[str]:
    """Features that are known for future days."""
    return [*(features or DATE_FEATURES), cfg.regime_col, *week_names(cfg)]


def feature_names(cfg: SeriesConfig, features: Mapping[str, DateFeature] | None = None) -> list[str]:
    return [*lag_names(cfg), *known_names(cfg, features)]


def rolling_column(spec: LagAgg, value: str, line) -> Column:
    """Statistic over ``window`` rows that end ``lag`` rows back; one known row is enough."""
    frame = line.rowsBetween(-(spec.lag + spec.window - 1), -spec.lag)
    return _FNS[spec.fn](value).over(frame).alias(spec.name)


def reach(cfg: SeriesConfig) -> int:
    """Past rows a feature can reach."""
    return max([*cfg.lags, *[r.lag + r.window - 1 for r in cfg.rolling]])


def lag_columns(cfg: SeriesConfig, value: str = "y", line=None) -> list[Column]:
    line = line or Window.partitionBy("unique_id").orderBy("ds")
    lags = [F.lag(value, n).over(line).alias(f"lag{n}") for n in cfg.lags]
    return lags + [rolling_column(spec, value, line) for spec in cfg.rolling]


def with_lags(series: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """Add lags and rolling statistics, chunk by chunk.

    A chunk is CHUNK_ROWS places of a series. The last rows of a chunk, as many as a
    feature can reach back, are copied into the chunk behind it, where they serve
    as the past only. So windows are exact and no task holds more than a chunk of a series.
    """
    place = F.col("_rn") - 1
    own = F.floor(place / F.lit(CHUNK_ROWS))
    copied = placed(series).select(*series.columns, "_rn", own.alias("_own"), F.explode(
        F.sequence(own, F.floor((place + reach(cfg)) / F.lit(CHUNK_ROWS)))).alias("_part"))
    line = Window.partitionBy("unique_id", "_part").orderBy("_rn")
    lagged = copied.select(*series.columns, "_own", "_part", *lag_columns(cfg, "y", line))
    return lagged.where(F.col("_own") == F.col("_part")).drop("_own", "_part")


def attach_week(df: DataFrame, profile: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """Week number, harmonics, one-hot and the profile row of the day's week."""
    marked = df.select("*", iso_week(F.col("ds")).alias("woy_week"), *harmonic_columns(cfg), *onehot_columns(cfg))
    return marked.join(profile, ["unique_id", "woy_week"], "left")


def known_features(df: DataFrame, profile: DataFrame, cfg: SeriesConfig,
                   features: Mapping[str, DateFeature] | None = None) -> DataFrame:
    """Add every feature that needs no past value to a frame with unique_id, ds and the regime flag."""
    own = [c for c in df.columns if c != cfg.regime_col]
    dated = df.select("*", *calendar_columns("ds", features))
    return attach_week(dated, profile, cfg).select(*own, *known_names(cfg, features))


def feature_matrix(series: DataFrame, profile: DataFrame, cfg: SeriesConfig,
                   features: Mapping[str, DateFeature] | None = None) -> DataFrame:
    """unique_id, ds, y and all features; days without a full set of lags are left out."""
    lagged = with_lags(series, cfg).na.drop(subset=lag_names(cfg))
    return known_features(lagged, profile, cfg, features).select("unique_id", "ds", "y", *feature_names(cfg, features))


def prefixed(columns: Sequence[str], prefix: str) -> list[str]:
    return [c for c in columns if c.startswith(prefix)]
