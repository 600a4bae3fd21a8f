"""Features of the date alone."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.config import EVENT_DAYS, WEEKS, SeriesConfig
from shelfline.functions import day_of_week, iso_week

DateFeature = Callable[[Column], Column]


def event_day(ds: Column, rules: tuple[tuple[int, int, int], ...] = EVENT_DAYS) -> Column:
    """1 on days that fall in a (month, first day, last day) rule."""
    hits = [(F.month(ds) == m) & F.dayofmonth(ds).between(a, b) for m, a, b in rules]
    return reduce(lambda x, y: x | y, hits).cast("int")


DATE_FEATURES: dict[str, DateFeature] = {
    "dayofweek": day_of_week,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofyear": F.dayofyear,
    "year": F.year,
    "weekofyear": iso_week,
    "quarter": F.quarter,
    "is_weekend": lambda ds: (day_of_week(ds) >= 5).cast("int"),
    "is_gregorian_peak": event_day,
}


def calendar_columns(ds: Column | str = "ds", features: Mapping[str, DateFeature] | None = None) -> list[Column]:
    ds = F.col(ds) if isinstance(ds, str) else ds
    return [fn(ds).alias(name) for name, fn in (features or DATE_FEATURES).items()]


def harmonic_columns(cfg: SeriesConfig, ds: Column | str = "ds") -> list[Column]:
    """Sine and cosine of the ISO week on a circle of 53 weeks."""
    ds = F.col(ds) if isinstance(ds, str) else ds
    out = []
    for k in cfg.harmonics:
        angle = F.lit(2 * math.pi * k) * iso_week(ds) / F.lit(float(WEEKS))
        out += [F.sin(angle).alias(f"woy_sin_{k}"), F.cos(angle).alias(f"woy_cos_{k}")]
    return out


def onehot_columns(cfg: SeriesConfig, ds: Column | str = "ds") -> list[Column]:
    ds = F.col(ds) if isinstance(ds, str) else ds
    if not cfg.week_onehot:
        return []
    return [(iso_week(ds) == w).cast("int").alias(f"woy_oh_{w:02d}") for w in range(1, WEEKS + 1)]


def add_calendar(df: DataFrame, features: Mapping[str, DateFeature] | None = None) -> DataFrame:
    return df.select("*", *calendar_columns("ds", features))
