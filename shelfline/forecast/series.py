"""Daily series in long form: ``unique_id, ds, y`` and the regime flag.

Every step is keyed by ``unique_id``. A series has at most one row per calendar
day, so windows over one series stay small however many series there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.config import SeriesConfig
from shelfline.operators.reshape import to_long

#: Days of a series that one task orders at once.
CHUNK_DAYS = 4096
SCENARIOS = ("non_covid", "covid", "auto")


def regime_flag(cfg: SeriesConfig, ds: Column | str = "ds", value: str | int | None = "auto") -> Column:
    """1 inside the regime dates (both included), or a forced 0/1 for a scenario."""
    ds = F.col(ds) if isinstance(ds, str) else ds
    if value is None or value == "auto":
        return ds.between(F.lit(cfg.regime_start), F.lit(cfg.regime_end)).cast("int")
    if value not in (0, 1):
        raise ValueError(f"regime value must be 'auto', 0 or 1, not {value!r}")
    return F.lit(int(value))


def scenario_value(name: str) -> str | int:
    values = {"non_covid": 0, "covid": 1, "auto": "auto"}
    if name not in values:
        raise ValueError(f"unknown scenario: {name}")
    return values[name]


def fill_calendar(series: DataFrame, keys: Sequence[str] = ("unique_id",), ds: str = "ds") -> DataFrame:
    """One row per key and day between the key's first and last day; new days have NULL values."""
    span = series.groupBy(*keys).agg(F.min(ds).alias("_a"), F.max(ds).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(ds))
    return days.join(series, [*keys, ds], "left")


def placed(series: DataFrame, keys: Sequence[str] = ("unique_id",), ds: str = "ds",
           marks: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``_rn``, the row's place in its series from 1, and ``_chunk``, without a window over a whole series.

    Rows are numbered inside chunks of CHUNK_DAYS days (``_in``); chunk totals, one row a chunk,
    shift them. ``marks`` are aggregates of a chunk that give structs with a place
    ``p``: ``_old`` brings the latest one of earlier chunks and ``_new`` the earliest of later chunks,
    with ``p`` as a place in the series.
    """
    chunk = F.floor(F.unix_date(F.col(ds)) / F.lit(CHUNK_DAYS))
    rows = series.withColumn("_chunk", chunk)
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(ds)).cast("long"))
    totals = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"), *[m.alias(n) for n, m in (marks or {}).items()])
    line = Window.partitionBy(*keys).orderBy("_chunk")
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    totals = totals.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    for n in marks or {}:
        moved = F.when(F.col(n).isNotNull(), F.struct((F.col(f"{n}.p") + F.col("_shift")).alias("p"), F.col(f"{n}.v").alias("v")))
        totals = totals.withColumn(n, moved)
    carried = {"_old": lambda c: F.last(c, True).over(earlier), "_new": lambda c: F.first(c, True).over(later)}
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_chunk").alias("_of"), "_shift",
                           *[carried[n](F.col(n)).alias(n) for n in marks or {}])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_chunk") == F.col("_of"))
    return rows.join(totals, same).withColumn("_rn", F.col("_in") + F.col("_shift")).drop("_of", "_shift", *[f"_{k}" for k in keys])


def fill_gaps(series: DataFrame, value: str = "y", keys: Sequence[str] = ("unique_id",), ds: str = "ds") -> DataFrame:
    """Linear fill between known values by position; the tail repeats the last one, the head stays NULL.

    Runs by chunk: a chunk takes the last known value before it and the next one
    behind it from the chunk summaries (see ``placed``), so no task holds a whole series.
    """
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_in").alias("p"), F.col(value).alias("v")))
    chunks = placed(series, keys, ds, {"_old": F.max(at), "_new": F.min(at)})
    line = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    back = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("_rn").alias("p"), F.col(value).alias("v")))
    known = chunks.select("*", F.coalesce(F.last(here, True).over(back), F.col("_old")).alias("_k0"),
                          F.coalesce(F.first(here, True).over(ahead), F.col("_new")).alias("_k1"))
    between = F.col("_k0.v") + (F.col("_k1.v") - F.col("_k0.v")) * (
        (F.col("_rn") - F.col("_k0.p")) / F.nullif(F.col("_k1.p") - F.col("_k0.p"), F.lit(0)))
    return known.withColumn(value, F.coalesce(F.col(value), between, F.col("_k0.v"))).select(*series.columns)


def load_series(sales: DataFrame, cfg: SeriesConfig, dense: bool = True) -> DataFrame:
    """Daily sales (date, revenue, cogs) as a long series with gaps filled and the regime flagged."""
    names = {"revenue": cfg.targets[0], "cogs": cfg.targets[1]}
    wide = sales.select(F.col("date").alias("ds"), *[F.col(c).cast("double").alias(n) for c, n in names.items()])
    long = to_long(wide, ["ds"], list(cfg.targets), "unique_id", "y")
    filled = fill_gaps(fill_calendar(long) if dense else long)
    return filled.select("unique_id", "ds", "y", regime_flag(cfg).alias(cfg.regime_col))


def regime_summary(series: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """First day, last day and number of days per flag value."""
    return (series.select("ds", cfg.regime_col).distinct().groupBy(cfg.regime_col)
            .agg(F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count("ds").alias("days")))


def cutoff(series: DataFrame, test_days: int) -> DataFrame:
    """One row: the last training day, which leaves the last ``test_days`` distinct days for testing."""
    return (series.select("ds").distinct().orderBy(F.desc("ds")).offset(test_days).limit(1)
            .withColumnRenamed("ds", "cutoff"))


def with_part(series: DataFrame, test_days: int) -> DataFrame:
    """The series with ``part`` = train or test."""
    edge = cutoff(series, test_days).scalar()
    return series.withColumn("part", F.when(F.col("ds") <= edge, "train").otherwise("test"))


def split(series: DataFrame, test_days: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) in time order; nothing is drawn at random."""
    parts = with_part(series, test_days)
    return parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")


def future_frame(series: DataFrame, cfg: SeriesConfig, scenarios: Sequence[str] = ("auto",),
                 start: date | None = None, horizon: int | None = None) -> DataFrame:
    """Every series and scenario on the days to forecast, with the scenario's regime flag."""
    horizon = horizon or cfg.horizon
    first = F.lit(start) if start is not None else F.date_add(F.max("ds"), 1)
    begin = series.groupBy("unique_id").agg(first.alias("_s"))
    days = begin.select("unique_id", F.explode(F.sequence("_s", F.date_add("_s", horizon - 1))).alias("ds"))
    flags = F.array(*[F.struct(F.lit(s).alias("scenario"), regime_flag(cfg, "ds", scenario_value(s))
                               .alias(cfg.regime_col)) for s in scenarios])
    return days.select("unique_id", "ds", F.explode(flags).alias("f")).select(
        "f.scenario", "unique_id", "ds", f"f.{cfg.regime_col}")


def wide_series(long: DataFrame, value: str, cfg: SeriesConfig, index: Sequence[str] = ("ds",)) -> DataFrame:
    """One column per target."""
    return long.groupBy(*index).pivot("unique_id", list(cfg.targets)).agg(F.first(value, ignorenulls=True))
