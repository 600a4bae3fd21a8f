"""What each ISO week of the year has meant for a series: level, trend and peak timing.

Built from three small layers: days grouped by week (A), years grouped by week
(B, with windows inside a series), and one row per series (D). They meet on the
grid of 53 weeks per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.config import WEEKS, SeriesConfig
from shelfline.functions import clip, iso_week, iso_year, safe_ratio, sum0, week_distance
from shelfline.operators.distribution import rank_pct_within

# Scores and sums are rounded before they are ranked, so ties do not hang on the
# order of floating-point additions.
RANK_DIGITS = 10
TOTAL_DIGITS = 6

LAYERS: dict[str, tuple[str, ...]] = {
    "base": ("woy_target_mean", "woy_profile_mean", "woy_profile_median", "woy_profile_std", "woy_profile_count",
             "woy_profile_ratio", "woy_profile_rank_pct"),
    "recent": ("woy_recent_mean", "woy_recent_median", "woy_recent_max", "woy_recent_count", "woy_last_year_mean",
               "woy_last_observed_year", "woy_recent_to_all_ratio", "woy_last_to_all_ratio"),
    "growth": ("woy_same_week_growth", "woy_projected_next_mean", "woy_projected_to_all_ratio"),
    "peak": ("woy_peak_frequency", "woy_top3_frequency", "woy_peak_score", "woy_mean_rank_desc", "woy_peak_rank_desc",
             "woy_is_top_mean_week", "woy_is_peak_candidate_week", "woy_reference_peak_week", "woy_peak_distance",
             "woy_peak_proximity"),
    "annual": ("woy_annual_peak_growth", "woy_last_peak_year", "woy_last_annual_peak_total",
               "woy_expected_next_annual_peak", "woy_expected_peak_to_current"),
}
PROFILE_COLUMNS: tuple[str, ...] = tuple(c for cols in LAYERS.values() for c in cols)

def _by_id():
    return Window.partitionBy("unique_id")


def _years_by_week(days: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """Per series, ISO year and week: mean, total, growth over the previous observed year, rank in the year."""
    weeks = days.groupBy("unique_id", "iso_year", "woy_week").agg(
        F.avg("y").alias("mean"), F.round(sum0("y"), TOTAL_DIGITS).alias("total"))
    before = Window.partitionBy("unique_id", "woy_week").orderBy("iso_year")
    in_year = Window.partitionBy("unique_id", "iso_year").orderBy(F.desc("total"))
    return weeks.select(
        "*", safe_ratio(F.col("mean"), F.lag("mean").over(before)).alias("growth"),
        F.rank().over(in_year).alias("place"),
        (F.col("iso_year") > F.max("iso_year").over(_by_id()) - cfg.recent_years).alias("is_recent"))


def _by_week(weeks: DataFrame) -> DataFrame:
    recent = lambda c: F.when(F.col("is_recent"), F.col(c))
    return weeks.groupBy("unique_id", "woy_week").agg(
        F.avg(recent("mean")).alias("recent_mean"), F.median(recent("mean")).alias("recent_median"),
        F.max(recent("mean")).alias("recent_max"), F.count(recent("mean")).alias("recent_count"),
        F.max_by("mean", "iso_year").alias("last_mean"), F.max("iso_year").alias("last_year"),
        F.median(recent("growth")).alias("growth"),
        F.avg(F.when(F.col("place") == 1, 1.0).otherwise(0.0)).alias("woy_peak_frequency"),
        F.avg(F.when(F.col("place") <= 3, 1.0).otherwise(0.0)).alias("woy_top3_frequency"))


def _by_series(weeks: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """Best week of each year, its growth over the years and the latest one."""
    best = Window.partitionBy("unique_id", "iso_year").orderBy(F.desc("total"), "woy_week")
    years = Window.partitionBy("unique_id").orderBy("iso_year")
    peaks = (weeks.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
             .select("unique_id", "iso_year", "total", "is_recent",
                     safe_ratio(F.col("total"), F.lag("total").over(years)).alias("growth")))
    per_series = peaks.groupBy("unique_id").agg(
        F.median(F.when(F.col("is_recent"), F.col("growth"))).alias("growth"),
        F.max("iso_year").alias("woy_last_peak_year"), F.max_by("total", "iso_year").alias("woy_last_annual_peak_total"))
    growth = F.coalesce(clip(F.col("growth"), *cfg.growth_clip), F.lit(1.0))
    top = F.col("woy_last_annual_peak_total")
    return per_series.select(
        "unique_id", growth.alias("woy_annual_peak_growth"), "woy_last_peak_year", top,
        (top * growth).alias("woy_expected_next_annual_peak"),
        safe_ratio(top * growth, top, 1.0).alias("woy_expected_peak_to_current"))


def _bounded_ratio(top: Column, bottom: Column, cfg: SeriesConfig) -> Column:
    return clip(safe_ratio(top, bottom, 1.0), *cfg.ratio_clip)


def build_profile(history: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """53 rows per series. Only ``history`` is looked at: pass the training part when validating."""
    days = history.select("unique_id", "y", iso_week(F.col("ds")).alias("woy_week"),
                          iso_year(F.col("ds")).alias("iso_year"))
    by_day = days.groupBy("unique_id", "woy_week").agg(
        F.avg("y").alias("mean"), F.median("y").alias("median"), F.stddev_samp("y").alias("std"),
        F.count("y").alias("woy_profile_count"))
    whole = days.groupBy("unique_id").agg(F.avg("y").alias("woy_target_mean"))
    newest = days.agg(F.max("iso_year").alias("_newest"))
    weeks = _years_by_week(days, cfg)
    grid = whole.select("*", F.explode(F.sequence(F.lit(1), F.lit(WEEKS))).alias("woy_week"))
    on_week = ["unique_id", "woy_week"]
    joined = (grid.join(by_day, on_week, "left").join(_by_week(weeks).withColumnRenamed("growth", "week_growth"), on_week, "left")
              .join(_by_series(weeks, cfg), "unique_id", "left").crossJoin(F.broadcast(newest)))

    mean = F.coalesce("mean", "woy_target_mean")
    last = F.coalesce(F.col("last_mean"), mean)
    growth = F.coalesce(clip(F.col("week_growth"), *cfg.growth_clip), F.lit(1.0))
    levels = joined.select(
        "*", mean.alias("woy_profile_mean"), F.coalesce("median", "woy_target_mean").alias("woy_profile_median"),
        F.coalesce("std", F.lit(0.0)).alias("woy_profile_std"),
        safe_ratio(mean, F.col("woy_target_mean"), 1.0).alias("woy_profile_ratio"),
        F.coalesce(F.col("recent_mean"), mean).alias("woy_recent_mean"),
        F.coalesce(F.col("recent_median"), mean).alias("woy_recent_median"),
        F.coalesce(F.col("recent_max"), mean).alias("woy_recent_max"),
        F.coalesce("recent_count", F.lit(0)).alias("woy_recent_count"), last.alias("woy_last_year_mean"),
        F.coalesce("last_year", "_newest").alias("woy_last_observed_year"), growth.alias("woy_same_week_growth"),
        (last * growth).alias("woy_projected_next_mean"),
        _bounded_ratio(F.coalesce(F.col("recent_mean"), mean), mean, cfg).alias("woy_recent_to_all_ratio"),
        _bounded_ratio(last, mean, cfg).alias("woy_last_to_all_ratio"),
        _bounded_ratio(last * growth, mean, cfg).alias("woy_projected_to_all_ratio"),
        F.round(mean, RANK_DIGITS).alias("_mean"))
    levels = levels.withColumn("woy_profile_rank_pct", rank_pct_within("_mean", ["unique_id"]))
    levels = levels.na.fill(0, subset=["woy_profile_count"]).na.fill(
        0.0, subset=["woy_peak_frequency", "woy_top3_frequency"])
    return _with_peaks(levels, cfg).select("unique_id", "woy_week", *PROFILE_COLUMNS)


def _with_peaks(levels: DataFrame, cfg: SeriesConfig) -> DataFrame:
    rank_w, top3_w, peak_w = cfg.score_weights
    score = (F.lit(rank_w) * F.col("woy_profile_rank_pct") + F.lit(top3_w) * F.col("woy_top3_frequency")
             + F.lit(peak_w) * F.col("woy_peak_frequency"))
    scored = levels.withColumn("woy_peak_score", F.round(score, RANK_DIGITS))
    by_mean = _by_id().orderBy(F.desc("_mean"), "woy_week")
    by_score = _by_id().orderBy(F.desc("woy_peak_score"), "woy_week")
    by_both = _by_id().orderBy(F.desc("woy_peak_score"), F.desc("_mean"), "woy_week")
    ranked = scored.select(
        "*", F.row_number().over(by_mean).alias("woy_mean_rank_desc"),
        F.row_number().over(by_score).alias("woy_peak_rank_desc"),
        F.first("woy_week").over(by_both).alias("woy_reference_peak_week"))
    distance = week_distance(F.col("woy_week"), F.col("woy_reference_peak_week"), WEEKS)
    return ranked.select(
        "*", (F.col("woy_mean_rank_desc") <= cfg.top_weeks).cast("int").alias("woy_is_top_mean_week"),
        (F.col("woy_peak_rank_desc") <= cfg.top_weeks).cast("int").alias("woy_is_peak_candidate_week"),
        distance.alias("woy_peak_distance"),
        clip(F.lit(1.0) - distance / F.lit(WEEKS / 2.0), 0.0, 1.0).alias("woy_peak_proximity"))


def peak_preview(profile: DataFrame, cfg: SeriesConfig) -> DataFrame:
    """The weeks of each series that are most likely its peak."""
    return profile.where(F.col("woy_peak_rank_desc") <= cfg.top_weeks).select(
        "unique_id", "woy_week", "woy_profile_ratio", "woy_recent_to_all_ratio", "woy_same_week_growth",
        "woy_annual_peak_growth", "woy_peak_score")


def annual_peaks(history: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Best week of each ISO year by mean level, with its growth over the previous year."""
    weeks = history.groupBy("unique_id", iso_year(F.col("ds")).alias("iso_year"),
                            iso_week(F.col("ds")).alias("woy_week")).agg(F.avg("y").alias("weekly_mean"))
    best = Window.partitionBy("unique_id", "iso_year").orderBy(F.desc(F.round("weekly_mean", RANK_DIGITS - 4)), "woy_week")
    years = Window.partitionBy("unique_id").orderBy("iso_year")
    top = weeks.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")
    grown = top.withColumn("peak_yoy_growth", safe_ratio(F.col("weekly_mean"), F.lag("weekly_mean").over(years)))
    return grown.where(F.col("iso_year").between(first_year, last_year))
