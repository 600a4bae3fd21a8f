from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfline.config import LagAgg, SeriesConfig
from shelfline.forecast import series as S
from shelfline.forecast.calendar import DATE_FEATURES, add_calendar
from shelfline.forecast.features import feature_matrix, feature_names, lag_columns, prefixed, week_names
from shelfline.forecast.profile import PROFILE_COLUMNS, build_profile

CFG = SeriesConfig(regime_start=date(2020, 1, 3), regime_end=date(2020, 1, 4))
START = date(2018, 1, 1)


def frame(spark, values, uid="a", start=START):
    rows = [(uid, start + timedelta(n), None if v is None else float(v)) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double")


def long(spark, days=900, ids=("a", "b"), seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k, uid in enumerate(ids):
        y = 100 * (k + 1) + 20 * np.sin(np.arange(days) * 2 * np.pi / 365.25) + rng.normal(0, 3, days)
        out += [(uid, START + timedelta(n), float(v)) for n, v in enumerate(y)]
    return spark.createDataFrame(out, "unique_id string, ds date, y double").select("*", S.regime_flag(CFG).alias("is_covid"))


def test_gaps_inside_at_the_tail_and_at_the_head(spark):
    df = frame(spark, [None, None, 1, None, None, 4, None, 5, None, None])
    got = [r.y for r in S.fill_gaps(df).orderBy("ds").collect()]
    assert got == pd.Series([np.nan, np.nan, 1, np.nan, np.nan, 4, np.nan, 5, np.nan, np.nan]).interpolate(
        method="linear").replace(np.nan, None).tolist()


def test_calendar_is_filled_per_series(spark):
    df = frame(spark, [1, 2, 3]).where(F.dayofmonth("ds") != 2).unionByName(frame(spark, [9], "b", date(2021, 5, 5)))
    full = S.fill_calendar(df)
    assert full.count() == 4 and full.where("y IS NULL").first().ds == date(2018, 1, 2)


def test_regime_flag_and_scenarios(spark):
    df = spark.createDataFrame([(date(2020, 1, d),) for d in range(2, 6)], "ds date")
    assert [r[0] for r in df.select(S.regime_flag(CFG)).collect()] == [0, 1, 1, 0]
    assert [r[0] for r in df.select(S.regime_flag(CFG, "ds", 1)).collect()] == [1] * 4
    with pytest.raises(ValueError):
        S.scenario_value("other")
    with pytest.raises(ValueError):
        S.regime_flag(CFG, "ds", 2)


def test_split_is_by_time(spark):
    train, test = S.split(long(spark, 30), 10)
    assert train.count() == 40 and test.count() == 20
    assert train.agg(F.max("ds")).first()[0] < test.agg(F.min("ds")).first()[0]


def test_future_follows_the_history(spark):
    f = S.future_frame(long(spark, 30), CFG, S.SCENARIOS, horizon=5)
    assert f.count() == 3 * 2 * 5 and f.agg(F.min("ds")).first()[0] == START + timedelta(30)
    fixed = S.future_frame(long(spark, 30), CFG, ["covid"], start=date(2023, 1, 1), horizon=2)
    assert {(r.ds, r.is_covid) for r in fixed.collect()} == {(date(2023, 1, 1), 1), (date(2023, 1, 2), 1)}


def test_lags_and_rolling_equal_pandas(spark):
    cfg = replace(CFG, lags=(1, 7), rolling=(LagAgg(7, 7, "mean"), LagAgg(2, 5, "max"), LagAgg(30, 30, "min")))
    df = long(spark, 120)
    got = df.select("*", *lag_columns(cfg)).toPandas().sort_values(["unique_id", "ds"])
    for _, part in got.groupby("unique_id"):
        y = part["y"]
        assert np.allclose(part["lag7"], y.shift(7), equal_nan=True)
        assert np.allclose(part["rolling_mean_lag7_window7"], y.shift(7).rolling(7, min_periods=1).mean(), equal_nan=True)
        assert np.allclose(part["rolling_max_lag2_window5"], y.shift(2).rolling(5, min_periods=1).max(), equal_nan=True)
        assert np.allclose(part["rolling_min_lag30_window30"], y.shift(30).rolling(30, min_periods=1).min(), equal_nan=True)


def test_feature_matrix_has_118_features_and_whole_lags(spark):
    df = long(spark, 500)
    matrix = feature_matrix(df, build_profile(df, CFG), CFG)
    names = feature_names(CFG)
    assert len(names) == 118 and len(prefixed(names, "woy_")) == 95 and len(week_names(CFG)) == 95
    assert matrix.columns == ["unique_id", "ds", "y", *names]
    assert matrix.count() == 2 * (500 - 365)
    assert matrix.na.drop().count() == matrix.count()


def test_own_date_features(spark):
    df = long(spark, 400)
    own = {**DATE_FEATURES, "is_month_start": lambda ds: (F.dayofmonth(ds) == 1).cast("int")}
    assert "is_month_start" in add_calendar(df, own).columns
    matrix = feature_matrix(df, build_profile(df, CFG), CFG, own)
    assert matrix.agg(F.sum("is_month_start")).first()[0] > 0


def test_profile_shape_and_bounds(spark):
    p = build_profile(long(spark), CFG)
    assert len(PROFILE_COLUMNS) == 33
    rows = p.toPandas()
    assert len(rows) == 106 and rows.groupby("unique_id")["woy_week"].nunique().eq(53).all()
    assert not rows.isna().any().any()
    assert rows["woy_recent_to_all_ratio"].between(0.5, 2.5).all() and rows["woy_same_week_growth"].between(0.8, 1.35).all()
    assert rows["woy_peak_proximity"].between(0, 1).all()
    assert (rows.groupby("unique_id")["woy_is_peak_candidate_week"].sum() == 6).all()


def test_week_seen_once_has_no_spread_and_unseen_week_takes_the_mean(spark):
    p = build_profile(frame(spark, [10, 20, 30, 40, 50, 60, 70, 80]), CFG).toPandas().set_index("woy_week")
    assert p.loc[2, "woy_profile_std"] == 0 and p.loc[2, "woy_profile_count"] == 1
    assert p.loc[30, "woy_profile_mean"] == 45 and p.loc[30, "woy_profile_count"] == 0
    assert p.loc[30, "woy_last_observed_year"] == 2018 and p.loc[30, "woy_same_week_growth"] == 1
    assert p.loc[30, "woy_profile_rank_pct"] == pytest.approx((2 + 52) / 2 / 53)  # 51 equal weeks share a rank


def test_profile_sees_its_reference_only(spark):
    df = long(spark, 800)
    train, _ = S.split(df, 100)
    changed = df.withColumn("y", F.when(F.col("ds") > START + timedelta(700), F.col("y") * 9).otherwise(F.col("y")))
    again, _ = S.split(changed, 100)
    key = ["unique_id", "woy_week"]
    a, b = (build_profile(x, CFG).toPandas().sort_values(key).reset_index(drop=True) for x in (train, again))
    pd.testing.assert_frame_equal(a, b)
