from datetime import date, timedelta

from pyspark.sql import functions as F

from shelfline import config as C
from shelfline.forecast.calendar import event_day
from shelfline.functions import (bucket_right_closed, clip, day_of_week, half_even, iso_week, iso_year, label_map,
                                 month_start, percent, safe_ratio, sum0, week_distance)


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_ratio_of_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None)], "a double, b double")
    assert one(df, safe_ratio(F.col("a"), F.col("b"))) == [0.5, None, None, None]
    assert one(df, safe_ratio(F.col("a"), F.col("b"), 1.0)) == [0.5, 1.0, 1.0, 1.0]
    assert one(df, percent(F.col("a"), F.col("b")))[0] == 50.0


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2)], "k string, x int")
    assert {r.k: r.s for r in df.groupBy("k").agg(sum0("x").alias("s")).collect()} == {"a": 0, "b": 2}


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (9.0,), (None,)], "x double")
    assert one(df, clip(F.col("x"), 0.0, 1.0)) == [0.0, 0.5, 1.0, None]
    assert one(df, clip(F.col("x"), high=1.0)) == [-1.0, 0.5, 1.0, None]


def test_aging_edges(spark):
    values = [-1.0, 0.0, 30.0, 30.5, 60.0, 60.1, 90.0, 91.0, 180.0, 181.0, 9e9, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    a, b, c, d, e = C.AGING_LABELS
    assert one(df, bucket_right_closed(F.col("x"), C.AGING_EDGES, C.AGING_LABELS)) == [
        None, a, a, b, b, c, c, d, d, e, e, None]


def test_iso_calendar_over_many_years(spark):
    days = [date(1998, 12, 20) + timedelta(n) for n in range(0, 9000)]
    df = spark.createDataFrame([(d,) for d in days], "ds date")
    rows = df.select(iso_week(F.col("ds")).alias("w"), iso_year(F.col("ds")).alias("y"),
                     day_of_week(F.col("ds")).alias("d"), event_day(F.col("ds")).alias("e"), month_start(F.col("ds")).alias("m")).collect()
    for day, row in zip(days, rows):
        y, w, d = day.isocalendar()
        assert (row.y, row.w, row.d) == (y, w, d - 1)
        assert row.m == day.replace(day=1)
    assert sum(r.e for day, r in zip(days, rows) if day.year == 2001) == 24


def test_week_distance_wraps(spark):
    df = spark.createDataFrame([(1, 53), (10, 12), (27, 1)], "a int, b int")
    assert one(df, week_distance(F.col("a"), F.col("b"))) == [1.0, 2.0, 26.0]


def test_half_even_and_labels(spark):
    df = spark.createDataFrame([(0.125, "a"), (0.375, "z")], "x double, k string")
    assert one(df, half_even(F.col("x"), 2)) == [0.12, 0.38]
    assert one(df, label_map(F.col("k"), {"a": "A"})) == ["A", None]
