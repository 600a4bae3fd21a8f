"""Series work by chunk equals the same work over whole series."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from shelfline.config import SeriesConfig
from shelfline.forecast import features, series as S

CFG = SeriesConfig(lags=(7, 14, 30), week_onehot=False)
START = date(2015, 3, 1)


@pytest.fixture(scope="module")
def gappy(spark):
    """Three series of unlike lengths, with missing days and missing values at the head, inside and at the tail."""
    rng = np.random.default_rng(4)
    rows = []
    for k, uid in enumerate(("a", "b", None)):
        for n in range(400 + 150 * k):
            if rng.random() < 0.9:
                hole = n < 20 or 100 <= n < 230 or n > 380 + 150 * k or rng.random() < 0.2
                rows.append((uid, START + timedelta(n), None if hole else float(rng.normal(100, 30)), k))
    rows += [("empty", START + timedelta(n), None, 0) for n in range(90)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, is_covid int").persist()


def whole_fill(df):
    """The fill in one window over each series."""
    line = Window.partitionBy("unique_id").orderBy("ds")
    back = line.rowsBetween(Window.unboundedPreceding, 0)
    ahead = line.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col("y").isNotNull(), F.struct("rn", "y"))
    df = df.withColumn("rn", F.row_number().over(line))
    df = df.select("*", F.last(here, True).over(back).alias("a"), F.first(here, True).over(ahead).alias("b"))
    line_value = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * ((F.col("rn") - F.col("a.rn")) / F.nullif(F.col("b.rn") - F.col("a.rn"), F.lit(0)))
    return df.select("unique_id", "ds", F.coalesce("y", line_value, "a.y").alias("y"), "is_covid")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("days", [1, 37, 4096])
def test_fill_by_chunk(gappy, monkeypatch, days):
    monkeypatch.setattr(S, "CHUNK_DAYS", days)
    assert rows_of(S.fill_gaps(gappy).select("unique_id", "ds", "y", "is_covid")) == rows_of(whole_fill(gappy))


@pytest.mark.parametrize("days, rows", [(37, 20), (200, 100), (4096, 4096)])
def test_lags_by_chunk(gappy, monkeypatch, days, rows):
    monkeypatch.setattr(S, "CHUNK_DAYS", days)
    monkeypatch.setattr(features, "CHUNK_ROWS", rows)
    known = gappy.where("unique_id is not null")
    names = ["unique_id", "ds", "y", *features.lag_names(CFG)]
    want = known.select("*", *features.lag_columns(CFG)).select(*names)
    assert rows_of(features.with_lags(known, CFG).select(*names)) == rows_of(want)


def test_no_window_holds_a_series(gappy):
    """Windows over rows are split by chunk; only the chunk totals are ordered a whole series at once."""
    for df in (S.fill_gaps(gappy), features.with_lags(gappy, CFG)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        windows = [line for line in plan if line.strip(" :+-").startswith("Window [")]
        over_rows = [w for w in windows if "_rows#" not in w and "_old#" not in w and "_new#" not in w and "_shift#" not in w]
        assert over_rows and all("_chunk#" in w or "_part#" in w for w in over_rows)
