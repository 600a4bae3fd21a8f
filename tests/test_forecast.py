import itertools
from datetime import date, timedelta
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shelfline.config import AttributionConfig, BlendConfig, SeriesConfig, TrendBreakConfig, quick_ensemble
from shelfline.forecast import blend as B, series as S, trend_break as T
from shelfline.forecast.attribution import attribute_rows, top_features
from shelfline.forecast.ensemble import (build_estimators, fit_ensemble, future_features, memory, recursive_forecast,
                                         step_size)
from shelfline.forecast.features import feature_matrix, feature_names
from shelfline.forecast.metrics import forecast_metrics, model_errors, nested_evaluation
from shelfline.forecast.profile import build_profile
from shelfline.forecast.store import ModelStore, series_fingerprint
from shelfline.forecast.submission import export, export_scenarios, to_submission
from shelfline.forecast.trees import TreeArrays, contributions, tree_arrays
from shelfline.session import work_path

CFG = SeriesConfig(regime_start=date(2019, 1, 1), regime_end=date(2019, 6, 30))
START = date(2018, 1, 1)
MODELS = ["m1", "m2", "m3"]


# --- blending ------------------------------------------------------------------

@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(3)
    out = []
    for uid in ("Revenue", "COGS"):
        y = rng.gamma(5, 20, 60)
        preds = np.column_stack([y + rng.normal(5, 10, 60), y * 1.2, rng.gamma(5, 20, 60)])
        out += [(uid, START + timedelta(n), float(y[n]), *map(float, preds[n])) for n in range(60)]
    return spark.createDataFrame(out, "unique_id string, ds date, y double, m1 double, m2 double, m3 double")


def test_weight_candidates():
    w = B.weight_candidates(4, BlendConfig())
    assert w.shape == (5005, 4) and (w >= 0).all() and np.allclose(w.sum(axis=1), 1)
    assert np.array_equal(w[:4], np.eye(4)) and np.allclose(w[4], 0.25)
    assert np.array_equal(w, B.weight_candidates(4, BlendConfig()))
    grid = B.weight_grid(4, 4)
    assert len(grid) == 35 and np.allclose(grid.sum(axis=1), 1) and len(np.unique(grid, axis=0)) == 35


def test_blend_is_the_first_best_candidate(judged):
    weights = B.weight_candidates(3, BlendConfig(random_draws=700))
    found = {r.unique_id: r for r in B.learn_blend(judged, MODELS, weights, BlendConfig()).collect()}
    for uid, part in judged.toPandas().groupby("unique_id"):
        errors = []
        for w in weights:
            raw = part[MODELS].to_numpy() @ w
            errors.append(np.abs(part["y"] - np.maximum(raw + np.median(part["y"] - raw), 0)).mean())
        assert found[uid].candidate == int(np.argmin(np.round(errors, 6)))
        assert found[uid].validation_mae == pytest.approx(min(errors))
        assert found[uid].validation_mae <= min(errors[:3])


def test_all_candidates_are_scored(judged):
    cfg = BlendConfig(random_draws=600)
    weights = B.weight_candidates(3, cfg)
    scores = B.score_candidates(judged, MODELS, weights, cfg).toPandas()
    best = {r.unique_id: r for r in B.learn_blend(judged, MODELS, weights, cfg).collect()}
    assert len(scores) == 2 * len(weights)
    for uid, part in scores.groupby("unique_id"):
        assert part["validation_mae"].min() == pytest.approx(best[uid].validation_mae)


def test_apply_blend_gives_the_learned_error(judged):
    cfg = BlendConfig(random_draws=50)
    found = B.learn_blend(judged, MODELS, B.weight_candidates(3, cfg), cfg)
    mae = {r.unique_id: r.mae for r in forecast_metrics(B.apply_blend(judged, found, MODELS, cfg), cfg.output).collect()}
    for r in found.collect():
        assert mae[r.unique_id] == pytest.approx(r.validation_mae)
    assert mae["Average"] == pytest.approx((mae["Revenue"] + mae["COGS"]) / 2)


def test_metrics_against_numpy(judged, spark):
    row = {r.unique_id: r for r in forecast_metrics(judged, "m1").collect()}["COGS"]
    part = judged.toPandas().query("unique_id == 'COGS'")
    err = part["y"] - part["m1"]
    assert row.rmse == pytest.approx(np.sqrt((err ** 2).mean()))
    assert row.r2 == pytest.approx(1 - (err ** 2).sum() / ((part["y"] - part["y"].mean()) ** 2).sum())
    assert row.mape_pct == pytest.approx((err / part["y"]).abs().mean() * 100)
    zero = spark.createDataFrame([("a", START, 0.0, 1.0), ("a", START, 2.0, 1.0)], "unique_id string, ds date, y double, p double")
    guarded = forecast_metrics(zero, "p", with_average=False).first()
    assert guarded.guarded_share == 0.5 and guarded.mape_pct == pytest.approx((1e8 + 0.5) / 2 * 100)
    assert model_errors(judged, MODELS).count() == 6


def test_nested_halves_are_in_time_order(judged):
    first, second = nested_evaluation(judged)
    assert first.count() == second.count() == 60
    assert first.agg(F.max("ds")).first()[0] < second.agg(F.min("ds")).first()[0]


def test_scenario_mix_ends_are_the_scenarios(spark):
    df = spark.createDataFrame([("a", "u", START, 1.0), ("b", "u", START, 3.0), ("c", "u", START, 9.0)],
                               "scenario string, unique_id string, ds date, x double")
    at = lambda p: B.mix_scenarios(df, "a", "b", p, ["x"]).first().x
    assert (at(0), at(1), at(0.25), at(7), at(-1)) == (1.0, 3.0, 1.5, 3.0, 1.0)


def test_submission_export(spark, tmp_path):
    rows = [(s, u, START + timedelta(n), v + n) for s in ("a", "b") for u, v in (("Revenue", 10.125), ("COGS", -3.0)) for n in range(3)]
    df = spark.createDataFrame(rows, "scenario string, unique_id string, ds date, p double")
    wide = to_submission(df.where("scenario = 'a'"), "p", CFG)
    first = wide.orderBy("Date").first()
    assert wide.columns == ["Date", "Revenue", "COGS"] and (first.Revenue, first.COGS) == (10.12, 0.0)
    from dataclasses import replace
    short = replace(CFG, horizon=3)
    path = export(wide, str(tmp_path / "one"), short, START)
    text = spark.read.text(path).collect()
    assert [r.value for r in text][:2] == ["Date,Revenue,COGS", "2018-01-01,10.12,0.0"] and len(text) == 4
    with pytest.raises(ValueError):
        export(wide, str(tmp_path / "two"), CFG)
    with pytest.raises(ValueError, match="different days"):
        export(wide.withColumn("Date", F.expr("if(Date = '2018-01-03', date'2018-01-04', Date)")), str(tmp_path / "gap"), short)
    both = to_submission(df, "p", CFG, by_scenario=True)
    back = spark.read.schema("Date date, Revenue double, COGS double, scenario string").option("header", True).csv(
        export_scenarios(both, str(tmp_path / "all")))
    assert sorted(back.select("scenario", "Date", "Revenue", "COGS").collect()) == sorted(both.collect())


# --- trees -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, x[:, 2], -x[:, 2]) + rng.normal(0, 0.1, 400)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, unique_id="u", ds=[START + timedelta(n) for n in range(400)])
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(pdf))
    model = GBTRegressor(labelCol="y", maxIter=4, maxDepth=4, subsamplingRate=0.8, seed=1).fit(df)
    return pdf, df, model, tree_arrays(model)


def test_arrays_predict_like_the_model(toy):
    pdf, df, model, trees = toy
    want = model.transform(df).orderBy("ds").toPandas()["prediction"]
    assert np.allclose(trees.predict(pdf[list("abcd")].to_numpy()), want)


def test_contributions_add_up(toy, spark):
    pdf, df, _, trees = toy
    out = attribute_rows(df.repartition(3), trees, list("abcd")).toPandas()
    total = out["contributions"].map(sum) + out["base"]
    assert len(out) == 400 and np.allclose(total, out["prediction"], atol=1e-6)
    top = top_features(df, "u", trees, list("abcd"), AttributionConfig(sample_rows=100, top=2))
    rows = top.collect()
    assert [r.feature for r in rows] == ["a", "c"] and rows[0].sampled_rows == 100


def _expected(trees: TreeArrays, row, known, k, node=0):
    """Tree output when only the features in ``known`` are known."""
    left, right = trees.left[k, node], trees.right[k, node]
    if left == node:
        return trees.value[k, node]
    f = trees.feature[k, node]
    if f in known:
        return _expected(trees, row, known, k, left if row[f] <= trees.threshold[k, node] else right)
    share = trees.cover[k, left] / trees.cover[k, node]
    return share * _expected(trees, row, known, k, left) + (1 - share) * _expected(trees, row, known, k, right)


def test_contributions_equal_brute_force(toy):
    pdf, _, _, trees = toy
    sample = pdf[list("abcd")].to_numpy()[:5]
    phi, base = contributions(trees, sample)
    pay = lambda row, known: sum(w * _expected(trees, row, known, k) for k, w in enumerate(trees.weight))
    assert base == pytest.approx(pay(sample[0], set()))
    for r, row in enumerate(sample):
        for i in range(4):
            others = [j for j in range(4) if j != i]
            total = 0.0
            for size in range(4):
                for known in itertools.combinations(others, size):
                    weight = factorial(size) * factorial(3 - size) / factorial(4)
                    total += weight * (pay(row, {*known, i}) - pay(row, set(known)))
            assert phi[r, i] == pytest.approx(total)


# --- ensemble ----------------------------------------------------------------------

def daily(spark, days, scale=1.0):
    t = np.arange(days)
    out = []
    for k, uid in enumerate(("Revenue", "COGS", "Third")):
        y = (100 * (k + 1) + 30 * np.sin(t * 2 * np.pi / 7) + 0.05 * t) * scale
        out += [(uid, START + timedelta(int(n)), float(v)) for n, v in zip(t, y)]
    return spark.createDataFrame(out, "unique_id string, ds date, y double").select("*", S.regime_flag(CFG).alias("is_covid"))


@pytest.fixture(scope="module")
def trained(spark):
    history = daily(spark, 500).persist()
    profile = build_profile(history, CFG).persist()
    matrix = feature_matrix(history, profile, CFG)
    params = dict(list(quick_ensemble(rounds=3, depth=3).items())[:2])
    return history, profile, fit_ensemble(matrix, CFG, build_estimators(params))


def test_recursion_by_block_equals_day_by_day(trained):
    history, profile, ensemble = trained
    assert (step_size(CFG), memory(CFG)) == (7, 365)
    ahead = future_features(S.future_frame(history, CFG, ("non_covid", "covid"), horizon=28), profile, CFG).persist()
    block, single = (recursive_forecast(ensemble, history, ahead, CFG, step).toPandas()
                     .sort_values(["scenario", "unique_id", "ds"]).reset_index(drop=True) for step in (7, 1))
    pd.testing.assert_frame_equal(block, single)
    assert len(block) == 2 * 3 * 28 and not block.isna().any().any()
    for _, part in block.groupby(["scenario", "unique_id"]):
        assert list(part["ds"]) == [START + timedelta(500 + n) for n in range(28)]
    with pytest.raises(ValueError):
        recursive_forecast(ensemble, history, ahead, CFG, 8)


def test_own_date_features_reach_the_forecast(trained):
    history, profile, _ = trained
    own = {"odd_day": lambda d: F.dayofmonth(d) % 2, "week_day": F.dayofweek}
    params = dict(list(quick_ensemble(rounds=2, depth=3).items())[:1])
    ensemble = fit_ensemble(feature_matrix(history, profile, CFG, own), CFG, build_estimators(params), own)
    ahead = future_features(S.future_frame(history, CFG, horizon=9), profile, CFG, own)
    assert {"odd_day", "week_day"} <= set(ahead.columns) and "month" not in ahead.columns
    predicted = recursive_forecast(ensemble, history, ahead, CFG, features=own).toPandas()
    assert len(predicted) == 3 * 9 and not predicted.isna().any().any()


def test_any_regression_is_a_member(spark, trained):
    """Another estimator class predicts, feeds on its own predictions and is stored like the trees."""
    from pyspark.ml.regression import LinearRegression

    history, profile, _ = trained
    line = LinearRegression(featuresCol="features", labelCol="y", regParam=1.0, solver="normal")
    ensemble = fit_ensemble(feature_matrix(history, profile, CFG), CFG, {"line": line, **build_estimators(dict(list(quick_ensemble(2, 2).items())[:1]))})
    assert ensemble.names == ["line", "gbt_base"]
    ahead = future_features(S.future_frame(history, CFG, horizon=9), profile, CFG)
    predicted = recursive_forecast(ensemble, history, ahead, CFG).toPandas()
    assert len(predicted) == 3 * 9 and not predicted.isna().any().any() and (predicted["line"] != predicted["gbt_base"]).any()


def test_models_are_kept_and_read_back(spark, trained, tmp_path):
    history, profile, _ = trained
    matrix = feature_matrix(history, profile, CFG)
    params = dict(list(quick_ensemble(2, 2).items())[:2])
    store = ModelStore(spark, str(tmp_path / "models"))
    first = fit_ensemble(matrix, CFG, build_estimators(params), store=store)
    folders = {p.name for p in (tmp_path / "models").iterdir()}
    assert len(folders) == 2

    class Refuses:
        def __getattr__(self, name):
            raise AssertionError("trained again")

    names = feature_names(CFG)
    again = store.fit(build_estimators(params), names, series_fingerprint(matrix.select("unique_id", "ds", "y")), Refuses)
    assert [m.toDebugString for m in again.values()] == [m.toDebugString for m in first.models.values()]
    assert {p.name for p in (tmp_path / "models").iterdir()} == folders
    # Another series, another setting or other features are other models.
    e, known = build_estimators(params)["gbt_base"], series_fingerprint(matrix.select("unique_id", "ds", "y"))
    places = {store.path(e, names, known), store.path(e.copy().setMaxIter(3), names, known), store.path(e, names[1:], known),
              store.path(e, names, series_fingerprint(matrix.select("unique_id", "ds", (F.col("y") + 0.01).alias("y"))))}
    assert len(places) == 4 and store.path(build_estimators(params)["gbt_base"], names, known) in places


def test_a_stopped_fit_goes_on_with_the_missing_member(spark, trained, tmp_path):
    history, profile, _ = trained
    matrix = feature_matrix(history, profile, CFG)
    params = dict(list(quick_ensemble(2, 2).items())[:2])
    store = ModelStore(spark, str(tmp_path / "models"))
    one = dict(list(params.items())[:1])
    fit_ensemble(matrix, CFG, build_estimators(one), store=store)
    (held,) = (tmp_path / "models").iterdir()
    stamp = held.stat().st_mtime_ns
    assert fit_ensemble(matrix, CFG, build_estimators(params), store=store).names == list(params)
    assert held.stat().st_mtime_ns == stamp and len(list((tmp_path / "models").iterdir())) == 2


def test_a_fit_reads_no_model_that_it_trained(spark, trained, tmp_path, monkeypatch):
    history, profile, _ = trained
    matrix = feature_matrix(history, profile, CFG)
    params = dict(list(quick_ensemble(2, 2).items())[:2])
    store, read = ModelStore(spark, str(tmp_path / "models")), []
    fit_ensemble(matrix, CFG, build_estimators(dict(list(params.items())[:1])), store=store)
    load = ModelStore.load
    monkeypatch.setattr(ModelStore, "load", lambda self, path: read.append(path) or load(self, path))
    assert fit_ensemble(matrix, CFG, build_estimators(params), store=store).names == list(params) and len(read) == 1


def test_a_member_sends_its_model_once(trained, monkeypatch):
    """The horizon's blocks share one call of `transform`, which broadcasts all trees."""
    history, profile, ensemble = trained
    kind = type(next(iter(ensemble.models.values())))
    calls, transform = [], kind.transform
    monkeypatch.setattr(kind, "transform", lambda self, *given: calls.append(self.uid) or transform(self, *given))
    ahead = future_features(S.future_frame(history, CFG, ("non_covid",), horizon=22), profile, CFG)
    assert recursive_forecast(ensemble, history, ahead, CFG).count() == 3 * 22
    assert sorted(calls) == sorted(m.uid for m in ensemble.models.values())


def test_a_block_shuffles_once(spark, trained):
    """Days and state are gathered by the keys that the prediction is grouped by: two jobs a block and member, with no broadcast."""
    history, profile, ensemble = trained
    ahead = future_features(S.future_frame(history, CFG, ("non_covid",), horizon=10 * 7), profile, CFG).persist()
    ahead.count()
    jobs = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    predicted = recursive_forecast(ensemble, history, ahead, CFG)
    assert jobs() - before <= len(ensemble.names) * 10 * 2 + 16
    assert predicted.count() == 3 * 70


def test_recursion_on_a_series_shorter_than_a_year(spark, trained):
    """Lags before the first day are unknown, not an error; the state holds all series and scenarios at once."""
    history, profile, ensemble = trained
    short = history.where(F.col("ds") >= F.lit(START + timedelta(440)))
    ahead = future_features(S.future_frame(short, CFG, ("non_covid", "covid"), horizon=15), profile, CFG)
    predicted = recursive_forecast(ensemble, short, ahead, CFG).toPandas()
    assert len(predicted) == 2 * 3 * 15 and not predicted.isna().any().any()


def test_candidate_blocks_spread_two_series(judged):
    cfg = BlendConfig()
    scored = B.score_candidates(judged, MODELS, B.weight_candidates(3, cfg), cfg)
    assert scored.select(F.spark_partition_id()).distinct().count() > 2
    assert {r.unique_id: r["count"] for r in scored.groupBy("unique_id").count().collect()} == {"Revenue": 5004, "COGS": 5004}


def test_one_step_equals_the_feature_matrix(spark, trained):
    """The first block's features and predictions are those of the batch feature builder."""
    history, profile, ensemble = trained
    ahead = future_features(S.future_frame(history, CFG, horizon=7), profile, CFG)
    predicted = recursive_forecast(ensemble, history, ahead, CFG).toPandas().sort_values(["unique_id", "ds"])
    rows = feature_matrix(daily(spark, 507), profile, CFG).where(F.col("ds") >= F.lit(START + timedelta(500)))
    rows = rows.toPandas().sort_values(["unique_id", "ds"])
    for name, trees in ensemble.trees.items():
        assert np.allclose(trees.predict(rows[feature_names(CFG)].to_numpy(float)), predicted[name])


def test_only_the_past_is_used(spark, trained):
    history, profile, ensemble = trained
    train, test = S.split(history, 30)
    days = lambda df: future_features(df.select(F.lit("auto").alias("scenario"), "unique_id", "ds", "is_covid"), profile, CFG)
    a = recursive_forecast(ensemble, train, days(test), CFG).toPandas()
    b = recursive_forecast(ensemble, train, days(test.withColumn("y", F.col("y") * 100)), CFG).toPandas()
    key = ["unique_id", "ds"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))


# --- trend break ---------------------------------------------------------------------

def test_trend_break_finds_a_planted_bend(spark):
    cfg = TrendBreakConfig(break_date=START + timedelta(700), yearly_order=2, weekly_order=2, reg_param=1e-9)
    out = []
    for uid, after in (("Revenue", 0.6), ("COGS", -0.4)):
        for n in range(1400):
            years = (n - 700) / 365.25
            wave = 0.1 * np.sin(2 * np.pi * n / 7)
            out.append((uid, START + timedelta(n), float(np.exp(5 + 0.2 * years + after * max(years, 0) + wave)), 0))
    history = spark.createDataFrame(out, "unique_id string, ds date, y double, is_covid int")
    fitted = T.fit(history, CFG, cfg)
    slopes = {r.unique_id: r.coefficients[1:3] for r in fitted.collect()}
    assert np.allclose(slopes["Revenue"], [0.2, 0.6], atol=0.02) and np.allclose(slopes["COGS"], [0.2, -0.4], atol=0.02)
    future = S.future_frame(history, CFG, S.SCENARIOS, horizon=20)
    mixed = T.with_mix(T.predict(fitted, future, CFG, cfg), 0.5, cfg, S.SCENARIOS).toPandas()
    assert len(mixed) == 4 * 2 * 20 and set(mixed["scenario"]) == {*S.SCENARIOS, "blend"}
    assert (mixed["yhat_lower"] <= mixed[cfg.output] + 1e-9).all() and (mixed[cfg.output] <= mixed["yhat_upper"] + 1e-9).all()


def test_history_meets_forecast(space):
    last = space.series.agg(F.max("ds")).first()[0]
    first = S.future_frame(space.series, space.cfg).agg(F.min("ds")).first()[0]
    assert first == last + timedelta(1)


def test_work_paths_are_new(spark):
    assert work_path(spark, "a") != work_path(spark, "a")


def test_registered_queries_train_the_published_ensemble(registered):
    from shelfline.config import FULL_ENSEMBLE

    assert registered.ensemble == FULL_ENSEMBLE
