"""The registered series queries. The test tables cover 1995 to 2001, hence the regime dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from shelfline.catalog import Query
from shelfline.config import ForecastConfig, SeriesConfig, TrendBreakConfig
from shelfline.forecast import baseline, series as S
from shelfline.forecast.attribution import top_features
from shelfline.forecast.blend import apply_blend, learn_blend, score_candidates, weight_candidates
from shelfline.forecast.calendar import DATE_FEATURES, add_calendar, harmonic_columns, onehot_columns
from shelfline.forecast.features import feature_matrix, feature_names
from shelfline.forecast.metrics import forecast_metrics, model_errors, nested_evaluation
from shelfline.forecast.profile import LAYERS, annual_peaks, build_profile, peak_preview
from shelfline.forecast.submission import export_scenarios, history_and_forecast, to_submission
from shelfline.forecast.workspace import Workspace, weights_as_columns
from shelfline.operators.keyed import seeded_sample
from shelfline.session import work_path
from shelfline.sources import RetailTables
from shelfline.sources.files import contract_facts, read_csv, write_csv
from shelfline.sources.schemas import SCHEMAS

TESTBED = SeriesConfig(regime_start=date(1999, 1, 1), regime_end=date(2000, 6, 30))
CONFIG = ForecastConfig(series=TESTBED, trend=TrendBreakConfig(break_date=date(1999, 1, 1)))
MIXES = weight_candidates(len(baseline.BASELINES), CONFIG.blend)
PRIMARY = "gbt_base"
SAMPLE_ROWS = 2000
_spaces: dict[tuple[str, str], Workspace] = {}


def workspace(t: RetailTables) -> Workspace:
    """One workspace per session and data folder, so that its stored series is shared."""
    key = (t.spark.sparkContext.applicationId, t.base)
    if key not in _spaces:
        _spaces[key] = Workspace(t, CONFIG)
    return _spaces[key]


def _days(t: RetailTables) -> DataFrame:
    """The days of all series."""
    return workspace(t).series.select("ds", TESTBED.regime_col).distinct()


def _interpolated(t: RetailTables) -> DataFrame:
    raw = S.load_series(t.sales(), TESTBED, dense=False).select("unique_id", "ds", "y")
    dense = S.fill_calendar(raw).withColumn("y_raw", F.col("y"))
    return S.fill_gaps(dense)


def _regimes(t: RetailTables) -> DataFrame:
    return _days(t).select("ds", S.regime_flag(TESTBED).alias("by_date"), S.regime_flag(TESTBED, "ds", 0).alias("forced_off"),
                           S.regime_flag(TESTBED, "ds", 1).alias("forced_on"))


def _profile_leakage(t: RetailTables) -> DataFrame:
    w = workspace(t)
    pick = lambda p, name: p.select("unique_id", "woy_week", F.col("woy_profile_mean").alias(f"{name}_mean"),
                                    F.col("woy_profile_count").alias(f"{name}_days"))
    return pick(w.train_profile, "train").join(pick(w.full_profile, "full"), ["unique_id", "woy_week"])


def _candidates(t: RetailTables) -> DataFrame:
    """All random candidates scored on the hold-out of every series."""
    w, count = workspace(t), len(baseline.BASELINES)
    scored = score_candidates(w.judged, baseline.BASELINES, weight_candidates(count, w.blend_cfg), w.blend_cfg)
    return weights_as_columns(scored, count)


def _submission(t: RetailTables) -> DataFrame:
    w = workspace(t)
    return to_submission(w.mixed_baselines(MIXES), w.blend_cfg.output, TESTBED)


def _roundtrip(t: RetailTables) -> DataFrame:
    path = write_csv(_submission(t), work_path(t.spark, "submission"), order=["Date"], single_file=True)
    return read_csv(t.spark, path, SCHEMAS["sample_submission"])


def _history_and_forecast(t: RetailTables) -> DataFrame:
    w = workspace(t)
    return history_and_forecast(w.series, w.mixed_baselines(MIXES), w.blend_cfg.output, TESTBED)


# --- trained models ------------------------------------------------------------

def _ensemble_metrics(t: RetailTables) -> DataFrame:
    """Errors of the blended ensemble on the days it never saw, next to those of the best seasonal baseline."""
    w = workspace(t)
    blended = forecast_metrics(w.ensemble_validation(), w.blend_cfg.output).withColumn("model", F.lit("ensemble"))
    naive = forecast_metrics(w.judged, baseline.BASELINES[0]).withColumn("model", F.lit(baseline.BASELINES[0]))
    trend = forecast_metrics(w.trend_validation(), w.trend_cfg.output).withColumn("model", F.lit("trend_break"))
    return blended.unionByName(naive).unionByName(trend)


def _nested_metrics(t: RetailTables) -> DataFrame:
    """Blend learned on the first half of the hold-out and scored on the second half."""
    w = workspace(t)
    learn_on, score_on = nested_evaluation(w.ensemble_judged)
    names = w.train_ensemble.names
    found = learn_blend(learn_on, names, weight_candidates(len(names), w.blend_cfg), w.blend_cfg)
    return forecast_metrics(apply_blend(score_on, found, names, w.blend_cfg), w.blend_cfg.output)


def _export_scenarios(t: RetailTables) -> DataFrame:
    w = workspace(t)
    wide = to_submission(w.scenario_forecasts, w.blend_cfg.output, TESTBED, by_scenario=True)
    path = export_scenarios(wide, work_path(t.spark, "scenarios"))
    schema = "Date date, Revenue double, COGS double, scenario string"
    return t.spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def _attribution(t: RetailTables) -> DataFrame:
    w = workspace(t)
    tables = [top_features(w.full_matrix, target, w.full_ensemble.trees[PRIMARY], feature_names(TESTBED),
                           w.attribution_cfg) for target in TESTBED.targets]
    return tables[0].unionByName(tables[1])


def _sample(t: RetailTables) -> DataFrame:
    w = workspace(t)
    picked = w.full_matrix.select("unique_id", "ds", "y")
    return seeded_sample(picked, ["unique_id", "ds"], SAMPLE_ROWS, w.attribution_cfg.seed)


# --- result columns ----------------------------------------------------------

_LEVELS = {"woy_target_mean", "woy_profile_mean", "woy_profile_median", "woy_profile_std", "woy_recent_mean",
           "woy_recent_median", "woy_recent_max", "woy_last_year_mean", "woy_projected_next_mean",
           "woy_last_annual_peak_total", "woy_expected_next_annual_peak"}
_COUNTS = {"woy_profile_count", "woy_recent_count", "woy_last_observed_year", "woy_mean_rank_desc", "woy_peak_rank_desc",
           "woy_is_top_mean_week", "woy_is_peak_candidate_week", "woy_reference_peak_week", "woy_last_peak_year",
           "woy_week"}


def _kind(name: str) -> str:
    if name in _COUNTS or name.startswith("woy_oh_") or name in DATE_FEATURES or name == TESTBED.regime_col:
        return f"{name}:i"
    if name in _LEVELS or name.startswith("rolling_mean"):
        return f"{name}:0"  # means of amounts around 1e7: eight digits are left
    return name if name.startswith("woy_") else f"{name}:4"


def _columns(lead: str, names) -> str:
    return " ".join([lead, *[_kind(n) for n in names]])


_PREDICTIONS = " ".join(f"{m}:0" for m in baseline.BASELINES)
_MEMBERS = " ".join(f"{m}:0" for m in CONFIG.ensemble)
_LONG = "unique_id:s ds:d"
_PROFILE_ALL = [c for cols in LAYERS.values() for c in cols]
_WEEK = "unique_id:s woy_week:i"

SERIES: dict[str, Query] = {
    "load_series": Query(lambda t: workspace(t).series, f"{_LONG} y:4 is_covid:i"),
    "interpolate_gaps": Query(_interpolated, f"{_LONG} y_raw:4 y:4"),
    "regime_flag": Query(_regimes, "ds:d by_date:i forced_off:i forced_on:i"),
    "covid_summary": Query(lambda t: S.regime_summary(workspace(t).series, TESTBED),
                           "is_covid:i first_day:d last_day:d days:l"),
    "temporal_split": Query(lambda t: S.with_part(workspace(t).series, TESTBED.test_days), f"{_LONG} y:4 part:s"),
    "future_frame": Query(lambda t: S.future_frame(workspace(t).series, TESTBED, S.SCENARIOS),
                          f"scenario:s {_LONG} is_covid:i"),
    "calendar_features": Query(lambda t: add_calendar(_days(t)), _columns("ds:d", DATE_FEATURES)),
    "week_harmonics": Query(lambda t: _days(t).select("ds", *harmonic_columns(TESTBED)),
                            "ds:d " + " ".join(f"woy_{f}_{k}" for k in TESTBED.harmonics for f in ("sin", "cos"))),
    "week_onehot": Query(lambda t: _days(t).select("ds", *onehot_columns(TESTBED)),
                         "ds:d " + " ".join(f"woy_oh_{w:02d}:i" for w in range(1, 54))),
    "woy_profile": Query(lambda t: workspace(t).full_profile, _columns(_WEEK, _PROFILE_ALL)),
    "woy_profile_base": Query(lambda t: workspace(t).full_profile, _columns(_WEEK, LAYERS["base"])),
    "woy_recent": Query(lambda t: workspace(t).full_profile, _columns(_WEEK, LAYERS["recent"])),
    "woy_growth": Query(lambda t: workspace(t).full_profile, _columns(_WEEK, LAYERS["growth"])),
    "woy_peak": Query(lambda t: workspace(t).full_profile, _columns(_WEEK, LAYERS["peak"])),
    "woy_annual": Query(lambda t: workspace(t).full_profile, _columns(_WEEK, LAYERS["annual"])),
    "profile_leakage": Query(_profile_leakage, f"{_WEEK} train_mean:0 full_mean:0 train_days:i full_days:i"),
    "weekly_peak_preview": Query(lambda t: peak_preview(workspace(t).train_profile, TESTBED),
                                 f"{_WEEK} woy_profile_ratio woy_recent_to_all_ratio woy_same_week_growth "
                                 "woy_annual_peak_growth woy_peak_score"),
    "annual_peak_note": Query(lambda t: annual_peaks(workspace(t).series, 1998, 2000),
                              "unique_id:s iso_year:i woy_week:i weekly_mean:0 peak_yoy_growth"),
    "feature_matrix": Query(lambda t: feature_matrix(workspace(t).series, workspace(t).full_profile, TESTBED),
                            _columns(f"{_LONG} y:4", feature_names(TESTBED))),
    "baseline_forecast": Query(lambda t: workspace(t).judged, f"{_LONG} y:4 {_PREDICTIONS}"),
    "model_mae": Query(lambda t: model_errors(workspace(t).judged, baseline.BASELINES), "model:s unique_id:s mae:0"),
    "blend_search": Query(lambda t: weights_as_columns(workspace(t).baseline_blend(MIXES), len(baseline.BASELINES)),
                          "unique_id:s candidate:i w1 w2 w3 w4 bias:0 validation_mae:0"),
    "blend_candidates": Query(_candidates, "unique_id:s candidate:i w1 w2 w3 w4 bias:0 validation_mae:0"),
    "apply_blend": Query(lambda t: workspace(t).judged_blend(MIXES), f"{_LONG} y:4 Optimized:0"),
    "forecast_metrics": Query(lambda t: forecast_metrics(workspace(t).judged_blend(MIXES), "Optimized"),
                              "unique_id:s mae:0 rmse:0 r2 mape_pct guarded_share days:l"),
    "scenario_blend": Query(lambda t: workspace(t).mixed_baselines(MIXES),
                            f"scenario:s {_LONG} {_PREDICTIONS} Optimized:0"),
    "submission_wide": Query(_submission, "Date:d Revenue:2 COGS:2"),
    "export_roundtrip": Query(_roundtrip, "Date:d Revenue:2 COGS:2"),
    "contract_check": Query(lambda t: contract_facts(_submission(t)), "first_day:d last_day:d rows:l days:l"),
    "ensemble_fit": Query(_ensemble_metrics, "model:s unique_id:s mae:0 rmse:0 r2 mape_pct guarded_share days:l"),
    "ensemble_nested": Query(_nested_metrics, "unique_id:s mae:0 rmse:0 r2 mape_pct guarded_share days:l"),
    "recursive_forecast": Query(lambda t: workspace(t).ensemble_validation(), f"{_LONG} y:4 {_MEMBERS} Optimized:0"),
    "scenario_forecast": Query(lambda t: workspace(t).scenario_forecasts, f"scenario:s {_LONG} {_MEMBERS} Optimized:0"),
    "export_scenarios": Query(_export_scenarios, "scenario:s Date:d Revenue:2 COGS:2"),
    "trend_break_forecast": Query(lambda t: workspace(t).trend_validation(),
                                  f"{_LONG} y:4 TrendBreak:0 yhat_lower:0 yhat_upper:0"),
    "trend_break_scenarios": Query(lambda t: workspace(t).trend_scenarios(),
                                   f"scenario:s {_LONG} TrendBreak:0 yhat_lower:0 yhat_upper:0"),
    "attribution_top20": Query(_attribution, "unique_id:s feature:s mean_abs_contribution:2 mean_contribution:2 "
                                             "sampled_rows:l"),
    "seeded_sample": Query(_sample, f"{_LONG} y:4"),
    "history_vs_forecast": Query(_history_and_forecast, "kind:s Date:d Revenue:4 COGS:4"),
}
