"""One set of tables with its stored series: everything the forecast steps share.

The daily series is tiny next to the order lines it is summed from, and every
later step reads it. It is therefore computed once, written to the shared folder
and read back by all steps of the session.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from shelfline.config import ForecastConfig
from shelfline.forecast.calendar import DateFeature
from shelfline.forecast import baseline, blend, series as S, trend_break
from shelfline.forecast.ensemble import Ensemble, build_estimators, fit_ensemble, future_features, recursive_forecast
from shelfline.forecast.features import feature_matrix
from shelfline.forecast.profile import build_profile
from shelfline.forecast.store import ModelStore, series_fingerprint
from shelfline.session import stored
from shelfline.sources import RetailTables


class Workspace:
    """``features``: date features (name to column function) in place of the usual ones, in fit and forecast alike.

    ``models``: folder of the trained models, for this and later applications.
    """

    def __init__(self, tables: RetailTables, config: ForecastConfig, features: Mapping[str, DateFeature] | None = None,
                 models: str | None = None) -> None:
        self.features, self.store = features, ModelStore(tables.spark, models)
        self.tables, self.cfg, self.blend_cfg = tables, config.series, config.blend
        self.params, self.trend_cfg, self.attribution_cfg = config.ensemble, config.trend, config.attribution

    @cached_property
    def series(self) -> DataFrame:
        return stored(S.load_series(self.tables.sales(), self.cfg), "series")

    @cached_property
    def parts(self) -> tuple[DataFrame, DataFrame]:
        return S.split(self.series, self.cfg.test_days)

    @cached_property
    def train_profile(self) -> DataFrame:
        """Learned on the training part only, for use while validating."""
        return build_profile(self.parts[0], self.cfg)

    @cached_property
    def full_profile(self) -> DataFrame:
        return build_profile(self.series, self.cfg)

    # --- baselines: a complete validation and forecast without a trained model ---

    @cached_property
    def judged(self) -> DataFrame:
        """Hold-out days with the truth and every baseline's prediction."""
        train, test = self.parts
        predicted = baseline.seasonal_baselines(train, test, self.cfg)
        return stored(test.select("unique_id", "ds", "y").join(predicted, ["unique_id", "ds"]), "judged")

    def baseline_blend(self, weights: np.ndarray) -> DataFrame:
        return blend.learn_blend(self.judged, baseline.BASELINES, weights, self.blend_cfg)

    def judged_blend(self, weights: np.ndarray) -> DataFrame:
        return blend.apply_blend(self.judged, self.baseline_blend(weights), baseline.BASELINES, self.blend_cfg)

    def scenario_baselines(self, weights: np.ndarray) -> DataFrame:
        """All scenarios of the days ahead, with the blend learned on the hold-out."""
        future = S.future_frame(self.series, self.cfg, S.SCENARIOS)
        plain = baseline.seasonal_baselines(self.series, future, self.cfg)
        scaled = baseline.regime_scaled(self.series, plain, future, self.cfg)
        return blend.apply_blend(scaled, self.baseline_blend(weights), baseline.BASELINES, self.blend_cfg)

    def mixed_baselines(self, weights: np.ndarray) -> DataFrame:
        columns = [*baseline.BASELINES, self.blend_cfg.output]
        return blend.mix_scenarios(self.scenario_baselines(weights), "non_covid", "covid",
                                   self.cfg.regime_probability, columns)

    # --- the trained ensemble ---

    @cached_property
    def train_matrix(self) -> DataFrame:
        return stored(feature_matrix(self.parts[0], self.train_profile, self.cfg, self.features), "train-matrix")

    @cached_property
    def full_matrix(self) -> DataFrame:
        return stored(feature_matrix(self.series, self.full_profile, self.cfg, self.features), "matrix")

    def _trained(self, matrix: DataFrame, series: DataFrame) -> Ensemble:
        known = series_fingerprint(series.select("unique_id", "ds", "y", self.cfg.regime_col))
        return fit_ensemble(matrix, self.cfg, build_estimators(self.params), self.features, self.store, known)

    @cached_property
    def train_ensemble(self) -> Ensemble:
        return self._trained(self.train_matrix, self.parts[0])

    @cached_property
    def full_ensemble(self) -> Ensemble:
        return self._trained(self.full_matrix, self.series)

    @cached_property
    def ensemble_judged(self) -> DataFrame:
        """Hold-out days with the truth and every member's recursive forecast."""
        train, test = self.parts
        days = test.select(F.lit("auto").alias("scenario"), "unique_id", "ds", self.cfg.regime_col)
        ahead = future_features(days, self.train_profile, self.cfg, self.features)
        predicted = recursive_forecast(self.train_ensemble, train, ahead, self.cfg, features=self.features).drop("scenario")
        return stored(test.select("unique_id", "ds", "y").join(predicted, ["unique_id", "ds"]), "ensemble-judged")

    @cached_property
    def ensemble_blend(self) -> DataFrame:
        names = self.train_ensemble.names
        weights = blend.weight_candidates(len(names), self.blend_cfg)
        return stored(blend.learn_blend(self.ensemble_judged, names, weights, self.blend_cfg), "blend")

    def ensemble_validation(self) -> DataFrame:
        return blend.apply_blend(self.ensemble_judged, self.ensemble_blend, self.train_ensemble.names, self.blend_cfg)

    @cached_property
    def scenario_forecasts(self) -> DataFrame:
        """Every scenario of the days ahead, blended, and the mix of the first two."""
        future = S.future_frame(self.series, self.cfg, S.SCENARIOS)
        ahead = future_features(future, self.full_profile, self.cfg, self.features)
        self.parts  # what both sides read is there before they start
        with ThreadPoolExecutor(max_workers=1) as pool:  # the blend is learned while the days ahead are predicted
            found = pool.submit(inheritable_thread_target(self.series.sparkSession)(lambda: self.ensemble_blend))
            raw = recursive_forecast(self.full_ensemble, self.series, ahead, self.cfg, features=self.features)
            each = stored(blend.apply_blend(raw, found.result(), self.full_ensemble.names, self.blend_cfg), "scenarios")
        columns = [*self.full_ensemble.names, self.blend_cfg.output]
        return each.unionByName(blend.mix_scenarios(each, S.SCENARIOS[0], S.SCENARIOS[1],
                                                    self.cfg.regime_probability, columns))

    # --- trend break ---

    def trend_validation(self) -> DataFrame:
        train, test = self.parts
        days = test.select(F.lit("auto").alias("scenario"), "unique_id", "ds", self.cfg.regime_col)
        found = trend_break.predict(trend_break.fit(train, self.cfg, self.trend_cfg), days, self.cfg, self.trend_cfg)
        return found.drop("scenario").join(test.select("unique_id", "ds", "y"), ["unique_id", "ds"])

    def trend_scenarios(self) -> DataFrame:
        future = S.future_frame(self.series, self.cfg, S.SCENARIOS)
        fitted = trend_break.fit(self.series, self.cfg, self.trend_cfg)
        each = trend_break.predict(fitted, future, self.cfg, self.trend_cfg)
        return trend_break.with_mix(each, self.cfg.regime_probability, self.trend_cfg, S.SCENARIOS)


def weights_as_columns(found: DataFrame, count: int) -> DataFrame:
    return found.select("unique_id", "candidate", *[F.get("weights", F.lit(i)).alias(f"w{i + 1}") for i in range(count)],
                        "bias", "validation_mae")
