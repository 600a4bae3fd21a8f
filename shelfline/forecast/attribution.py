"""Which features drive a model's predictions for one series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfline.config import AttributionConfig
from shelfline.forecast.trees import TreeArrays, contributions
from shelfline.operators.keyed import seeded_sample

ROW_SCHEMA = "unique_id string, ds date, base double, prediction double, contributions array<double>"


def attribute_rows(matrix: DataFrame, trees: TreeArrays, features: Sequence[str]) -> DataFrame:
    """Additive contributions per row; with the base value they add up to the prediction."""
    features = list(features)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[features].to_numpy(float)
            phi, base = contributions(trees, rows)
            yield pd.DataFrame({"unique_id": batch["unique_id"], "ds": batch["ds"], "base": base,
                                "prediction": trees.predict(rows), "contributions": list(phi.astype(np.float64))})

    return matrix.select("unique_id", "ds", *features).mapInPandas(explain, ROW_SCHEMA)


def top_features(matrix: DataFrame, target: str, trees: TreeArrays, features: Sequence[str],
                 cfg: AttributionConfig) -> DataFrame:
    """The ``cfg.top`` features by mean absolute contribution over the target's days, or a seeded sample of them."""
    chosen = matrix.where(F.col("unique_id") == target).na.drop()
    if cfg.sample_rows is not None:
        chosen = seeded_sample(chosen, ["unique_id", "ds"], cfg.sample_rows, cfg.seed)
    chosen = chosen.repartition("ds")
    names = F.array(*[F.lit(f) for f in features])
    per_feature = (attribute_rows(chosen, trees, features)
                   .select("unique_id", F.posexplode("contributions").alias("pos", "contribution"))
                   .groupBy("unique_id", "pos").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"),
                                                    F.avg("contribution").alias("mean_contribution"),
                                                    F.count(F.lit(1)).alias("sampled_rows")))
    return (per_feature.select("unique_id", F.get(names, F.col("pos")).alias("feature"), "mean_abs_contribution",
                               "mean_contribution", "sampled_rows")
            .orderBy(F.desc("mean_abs_contribution"), "feature").limit(cfg.top))
