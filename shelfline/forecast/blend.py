"""Blending several forecasts: weights and a median correction learned per series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.config import BlendConfig

BLEND_SCHEMA = "unique_id string, candidate int, weights array<double>, bias double, validation_mae double"
#: Candidates of one group: a group holds one series' hold-out days and scores this many mixes.
BLOCK = 125


def weight_candidates(n_models: int, cfg: BlendConfig) -> np.ndarray:
    """Every single model, the even mix, then random mixes; one row of weights each, summing to 1."""
    rng = np.random.default_rng(cfg.seed)
    draws = rng.dirichlet(np.full(n_models, cfg.alpha), size=cfg.random_draws)
    return np.vstack([np.eye(n_models), np.full((1, n_models), 1.0 / n_models), draws])


def weight_grid(n_models: int, steps: int) -> np.ndarray:
    """All weights that are multiples of ``1 / steps``, in lexical order."""
    def fill(left: int, slots: int) -> Iterator[list[int]]:
        if slots == 1:
            yield [left]
            return
        for first in range(left + 1):
            for rest in fill(left - first, slots - 1):
                yield [first, *rest]
    return np.array(list(fill(steps, n_models)), dtype=float) / steps


def _score(rows: pd.DataFrame, models: Sequence[str], weights: np.ndarray, cfg: BlendConfig) -> tuple[np.ndarray, np.ndarray]:
    """Median correction and mean absolute error of some candidates on one series' hold-out days."""
    rows = rows.sort_values("ds")
    truth = rows["y"].to_numpy(float)[:, None]
    raw = rows[list(models)].to_numpy(float) @ weights.T
    bias = np.median(truth - raw, axis=0) if cfg.median_bias else np.zeros(raw.shape[1])
    fixed = np.maximum(raw + bias, 0.0) if cfg.clip_negative else raw + bias
    return bias, np.abs(truth - fixed).mean(axis=0)


def _blocks(evaluated: DataFrame, models: Sequence[str], count: int) -> DataFrame:
    """Hold-out days once for each block of candidates, dealt out by (series, block).

    The number of partitions is given, so that adaptive execution does not merge
    the groups of few series into one task: bytes say nothing about the work here.
    """
    spark = evaluated.sparkSession
    blocks = F.sequence(F.lit(0), F.lit(-(-count // BLOCK) - 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    known = evaluated.na.drop(subset=["y", *models]).select("unique_id", "ds", "y", *models, F.explode(blocks).alias("block"))
    return known.repartition(parts, "unique_id", "block")


def score_candidates(evaluated: DataFrame, models: Sequence[str], weights: np.ndarray, cfg: BlendConfig) -> DataFrame:
    """Every candidate's weights, correction and error per series; one group per (series, block of candidates)."""
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["block"].iloc[0]) * BLOCK
        mine = weights[first:first + BLOCK]
        bias, error = _score(rows, models, mine, cfg)
        return pd.DataFrame({"unique_id": rows["unique_id"].iloc[0], "candidate": first + np.arange(len(mine)),
                             "weights": list(mine), "bias": bias, "validation_mae": error})

    return _blocks(evaluated, models, len(weights)).groupBy("unique_id", "block").applyInPandas(score, BLEND_SCHEMA)


def learn_blend(evaluated: DataFrame, models: Sequence[str], weights: np.ndarray, cfg: BlendConfig) -> DataFrame:
    """The candidate with the lowest error (to six digits) per series; the first one wins a tie."""
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["block"].iloc[0]) * BLOCK
        mine = weights[first:first + BLOCK]
        bias, error = _score(rows, models, mine, cfg)
        at = int(np.argmin(np.round(error, 6)))
        return pd.DataFrame({"unique_id": [rows["unique_id"].iloc[0]], "candidate": [first + at], "weights": [mine[at]],
                             "bias": [bias[at]], "validation_mae": [error[at]], "rounded": [np.round(error[at], 6)]})

    best = _blocks(evaluated, models, len(weights)).groupBy("unique_id", "block") \
        .applyInPandas(search, f"{BLEND_SCHEMA}, rounded double")
    return best.groupBy("unique_id").agg(F.min(F.struct("rounded", "candidate", "weights", "bias", "validation_mae")).alias("best")) \
        .select("unique_id", "best.candidate", "best.weights", "best.bias", "best.validation_mae")


def blended(models: Sequence[str], cfg: BlendConfig) -> Column:
    mix = reduce(add, [F.col(m) * F.get("weights", F.lit(i)) for i, m in enumerate(models)]) + F.col("bias")
    return F.greatest(mix, F.lit(0.0)) if cfg.clip_negative else mix


def apply_blend(forecast: DataFrame, blend: DataFrame, models: Sequence[str], cfg: BlendConfig,
                out: str | None = None) -> DataFrame:
    """Add the blended prediction; a series without a blend gets NULL."""
    joined = forecast.join(blend.select("unique_id", "weights", "bias"), "unique_id", "left")
    mix = F.when(F.col("bias").isNotNull(), blended(models, cfg))
    return joined.select(*forecast.columns, mix.alias(out or cfg.output))


def mix_scenarios(forecasts: DataFrame, first: str, second: str, probability: float, columns: Sequence[str],
                  name: str = "blend") -> DataFrame:
    """``(1 - p) * first + p * second`` of every column; one pass over both scenarios."""
    p = min(max(float(probability), 0.0), 1.0)
    part = lambda c, s: F.max(F.when(F.col("scenario") == s, F.col(c)))
    return (forecasts.where(F.col("scenario").isin(first, second)).groupBy("unique_id", "ds")
            .agg(*[(part(c, first) * (1.0 - p) + part(c, second) * p).alias(c) for c in columns])
            .select(F.lit(name).alias("scenario"), "unique_id", "ds", *columns))
