"""Equi-joins with cardinality contracts and NULL-matching keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

_ONE_SIDES = {"one_to_one": (True, True), "many_to_one": (False, True), "one_to_many": (True, False)}


def unique_by(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """``df``, failing at run time if a non-NULL key repeats.

    Keys are counted by a combining aggregate, so a hot key is one row per task;
    only the largest count meets the rows.
    """
    most = (df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
            .agg(F.max("_copies").alias("_most")))
    guard = F.when(F.col("_most") > 1, F.raise_error(F.lit(f"{name}: key {tuple(keys)} is not unique")).cast("boolean")).otherwise(True)
    return df.crossJoin(F.broadcast(most)).where(guard).drop("_most")


def contract_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner",
                  validate: str | None = None, null_safe: bool = False) -> DataFrame:
    """Join on equal column names; ``validate`` names the side(s) whose key must be unique."""
    keys = [on] if isinstance(on, str) else list(on)
    if validate is not None:
        if validate not in _ONE_SIDES:
            raise ValueError(f"unknown join contract: {validate}")
        left_one, right_one = _ONE_SIDES[validate]
        left = unique_by(left, keys, "left side") if left_one else left
        right = unique_by(right, keys, "right side") if right_one else right
    if not null_safe:
        return left.join(right, keys, how)
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    merged = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) if how in ("outer", "full", "right") else F.col(k)
              for k in keys]
    rest = [c for c in joined.columns if c not in keys and not (c.startswith("_r_") and c[3:] in keys)]
    return joined.select(*merged, *rest)


def key_profile(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: how many keys a table has and how many of them repeat."""
    per_key = df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.lit(name).alias("side"),
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)), F.lit(0)).alias("repeated_keys"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
    )
