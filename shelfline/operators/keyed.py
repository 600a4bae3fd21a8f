"""Grouping, picking and de-duplicating rows by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, GroupedData, Window, functions as F


def group(df: DataFrame, *keys: str) -> GroupedData:
    """``groupBy`` that leaves out rows with a NULL key."""
    return df.na.drop(subset=list(keys)).groupBy(*keys)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the smallest by ``order`` (NULLs first).

    ``order`` must decide between any two rows that differ in ``keep``. A minimum
    over a struct combines on the map side, so a key with many copies sends at
    most one row per task through the shuffle.
    """
    keep = list(keep if keep is not None else [c for c in df.columns if c not in keys])
    fields = list(order) + [c for c in keep if c not in order]
    packed = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in keep])


def best(df: DataFrame, metric: str, label: str, largest: bool = True) -> DataFrame:
    """The row with the best metric; ties go to the smallest label."""
    return ranked(df, [(metric, largest), (label, False)], 1)


def ranked(df: DataFrame, order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """Top ``n`` rows by ``(column, descending)`` pairs."""
    sort = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    return df.orderBy(*sort).limit(n)


def share_of_total(df: DataFrame, **shares: str) -> DataFrame:
    """Add ``100 * column / sum(column)`` columns. For small, already aggregated frames."""
    whole = Window.partitionBy(F.lit(0))
    return df.select("*", *[
        (F.col(c).cast("double") / F.nullif(F.sum(c).over(whole).cast("double"), F.lit(0.0)) * 100.0).alias(name)
        for name, c in shares.items()
    ])


def share_within(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Add the share of ``column`` in its key's total, in percent."""
    total = F.sum(column).over(Window.partitionBy(*keys)).cast("double")
    return df.withColumn(out, F.col(column).cast("double") / F.nullif(total, F.lit(0.0)) * 100.0)


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of their key: the same rows whatever the partitioning."""
    said = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return df.orderBy(F.md5(said), *keys).limit(n)
