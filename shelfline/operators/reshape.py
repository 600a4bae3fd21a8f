"""Long and wide forms. A wide form loses no value: it fails on one that is not listed, or lists those that occur."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from shelfline.functions import label_map


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str,
            labels: Mapping[str, str] | None = None) -> DataFrame:
    """One row per id and value column; optionally relabel the column names."""
    out = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        list(ids), list(values), name, value)
    return out if labels is None else out.withColumn(name, label_map(F.col(name), labels))


def to_wide(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence[str],
            fill: float | None = None) -> DataFrame:
    """One column per listed value; a value that never occurs still gets its column.

    A value outside the list fails the query. NULL has no column.
    """
    known = F.col(column).isin(*values) | F.col(column).isNull()
    guard = F.when(known, True).otherwise(
        F.raise_error(F.concat(F.lit(f"{column} has a value without a column: "), F.col(column).cast("string"))).cast("boolean"))
    df = df.where(guard)
    wide = df.groupBy(*index).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else wide.na.fill(fill, subset=list(values))


def values_of(df: DataFrame, column: str) -> tuple[str, ...]:
    """The values that occur, in order; one small job. For columns whose values are headings of a wide form."""
    return tuple(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect())
