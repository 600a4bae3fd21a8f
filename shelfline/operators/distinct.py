"""Exact distinct counts of several id columns in one aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfline.functions import sum0
from shelfline.operators.keyed import group

WORD_BITS = 6


def _word(column: str) -> Column:
    return F.shiftright(F.col(column).cast("long"), WORD_BITS)


def _bit(column: str) -> Column:
    place = F.col(column).cast("long").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def distinct_counts(df: DataFrame, key: str, ids: Mapping[str, str], sums: Mapping[str, str] | None = None) -> DataFrame:
    """For each ``key``: distinct non-NULL values of every ``ids`` column and totals of the ``sums`` columns.

    Both map a result's name to its column. Ids are set as bits of 64-bit words, so 64
    neighbouring ids travel as one word; words are merged by `bit_or`, which combines on
    the map side in a hash aggregate and never grows. Scattered ids cost a word each, no more
    than the ids themselves would. One shuffle serves all columns. Ids that are not whole numbers
    are counted by Spark's own distinct count. Rows with a NULL key are left out; a total of no value is 0.
    """
    sums = dict(sums or {})
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not all(isinstance(df.schema[c].dataType, whole) for c in ids.values()):
        return group(df, key).agg(*[F.countDistinct(c).alias(n) for n, c in ids.items()], *[sum0(c).alias(n) for n, c in sums.items()])

    def part(place: int, column: str) -> Column:
        values = [F.col(c) if place == 0 else F.lit(None).cast(df.schema[c].dataType) for c in sums.values()]
        return F.struct(F.lit(place).alias("_place"), _word(column).alias("_word"), _bit(column).alias("_bit"),
                        *[v.alias(f"_sum{i}") for i, v in enumerate(values)])

    parts = df.na.drop(subset=[key]).select(key, F.inline(F.array(*[part(i, c) for i, c in enumerate(ids.values())])))
    words = parts.groupBy(key, "_place", "_word").agg(
        F.bit_or("_bit").alias("_bits"), *[F.sum(f"_sum{i}").alias(f"_sum{i}") for i in range(len(sums))])
    counts = [F.coalesce(F.sum(F.when(F.col("_place") == i, F.bit_count("_bits"))), F.lit(0)).cast("long").alias(name)
              for i, name in enumerate(ids)]
    return words.groupBy(key).agg(*counts, *[sum0(f"_sum{i}").alias(name) for i, name in enumerate(sums)])
