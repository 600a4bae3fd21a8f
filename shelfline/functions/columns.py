"""Column expressions that carry the dataframe semantics the plans rely on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def sum0(col: Column | str) -> Column:
    """Sum that is 0, not NULL, when every value is NULL."""
    return F.coalesce(F.sum(col), F.lit(0))


def average_or_none(col: Column | str) -> Column:
    """Mean in double precision (decimal means would be cut to a fixed scale)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.avg(col.cast("double"))


def safe_ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    """``top / bottom`` in double; a zero divisor gives ``default``."""
    ratio = top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))


def percent(top: Column, bottom: Column) -> Column:
    return safe_ratio(top, bottom) * 100.0


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to a range; NULL stays NULL (``greatest``/``least`` alone would drop it)."""
    out = col
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(col.isNotNull(), out)


def month_start(col: Column) -> Column:
    return F.trunc(col, "month")


def iso_week(col: Column) -> Column:
    return F.weekofyear(col)


def iso_year(col: Column) -> Column:
    """Year that owns the ISO week; always pair it with ``iso_week``."""
    return F.extract(F.lit("YEAROFWEEK"), col)


def day_of_week(col: Column) -> Column:
    """Monday = 0."""
    return F.weekday(col)


def week_distance(a: Column, b: Column, period: int = 53) -> Column:
    """Distance between two weeks on a circle of ``period`` weeks."""
    gap = F.abs(a.cast("double") - b.cast("double"))
    return F.least(gap, F.lit(float(period)) - gap)


def half_even(col: Column, digits: int) -> Column:
    return F.bround(col, digits)


def bucket_right_closed(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of ``(edge[i], edge[i+1]]``; the first bucket also holds its lower edge.

    Values outside the edges, and NULL, have no label.
    """
    out = None
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        inside = col >= F.lit(low) if i == 0 else col > F.lit(low)
        if high != float("inf"):
            inside = inside & (col <= F.lit(high))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def label_map(col: Column, labels: Mapping[str, str]) -> Column:
    """Relabel by a small dictionary; unknown values become NULL."""
    out = None
    for key, value in labels.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out
