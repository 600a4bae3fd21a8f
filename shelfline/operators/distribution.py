"""Exact order statistics, histograms and densities without a one-task sort.

Medians, quartiles and percentile ranks need rows in order. Sorting a whole group
in one task breaks down when a group holds a large part of the data, so the
values are first reduced to counts per distinct value, cut into cells of similar
size, and only ordered inside a cell. Cell totals then give every value its exact
position in its group.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

FAN = (16, 256)  # a cell is found in two steps of so many comparisons at least and at most
VALUES_PER_CELL = 65_536
SAMPLES_PER_CELL = 16
BINS_PER_WIDTH, MOMENTS, REACH = 16, 6, 9.0  # of the density: see its error bound


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each (keys, value) occurs; rows without a key or value are left out."""
    return df.na.drop(subset=[*keys, value]).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))


def _borders(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: cell borders, and every ``_fan``-th of them. They follow the number of counted values.

    They come from values whose hash is small, so they do not depend on task
    order. The row holds at most the square of the larger FAN, 65,536 numbers.
    """
    # Looking at ``copies`` keeps the column alive, so that all uses of ``counts``
    # read one shuffle instead of repeating the scan.
    size = counts.agg(F.sum(F.least("copies", F.lit(1))).alias("_values"))
    fan = F.least(F.greatest(F.ceil(F.sqrt(F.col("_values") / VALUES_PER_CELL)), F.lit(FAN[0])), F.lit(FAN[1])).cast("int")
    size = size.select(fan.alias("_fan"), (F.lit(float(SAMPLES_PER_CELL)) * fan * fan / F.col("_values")).alias("_share"))
    spot = F.pmod(F.xxhash64(*keys, value), F.lit(1 << 40)) / float(1 << 40)
    drawn = (counts.where(F.col("copies") > 0).crossJoin(F.broadcast(size)).where(spot < F.col("_share"))
             .agg(F.max("_fan").alias("_fan"), F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_drawn")))
    cells = F.col("_fan") * F.col("_fan")
    borders = drawn.select("_fan", F.transform(F.sequence(F.lit(1), cells - 1), lambda i: F.get(
        "_drawn", F.floor(i * F.size("_drawn") / cells).cast("int"))).alias("_borders"))
    return borders.select("_fan", "_borders", F.transform(F.sequence(F.lit(1), F.col("_fan") - 1),
                                                          lambda i: F.get("_borders", i * F.col("_fan") - 1)).alias("_coarse"))


def ordered_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per distinct (keys, value) of ``value_counts``: ``below``, the number of smaller values in the key, ``total``, that of
    all its values, and ``cell``. Borders only balance the work; the counts are exact whatever they are.
    """
    keys = list(keys)
    below = lambda edges: F.size(F.filter(edges, lambda b: b < F.col("_x")))
    cell_keys = [*keys, "cell"]
    placed = (counts.withColumn("_x", F.col(value).cast("double"))  # converted once, not per comparison
              .crossJoin(F.broadcast(_borders(counts, keys, value)))
              .withColumn("_part", below(F.col("_coarse")) * F.col("_fan"))
              .withColumn("cell", F.col("_part") + below(F.slice("_borders", F.col("_part") + 1, F.col("_fan"))))
              .select(*keys, value, "copies", "cell").repartition(*cell_keys))
    # The totals look at the values as well (a condition that always holds), so
    # that totals and rows read one shuffle and the cells are found only once.
    offsets = (placed.groupBy(*cell_keys).agg(F.sum("copies").alias("_in_cell"), F.max(value).alias("_top"))
               .where(F.col("_top").isNotNull()))
    run = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = run.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(*cell_keys, F.coalesce(F.sum("_in_cell").over(before), F.lit(0)).alias("_offset"),
                             F.sum("_in_cell").over(run).alias("total"))
    inside = (Window.partitionBy(*cell_keys).orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("_local", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
            .join(offsets, cell_keys)
            .select(*keys, value, "copies", (F.col("_offset") + F.col("_local")).alias("below"), "total", "cell"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per key: one column per entry of ``probs``."""
    return _quantiles(ordered_counts(value_counts(df, keys, value), keys, value), keys, value, probs)


def _quantiles(ordered: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    last = F.col("below") + F.col("copies") - 1
    number = F.col(value).cast("double")
    picks, shape = [], []
    for name, p in probs.items():
        spot = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        picks += [F.max(F.when((F.col("below") <= low) & (low <= last), number)).alias(f"_lo_{name}"),
                  F.max(F.when((F.col("below") <= high) & (high <= last), number)).alias(f"_hi_{name}"),
                  F.max(spot - low).alias(f"_w_{name}")]
        shape.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}"))
                     .alias(name))
    return ordered.groupBy(*keys).agg(*picks).select(*keys, *shape)


def percentile_ranks(df: DataFrame, **ranks: str) -> DataFrame:
    """Add ``name=column`` ranks among all rows as a share of the row count; ties get their mean rank.

    ``df`` is read once per rank and once more for the result: pass a stored table.
    """
    out = df
    for name, value in ranks.items():
        place = (F.col("below") + (F.col("copies") + 1) / 2.0) / F.col("total")
        ranked = ordered_counts(value_counts(df, [], value), [], value).select(value, place.alias(name))
        out = out.join(ranked, value, "left")
    return out


def rank_pct_within(value: Column | str, keys: Sequence[str]) -> Column:
    """Percentile rank inside small groups (ties get their mean rank)."""
    value = F.col(value) if isinstance(value, str) else value
    by = Window.partitionBy(*keys)
    ties = Window.partitionBy(*keys, value)
    position = F.rank().over(by.orderBy(value)) + (F.count(value).over(ties) - 1) / 2.0
    return F.when(value.isNotNull(), position / F.count(value).over(by))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes: ``bin``, its edges and ``records`` (empty bins have no row)."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    span = x.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    spot = F.coalesce((F.col("_x") - F.col("_lo")) / F.nullif(width, F.lit(0.0)), F.lit(0.0))
    counted = (x.crossJoin(F.broadcast(span))
               .groupBy(F.least(F.floor(spot * bins), F.lit(bins - 1)).cast("int").alias("bin"), "_lo", "_hi")
               .agg(F.count(F.lit(1)).alias("records")))
    return counted.select("bin", (F.col("_lo") + width * F.col("bin") / bins).alias("bin_start"),
                          (F.col("_lo") + width * (F.col("bin") + 1) / bins).alias("bin_end"), "records")


def density(df: DataFrame, value: str, points: int) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid between the extremes.

    Values are summed into bins of ``1 / BINS_PER_WIDTH`` bandwidths, each with the first six
    moments about its centre, by a combining aggregate: the shuffle holds bins, not
    values. A bin's kernel is its Taylor sum, exp(-(u - t)^2 / 2) = exp(-u^2 / 2) * sum of He_p(u) t^p / p!,
    and only the grid points within REACH bandwidths of it are visited. With |t| <= 1 / 32 a
    value's kernel (at most 1) is off by less than 2e-11, the sum of the tails that are left out by less than 1e-17.
    Without any spread there is no density (NULL).
    """
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    shape = x.agg(F.count("_x").alias("_n"), F.stddev_samp("_x").alias("_s"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = F.nullif(F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)), F.lit(0.0))
    shape = shape.where("_n > 0").select("*", width.alias("_h"))
    centre = F.col("_lo") + (F.col("_bin") + 0.5) * F.col("_h") / BINS_PER_WIDTH
    t = (F.col("_x") - centre) / F.col("_h")
    moments = [F.sum(F.pow(F.col("_t"), F.lit(float(p)))).alias(f"_m{p}") for p in range(MOMENTS)]
    bins = (x.crossJoin(F.broadcast(shape)).where(F.col("_h").isNotNull())
            .withColumn("_bin", F.floor((F.col("_x") - F.col("_lo")) * BINS_PER_WIDTH / F.col("_h"))).withColumn("_t", t)
            .groupBy("_bin").agg(*moments))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    near = lambda side: (centre + side * REACH * F.col("_h") - F.col("_lo")) / step
    seen = bins.crossJoin(F.broadcast(shape)).withColumn("point", F.explode(F.sequence(
        F.greatest(F.ceil(near(-1)), F.lit(0)).cast("int"), F.least(F.floor(near(1)), F.lit(points - 1)).cast("int"))))
    seen = seen.withColumn("_u", (F.col("_lo") + step * F.col("point") - centre) / F.col("_h"))
    hermite, u = [F.lit(1.0), F.col("_u")], F.col("_u")
    for p in range(2, MOMENTS):
        hermite.append(u * hermite[-1] - (p - 1) * hermite[-2])
    taylor = sum((F.col(f"_m{p}") * hermite[p] / float(factorial(p)) for p in range(1, MOMENTS)), F.col("_m0"))
    kernel = seen.groupBy("point").agg(F.sum(F.exp(-0.5 * u * u) * taylor).alias("_k"))
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    scale = F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    return grid.join(kernel, "point", "left").select(
        "point", (F.col("_lo") + step * F.col("point")).alias("x"), (F.coalesce("_k", F.lit(0.0)) / scale).alias("density"))


def box_stats(df: DataFrame, key: str, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles per key and the extreme values inside ``reach`` interquartile ranges.

    The fences meet the counted values cell by cell, so a hot key is as many groups as it has cells.
    """
    ordered = ordered_counts(value_counts(df, [key], value), [key], value)
    quart = _quantiles(ordered, [key], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fences = ordered.select(key, "cell").distinct().join(quart, key)
    spread = F.col("q3") - F.col("q1")
    x = F.col(value).cast("double")
    inside = (x >= F.col("q1") - spread * reach) & (x <= F.col("q3") + spread * reach)
    return (ordered.join(fences, [key, "cell"]).groupBy(key, "q1", "median", "q3")
            .agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
                 F.sum("copies").alias("records")))
