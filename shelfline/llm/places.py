"""Places of rows in a total order without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stored


def placed(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Columns of `df`, `pos` (place of the row among those of its `key`, from 0) and `n` (rows of the key).

    Rows are range-partitioned by (key, order, row number), so a key with a third of
    all rows lies in a third of the tasks, and so do equal rows. Places follow from
    the running number in sorted tasks and the counts of (key, task), a table of at
    most keys + tasks rows. `df` should read stored rows: it is read twice, once for
    the range borders. The key must not be null.
    """
    by = [F.col(key), *map(F.col, order), F.col("_row")]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row") \
        .select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at"))
    ordered = stored(ordered, name)
    spans = ordered.groupBy(key, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    mine = Window.partitionBy(key)
    before = mine.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(key, "_task", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_rows").over(mine).alias("n"))
    return ordered.join(spans, [key, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift")
