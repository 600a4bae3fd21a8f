"""Shared pieces of the operators: session settings, Arrow passes over documents, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import remove_path, tuned, work_path

#: Words are maximal runs of other characters than the space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"

#: Documents that one Arrow batch hands to Python. Texts may be long, so batches are short; Spark also ends one at
#: spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), and a single row may be larger.
BATCH_DOCUMENTS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The library's session settings, shuffle files that go when their query ends, and short Arrow batches."""
    tuned(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCUMENTS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Columns of an Arrow batch in, columns of result rows out. Text columns arrive as UTF-8 bytes."""

    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = {}
                for name, column in zip(batch.schema.names, batch.columns):
                    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                        column = column.cast(pa.large_binary())
                    columns[name] = column.to_pylist()
                made = fn(columns)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def kept_path(df: DataFrame, name: str) -> str:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def components(links: DataFrame) -> DataFrame:
    """Connected components of `links` (a, b): one row (node, root) per linked node, root the smallest node.

    Rounds of large-star and small-star steps. A node's smallest neighbour is
    found by a combining aggregate and joined back, so a node with very many
    links is split like any skewed join key. Each round is written to the
    shared folder; only its row count and checksum reach the driver.
    """
    spark = links.sparkSession
    path = kept_path(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .distinct(), "links")
    before = None
    while True:
        edges = spark.read.parquet(path)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large_path = kept_path(large.distinct(), "large-star")
        large = spark.read.parquet(large_path)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        next_path = kept_path(small.distinct(), "small-star")
        for old in (path, large_path):
            remove_path(spark, old)
        path = next_path
    return spark.read.parquet(path).select(F.col("u").alias("node"), F.col("v").alias("root"))
