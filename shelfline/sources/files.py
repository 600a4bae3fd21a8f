"""CSV reading and writing, and the checks on written results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfline.sources.schemas import SCHEMAS


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file with a header (no data is parsed)."""
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None,
             date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Typed CSV scan; bad records fail. Columns are matched by name, whatever their order in the file."""
    typed = {f.name: f for f in schema.fields}
    header = csv_header(spark, path)
    in_file = T.StructType([T.StructField(c, typed[c].dataType if c in typed else T.StringType(), True)
                            for c in header])
    scan = (spark.read.schema(in_file).option("header", True).option("mode", "FAILFAST")
            .option("dateFormat", date_format).csv(path))
    wanted = list(columns) if columns is not None else [c for c in header if c in typed]
    lacking = [c for c in wanted if c not in header]
    if lacking:
        raise ValueError(f"{path} lacks columns: {', '.join(lacking)}")
    return scan.select(*wanted)


def read_table(spark: SparkSession, base: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    return read_csv(spark, f"{base}/{table}.csv", SCHEMAS[table], columns)


def write_csv(df: DataFrame, path: str, order: Sequence[str] | None = None, single_file: bool = False) -> str:
    """CSV with a header and ISO dates.

    ``single_file`` is for results of a known small size (one row per forecast
    day); larger results are written in parallel, range-partitioned if ordered.
    """
    if order is not None:
        df = df.repartition(1).sortWithinPartitions(*order) if single_file else df.orderBy(*order)
    elif single_file:
        df = df.repartition(1)
    df.write.mode("errorifexists").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return path


def write_by(df: DataFrame, path: str, column: str) -> str:
    """One sub-folder per value of ``column``; every task writes its own rows, so a frequent value is many files."""
    (df.write.mode("errorifexists").option("header", True)
       .option("dateFormat", "yyyy-MM-dd").partitionBy(column).csv(path))
    return path


def contract_facts(wide: DataFrame, date_col: str = "Date") -> DataFrame:
    """The facts a finished forecast is checked by: first and last day, rows and distinct days."""
    return wide.agg(F.min(date_col).alias("first_day"), F.max(date_col).alias("last_day"),
                    F.count(F.lit(1)).alias("rows"), F.countDistinct(date_col).alias("days"))


def check_contract(wide: DataFrame, first_day: date | None, rows: int, date_col: str = "Date") -> None:
    """Raise unless the forecast has exactly ``rows`` rows, one a day without gaps, from ``first_day`` (if given) on."""
    facts = contract_facts(wide, date_col).first()
    if first_day is not None and facts["first_day"] != first_day:
        raise ValueError(f"first day is {facts['first_day']}, expected {first_day}")
    if facts["rows"] != rows:
        raise ValueError(f"{facts['rows']} rows, expected {rows}")
    if rows and not facts["days"] == rows == (facts["last_day"] - facts["first_day"]).days + 1:
        raise ValueError(f"{facts['days']} different days from {facts['first_day']} to {facts['last_day']}, expected {rows}")
