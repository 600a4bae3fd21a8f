"""Orders and unique order lines kept in a layout that later queries read without a shuffle.

Both are folders by order month, so a span of days reads its months only, and inside
them buckets by order_id, so grouping or joining by order needs no exchange. Lines are
de-duplicated and joined with orders once, when they are stored. Product columns are looked
up when a query asks for them, wherever the source looks them up by product too: stored, they
would cost one more shuffle of all lines and widen the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfline.functions import month_start
from shelfline.session import path_exists, remove_path, work_path
from shelfline.sources.master import PRODUCT_COLUMNS, with_products
from shelfline.sources.schemas import SCHEMAS
from shelfline.sources.tables import RetailTables

LINES = tuple(SCHEMAS["master_table"].names)
TRAFFIC = tuple(SCHEMAS["web_traffic"].names)
TABLES = ("orders", "lines", "web_traffic")
BUCKETS = 16


class StoredTables(RetailTables):
    """Another source's tables, with orders, lines and traffic read from a folder that `store` filled.

    The copy does not follow later changes of the source; store those in a new folder. A session
    knows the buckets through its catalog, so each session opens the folder once and closes it when done.
    An order that holds much of the data is written by several tasks, and its bucket is
    read as one; where that is too slow, ``spark.sql.sources.bucketing.enabled=false`` brings the shuffle back.
    """

    MONTH = "order_month"

    def __init__(self, source: RetailTables, folder: str) -> None:
        super().__init__(source.spark, folder)
        self.source = source
        if not path_exists(self.spark, f"{folder}/layout"):
            raise ValueError(f"{folder} holds no finished copy")
        self.buckets = self.spark.read.parquet(f"{folder}/layout").first()["buckets"]
        self._names: dict[str, str] = {}

    @classmethod
    def store(cls, source: RetailTables, folder: str, buckets: int = BUCKETS, tables: Sequence[str] = TABLES) -> StoredTables:
        """Write the copy; ``buckets`` should be about the stored bytes over the bytes a task can read.

        Tables that are not named are written when a query first reads them.
        """
        for table in tables:
            cls._write(source, folder, buckets, table)
        # Written last: a folder without it is no finished copy.
        source.spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/layout")
        return cls(source, folder)

    @classmethod
    def _write(cls, source: RetailTables, folder: str, buckets: int, table: str) -> None:
        """One table; its mark is written last, and what a stopped write left is replaced."""
        spark = source.spark
        remove_path(spark, f"{folder}/{table}")
        if table == "web_traffic":
            source.web_traffic().select(*TRAFFIC).write.parquet(f"{folder}/{table}")
        else:
            if table == "lines" and source.products_apart():
                source.products().select("product_id", *PRODUCT_COLUMNS).write.mode("overwrite").parquet(f"{folder}/products")
                df = source.master_once([c for c in LINES if c not in PRODUCT_COLUMNS and c != "line_cogs"])
            else:
                df = source.orders() if table == "orders" else source.master_once(LINES)
            name = f"shelfline_write_{uuid.uuid4().hex}"
            dated = df.withColumn(cls.MONTH, month_start(F.col("order_date")))
            # Rebalancing lets several tasks write a bucket that is far larger than others.
            (dated.hint("rebalance", buckets, "order_id").write.partitionBy(cls.MONTH).bucketBy(buckets, "order_id")
                  .option("path", f"{folder}/{table}").saveAsTable(name))
            spark.sql(f"DROP TABLE {name}")  # the files stay
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/done/{table}")

    def _path(self, table: str) -> str:
        if not path_exists(self.spark, f"{self.base}/done/{table}"):
            self._write(self.source, self.base, self.buckets, table)
        return f"{self.base}/{table}"

    def _bucketed(self, table: str) -> DataFrame:
        if table not in self._names:
            path, name = self._path(table), f"shelfline_{table}_{uuid.uuid4().hex}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema
                                if f.name != self.MONTH)
            self.spark.sql(f"CREATE TABLE {name} ({columns}, {self.MONTH} date) USING parquet PARTITIONED BY ({self.MONTH}) "
                           f"CLUSTERED BY (order_id) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
            self._names[table] = name
        return self.spark.table(self._names[table])

    def close(self) -> None:
        """Forget the folder's tables; its files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names.clear()

    def orders(self) -> DataFrame:
        return self._bucketed("orders")

    def master_once(self, columns: Sequence[str]) -> DataFrame:
        lines = self._bucketed("lines")
        if set(columns) <= set(lines.columns):
            return lines.select(*columns)
        products = self.spark.read.parquet(f"{self.base}/products")
        return with_products(lines, products, columns, lines.schema["line_revenue"].dataType.simpleString()).select(*columns)

    def web_traffic(self) -> DataFrame:
        return self.spark.read.parquet(self._path("web_traffic"))

    def master(self, columns: Sequence[str]) -> DataFrame:
        return self.source.master(columns)

    def order_items(self) -> DataFrame:
        return self.source.order_items()

    def products(self) -> DataFrame:
        return self.source.products()

    def customers(self) -> DataFrame:
        return self.source.customers()

    def geography(self) -> DataFrame:
        return self.source.geography()

    def returns(self) -> DataFrame:
        return self.source.returns()

    def payments(self) -> DataFrame:
        return self.source.payments()

    def sales(self) -> DataFrame:
        return self.source.sales()

    def inventory(self) -> DataFrame:
        return self.source.inventory()


_kept: dict[tuple[str, str], StoredTables] = {}


def kept_tables(source: RetailTables) -> StoredTables:
    """The copy of ``source`` in this application's work folder; each table is written by the first query that reads it."""
    key = (source.spark.sparkContext.applicationId, source.base)
    if key not in _kept or not path_exists(source.spark, f"{_kept[key].base}/layout"):
        _kept[key] = StoredTables.store(source, work_path(source.spark, "tables"), tables=())
    return _kept[key]
