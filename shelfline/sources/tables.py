"""Where the plans get their tables from."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.session import path_exists
from shelfline.sources.files import read_table
from shelfline.sources.master import build_master, lines_once, order_lines
from shelfline.sources.schemas import missing_columns, require_columns


class TableRegistry:
    """Keeps loaded tables for reuse while they have the columns asked for."""

    def __init__(self) -> None:
        self._tables: dict[str, DataFrame] = {}

    def get(self, name: str, required: Iterable[str], load: Callable[[], DataFrame]) -> DataFrame:
        held = self._tables.get(name)
        if held is None or missing_columns(held, required):
            if held is not None:
                held.unpersist()
            held = load().persist(StorageLevel.MEMORY_AND_DISK)
            self._tables[name] = held
        return held

    def columns(self, name: str) -> list[str]:
        return self._tables[name].columns if name in self._tables else []

    def clear(self) -> None:
        for df in self._tables.values():
            df.unpersist()
        self._tables.clear()


class RetailTables(ABC):
    """The retail star schema. ``master`` is the denormalised order line."""

    #: Column of orders and lines by whose value they are stored in folders, if they are.
    MONTH: str | None = None

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base
        self.registry: TableRegistry | None = None

    @contextmanager
    def reuse(self) -> Iterator[RetailTables]:
        """Within the block `lines` are computed once, however many queries ask for them; they go when it ends.

        A query that asks for more columns than are held has them loaded anew, together with those held.
        """
        self.registry = TableRegistry()
        try:
            yield self
        finally:
            self.registry.clear()
            self.registry = None

    def lines(self, columns: Sequence[str]) -> DataFrame:
        """``master_once``, held for reuse within `reuse`."""
        if self.registry is None:
            return self.master_once(columns)
        both = list(dict.fromkeys([*self.registry.columns("lines"), *columns]))
        return self.registry.get("lines", columns, lambda: self.master_once(both)).select(*columns)

    def products_apart(self) -> bool:
        """Whether lines get their product columns by product_id from `products` alone."""
        return False

    @abstractmethod
    def orders(self) -> DataFrame: ...

    @abstractmethod
    def order_items(self) -> DataFrame: ...

    @abstractmethod
    def products(self) -> DataFrame: ...

    @abstractmethod
    def customers(self) -> DataFrame: ...

    @abstractmethod
    def geography(self) -> DataFrame: ...

    @abstractmethod
    def returns(self) -> DataFrame: ...

    @abstractmethod
    def payments(self) -> DataFrame: ...

    @abstractmethod
    def web_traffic(self) -> DataFrame: ...

    @abstractmethod
    def sales(self) -> DataFrame:
        """Daily totals: date, revenue, cogs."""

    @abstractmethod
    def inventory(self) -> DataFrame: ...

    @abstractmethod
    def master(self, columns: Sequence[str]) -> DataFrame:
        """Order lines with the given columns; a line may occur more than once."""

    @abstractmethod
    def master_once(self, columns: Sequence[str]) -> DataFrame:
        """Order lines, one row per order_item_id."""


class CsvTables(RetailTables):
    """Tables as CSV files with a header in one folder."""

    def _read(self, table: str) -> DataFrame:
        return read_table(self.spark, self.base, table)

    def orders(self) -> DataFrame:
        return self._read("orders")

    def order_items(self) -> DataFrame:
        return self._read("order_items")

    def products(self) -> DataFrame:
        return self._read("products")

    def customers(self) -> DataFrame:
        return self._read("customers")

    def geography(self) -> DataFrame:
        return self._read("geography")

    def returns(self) -> DataFrame:
        return self._read("returns")

    def payments(self) -> DataFrame:
        return self._read("payments")

    def web_traffic(self) -> DataFrame:
        return self._read("web_traffic")

    def sales(self) -> DataFrame:
        return self._read("sales").select(F.col("Date").alias("date"), F.col("Revenue").alias("revenue"), F.col("COGS").alias("cogs"))

    def inventory(self) -> DataFrame:
        return self._read("inventory")

    def promotions(self) -> DataFrame:
        return self._read("promotions")

    def _lines(self) -> DataFrame | None:
        """The stored denormalised lines, if the folder has the file; a file that cannot be read fails."""
        return self._read("master_table") if path_exists(self.spark, f"{self.base}/master_table.csv") else None

    def products_apart(self) -> bool:
        return self._lines() is None

    def _built_lines(self) -> DataFrame:
        items = require_columns(self.order_items(), ["order_item_id"], "order_items")
        refund = F.col("refund_amount") if "refund_amount" in items.columns else F.lit(None)
        return order_lines(items, "double").withColumn("refund_amount", refund.cast("double"))

    def master(self, columns: Sequence[str]) -> DataFrame:
        lines = self._lines()
        if lines is not None:
            return lines.select(*columns)
        return build_master(self._built_lines(), self.orders(), self.products(), columns, "double")

    def master_once(self, columns: Sequence[str]) -> DataFrame:
        lines = self._lines()
        if lines is None:
            items = self._built_lines()
            once = lines_once(items, [c for c in items.columns if c != "order_item_id"])
            return build_master(once, self.orders(), self.products(), columns, "double")
        return lines_once(lines, [c for c in lines.columns if c != "order_item_id"]).select(*columns)
