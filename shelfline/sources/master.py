"""The denormalised order line: items, their order and product, and refunds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfline.operators.keyed import first_per_key

ORDER_COLUMNS = ("customer_id", "order_date", "order_status", "order_source")
PRODUCT_COLUMNS = ("product_name", "category", "segment", "cogs")


def order_lines(items: DataFrame, money: str = "decimal(18,4)") -> DataFrame:
    """Add ``line_revenue``, net of discount, to the items."""
    net = F.col("quantity") * F.col("unit_price") - F.coalesce(F.col("discount_amount"), F.lit(0))
    return items.withColumn("line_revenue", net.cast(money))


def lines_once(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per order_item_id, the smallest by ``order``.

    Runs on the item table, before the look-ups: order and product columns depend
    on the item's ids only, so the same rows survive, and the joins see fewer.
    """
    return first_per_key(lines, ["order_item_id"], order)


def build_master(lines: DataFrame, orders: DataFrame, products: DataFrame, columns: Sequence[str],
                 money: str = "decimal(18,4)") -> DataFrame:
    """Join only what ``columns`` need.

    Every line counts in every query: one without its order or product keeps NULL
    in those columns. So a look-up table whose columns are not asked for need not
    be joined, and any column list gives the same lines.
    """
    wanted = list(columns)
    out = lines
    if set(wanted) & set(ORDER_COLUMNS):
        own = [c for c in ORDER_COLUMNS if c in wanted]
        out = out.join(orders.select("order_id", *own), "order_id", "left")
    return with_products(out, products, wanted, money).select(*wanted)


def with_products(lines: DataFrame, products: DataFrame, columns: Sequence[str], money: str = "decimal(18,4)") -> DataFrame:
    """Look up the product columns among ``columns``, if any."""
    own = [c for c in PRODUCT_COLUMNS if c in columns or (c == "cogs" and "line_cogs" in columns)]
    if not own:
        return lines
    out = lines.join(products.select("product_id", *own), "product_id", "left")
    return out.withColumn("line_cogs", (F.col("quantity") * F.col("cogs")).cast(money)) if "line_cogs" in columns else out
