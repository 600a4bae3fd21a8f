"""Inventory: stock, sell-through, supply days, dead stock, top products, aging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline import config as C
from shelfline.functions import average_or_none, bucket_right_closed, clip, month_start, percent, sum0
from shelfline.operators import distribution as D
from shelfline.operators.joins import contract_join
from shelfline.operators.keyed import group, ranked, share_of_total
from shelfline.operators.reshape import to_long, to_wide
from shelfline.plans.traffic import is_valid
from shelfline.session import stored
from shelfline.sources import RetailTables
from shelfline.sources.schemas import require_columns

SKU = ("product_id", "product_name", "category")


def _monthly(t: RetailTables) -> DataFrame:
    return t.inventory().withColumn("month", month_start(F.col("snapshot_date")))


def checked_inventory(t: RetailTables) -> DataFrame:
    """Inventory with its category and product known and missing flags as 0."""
    needed = {"snapshot_date", *SKU, "stock_on_hand", "units_sold", "stockout_flag", "overstock_flag",
              "days_of_supply", "fill_rate", "sell_through_rate"}
    return (require_columns(_monthly(t), needed, "inventory").na.drop(subset=["category", "product_id"])
            .na.fill(0, subset=["stockout_flag", "overstock_flag"]))


def stock_and_sales(t: RetailTables) -> DataFrame:
    return group(_monthly(t), "month").agg(sum0("stock_on_hand").alias("total_stock_on_hand"),
                                           sum0("units_sold").alias("total_units_sold"))


def stock_and_sales_tail(t: RetailTables, months: int = 12) -> DataFrame:
    return ranked(stock_and_sales(t), [("month", True)], months)


def _per_category(t: RetailTables, *sums: Column) -> DataFrame:
    """Category measures from product totals: a product is counted once, without a distinct."""
    per_product = t.inventory().na.drop(subset=["category"]).groupBy("category", "product_id").agg(
        F.sum("stock_on_hand").alias("stock"), F.count("stock_on_hand").alias("stock_n"),
        F.sum("units_sold").alias("units"), F.count("units_sold").alias("units_n"))
    return per_product.groupBy("category").agg(*sums, F.count("product_id").alias("products"))


def category_stock(t: RetailTables) -> DataFrame:
    return _per_category(t, (F.sum("stock") / F.sum("stock_n")).alias("avg_stock_on_hand"),
                         sum0("stock").alias("total_stock_on_hand"))


def category_sales(t: RetailTables) -> DataFrame:
    return _per_category(t, sum0("units").alias("total_units_sold"),
                         (F.sum("units") / F.sum("units_n")).alias("avg_units_sold"))


def sell_through_bands(t: RetailTables) -> DataFrame:
    """Records in three bands; the bands leave gaps between them on purpose."""
    rate = F.col("sell_through_rate")

    def inside(low, low_in, high, high_in) -> Column:
        test = F.lit(True)
        if low is not None:
            test = test & (rate >= low if low_in else rate > low)
        if high is not None:
            test = test & (rate <= high if high_in else rate < high)
        return test

    known = t.inventory().na.drop(subset=["sell_through_rate"])
    counts = known.agg(F.count(F.lit(1)).alias("n"),
                       *[F.count_if(inside(*b[1:])).alias(b[0]) for b in C.SELL_THROUGH_BANDS])
    labels = [b[0] for b in C.SELL_THROUGH_BANDS]
    return (counts.select("n", F.explode(F.array(*[
        F.struct(F.lit(x).alias("segment"), F.col(f"`{x}`").alias("records")) for x in labels])).alias("b"))
        .select("b.segment", "b.records", percent(F.col("b.records"), F.col("n")).alias("record_share_pct")))


def sell_through_histogram(t: RetailTables) -> DataFrame:
    return D.histogram(t.inventory(), "sell_through_rate", C.HISTOGRAM_BINS)


def sell_through_density(t: RetailTables) -> DataFrame:
    return D.density(t.inventory(), "sell_through_rate", C.DENSITY_POINTS)


def category_sell_through(t: RetailTables) -> DataFrame:
    known = t.inventory().na.drop(subset=["category"])
    means = known.groupBy("category").agg(
        F.avg("sell_through_rate").alias("avg_sell_through"), F.count("product_id").alias("records"),
        sum0("units_sold").alias("total_units_sold"), sum0("stock_on_hand").alias("total_stock_on_hand"))
    middle = D.exact_quantiles(known, ["category"], "sell_through_rate", {"median_sell_through": 0.5})
    return means.join(middle, "category", "left")


def stockout_risk(t: RetailTables) -> DataFrame:
    known = t.inventory().na.drop(subset=["category", "product_id", "stockout_days", "units_sold",
                                          "sell_through_rate"])
    risk = known.groupBy("category").agg(
        F.count("product_id").alias("records"), F.count_if(F.col("stockout_days") > 0).alias("stockout_records"),
        sum0("stockout_days").alias("total_stockout_days"), sum0("units_sold").alias("total_units_sold"),
        F.avg("units_sold").alias("avg_units_sold"))
    return risk.withColumn("stockout_record_pct", percent(F.col("stockout_records"), F.col("records")))


# --- diagnosis by category and month ------------------------------------------------

def _rates(df: DataFrame) -> DataFrame:
    return df.select("*", (F.col("overstock_rate") * 100.0).alias("overstock_rate_pct"),
                     (F.col("stockout_rate") * 100.0).alias("stockout_rate_pct"))


def category_means(t: RetailTables) -> DataFrame:
    return _rates(checked_inventory(t).groupBy("category").agg(
        F.avg("sell_through_rate").alias("avg_sell_through_rate"),
        F.avg("stock_on_hand").alias("avg_stock_on_hand"), F.avg("units_sold").alias("avg_units_sold"),
        sum0("stock_on_hand").alias("total_stock_on_hand"), sum0("units_sold").alias("total_units_sold"),
        F.avg("days_of_supply").alias("avg_days_of_supply"), F.avg("fill_rate").alias("avg_fill_rate"),
        average_or_none("overstock_flag").alias("overstock_rate"),
        average_or_none("stockout_flag").alias("stockout_rate")))


def category_diagnosis(t: RetailTables) -> DataFrame:
    middle = D.exact_quantiles(checked_inventory(t), ["category"], "sell_through_rate",
                               {"median_sell_through_rate": 0.5})
    return category_means(t).join(middle, "category", "left")


def category_month_diagnosis(t: RetailTables) -> DataFrame:
    return _rates(group(checked_inventory(t), "month", "category").agg(
        sum0("stock_on_hand").alias("stock_on_hand"), sum0("units_sold").alias("units_sold"),
        F.avg("sell_through_rate").alias("avg_sell_through_rate"),
        F.avg("days_of_supply").alias("avg_days_of_supply"), F.avg("fill_rate").alias("avg_fill_rate"),
        average_or_none("overstock_flag").alias("overstock_rate"),
        average_or_none("stockout_flag").alias("stockout_rate")))


def sell_through_boxes(t: RetailTables) -> DataFrame:
    """Box statistics per category, numbered from the lowest mean sell-through."""
    known = checked_inventory(t).na.drop(subset=["sell_through_rate"])
    means = known.groupBy("category").agg(F.round(F.avg("sell_through_rate"), 10).alias("_mean"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_mean", "category"))
    boxes = D.box_stats(known, "category", "sell_through_rate")
    return boxes.join(means.select("category", place.alias("position")), "category")


def stock_and_units_long(t: RetailTables) -> DataFrame:
    return to_long(category_means(t), ["category"], ["avg_stock_on_hand", "avg_units_sold"], "metric", "value",
                   {"avg_stock_on_hand": "Avg Stock on Hand", "avg_units_sold": "Avg Units Sold"})


def flag_mix(t: RetailTables) -> DataFrame:
    labels = {"overstock_rate_pct": "Overstock flag", "stockout_rate_pct": "Stockout flag"}
    rates = to_long(category_means(t), ["category"], list(labels), "flag_type", "rate_pct", labels)
    return to_wide(rates, ["category"], "flag_type", "rate_pct", list(labels.values()), 0.0)


def supply_days_by_month(t: RetailTables) -> DataFrame:
    return group(checked_inventory(t), "month").agg(F.avg("days_of_supply").alias("avg_days_of_supply"))


def supply_days_histogram(t: RetailTables) -> DataFrame:
    return D.histogram(checked_inventory(t), "days_of_supply", C.HISTOGRAM_BINS)


def fill_against_sell_through(t: RetailTables, n: int = 20) -> DataFrame:
    """Months and categories that are best supplied yet sell worst."""
    known = category_month_diagnosis(t).na.drop(subset=["avg_fill_rate", "avg_sell_through_rate"])
    tie_free = known.withColumn("_f", F.round("avg_fill_rate", 10)).withColumn("_s", F.round("avg_sell_through_rate", 10))
    return ranked(tie_free, [("_f", True), ("_s", False), ("month", False), ("category", False)], n).drop("_f", "_s")


# --- products ---------------------------------------------------------------------------

def dead_stock(t: RetailTables) -> DataFrame:
    """Stock weighted by the share that does not sell, per product."""
    sku = group(checked_inventory(t), *SKU).agg(
        F.avg("stock_on_hand").alias("avg_stock_on_hand"), sum0("stock_on_hand").alias("total_stock_on_hand"),
        F.avg("sell_through_rate").alias("avg_sell_through_rate"),
        F.avg("days_of_supply").alias("avg_days_of_supply"), F.avg("units_sold").alias("avg_units_sold"))
    unsold = F.lit(1.0) - clip(F.col("avg_sell_through_rate"), high=1.0)
    return sku.withColumn("dead_stock_score", F.round(F.col("total_stock_on_hand") * unsold, 8))


def top_dead_stock(t: RetailTables, n: int = 15) -> DataFrame:
    scored = dead_stock(t).withColumn("_s", F.round("avg_sell_through_rate", 10))
    return ranked(scored, [("dead_stock_score", True), ("_s", False), ("product_id", False)], n).drop("_s")


def sku_performance(t: RetailTables) -> DataFrame:
    """Sell-through joined with revenue per product, scored by the mean of both percentile ranks."""
    stock = group(t.inventory().na.drop(subset=["product_id", "sell_through_rate"]), *SKU).agg(
        F.round(F.avg("sell_through_rate"), 10).alias("avg_sell_through_rate"),
        sum0("units_sold").alias("total_units_sold_inventory"), F.avg("stock_on_hand").alias("avg_stock_on_hand"),
        F.avg("days_of_supply").alias("avg_days_of_supply"))
    lines = t.lines(["order_item_id", *SKU, "quantity", "line_revenue", "refund_amount",
                           "order_status"]).where(is_valid())
    net = F.col("line_revenue") - F.coalesce(F.col("refund_amount"), F.lit(0))
    revenue = group(lines.withColumn("net", net), *SKU).agg(
        sum0("net").alias("net_revenue"), sum0("line_revenue").alias("gross_revenue"),
        sum0("quantity").alias("total_quantity_ordered"), F.count("order_item_id").alias("order_item_count"))
    both = stored(stock.join(revenue, list(SKU)), "sku")  # read once per rank
    scored = D.percentile_ranks(both, sell_through_rank_pct="avg_sell_through_rate", revenue_rank_pct="net_revenue")
    score = (F.col("sell_through_rank_pct") + F.col("revenue_rank_pct")) / 2
    return scored.withColumn("combined_score", F.round(score, 10))


def top_skus(t: RetailTables, n: int = 15) -> DataFrame:
    return ranked(sku_performance(t), [("combined_score", True), ("net_revenue", True), ("product_id", False)], n)


# --- aging ----------------------------------------------------------------------------------

def aging_value(t: RetailTables) -> DataFrame:
    """Inventory value per aging bucket and category, empty cells kept; products must be unique."""
    stock = t.inventory().select("product_id", "category", "stock_on_hand", "days_of_supply", "overstock_flag")
    bucket = bucket_right_closed(F.col("days_of_supply"), C.AGING_EDGES, C.AGING_LABELS)
    known = stock.na.drop(subset=["days_of_supply"]).withColumn("aging_bucket", bucket)
    per_product = known.groupBy("product_id", "category", "aging_bucket").agg(
        F.sum("stock_on_hand").alias("stock"), F.count("stock_on_hand").alias("stock_n"),
        F.count(F.lit(1)).alias("n"), F.sum("overstock_flag").alias("over"))
    costs = t.products().select("product_id", "cogs")
    priced = contract_join(per_product, costs, "product_id", "left", validate="many_to_one").na.drop(subset=["cogs"])
    cells = group(priced, "aging_bucket", "category").agg(
        F.sum(F.col("stock") * F.col("cogs")).alias("inventory_value"), F.sum("stock").alias("stock"),
        F.sum("stock_n").alias("stock_n"), F.sum("n").alias("sku_month_records"),
        F.sum("over").alias("overstock_records"))
    order = F.array(*[F.struct(F.lit(i + 1).alias("bucket_order"), F.lit(x).alias("aging_bucket"))
                      for i, x in enumerate(C.AGING_LABELS)])
    # Every category that is in stock, labelled with all buckets.
    grid = (priced.select("category").na.drop().distinct().select("category", F.explode(order).alias("b"))
            .select("category", "b.*"))
    filled = grid.join(cells, ["category", "aging_bucket"], "left")
    return filled.select(
        "aging_bucket", "bucket_order", "category", F.coalesce("inventory_value", F.lit(0)).alias("inventory_value"),
        (F.col("stock") / F.col("stock_n")).alias("avg_stock_on_hand"),
        F.coalesce("sku_month_records", F.lit(0)).alias("sku_month_records"),
        F.coalesce("overstock_records", F.lit(0)).alias("overstock_records"))


def aging_buckets(t: RetailTables) -> DataFrame:
    totals = aging_value(t).groupBy("aging_bucket", "bucket_order").agg(
        F.sum("inventory_value").alias("total_inventory_value"), F.sum("sku_month_records").alias("sku_month_records"),
        F.sum("overstock_records").alias("overstock_records"))
    return share_of_total(totals, value_share_pct="total_inventory_value")
