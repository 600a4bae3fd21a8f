"""Ten business questions. Each plan returns the whole ranking; ``answer`` picks the winner.

Big tables are first brought down to one row per join key. A product or customer
that holds a large part of the rows is then one row before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfline import config as C
from shelfline.functions import average_or_none, percent, safe_ratio, sum0
from shelfline.operators.keyed import best, group
from shelfline.plans.traffic import order_facts
from shelfline.sources import RetailTables


def answer(ranking: DataFrame, metric: str, label: str, largest: bool = True) -> DataFrame:
    return best(ranking, metric, label, largest)


def _order_days(t: RetailTables) -> DataFrame:
    """One row per customer and order day; a customer has at most one row per calendar day."""
    days = (group(order_facts(t).select("customer_id", "order_date", "order_id").where(F.col("order_date").isNotNull()),
                  "customer_id", "order_date")
            .agg(F.count(F.lit(1)).alias("orders"), F.min("order_id").alias("first_order")))
    before = F.lag("order_date").over(Window.partitionBy("customer_id").orderBy("order_date"))
    return days.withColumn("days_since", F.datediff("order_date", before))


def order_gaps(t: RetailTables) -> DataFrame:
    """Days since the customer's previous order, one row per order that has one.

    The gap is found between order days. Further orders of the same day follow at
    a gap of 0, so only the day's first order carries the distance.
    """
    days = _order_days(t)
    orders = order_facts(t).select("customer_id", "order_date", "order_id")
    each = orders.join(days, ["customer_id", "order_date"])
    gap = F.when(F.col("order_id") == F.col("first_order"), F.col("days_since")).otherwise(0)
    return each.select("customer_id", "order_id", "order_date", gap.alias("gap_days")).na.drop(subset=["gap_days"])


def median_gap(t: RetailTables) -> DataFrame:
    """Median gap over all consecutive orders of customers with at least two."""
    days = _order_days(t)
    spaced = days.where(F.col("days_since").isNotNull()).groupBy(F.col("days_since").alias("gap")).agg(
        F.count(F.lit(1)).alias("n"))
    repeats = days.where(F.col("orders") > 1).agg(F.lit(0).alias("gap"), F.sum(F.col("orders") - 1).alias("n"))
    gaps = spaced.unionByName(repeats).where(F.col("n") > 0).groupBy("gap").agg(F.sum("n").alias("n"))
    # One row per distinct gap, so at most as many rows as the history has days.
    line = Window.partitionBy(F.lit(0)).orderBy("gap")
    ranked = gaps.select("gap", F.sum("n").over(line).alias("upto"),
                         F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("gap")))
    return ranked.agg(F.max("total").alias("gaps"), ((value(low) + value(high)) / 2.0).alias("median_gap_days"))


def segment_margin(t: RetailTables) -> DataFrame:
    margin = safe_ratio(F.col("price") - F.col("cogs"), F.col("price"))
    return (group(t.products().select("segment", margin.alias("m")), "segment")
            .agg(F.avg("m").alias("avg_gross_margin")))


def return_reasons(t: RetailTables, category: str = C.STREETWEAR) -> DataFrame:
    per_product = group(t.returns(), "product_id", "return_reason").agg(F.count(F.lit(1)).alias("n"))
    chosen = t.products().where(F.col("category") == category).select("product_id")
    return per_product.join(chosen, "product_id").groupBy("return_reason").agg(F.sum("n").alias("returns"))


def bounce_by_source(t: RetailTables) -> DataFrame:
    return group(t.web_traffic(), "traffic_source").agg(F.avg("bounce_rate").alias("avg_bounce_rate"))


def promo_rate(t: RetailTables, prefix: str = C.PROMO_PREFIX) -> DataFrame:
    is_promo = F.coalesce(F.col("promo_id"), F.lit("")).startswith(prefix)
    counted = t.order_items().agg(F.count(F.lit(1)).alias("order_lines"),
                                  F.count_if(is_promo).alias("promo_lines"))
    return counted.withColumn("promo_rate_pct", percent(F.col("promo_lines"), F.col("order_lines")))


def orders_per_age_group(t: RetailTables) -> DataFrame:
    customers = t.customers().select("customer_id", "age_group").na.drop(subset=["age_group"])
    counts = group(order_facts(t).select("customer_id", "order_id"), "customer_id").agg(
        F.count("order_id").alias("orders"))
    per_group = (customers.join(counts, "customer_id", "left").na.fill(0, subset=["orders"])
                 .groupBy("age_group").agg(F.sum("orders").alias("total_orders"),
                                           F.count("customer_id").alias("total_customers")))
    return per_group.withColumn("avg_orders", safe_ratio(F.col("total_orders"), F.col("total_customers")))


def region_revenue(t: RetailTables) -> DataFrame:
    """Net revenue per region without cancelled orders; an unknown status stays in."""
    net = F.col("quantity") * F.col("unit_price") - F.coalesce(F.col("discount_amount"), F.lit(0))
    per_order = group(t.order_items(), "order_id").agg(F.sum(net).alias("net"))
    orders = t.orders().where(~F.col("order_status").eqNullSafe(C.CANCELLED_STATUS)).select("order_id", "zip")
    per_zip = group(per_order.join(orders, "order_id"), "zip").agg(F.sum("net").alias("net"))
    return group(per_zip.join(t.geography(), "zip"), "region").agg(sum0("net").alias("revenue"))


def region_revenue_text(t: RetailTables) -> DataFrame:
    amount = F.round(F.col("revenue").cast("decimal(28,4)"), 2)
    return region_revenue(t).select("region", F.concat(F.lit("$"), F.format_number(amount, 2)).alias("revenue"))


def cancelled_payments(t: RetailTables) -> DataFrame:
    cancelled = order_facts(t).where(F.col("order_status") == C.CANCELLED_STATUS)
    return group(cancelled, "payment_method").agg(F.count(F.lit(1)).alias("cancellations"))


def size_return_rate(t: RetailTables, sizes: tuple[str, ...] = C.RETURN_SIZES) -> DataFrame:
    """Returned lines over sold lines; a size on one side only has no rate."""
    products = t.products().where(F.col("size").isin(*sizes)).select("product_id", "size")

    def lines(df: DataFrame, name: str) -> DataFrame:
        per_product = group(df.select("product_id"), "product_id").agg(F.count(F.lit(1)).alias("n"))
        return per_product.join(products, "product_id").groupBy("size").agg(F.sum("n").alias(name))

    both = lines(t.order_items(), "sold_lines").join(lines(t.returns(), "returned_lines"), "size", "outer")
    return both.withColumn("return_rate_pct", percent(F.col("returned_lines"), F.col("sold_lines")))


def installment_value(t: RetailTables) -> DataFrame:
    return group(t.payments(), "installments").agg(average_or_none("payment_value").alias("avg_payment"))
