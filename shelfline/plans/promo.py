"""Promotions: revenue share, margin, order value, quantities and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline import config as C
from shelfline.functions import average_or_none, month_start, percent, safe_ratio, sum0
from shelfline.operators.distribution import exact_quantiles
from shelfline.operators.joins import contract_join
from shelfline.operators.keyed import group, share_within
from shelfline.operators.reshape import to_long, to_wide
from shelfline.plans.traffic import is_valid, order_facts
from shelfline.sources import RetailTables


def has_promo(promo: Column | str = "promo_id") -> Column:
    """A line counts as promo unless its promo id is missing or the placeholder."""
    promo = F.col(promo) if isinstance(promo, str) else promo
    return F.coalesce(promo, F.lit(C.NO_PROMO)) != C.NO_PROMO


def promo_group(flag: Column) -> Column:
    return F.when(flag, C.PROMO_LABEL).otherwise(C.NON_PROMO_LABEL)


def _dated_lines(t: RetailTables) -> DataFrame:
    """Valid order items with their order's month; an order id must be unique among orders."""
    net = F.col("quantity") * F.col("unit_price") - F.coalesce(F.col("discount_amount"), F.lit(0))
    items = t.order_items().select("order_id", net.alias("revenue"), has_promo().alias("is_promo"))
    per_order = items.groupBy("order_id", "is_promo").agg(F.sum("revenue").alias("revenue"),
                                                          F.count(F.lit(1)).alias("lines"))
    orders = order_facts(t).select("order_id", "order_date", "order_status")
    joined = contract_join(per_order, orders, "order_id", "left", validate="many_to_one")
    return joined.where(is_valid()).withColumn("month", month_start(F.col("order_date")))


def monthly_promo_share(t: RetailTables) -> DataFrame:
    """Share of each month's revenue by promo group, one column per group."""
    monthly = group(_dated_lines(t).withColumn("promo_group", promo_group(F.col("is_promo"))),
                    "month", "promo_group").agg(sum0("revenue").alias("revenue"))
    shares = share_within(monthly, ["month"], "revenue", "share_pct")
    return to_wide(shares, ["month"], "promo_group", "share_pct", C.PROMO_GROUPS, 0.0)


def promo_share_by_month(t: RetailTables) -> DataFrame:
    promo = F.col("is_promo")
    monthly = group(_dated_lines(t), "month").agg(
        sum0("revenue").alias("total_revenue"), sum0(F.when(promo, F.col("revenue"))).alias("promo_revenue"),
        sum0(F.when(promo, F.col("lines"))).alias("promo_order_items"), F.sum("lines").alias("total_order_items"))
    share = percent(F.col("promo_revenue"), F.col("total_revenue"))
    whole = Window.partitionBy(F.lit(0))
    return monthly.select(
        "*", (F.col("total_revenue") - F.col("promo_revenue")).alias("non_promo_revenue"),
        share.alias("promo_revenue_share_pct"), (F.lit(100.0) - share).alias("non_promo_revenue_share_pct"),
        percent(F.sum("promo_revenue").over(whole), F.sum("total_revenue").over(whole)).alias("overall_promo_share_pct"))


def promo_share_by_year(t: RetailTables) -> DataFrame:
    """Yearly shares from yearly sums, not from the monthly shares."""
    yearly = (promo_share_by_month(t).groupBy(F.year("month").alias("year"))
              .agg(*[F.sum(c).alias(c) for c in ("total_revenue", "promo_revenue", "non_promo_revenue")]))
    return yearly.withColumn("promo_revenue_share_pct", percent(F.col("promo_revenue"), F.col("total_revenue")))


# --- margin and order value on unique lines -------------------------------------

def _lines(t: RetailTables, *columns: str) -> DataFrame:
    own = list(dict.fromkeys(["order_item_id", "order_status", "promo_id", *columns]))
    flag = promo_group(has_promo())
    return t.lines(own).where(is_valid()).withColumn("promo_group", flag)


def _margin(discount_already_net: bool) -> Column:
    profit = F.col("revenue") - F.col("cogs")
    if not discount_already_net:
        profit = profit - F.col("discount")
    return percent(profit, F.col("revenue"))


def _margin_sums(lines: DataFrame, *keys: str) -> DataFrame:
    return group(lines, *keys).agg(
        sum0("line_revenue").alias("revenue"), sum0("line_cogs").alias("cogs"),
        sum0("discount_amount").alias("discount"), sum0("quantity").alias("quantity"),
        F.count("order_item_id").alias("order_items"))


def promo_margin(t: RetailTables, discount_already_net: bool = False) -> DataFrame:
    """Margin per promo group.

    By default the discount is taken off revenue once more, as the published
    figures do; ``discount_already_net`` leaves it out where revenue is net.
    Lines are first brought to one row per order and group, so counting orders
    needs no second de-duplication.
    """
    lines = _lines(t, "order_id", "line_revenue", "line_cogs", "discount_amount", "quantity")
    per_order = lines.groupBy("promo_group", "order_id").agg(
        sum0("line_revenue").alias("r"), sum0("line_cogs").alias("c"), sum0("discount_amount").alias("d"),
        sum0("quantity").alias("q"), F.count("order_item_id").alias("n"))
    groups = per_order.groupBy("promo_group").agg(
        F.sum("r").alias("revenue"), F.sum("c").alias("cogs"), F.sum("d").alias("discount"),
        F.sum("q").alias("quantity"), F.sum("n").alias("order_items"), F.count("order_id").alias("orders"))
    return groups.withColumn("margin", _margin(discount_already_net))


def overall_margin(t: RetailTables, discount_already_net: bool = False) -> DataFrame:
    lines = _lines(t, "line_revenue", "line_cogs", "discount_amount", "quantity")
    return (_margin_sums(lines, "promo_group").agg(*[F.sum(c).alias(c) for c in ("revenue", "cogs", "discount")])
            .withColumn("overall_margin", _margin(discount_already_net)))


def margin_by_month(t: RetailTables, discount_already_net: bool = False) -> DataFrame:
    lines = _lines(t, "order_date", "line_revenue", "line_cogs", "discount_amount", "quantity")
    monthly = _margin_sums(lines.withColumn("month", month_start(F.col("order_date"))), "month", "promo_group")
    return monthly.withColumn("margin_pct", _margin(discount_already_net))


def order_group_value(t: RetailTables) -> DataFrame:
    """Mean and median order value per promo group; a mixed order counts in both groups with its part."""
    part = (_lines(t, "order_id", "line_revenue").na.drop(subset=["order_id"])
            .groupBy("order_id", "promo_group").agg(sum0("line_revenue").alias("order_revenue")))
    summary = part.groupBy("promo_group").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_revenue").alias("revenue"),
        average_or_none("order_revenue").alias("aov"))
    whole = Window.partitionBy(F.lit(0))
    summary = summary.withColumn("overall_aov",
                                 safe_ratio(F.sum("revenue").over(whole), F.sum("orders").over(whole)))
    middle = exact_quantiles(part, ["promo_group"], "order_revenue", {"median_order_value": 0.5})
    return summary.join(middle, "promo_group")


# --- whole orders ----------------------------------------------------------------

def order_promo(t: RetailTables) -> DataFrame:
    """One row per order; any promo line makes it a promo order."""
    lines = _lines(t, "order_id", "order_date", "line_revenue", "quantity", "discount_amount")
    orders = group(lines.withColumn("p", has_promo()), "order_id").agg(
        F.min("order_date").alias("order_date"), sum0("line_revenue").alias("revenue"),
        sum0("discount_amount").alias("discount"), sum0("quantity").alias("quantity"),
        F.bool_or("p").alias("has_promo"))
    gross = F.col("revenue") + F.col("discount")
    return orders.select(
        "*", month_start(F.col("order_date")).alias("month"), promo_group(F.col("has_promo")).alias("promo_group"),
        gross.alias("gross_before_discount"), (safe_ratio(F.col("discount"), gross, 0.0) * 100.0).alias("discount_pct"))


def with_quantity(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Add the ordered quantity from the lines where the order table lacks it."""
    if "quantity" in orders.columns:
        return orders
    per_order = group(lines, "order_id").agg(sum0("quantity").alias("quantity"))
    return contract_join(orders, per_order, "order_id", "left", validate="one_to_one")


def order_value(t: RetailTables) -> DataFrame:
    """Revenue over orders, per group and overall."""
    groups = order_promo(t).groupBy("promo_group").agg(F.sum("revenue").alias("revenue"),
                                                       F.count("order_id").alias("orders"))
    whole = Window.partitionBy(F.lit(0))
    return groups.select("*", safe_ratio(F.col("revenue"), F.col("orders")).alias("aov"),
                         safe_ratio(F.sum("revenue").over(whole), F.sum("orders").over(whole)).alias("overall_aov"))


def orders_by_month(t: RetailTables) -> DataFrame:
    return group(order_promo(t), "month", "promo_group").agg(F.count("order_id").alias("orders"))


def quantity_per_order(t: RetailTables) -> DataFrame:
    orders = order_promo(t)
    groups = orders.groupBy("promo_group").agg(F.count("order_id").alias("orders"),
                                               F.sum("quantity").alias("total_quantity"))
    return groups.withColumn("quantity_per_order", safe_ratio(F.col("total_quantity"), F.col("orders")))


def selling_price(t: RetailTables) -> DataFrame:
    groups = order_promo(t).groupBy("promo_group").agg(F.sum("revenue").alias("revenue"),
                                                       F.sum("quantity").alias("total_quantity"))
    return groups.withColumn("asp", safe_ratio(F.col("revenue"), F.col("total_quantity")))


def discount_effect(t: RetailTables) -> DataFrame:
    """Order value before and after discount."""
    groups = order_promo(t).groupBy("promo_group").agg(
        F.count("order_id").alias("orders"), F.sum("revenue").alias("revenue_after_discount"),
        F.sum("gross_before_discount").alias("revenue_before_discount"), F.sum("discount").alias("total_discount"))
    before = safe_ratio(F.col("revenue_before_discount"), F.col("orders"))
    after = safe_ratio(F.col("revenue_after_discount"), F.col("orders"))
    return groups.select("*", before.alias("aov_before_discount"), after.alias("aov_after_discount"),
                         (before - after).alias("aov_discount_gap"))


def discount_effect_long(t: RetailTables) -> DataFrame:
    return to_long(discount_effect(t), ["promo_group"], ["aov_before_discount", "aov_after_discount"],
                   "aov_type", "aov",
                   {"aov_before_discount": "Before discount", "aov_after_discount": "After discount"})


# --- units by category -------------------------------------------------------------

def promo_units(t: RetailTables) -> DataFrame:
    """Units per category and promo group; here any promo id at all makes a promo line."""
    lines = t.lines(["order_item_id", "category", "quantity", "promo_id", "order_status"]).where(is_valid())
    units = group(lines.withColumn("promo_group", promo_group(F.col("promo_id").isNotNull())),
                  "category", "promo_group").agg(sum0("quantity").alias("units_sold"))
    return share_within(units, ["category"], "units_sold", "units_share_pct")


def promo_units_wide(t: RetailTables) -> DataFrame:
    return to_wide(promo_units(t), ["category"], "promo_group", "units_share_pct", C.PROMO_GROUPS, 0.0)
