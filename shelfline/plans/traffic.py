"""Traffic, channels and sources: conversion, revenue share, engagement, repeat rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline import config as C
from shelfline.functions import month_start, percent, safe_ratio, sum0
from shelfline.operators.distinct import distinct_counts
from shelfline.operators.keyed import group, share_of_total, share_within
from shelfline.operators.reshape import to_long, to_wide, values_of
from shelfline.sources import RetailTables


def is_valid(status: Column | str = "order_status") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return status.isin(*C.VALID_STATUSES)


def valid_orders(t: RetailTables) -> DataFrame:
    """Orders that count as sales."""
    return t.orders().where(is_valid())


def order_facts(t: RetailTables) -> DataFrame:
    """Orders without their zip, where the source can leave it out."""
    return getattr(t, "order_facts", t.orders)()


def _valid(t: RetailTables) -> DataFrame:
    return order_facts(t).where(is_valid())


# --- months -----------------------------------------------------------------

def monthly_traffic(t: RetailTables) -> DataFrame:
    return group(t.web_traffic().withColumn("month", month_start(F.col("date"))), "month").agg(
        sum0("sessions").alias("sessions"), sum0("unique_visitors").alias("unique_visitors"),
        sum0("page_views").alias("page_views"), F.avg("bounce_rate").alias("avg_bounce_rate"))


def monthly_sales(t: RetailTables) -> DataFrame:
    return group(t.sales().withColumn("month", month_start(F.col("date"))), "month").agg(
        sum0("revenue").alias("revenue"), sum0("cogs").alias("cogs"))


def monthly_orders(t: RetailTables) -> DataFrame:
    return group(_valid(t).withColumn("month", month_start(F.col("order_date"))), "month").agg(
        F.count("order_status").alias("valid_orders"))


def traffic_sales(t: RetailTables) -> DataFrame:
    """Months with traffic and sales; monthly frames are unique by construction."""
    joined = (monthly_traffic(t).join(monthly_sales(t), "month")
              .join(monthly_orders(t), "month", "left").na.fill(0, subset=["valid_orders"]))
    return joined.select(
        "*", percent(F.col("valid_orders"), F.col("sessions")).alias("conversion_rate"),
        safe_ratio(F.col("revenue"), F.col("sessions")).alias("revenue_per_session"),
        (F.col("revenue") - F.col("cogs")).alias("profit"))


def traffic_index(t: RetailTables) -> DataFrame:
    """Revenue, sessions and conversion with the first shared month at 100."""
    base = traffic_sales(t).select("month", "revenue", "sessions", "valid_orders", "conversion_rate")
    first = Window.partitionBy(F.lit(0)).orderBy("month")  # one row per month
    at = lambda c: safe_ratio(F.col(c), F.first(c).over(first)) * 100.0
    return base.select("*", at("revenue").alias("revenue_index"), at("sessions").alias("sessions_index"),
                       at("conversion_rate").alias("conversion_index"))


def traffic_index_long(t: RetailTables) -> DataFrame:
    return to_long(traffic_index(t), ["month"], ["revenue_index", "sessions_index", "conversion_index"],
                   "metric", "index_value",
                   {"revenue_index": "Revenue", "sessions_index": "Sessions", "conversion_index": "Conversion Rate"})


# --- channels ---------------------------------------------------------------

def orders_by_source(t: RetailTables) -> DataFrame:
    return group(_valid(t), "order_source").agg(F.countDistinct("order_id").alias("valid_orders"))


def revenue_by_source(t: RetailTables) -> DataFrame:
    """Net and gross revenue of valid order lines; lines are unique after de-duplication."""
    lines = t.lines(["order_item_id", "order_source", "line_revenue", "refund_amount", "order_status"])
    net = F.col("line_revenue") - F.coalesce(F.col("refund_amount"), F.lit(0))
    return group(lines.where(is_valid()).withColumn("net", net), "order_source").agg(
        sum0("net").alias("net_revenue"), sum0("line_revenue").alias("gross_revenue"),
        F.count("order_item_id").alias("order_items"))


def channel_summary(t: RetailTables) -> DataFrame:
    """Traffic share against net revenue share, channels of either side."""
    traffic = group(t.web_traffic(), "traffic_source").agg(
        sum0("sessions").alias("sessions"), sum0("unique_visitors").alias("unique_visitors"),
        sum0("page_views").alias("page_views"), F.avg("bounce_rate").alias("avg_bounce_rate"))
    revenue = revenue_by_source(t).withColumnRenamed("order_items", "valid_order_items")
    both = (traffic.withColumnRenamed("traffic_source", "channel")
            .join(revenue.withColumnRenamed("order_source", "channel"), "channel", "outer").na.fill(0))
    shares = share_of_total(both, traffic_share_pct="sessions", revenue_share_pct="net_revenue")
    return shares.select("*", safe_ratio(F.col("net_revenue"), F.col("sessions")).alias("revenue_per_session"),
                         (F.col("traffic_share_pct") - F.col("revenue_share_pct")).alias("share_gap_pct_point"))


def conversion_efficiency(t: RetailTables) -> DataFrame:
    """Orders per session and channel, flagged against the median channel."""
    traffic = group(t.web_traffic(), "traffic_source").agg(
        sum0("sessions").alias("sessions"), sum0("unique_visitors").alias("unique_visitors"),
        F.avg("bounce_rate").alias("avg_bounce_rate"),
        F.avg("avg_session_duration_sec").alias("avg_session_duration_sec"))
    joined = (traffic.withColumnRenamed("traffic_source", "channel")
              .join(orders_by_source(t).withColumnRenamed("order_source", "channel"), "channel", "left")
              .na.fill(0, subset=["valid_orders"]))
    rates = share_of_total(joined, traffic_share_pct="sessions").select(
        "*", percent(F.col("valid_orders"), F.col("sessions")).alias("conversion_rate"),
        (safe_ratio(F.col("valid_orders"), F.col("sessions")) * 10_000.0).alias("orders_per_10k_sessions"))
    middle = F.median("conversion_rate").over(Window.partitionBy(F.lit(0)))  # one row per channel
    return (rates.withColumn("median_conversion_rate", middle)
            .withColumn("at_or_above_median", F.col("conversion_rate") >= F.col("median_conversion_rate")))


def source_summary(t: RetailTables) -> DataFrame:
    """Traffic, revenue and orders per source with session-weighted bounce."""
    traffic = group(t.web_traffic(), "traffic_source").agg(
        sum0("sessions").alias("sessions"), sum0("unique_visitors").alias("unique_visitors"),
        sum0(F.col("bounce_rate") * F.col("sessions")).alias("weighted_bounce"),
        F.avg("avg_session_duration_sec").alias("avg_session_duration_sec"))
    traffic = traffic.withColumn("bounce_rate", safe_ratio(F.col("weighted_bounce"), F.col("sessions")))
    joined = (traffic.withColumnRenamed("traffic_source", "source")
              .join(revenue_by_source(t).withColumnRenamed("order_source", "source"), "source", "outer")
              .join(orders_by_source(t).withColumnRenamed("order_source", "source"), "source", "outer")
              .na.fill(0))
    per_session = lambda c: safe_ratio(F.col(c), F.col("sessions"))
    return share_of_total(joined, traffic_share_pct="sessions", revenue_share_pct="net_revenue").select(
        "*", per_session("net_revenue").alias("revenue_per_session"),
        (per_session("valid_orders") * 100.0).alias("conversion_rate"),
        (per_session("valid_orders") * 10_000.0).alias("orders_per_10k_sessions"),
        (F.col("traffic_share_pct") - F.col("revenue_share_pct")).alias("traffic_minus_revenue_pp"),
        (F.col("source") == C.SOCIAL_SOURCE).alias("is_social"))


def weighted_bounce(t: RetailTables) -> DataFrame:
    """Session-weighted bounce rate per source, next to the overall rate (percent)."""
    traffic = t.web_traffic().select("traffic_source", "sessions", (F.col("bounce_rate") * F.col("sessions")).alias("b"))
    sources = group(traffic, "traffic_source").agg(sum0("sessions").alias("sessions"), sum0("b").alias("b"))
    whole = Window.partitionBy(F.lit(0))
    overall = safe_ratio(F.sum("b").over(whole), F.sum("sessions").over(whole)) * 100.0
    return sources.select(F.col("traffic_source").alias("source"), "sessions",
                          percent(F.col("b"), F.col("sessions")).alias("bounce_rate_pct"),
                          overall.alias("overall_bounce_pct"))


def conversion_by_source(t: RetailTables) -> DataFrame:
    """Conversion of all sources with the median over sources that have traffic."""
    traffic = group(t.web_traffic(), "traffic_source").agg(sum0("sessions").alias("sessions"))
    both = (traffic.withColumnRenamed("traffic_source", "source")
            .join(orders_by_source(t).withColumnRenamed("order_source", "source"), "source", "outer").na.fill(0))
    rates = both.withColumn("conversion_rate", percent(F.col("valid_orders"), F.col("sessions")))
    return rates.withColumn("median_conversion_rate",
                            F.median("conversion_rate").over(Window.partitionBy(F.lit(0))))


def source_quality(t: RetailTables) -> DataFrame:
    """Every traffic source with its orders and revenue, 0 where it has none."""
    traffic = group(t.web_traffic(), "traffic_source").agg(
        sum0("sessions").alias("sessions"), sum0("unique_visitors").alias("unique_visitors"),
        F.avg("bounce_rate").alias("avg_bounce_rate"))
    orders = orders_by_source(t).select(F.col("order_source").alias("traffic_source"),
                                        F.col("valid_orders").alias("orders"))
    revenue = revenue_by_source(t).select(F.col("order_source").alias("traffic_source"),
                                          F.col("net_revenue").alias("revenue"))
    joined = (traffic.join(orders, "traffic_source", "left").join(revenue, "traffic_source", "left")
              .na.fill(0, subset=["orders", "revenue"]))
    return share_of_total(joined, traffic_share_pct="sessions", revenue_share_pct="revenue").select(
        "*", percent(F.col("orders"), F.col("sessions")).alias("conversion_rate"),
        safe_ratio(F.col("revenue"), F.col("sessions")).alias("revenue_per_session"),
        (F.col("traffic_share_pct") - F.col("revenue_share_pct")).alias("traffic_minus_revenue_pp"))


# --- orders inside the traffic window ----------------------------------------

def within_traffic(t: RetailTables) -> Column:
    """Whether an order date lies within the traffic history, both ends included.

    Where orders are stored by month, the months of both ends say which folders are read.
    """
    dates = t.web_traffic()

    def ends(value: Column) -> tuple[Column, Column]:
        return tuple(dates.select(fn(value)).scalar() for fn in (F.min, F.max))

    inside = F.col("order_date").between(*ends(F.col("date")))
    if t.MONTH:
        inside &= F.col(t.MONTH).between(*ends(month_start(F.col("date"))))
    return inside


def window_orders(t: RetailTables) -> DataFrame:
    """Valid orders dated within the traffic history, both ends included."""
    return _valid(t).where(within_traffic(t)).select(
        "order_id", "customer_id", "order_date", "order_status", "order_source")


def window_lines(t: RetailTables, columns: tuple[str, ...] = (
        "order_id", "customer_id", "order_source", "category", "quantity", "line_revenue")) -> DataFrame:
    """Unique valid order lines whose order lies within the traffic history."""
    own = list(dict.fromkeys(["order_item_id", "order_id", "order_status", "order_date", *([t.MONTH] if t.MONTH else []), *columns]))
    return t.lines(own).where(is_valid() & within_traffic(t)).select("order_item_id", *columns)


def _window_order_level(t: RetailTables) -> DataFrame:
    lines = window_lines(t, ("order_id", "customer_id", "order_source", "quantity", "line_revenue"))
    return group(lines, "order_id", "order_source", "customer_id").agg(
        sum0("line_revenue").alias("order_revenue"), sum0("quantity").alias("order_quantity"))


def engagement(t: RetailTables) -> DataFrame:
    """Session-weighted bounce and duration, and pages per session."""
    w = lambda c: sum0(F.col(c) * F.col("sessions"))
    traffic = group(t.web_traffic(), "traffic_source").agg(
        sum0("sessions").alias("sessions"), sum0("page_views").alias("total_page_views"),
        w("bounce_rate").alias("wb"), w("avg_session_duration_sec").alias("wd"))
    per = lambda c: safe_ratio(F.col(c), F.col("sessions"))
    return traffic.select("traffic_source", "sessions", "total_page_views", per("wb").alias("bounce_rate"),
                          per("wd").alias("avg_session_duration_sec"), per("total_page_views").alias("pages_per_session"))


def window_conversion(t: RetailTables) -> DataFrame:
    orders = distinct_counts(window_orders(t), "order_source", {"orders": "order_id", "customers": "customer_id"})
    traffic = group(t.web_traffic(), "traffic_source").agg(sum0("sessions").alias("sessions"))
    joined = (traffic.join(orders.withColumnRenamed("order_source", "traffic_source"), "traffic_source", "left")
              .na.fill(0, subset=["orders", "customers"]))
    return joined.withColumn("conversion_rate", percent(F.col("orders"), F.col("sessions")))


def source_value(t: RetailTables) -> DataFrame:
    """Revenue, orders, customers and order value per source, of lines with an order and a customer."""
    lines = window_lines(t, ("order_id", "customer_id", "order_source", "quantity", "line_revenue"))
    value = distinct_counts(lines.na.drop(subset=["order_id", "customer_id"]), "order_source",
                            {"orders": "order_id", "customers": "customer_id"},
                            {"revenue": "line_revenue", "total_quantity": "quantity"})
    return value.withColumn("aov", safe_ratio(F.col("revenue"), F.col("orders")))


def repeat_rate(t: RetailTables) -> DataFrame:
    """Share of a source's customers with more than one order."""
    per_customer = _window_order_level(t).groupBy("order_source", "customer_id").agg(F.countDistinct("order_id").alias("n"))
    summary = per_customer.groupBy("order_source").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n") > 1).alias("repeat_customers"))
    return summary.withColumn("repeat_rate_pct", percent(F.col("repeat_customers"), F.col("customers")))


def traffic_revenue_share(t: RetailTables) -> DataFrame:
    traffic = group(t.web_traffic(), "traffic_source").agg(sum0("sessions").alias("sessions"))
    revenue = _window_order_level(t).groupBy("order_source").agg(F.sum("order_revenue").alias("revenue"))
    joined = (traffic.join(revenue.withColumnRenamed("order_source", "traffic_source"), "traffic_source", "left")
              .na.fill(0, subset=["revenue"]))
    return share_of_total(joined, traffic_share_pct="sessions", revenue_share_pct="revenue").withColumn(
        "traffic_minus_revenue_pp", F.col("traffic_share_pct") - F.col("revenue_share_pct"))


def traffic_revenue_share_long(t: RetailTables) -> DataFrame:
    return to_long(traffic_revenue_share(t), ["traffic_source"], ["traffic_share_pct", "revenue_share_pct"],
                   "share_type", "share_pct",
                   {"traffic_share_pct": "Traffic Share", "revenue_share_pct": "Revenue Share"})


def product_preference(t: RetailTables) -> DataFrame:
    """Units per source and category and their share in the source."""
    lines = window_lines(t, ("order_id", "order_source", "category", "quantity"))
    units = group(lines, "order_source", "category").agg(sum0("quantity").alias("quantity"))
    return share_within(units, ["order_source"], "quantity", "category_share_pct")


def product_preference_wide(t: RetailTables) -> DataFrame:
    return to_wide(product_preference(t), ["order_source"], "category", "category_share_pct", values_of(t.products(), "category"), 0.0)


# --- customers ----------------------------------------------------------------

def customer_mix(t: RetailTables, attribute: str) -> DataFrame:
    """Customers per acquisition channel and attribute, complete profiles only."""
    complete = t.customers().na.drop(subset=["acquisition_channel", "age_group", "gender"])
    counts = complete.groupBy("acquisition_channel", attribute).agg(
        F.countDistinct("customer_id").alias("customers"))
    return share_within(counts, ["acquisition_channel"], "customers", "share_pct")


def customer_mix_wide(t: RetailTables, attribute: str) -> DataFrame:
    return to_wide(customer_mix(t, attribute), ["acquisition_channel"], attribute, "share_pct", values_of(t.customers(), attribute), 0.0)


