"""The retail tables derived from the generated star-schema Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.functions import label_map, month_start
from shelfline.sources.master import build_master, lines_once
from shelfline.sources.tables import RetailTables


def _nth(index: Column, *labels) -> Column:
    """``labels[index]``, the last one for every larger index."""
    out = None
    for i, label in enumerate(labels[:-1]):
        out = F.when(index == i, label) if out is None else out.when(index == i, label)
    return out.otherwise(labels[-1])


# Prices have two decimals and discounts whole percents, so amounts are whole
# numbers of cents or of 1/10000. Decimals are made from them once, and late.

def _cents() -> Column:
    return F.rint(F.col("l_extendedprice") * 100).cast("bigint")


def _percent() -> Column:
    return F.rint(F.col("l_discount") * 100).cast("bigint")


def _exact(units: Column, digits: int, kind: str = "decimal(18,4)") -> Column:
    unit = F.lit("0." + "0" * (digits - 1) + "1").cast(f"decimal({digits},{digits})")
    return (units.cast("decimal(18,0)") * unit).cast(kind)


def _promo_id(product: Column) -> Column:
    return F.concat(F.lit("PROMO-"), F.lpad((product % 50 + 1).cast("string"), 4, "0"))


class ParquetTestbed(RetailTables):
    # How generated codes stand for retail labels.
    SOURCES = {"1-URGENT": "organic_search", "2-HIGH": "paid_search", "3-MEDIUM": "social_media",
               "4-NOT SPECIFIED": "email_campaign"}
    TRAFFIC = {"click": "organic_search", "view": "paid_search", "signup": "social_media",
               "purchase": "email_campaign"}
    CATEGORIES = {"ECONOMY": "Streetwear", "STANDARD": "Outdoor"}
    LINE_ORDER = ("order_id", "product_id", "src_supplier", "src_shipdate", "quantity", "net", "off", "has_promo",
                  "refund")

    def _raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")

    def _order_facts(self) -> DataFrame:
        """Orders without the customer's zip; every order has its customer."""
        o, key = self._raw("orders"), F.col("o_orderkey")
        status = (F.when(F.col("o_orderstatus") == "F", F.when(key % 4 == 0, "returned").otherwise("delivered"))
                  .when(F.col("o_orderstatus") == "O", F.when(key % 2 == 0, "paid").otherwise("shipped"))
                  .otherwise(F.when(key % 3 == 0, "created").otherwise("cancelled")))
        return o.select(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"), status.alias("order_status"),
            F.coalesce(label_map(F.col("o_orderpriority"), self.SOURCES), F.lit("referral")).alias("order_source"),
            F.concat(F.lit("method_"), (key % 5).cast("string")).alias("payment_method"))

    def orders(self) -> DataFrame:
        zips = self._raw("customer").select(F.col("c_custkey").alias("customer_id"),
                                            F.col("c_nationkey").alias("zip"))
        return self._order_facts().join(zips, "customer_id").select(
            "order_id", "customer_id", "order_date", "order_status", "order_source", "payment_method", "zip")

    def order_facts(self) -> DataFrame:
        return self._order_facts()

    def payments(self) -> DataFrame:
        return self._raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"),
            _nth(F.col("o_custkey") % 5, 1, 3, 6, 9, 12).alias("installments"))

    def order_items(self) -> DataFrame:
        cents, percent = _cents(), _percent()
        return self._raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"), _exact(cents, 2, "decimal(12,2)").alias("unit_price"),
            F.when(F.col("l_discount") > 0, _exact(cents * percent, 4)).alias("discount_amount"),
            F.when(percent >= 6, _promo_id(F.col("l_partkey"))).alias("promo_id"),
            F.col("l_suppkey").alias("src_supplier"), F.col("l_returnflag").alias("src_flag"),
            F.col("l_shipdate").cast("date").alias("src_shipdate"))

    def products(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(12,2)")
        share = (F.lit(50) + F.col("p_size") % 30).cast("decimal(4,0)")
        return self._raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("product_name"),
            F.coalesce(label_map(F.col("p_type"), self.CATEGORIES), F.col("p_type")).alias("category"),
            F.col("p_brand").alias("segment"),
            _nth(F.col("p_size") % 6, "S", "M", "L", "XL", "XXL", "FREE").alias("size"), price.alias("price"),
            (price * F.lit("0.01").cast("decimal(4,2)") * share).cast("decimal(18,4)").alias("cogs"))

    def customers(self) -> DataFrame:
        balance = F.col("c_acctbal")
        return self._raw("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.when(balance < 0, F.lit(None).cast("string")).when(balance < 2500, "18-24")
             .when(balance < 5000, "25-34").when(balance < 7500, "35-44").otherwise("45+").alias("age_group"),
            _nth(F.col("c_custkey") % 3, "Female", "Male", "Other").alias("gender"),
            F.lower("c_mktsegment").alias("acquisition_channel"))

    def geography(self) -> DataFrame:
        regions = self._raw("region").select(F.col("r_regionkey").alias("_rk"), F.col("r_name").alias("region"))
        return (self._raw("nation").select(F.col("n_nationkey").alias("zip"), F.col("n_regionkey").alias("_rk"))
                .join(regions, "_rk").select("zip", "region"))

    def returns(self) -> DataFrame:
        number = F.col("l_linenumber")
        return self._raw("lineitem").where(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.when(number.isin(1, 2), "wrong_size").when(number == 3, "defective").when(number == 4, "late")
             .otherwise("changed_mind").alias("return_reason"))

    def web_traffic(self) -> DataFrame:
        ts = F.col("ts")
        before = F.dayofmonth(ts) - 1
        day = F.make_date((F.lit(1999) + F.floor(before / 12.0)).cast("int"), (before % 12 + 1).cast("int"),
                          (F.hour(ts) + 1).cast("int"))
        event = F.col("event_id")
        return (self._raw("events")
                .groupBy(day.alias("date"),
                         F.coalesce(label_map(F.col("event_type"), self.TRAFFIC), F.lit("direct"))
                         .alias("traffic_source"))
                .agg((F.count(F.lit(1)) * 100).cast("bigint").alias("sessions"),
                     F.countDistinct("user_id").alias("unique_visitors"),
                     (F.sum(event % 7 + 1) * 100).cast("bigint").alias("page_views"),
                     F.avg(F.when(event % 3 == 0, 1.0).otherwise(0.0)).alias("bounce_rate"),
                     F.avg((event % 600).cast("double")).alias("avg_session_duration_sec")))

    def inventory(self) -> DataFrame:
        monthly = (self._raw("lineitem")
                   .groupBy(month_start(F.col("l_shipdate").cast("date")).alias("_m"),
                            F.col("l_partkey").alias("product_id"))
                   .agg(F.sum("l_quantity").cast("bigint").alias("units_sold")))
        stock = (monthly.join(self.products().select("product_id", "product_name", "category"), "product_id")
                 .withColumn("stock_on_hand", F.col("product_id") % 97)
                 .withColumn("stockout_days",
                             F.when(F.col("product_id") % 3 == 0, F.col("product_id") % 9).otherwise(F.lit(0))))
        stocked, sold = F.col("stock_on_hand"), F.col("units_sold")
        return stock.select(
            F.last_day("_m").alias("snapshot_date"), "product_id", "product_name", "category", "stock_on_hand",
            "units_sold", "stockout_days",
            F.when(F.col("stockout_days") > 0, 1).otherwise(0).alias("stockout_flag"),
            F.when(stocked > sold * 3, 1).otherwise(0).alias("overstock_flag"),
            (F.lit(30.0) * stocked / sold).alias("days_of_supply"),
            (F.lit(1.0) - F.col("stockout_days") / F.lit(30.0)).alias("fill_rate"),
            (sold / (F.lit(1.0) * sold + stocked)).alias("sell_through_rate"))

    def _lines(self) -> DataFrame:
        """Order lines in whole numbers only: small to shuffle and quick to compare."""
        cents, percent, quantity = _cents(), _percent(), F.col("l_quantity").cast("int")
        return self._raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("src_supplier"), F.col("l_shipdate").cast("date").alias("src_shipdate"),
            quantity.alias("quantity"), (quantity * cents * 100 - cents * percent).alias("net"),
            F.when(F.col("l_discount") > 0, cents * percent).alias("off"), (percent >= 6).alias("has_promo"),
            F.when(F.col("l_returnflag") == "R", cents * 100).alias("refund"))

    def _typed(self, lines: DataFrame) -> DataFrame:
        own = [c for c in lines.columns if c not in ("net", "off", "has_promo", "refund")]
        return lines.select(
            *own, _exact(F.col("net"), 4).alias("line_revenue"), _exact(F.col("off"), 4).alias("discount_amount"),
            F.when(F.col("has_promo"), _promo_id(F.col("product_id"))).alias("promo_id"),
            _exact(F.col("refund"), 4).alias("refund_amount"))

    def master(self, columns: Sequence[str]) -> DataFrame:
        return build_master(self._typed(self._lines()), self._order_facts(), self.products(), columns)

    def master_once(self, columns: Sequence[str]) -> DataFrame:
        lines = lines_once(self._lines(), self.LINE_ORDER)
        return build_master(self._typed(lines), self._order_facts(), self.products(), columns)

    def products_apart(self) -> bool:
        return True

    def sales(self) -> DataFrame:
        """Daily totals. Lines are summed per order before they meet the orders."""
        costs = self.products().select("product_id", "cogs")
        lines = self._lines().select("order_id", "product_id", "net", "quantity").join(costs, "product_id")
        orders = lines.groupBy("order_id").agg(F.sum("net").alias("net"),
                                               F.sum(F.col("quantity") * F.col("cogs")).alias("cogs"))
        days = (orders.join(self._order_facts().select("order_id", "order_date"), "order_id")
                .groupBy(F.col("order_date").alias("date")).agg(F.sum("net").alias("net"), F.sum("cogs").alias("cogs")))
        return days.select("date", _exact(F.col("net"), 4).alias("revenue"), F.col("cogs").cast("decimal(18,4)").alias("cogs"))
