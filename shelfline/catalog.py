"""The registered queries: a name, a plan over the tables, and the columns of the result.

Columns are listed as ``name:type``; the type is ``s`` string, ``l`` bigint,
``i`` int, ``d`` date, ``b`` boolean, ``m`` exact money, or a number of decimals
for a double (6 where nothing is given). The same list shapes the Spark result
and the checking SQL, so both sides have equal types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shelfline.plans import inventory as inv, promo, questions as q, traffic as tr
from shelfline.operators.joins import key_profile
from shelfline.sources import RetailTables, kept_tables

_SPARK = {"s": "string", "l": "bigint", "i": "int", "d": "date", "b": "boolean", "m": "decimal(28,4)"}
_SQL = {"s": "VARCHAR", "l": "BIGINT", "i": "INTEGER", "d": "DATE", "b": "BOOLEAN", "m": "DECIMAL(28,4)"}


@dataclass(frozen=True)
class Query:
    build: Callable[[RetailTables], DataFrame]
    columns: str

    def fields(self) -> list[tuple[str, str]]:
        """``(name, type)`` pairs; names with blanks use ``_`` for the blank, written as ``~``."""
        out = []
        for item in self.columns.split():
            name, _, kind = item.partition(":")
            out.append((name.replace("~", " "), kind or "6"))
        return out

    def shape(self, df: DataFrame) -> DataFrame:
        cols = []
        for name, kind in self.fields():
            col = F.col(f"`{name}`")
            if kind in _SPARK:
                col = col.cast(_SPARK[kind])
            else:  # plain arithmetic, so that both engines round equal doubles equally
                unit = F.lit(float(10 ** int(kind)))
                col = F.floor(col.cast("double") * unit + F.lit(0.5)).cast("double") / unit
            cols.append(col.alias(name))
        return df.select(*cols)

    def shape_sql(self, sql: str) -> str:
        cols = []
        for name, kind in self.fields():
            ref = f'"{name}"'
            cols.append(f"CAST({ref} AS {_SQL[kind]}) AS {ref}" if kind in _SQL
                        else f"FLOOR(CAST({ref} AS DOUBLE) * 1E{int(kind)} + 0.5E0) / 1E{int(kind)} AS {ref}")
        return f"SELECT {', '.join(cols)} FROM ({sql.strip()}) result"

    def run(self, tables: RetailTables) -> DataFrame:
        return self.shape(self.build(tables))


# Fixed values of the generated data, for wide results with known columns.
CATEGORIES = ("Streetwear", "Outdoor", "LARGE", "MEDIUM", "PROMO", "SMALL")
AGES = ("18-24", "25-34", "35-44", "45+")
GENDERS = ("Female", "Male", "Other")

_MASTER = ["order_item_id", "order_id", "customer_id", "order_date", "order_status", "order_source", "product_id",
           "product_name", "category", "segment", "quantity", "discount_amount", "promo_id", "line_revenue",
           "line_cogs", "refund_amount", "src_supplier", "src_shipdate"]
_MASTER_COLUMNS = ("order_item_id:l order_id:l customer_id:l order_date:d order_status:s order_source:s product_id:l "
                   "product_name:s category:s segment:s quantity:i discount_amount:m promo_id:s line_revenue:m "
                   "line_cogs:m refund_amount:m src_supplier:l src_shipdate:d")


def _join_contract(t: RetailTables) -> DataFrame:
    return key_profile(t.order_items(), ["order_id"], "order_items").unionByName(
        key_profile(tr.order_facts(t), ["order_id"], "orders"))


RETAIL: dict[str, Query] = {
    # sources, filters, joins
    "scan_project": Query(lambda t: tr.order_facts(t).select("order_id", "order_date", "order_status"),
                          "order_id:l order_date:d order_status:s"),
    "valid_orders": Query(tr.valid_orders, "order_id:l customer_id:l order_date:d order_status:s order_source:s "
                                           "payment_method:s zip:l"),
    "master": Query(lambda t: t.master(_MASTER), _MASTER_COLUMNS),
    "master_dedup": Query(lambda t: t.master_once(_MASTER), _MASTER_COLUMNS),
    "join_contract": Query(_join_contract, "side:s keys:l repeated_keys:l rows:l"),
    "monthly_traffic": Query(tr.monthly_traffic, "month:d sessions:l unique_visitors:l page_views:l avg_bounce_rate"),
    "monthly_sales": Query(tr.monthly_sales, "month:d revenue:m cogs:m"),
    "orders_by_source": Query(tr.orders_by_source, "order_source:s valid_orders:l"),
    # ten questions
    "q01_gap_days": Query(q.order_gaps, "customer_id:l order_id:l order_date:d gap_days:i"),
    "q01_median_gap": Query(q.median_gap, "gaps:l median_gap_days"),
    "q02_segment_margin": Query(lambda t: q.answer(q.segment_margin(t), "avg_gross_margin", "segment"),
                                "segment:s avg_gross_margin"),
    "q03_return_reason": Query(lambda t: q.answer(q.return_reasons(t), "returns", "return_reason"),
                               "return_reason:s returns:l"),
    "q04_bounce": Query(lambda t: q.answer(q.bounce_by_source(t), "avg_bounce_rate", "traffic_source", largest=False),
                        "traffic_source:s avg_bounce_rate"),
    "q05_promo_rate": Query(q.promo_rate, "order_lines:l promo_lines:l promo_rate_pct"),
    "q06_age_group": Query(lambda t: q.answer(q.orders_per_age_group(t), "avg_orders", "age_group"),
                           "age_group:s total_orders:l total_customers:l avg_orders"),
    "q07_region_revenue": Query(lambda t: q.answer(q.region_revenue(t), "revenue", "region"), "region:s revenue:m"),
    "q07_region_revenue_fmt": Query(q.region_revenue_text, "region:s revenue:s"),
    "q08_cancel_payment": Query(lambda t: q.answer(q.cancelled_payments(t), "cancellations", "payment_method"),
                                "payment_method:s cancellations:l"),
    "q09_size_return_rate": Query(lambda t: q.answer(q.size_return_rate(t), "return_rate_pct", "size"),
                                  "size:s sold_lines:l returned_lines:l return_rate_pct"),
    "q10_installment": Query(lambda t: q.answer(q.installment_value(t), "avg_payment", "installments"),
                             "installments:i avg_payment"),
    # traffic and channels
    "traffic_sales_monthly": Query(tr.traffic_sales, "month:d sessions:l unique_visitors:l page_views:l avg_bounce_rate "
                                   "revenue:m cogs:m valid_orders:l conversion_rate revenue_per_session profit:m"),
    "c01_index": Query(tr.traffic_index, "month:d revenue:m sessions:l valid_orders:l conversion_rate revenue_index "
                                         "sessions_index conversion_index"),
    "c01_long": Query(tr.traffic_index_long, "month:d metric:s index_value"),
    "channel_summary": Query(tr.channel_summary, "channel:s sessions:l unique_visitors:l page_views:l avg_bounce_rate "
                             "net_revenue:m gross_revenue:m valid_order_items:l traffic_share_pct revenue_share_pct "
                             "revenue_per_session share_gap_pct_point"),
    "conversion_efficiency": Query(tr.conversion_efficiency, "channel:s sessions:l unique_visitors:l avg_bounce_rate "
                                   "avg_session_duration_sec valid_orders:l traffic_share_pct conversion_rate "
                                   "orders_per_10k_sessions median_conversion_rate at_or_above_median:b"),
    "source_summary": Query(tr.source_summary, "source:s sessions:l unique_visitors:l weighted_bounce "
                            "avg_session_duration_sec bounce_rate net_revenue:m gross_revenue:m order_items:l "
                            "valid_orders:l traffic_share_pct revenue_share_pct revenue_per_session conversion_rate "
                            "orders_per_10k_sessions traffic_minus_revenue_pp is_social:b"),
    "c07_bounce": Query(tr.weighted_bounce, "source:s sessions:l bounce_rate_pct overall_bounce_pct"),
    "c08_conversion": Query(tr.conversion_by_source, "source:s sessions:l valid_orders:l conversion_rate "
                                                     "median_conversion_rate"),
    "source_quality": Query(tr.source_quality, "traffic_source:s sessions:l unique_visitors:l avg_bounce_rate orders:l "
                            "revenue:m traffic_share_pct revenue_share_pct conversion_rate revenue_per_session "
                            "traffic_minus_revenue_pp"),
    "src_window_orders": Query(tr.window_orders, "order_id:l customer_id:l order_date:d order_status:s order_source:s"),
    "src_window_lines": Query(tr.window_lines, "order_item_id:l order_id:l customer_id:l order_source:s category:s "
                                               "quantity:i line_revenue:m"),
    "c25_conversion": Query(tr.window_conversion, "traffic_source:s sessions:l orders:l customers:l conversion_rate"),
    "source_value": Query(tr.source_value, "order_source:s revenue:m orders:l customers:l total_quantity:l aov"),
    "c27_engagement": Query(tr.engagement, "traffic_source:s sessions:l total_page_views:l bounce_rate "
                                           "avg_session_duration_sec pages_per_session"),
    "c28_age_mix": Query(lambda t: tr.customer_mix(t, "age_group"),
                         "acquisition_channel:s age_group:s customers:l share_pct"),
    "c28_gender_mix": Query(lambda t: tr.customer_mix(t, "gender"),
                            "acquisition_channel:s gender:s customers:l share_pct"),
    "c28_age_wide": Query(lambda t: tr.customer_mix_wide(t, "age_group"),
                          "acquisition_channel:s " + " ".join(AGES)),
    "c28_gender_wide": Query(lambda t: tr.customer_mix_wide(t, "gender"),
                             "acquisition_channel:s " + " ".join(GENDERS)),
    "c29_repeat_rate": Query(tr.repeat_rate, "order_source:s customers:l repeat_customers:l repeat_rate_pct"),
    "c30_share": Query(tr.traffic_revenue_share, "traffic_source:s sessions:l revenue:m traffic_share_pct "
                                                 "revenue_share_pct traffic_minus_revenue_pp"),
    "c30_share_long": Query(tr.traffic_revenue_share_long, "traffic_source:s share_type:s share_pct"),
    "c31_product_pref": Query(tr.product_preference, "order_source:s category:s quantity:l category_share_pct"),
    "c31_wide": Query(lambda t: tr.product_preference_wide(t), "order_source:s " + " ".join(CATEGORIES)),
    # promotions
    "promo_share_monthly": Query(promo.monthly_promo_share, "month:d Promo Non-promo"),
    "c09_margin": Query(promo.promo_margin, "promo_group:s revenue:m cogs:m discount:m quantity:l order_items:l "
                                            "orders:l margin"),
    "overall_margin": Query(promo.overall_margin, "revenue:m cogs:m discount:m overall_margin"),
    "c10_aov": Query(promo.order_group_value, "promo_group:s orders:l revenue:m aov overall_aov median_order_value"),
    "c11_margin_monthly": Query(promo.margin_by_month, "month:d promo_group:s revenue:m cogs:m discount:m quantity:l "
                                                       "order_items:l margin_pct"),
    "c12_promo_share": Query(promo.promo_share_by_month, "month:d total_revenue:m promo_revenue:m promo_order_items:l "
                             "total_order_items:l non_promo_revenue:m promo_revenue_share_pct "
                             "non_promo_revenue_share_pct overall_promo_share_pct"),
    "c13_promo_share_year": Query(promo.promo_share_by_year, "year:i total_revenue:m promo_revenue:m "
                                                             "non_promo_revenue:m promo_revenue_share_pct"),
    "order_promo": Query(promo.order_promo, "order_id:l order_date:d revenue:m discount:m quantity:l has_promo:b month:d "
                                            "promo_group:s gross_before_discount:m discount_pct"),
    "c14_aov": Query(promo.order_value, "promo_group:s revenue:m orders:l aov overall_aov"),
    "c15_orders_monthly": Query(promo.orders_by_month, "month:d promo_group:s orders:l"),
    "c16_qty_per_order": Query(promo.quantity_per_order, "promo_group:s orders:l total_quantity:l quantity_per_order"),
    "c17_asp": Query(promo.selling_price, "promo_group:s revenue:m total_quantity:l asp"),
    "c18_aov_discount": Query(promo.discount_effect, "promo_group:s orders:l revenue_after_discount:m "
                              "revenue_before_discount:m total_discount:m aov_before_discount aov_after_discount "
                              "aov_discount_gap"),
    "c18_aov_long": Query(promo.discount_effect_long, "promo_group:s aov_type:s aov"),
    "c37_promo_units": Query(promo.promo_units, "category:s promo_group:s units_sold:l units_share_pct"),
    "c37_promo_units_wide": Query(promo.promo_units_wide, "category:s Promo Non-promo"),
    # inventory
    "c19_stock_sales": Query(inv.stock_and_sales, "month:d total_stock_on_hand:l total_units_sold:l"),
    "c19_stock_sales_tail": Query(inv.stock_and_sales_tail, "month:d total_stock_on_hand:l total_units_sold:l"),
    "c20_category_stock": Query(inv.category_stock, "category:s avg_stock_on_hand total_stock_on_hand:l products:l"),
    "c21_sell_through_bands": Query(inv.sell_through_bands, "segment:s records:l record_share_pct"),
    "c21_hist": Query(inv.sell_through_histogram, "bin:i bin_start bin_end records:l"),
    "c21_kde": Query(inv.sell_through_density, "point:i x density"),
    "c22_category_sales": Query(inv.category_sales, "category:s total_units_sold:l avg_units_sold products:l"),
    "c23_category_str": Query(inv.category_sell_through, "category:s avg_sell_through records:l total_units_sold:l "
                                                         "total_stock_on_hand:l median_sell_through"),
    "c24_stockout_risk": Query(inv.stockout_risk, "category:s records:l stockout_records:l total_stockout_days:l "
                                                  "total_units_sold:l avg_units_sold stockout_record_pct"),
    "category_diag": Query(inv.category_diagnosis, "category:s avg_sell_through_rate median_sell_through_rate "
                           "avg_stock_on_hand avg_units_sold total_stock_on_hand:l total_units_sold:l "
                           "avg_days_of_supply avg_fill_rate overstock_rate stockout_rate overstock_rate_pct "
                           "stockout_rate_pct"),
    "c32_box": Query(inv.sell_through_boxes, "category:s q1 median q3 whisker_low whisker_high records:l position:i"),
    "c33_stock_units_long": Query(inv.stock_and_units_long, "category:s metric:s value"),
    "c34_flag_mix": Query(inv.flag_mix, "category:s Overstock~flag Stockout~flag"),
    "c35_dos_monthly": Query(inv.supply_days_by_month, "month:d avg_days_of_supply"),
    "c35_dos_hist": Query(inv.supply_days_histogram, "bin:i bin_start bin_end records:l"),
    "c36_fill_str": Query(inv.fill_against_sell_through, "month:d category:s stock_on_hand:l units_sold:l "
                          "avg_sell_through_rate avg_days_of_supply avg_fill_rate overstock_rate stockout_rate "
                          "overstock_rate_pct stockout_rate_pct"),
    "c38_dead_stock": Query(inv.top_dead_stock, "product_id:l product_name:s category:s avg_stock_on_hand "
                            "total_stock_on_hand:l avg_sell_through_rate avg_days_of_supply avg_units_sold "
                            "dead_stock_score"),
    "c39_top_sku": Query(inv.top_skus, "product_id:l product_name:s category:s avg_sell_through_rate "
                         "total_units_sold_inventory:l avg_stock_on_hand avg_days_of_supply net_revenue:m "
                         "gross_revenue:m total_quantity_ordered:l order_item_count:l sell_through_rank_pct "
                         "revenue_rank_pct combined_score"),
    "c40_aging": Query(inv.aging_value, "aging_bucket:s bucket_order:i category:s inventory_value:m avg_stock_on_hand "
                                        "sku_month_records:l overstock_records:l"),
    "c40_bucket": Query(inv.aging_buckets, "aging_bucket:s bucket_order:i total_inventory_value:m sku_month_records:l "
                                           "overstock_records:l value_share_pct"),
}


def _over_stored(name: str) -> Query:
    """The same query over the stored orders and lines, which the first of them writes."""
    query = RETAIL[name]
    return Query(lambda t: query.build(kept_tables(t)), query.columns)


RETAIL["order_quantity"] = Query(
    lambda t: promo.with_quantity(promo.order_promo(t).drop("quantity"), t.lines(["order_item_id", "order_id", "quantity"]))
    .select("order_id", "revenue", "quantity"), "order_id:l revenue:m quantity:l")
#: Queries that read orders and lines by order or by traffic window, again from the stored layout.
STORED = ("order_promo", "c10_aov", "c29_repeat_rate", "src_window_orders", "source_value", "c25_conversion")
RETAIL |= {f"stored_{name}": _over_stored(name) for name in STORED}
