"""Declared schemas of the retail tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

_S, _L, _I, _D, _DT = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(order_id=_L, order_date=_DT, customer_id=_L, order_status=_S, order_source=_S,
                      payment_method=_S, zip=_S),
    "order_items": _schema(order_id=_L, product_id=_L, quantity=_I, unit_price=_D, discount_amount=_D,
                           promo_id=_S, order_item_id=_L, refund_amount=_D),
    "products": _schema(product_id=_L, product_name=_S, category=_S, segment=_S, size=_S, price=_D, cogs=_D),
    "customers": _schema(customer_id=_L, age_group=_S, gender=_S, acquisition_channel=_S),
    "geography": _schema(zip=_S, region=_S),
    "returns": _schema(product_id=_L, return_reason=_S),
    "payments": _schema(payment_value=_D, installments=_I),
    "web_traffic": _schema(date=_DT, traffic_source=_S, sessions=_L, unique_visitors=_L, page_views=_L,
                           bounce_rate=_D, avg_session_duration_sec=_D),
    "sales": _schema(Date=_DT, Revenue=_D, COGS=_D),
    "inventory": _schema(snapshot_date=_DT, product_id=_L, product_name=_S, category=_S, stock_on_hand=_L,
                         units_sold=_L, stockout_days=_L, stockout_flag=_I, overstock_flag=_I,
                         days_of_supply=_D, fill_rate=_D, sell_through_rate=_D),
    "master_table": _schema(order_item_id=_L, order_id=_L, customer_id=_L, order_date=_DT, order_status=_S,
                            order_source=_S, product_id=_L, product_name=_S, category=_S, segment=_S,
                            quantity=_I, line_revenue=_D, line_cogs=_D, discount_amount=_D, refund_amount=_D,
                            promo_id=_S),
    "promotions": _schema(promo_id=_S, promo_name=_S, promo_type=_S, discount_value=_D, start_date=_DT,
                          end_date=_DT, applicable_category=_S, promo_channel=_S, stackable_flag=_I,
                          min_order_value=_I),
    "sample_submission": _schema(Date=_DT, Revenue=_D, COGS=_D),
}


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], name: str = "table") -> DataFrame:
    """``df`` itself, or an error naming the columns it lacks."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df
