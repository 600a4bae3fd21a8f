"""One customer, order, product and source hold a large part of all rows; results stay whole."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from shelfline.plans import inventory as inv, promo, questions as q, traffic as tr
from shelfline.sources import CsvTables

N = 4000


def skewed_tables(seed=11):
    rng = np.random.default_rng(seed)
    hot = lambda size, other: np.where(rng.random(size) < 1 / 3, 1, rng.integers(2, other, size))
    day = lambda n: [date(2020, 1, 1) + timedelta(int(k)) for k in rng.integers(0, 200, n)]
    orders = pd.DataFrame({
        "order_id": np.arange(1, N + 1), "order_date": day(N), "customer_id": hot(N, 900),
        "order_status": rng.choice(["paid", "shipped", "cancelled", "created"], N),
        "order_source": np.where(rng.random(N) < 0.5, "direct", rng.choice(["referral", "social_media"], N)),
        "payment_method": rng.choice(["card", "cash"], N), "zip": rng.choice(["z1", "z2", "z3"], N)})
    lines = pd.DataFrame({
        "order_item_id": np.where(rng.random(3 * N) < 1 / 3, 7, np.arange(3 * N) + 100), "order_id": hot(3 * N, N),
        "product_id": hot(3 * N, 60), "quantity": rng.integers(1, 5, 3 * N),
        "unit_price": rng.integers(100, 10000, 3 * N) / 100, "discount_amount": rng.choice([np.nan, 0.5, 1.25], 3 * N),
        "promo_id": rng.choice([None, "PROMO-0001"], 3 * N)})
    products = pd.DataFrame({
        "product_id": np.arange(1, 61), "product_name": [f"p{i}" for i in range(1, 61)],
        "category": rng.choice(["Streetwear", "Outdoor"], 60), "segment": "A",
        "size": rng.choice(["S", "M", "L", "XL", "XXL"], 60), "price": 10.0, "cogs": 4.0})
    returns = pd.DataFrame({"product_id": hot(N, 60), "return_reason": rng.choice(["late", "defective"], N)})
    traffic = pd.DataFrame({
        "date": [date(2020, 2, 1), date(2020, 5, 1)], "traffic_source": ["direct", "referral"], "sessions": [900, 500],
        "unique_visitors": [5, 6], "page_views": [7, 8], "bounce_rate": [0.5, 0.4], "avg_session_duration_sec": [60.0, 30.0]})
    geography = pd.DataFrame({"zip": ["z1", "z2", "z3"], "region": ["East", "West", "West"]})
    return {"orders": orders, "order_items": lines, "products": products, "returns": returns, "web_traffic": traffic,
            "geography": geography}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    frames = skewed_tables()
    folder = tmp_path_factory.mktemp("skew")
    for name, frame in frames.items():
        frame.to_csv(folder / f"{name}.csv", index=False)
    return frames, CsvTables(spark, str(folder))


def test_gaps(data):
    frames, t = data
    orders = frames["orders"].sort_values(["customer_id", "order_date"])
    gaps = pd.to_datetime(orders["order_date"]).groupby(orders["customer_id"]).diff().dt.days.dropna()
    got = q.median_gap(t).first()
    assert (got.gaps, got.median_gap_days) == (len(gaps), gaps.median())
    listed = sorted(r.gap_days for r in q.order_gaps(t).collect())
    assert listed == sorted(gaps.astype(int).tolist())


def test_counts_and_sums_over_hot_products_and_orders(data):
    frames, t = data
    joined = frames["returns"].merge(frames["products"], on="product_id")
    want = joined[joined.category == "Streetwear"].groupby("return_reason").size().to_dict()
    assert {r.return_reason: r.returns for r in q.return_reasons(t).collect()} == want
    lines = frames["order_items"].merge(frames["orders"], on="order_id").merge(frames["geography"], on="zip")
    lines = lines[lines.order_status != "cancelled"]
    net = (lines.quantity * lines.unit_price - lines.discount_amount.fillna(0)).groupby(lines.region).sum()
    got = {r.region: r.revenue for r in q.region_revenue(t).collect()}
    assert got == pytest.approx(net.to_dict())


def _once(frames):
    lines = frames["order_items"].copy()
    lines["line_revenue"] = lines.quantity * lines.unit_price - lines.discount_amount.fillna(0)
    columns = ["order_id", "product_id", "quantity", "unit_price", "discount_amount", "promo_id"]
    ordered = lines.sort_values(columns, na_position="first")
    return ordered.drop_duplicates("order_item_id").merge(frames["orders"], on="order_id")


def test_a_line_with_thousands_of_copies_counts_once(data):
    frames, t = data
    once = _once(frames)
    columns = ["order_item_id", "order_id", "line_revenue"]
    rows = t.master_once(columns).toPandas()
    assert len(rows) == len(once) and rows["order_item_id"].is_unique
    assert rows["line_revenue"].sum() == pytest.approx(once["line_revenue"].sum())


def test_order_values(data):
    frames, t = data
    once = _once(frames)
    once = once[once.order_status.isin(["paid", "shipped", "delivered", "returned"])]
    once["g"] = np.where(once.promo_id.notna(), "Promo", "Non-promo")
    per_order = once.groupby(["order_id", "g"])["line_revenue"].sum().reset_index()
    want = per_order.groupby("g")["line_revenue"].agg(["count", "mean", "median"])
    for r in promo.order_group_value(t).collect():
        w = want.loc[r.promo_group]
        assert (r.orders, r.aov, r.median_order_value) == (w["count"], pytest.approx(w["mean"]), pytest.approx(w["median"]))


def test_orders_in_the_traffic_window(data):
    frames, t = data
    orders = frames["orders"]
    inside = orders[orders.order_status.isin(["paid", "shipped"]) & (pd.to_datetime(orders.order_date) >= "2020-02-01")
                    & (pd.to_datetime(orders.order_date) <= "2020-05-01")]
    assert tr.window_orders(t).count() == len(inside)
    once = _once(frames)
    inside_lines = once[once.order_id.isin(inside.order_id)]
    per_customer = inside_lines.groupby(["order_source", "customer_id"])["order_id"].nunique()
    want = (per_customer > 1).groupby("order_source").agg(["size", "sum"])
    got = {r.order_source: (r.customers, r.repeat_customers) for r in tr.repeat_rate(t).collect()}
    assert got == {k: tuple(v) for k, v in want.iterrows()}
    assert inv.SKU == ("product_id", "product_name", "category")
