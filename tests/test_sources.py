from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfline.plans import inventory as inv, promo, questions as q, traffic as tr
from shelfline.session import shared_folder, stored, work_path
from shelfline.sources import CsvTables, ParquetTestbed, TableRegistry
from shelfline.sources.files import check_contract, read_csv, write_by, write_csv
from shelfline.sources.schemas import SCHEMAS, require_columns

FILES = {
    "orders": """order_date,order_id,customer_id,order_status,order_source,payment_method,zip
2020-01-01,1,10,paid,direct,card,z1
2020-01-05,2,10,cancelled,direct,cash,z1
2020-01-05,3,10,,referral,card,z2
2020-02-01,4,11,shipped,referral,card,z2
""",
    "order_items": """order_id,product_id,quantity,unit_price,discount_amount,promo_id
1,100,2,10.0,,
2,100,1,10.0,1.0,PROMO-0001
3,101,1,5.0,0.5,PROMO-0002
4,101,4,5.0,,X-1
""",
    "products": """product_id,product_name,category,segment,size,price,cogs
100,Shirt,Streetwear,A,S,10.0,4.0
101,Boot,Outdoor,B,M,5.0,4.0
""",
    "customers": "customer_id,age_group,gender,acquisition_channel\n10,18-24,F,ads\n11,25-34,M,ads\n12,25-34,M,\n13,,F,ads\n",
    "geography": "zip,region\nz1,East\nz2,West\n",
    "returns": "product_id,return_reason\n100,late\n100,defective\n100,late\n101,late\n",
    "payments": "payment_value,installments\n10.0,1\n20.0,3\n40.0,3\n",
    "web_traffic": "date,traffic_source,sessions,unique_visitors,page_views,bounce_rate,avg_session_duration_sec\n"
                   "2020-01-01,direct,100,50,200,0.5,60\n2020-01-31,referral,50,20,90,0.25,30\n",
    "master_table": """order_item_id,order_id,customer_id,order_date,order_status,order_source,product_id,product_name,category,segment,quantity,line_revenue,line_cogs,discount_amount,refund_amount,promo_id
1,1,10,2020-01-01,paid,direct,100,Shirt,Streetwear,A,2,20.0,8.0,,5.0,
1,1,10,2020-01-01,paid,direct,100,Shirt,Streetwear,A,2,20.0,8.0,,5.0,
2,4,11,2020-02-01,shipped,referral,101,Boot,Outdoor,B,4,20.0,16.0,,,NO_PROMO
3,4,11,2020-02-01,shipped,referral,101,Boot,Outdoor,B,1,5.0,4.0,1.0,,PROMO-0001
""",
    "inventory": """snapshot_date,product_id,product_name,category,stock_on_hand,units_sold,stockout_days,stockout_flag,overstock_flag,days_of_supply,fill_rate,sell_through_rate
2020-01-31,100,Shirt,Streetwear,10,5,0,0,,30.0,1.0,0.33
2020-01-31,101,Boot,Outdoor,4,8,2,1,1,181.0,0.9,0.95
2020-02-29,100,Shirt,Streetwear,20,5,0,,0,-1.0,1.0,0.7
""",
}


@pytest.fixture(scope="module")
def csv(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    return CsvTables(spark, str(folder))


def test_questions_on_csv(csv):
    assert q.median_gap(csv).first().median_gap_days == 2.0  # gaps 4 and 0
    assert sorted(r.gap_days for r in q.order_gaps(csv).collect()) == [0, 4]
    assert q.answer(q.segment_margin(csv), "avg_gross_margin", "segment").first().segment == "A"
    assert q.answer(q.return_reasons(csv), "returns", "return_reason").first().return_reason == "late"
    assert q.answer(q.bounce_by_source(csv), "avg_bounce_rate", "traffic_source", False).first().traffic_source == "referral"
    assert q.promo_rate(csv).first().promo_rate_pct == 50.0  # X-1 has another prefix
    ages = {r.age_group: (r.total_orders, r.total_customers) for r in q.orders_per_age_group(csv).collect()}
    assert ages == {"18-24": (3, 1), "25-34": (1, 2)}
    assert {r.region: r.revenue for r in q.region_revenue(csv).collect()} == {"East": 20.0, "West": 24.5}  # NULL status stays
    assert q.answer(q.cancelled_payments(csv), "cancellations", "payment_method").first().payment_method == "cash"
    assert {r["size"]: r.return_rate_pct for r in q.size_return_rate(csv).collect()} == {"S": 150.0, "M": 50.0}
    assert q.answer(q.installment_value(csv), "avg_payment", "installments").first().installments == 3


def test_dashboard_tables_on_csv(csv):
    channel = {r.channel: r for r in tr.channel_summary(csv).collect()}
    assert channel["direct"].net_revenue == 15.0 and channel["referral"].valid_order_items == 2
    margin = {r.promo_group: r.margin for r in promo.promo_margin(csv).collect()}
    assert margin["Promo"] == pytest.approx(0.0) and margin["Non-promo"] == pytest.approx(40.0)
    net = {r.promo_group: r.margin for r in promo.promo_margin(csv, discount_already_net=True).collect()}
    assert net["Promo"] == pytest.approx(20.0)
    units = {(r.category, r.promo_group): r.units_sold for r in promo.promo_units(csv).collect()}
    assert units[("Outdoor", "Promo")] == 5  # any promo id counts here
    cells = {(r.aging_bucket, r.category): r.inventory_value for r in inv.aging_value(csv).collect()}
    assert len(cells) == 10 and cells[("0-30 days", "Streetwear")] == 40.0 and cells[("180+ days", "Outdoor")] == 16.0
    assert sum(v > 0 for v in cells.values()) == 2  # a negative supply has no bucket


def test_master_is_built_where_no_file_has_it(spark, tmp_path):
    for name in ("orders", "products"):
        (tmp_path / f"{name}.csv").write_text(FILES[name])
    (tmp_path / "order_items.csv").write_text(
        "order_item_id,order_id,product_id,quantity,unit_price,discount_amount,promo_id\n"
        "1,1,100,2,10.0,,\n1,1,100,2,10.0,,\n2,4,101,3,5.0,1.0,PROMO-0001\n")
    t = CsvTables(spark, str(tmp_path))
    columns = ["order_item_id", "order_status", "category", "line_revenue", "line_cogs", "refund_amount"]
    assert t.master(columns).count() == 3
    assert sorted(map(tuple, t.master_once(columns).collect())) == [
        (1, "paid", "Streetwear", 20.0, 8.0, None), (2, "shipped", "Outdoor", 14.0, 12.0, None)]
    assert t.master_once(["order_item_id", "line_revenue"]).count() == 2


def test_quantity_is_added_only_where_missing(csv):
    orders = promo.order_promo(csv)
    assert promo.with_quantity(orders, csv.master(["order_id", "quantity"])) is orders
    again = promo.with_quantity(orders.drop("quantity"), csv.master_once(["order_item_id", "order_id", "quantity"]))
    assert sorted(r.quantity for r in again.collect()) == [2, 5]


def test_wrong_values_and_columns_fail(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("product_id,return_reason\nnot-a-number,late\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "bad.csv"), SCHEMAS["returns"]).collect()
    with pytest.raises(ValueError, match="zip"):
        read_csv(spark, str(tmp_path / "bad.csv"), SCHEMAS["geography"], ["zip"])
    with pytest.raises(ValueError, match="other"):
        require_columns(spark.range(1), ["id", "other"])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(date(2023, 1, 2), 1.25, None), (date(2023, 1, 1), 2.5, 3.0)], SCHEMAS["sample_submission"])
    path = write_csv(df, str(tmp_path / "out"), order=["Date"], single_file=True)
    back = read_csv(spark, path, SCHEMAS["sample_submission"]).collect()
    assert [tuple(r) for r in back] == [(date(2023, 1, 1), 2.5, 3.0), (date(2023, 1, 2), 1.25, None)]
    with pytest.raises(Exception):
        write_csv(df, path)  # results are never overwritten silently
    many = write_by(df.withColumn("scenario", F.lit("a")), str(tmp_path / "many"), "scenario")
    assert spark.read.option("header", True).csv(many).count() == 2


def test_output_contract(spark):
    df = spark.createDataFrame([(date(2023, 1, 1), 1.0, 1.0), (date(2023, 1, 2), 1.0, 1.0)], SCHEMAS["sample_submission"])
    check_contract(df, date(2023, 1, 1), 2)
    with pytest.raises(ValueError, match="first day"):
        check_contract(df, date(2023, 1, 2), 2)
    with pytest.raises(ValueError, match="rows"):
        check_contract(df, date(2023, 1, 1), 3)


def test_registry_reloads_only_for_missing_columns(spark):
    registry, loads = TableRegistry(), []

    def load(*cols):
        loads.append(cols)
        return spark.range(3).select(*[F.col("id").alias(c) for c in cols])

    registry.get("t", ["a"], lambda: load("a", "b"))
    registry.get("t", ["b"], lambda: load("a", "b"))
    assert len(loads) == 1
    assert registry.get("t", ["c"], lambda: load("c")).columns == ["c"] and len(loads) == 2
    registry.clear()


def test_shared_folder_follows_the_session(spark):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark) and work_path(spark, "x").startswith(folder)
    assert stored(spark.range(5), "five").count() == 5


def test_testbed_keys_hold(spark, tables):
    """Joins are left out where no column is needed, so every key must find its row."""
    items, orders = tables.order_items(), tables.order_facts()
    assert items.join(orders, "order_id", "left_anti").count() == 0
    assert items.join(tables.products(), "product_id", "left_anti").count() == 0
    assert tables.orders().count() == orders.count()
    assert isinstance(tables, ParquetTestbed)


def test_sales_columns_go_by_name(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("COGS,Date,Revenue\n1.0,2020-01-01,100.0\n")
    row = CsvTables(spark, str(tmp_path)).sales().first()
    assert (float(row.revenue), float(row.cogs)) == (100.0, 1.0)


def test_every_column_list_gives_the_same_lines(spark):
    from shelfline.sources.master import build_master

    lines = spark.createDataFrame([(1, 10, 100, 2), (2, 11, 100, 1), (3, 10, 101, 1)],
                                  "order_item_id int, order_id int, product_id int, quantity int")
    orders = spark.createDataFrame([(10, "done")], "order_id int, order_status string")
    products = spark.createDataFrame([(100, "a", 1.0)], "product_id int, category string, cogs double")
    for columns in (["quantity"], ["order_status"], ["category"], ["order_status", "line_cogs"]):
        assert build_master(lines, orders, products, ["order_item_id", *columns], "double").count() == 3
