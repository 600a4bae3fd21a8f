"""Stored lines and orders: same rows as the source, no exchange by order, months pruned; lines held for reuse."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from shelfline.operators.distinct import distinct_counts
from shelfline.plans import promo, traffic as tr
from shelfline.sources import ParquetTestbed, StoredTables


@pytest.fixture(scope="module")
def copy(tables, tmp_path_factory):
    stored = StoredTables.store(tables, str(tmp_path_factory.mktemp("stored") / "retail"), buckets=4)
    yield stored
    stored.close()


@pytest.fixture
def unaided(spark):
    """No table is small enough to be broadcast by its size, and no plan changes while it runs."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("build", [promo.order_promo, promo.order_value, tr.repeat_rate, tr.window_orders, tr.window_lines,
                                   tr.source_value, tr.window_conversion, tr.channel_summary])
def test_same_rows_as_the_source(copy, tables, build):
    def plain(df):
        return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])

    got, want = plain(build(copy)), plain(build(tables))
    assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("build", [promo.order_promo, promo.order_group_value, tr.repeat_rate])
def test_orders_are_grouped_and_joined_without_an_exchange(copy, unaided, build):
    assert "hashpartitioning(order_id" not in plan(build(copy))


def test_orders_join_lines_without_an_exchange(copy, unaided):
    both = copy.orders().select("order_id", "zip").join(copy.lines(["order_id", "quantity"]), "order_id")
    assert "Exchange" not in plan(both) and both.count() == copy.lines(["order_id"]).count()


def scanned_files(df):
    """Files that the scans of an executed plan have read."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numFiles").value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_span_of_days_reads_its_months(copy, tables, spark):
    first, last = tables.web_traffic().agg(F.min("date"), F.max("date")).first()
    all_files = copy.orders().inputFiles()
    inside = [f for f in all_files
              if first.replace(day=1) <= datetime.date.fromisoformat(f.split("order_month=")[1][:10]) <= last]
    orders = tr.window_orders(copy)
    orders.collect()
    assert scanned_files(orders) == [len(inside)] and 0 < len(inside) < len(all_files)


def test_an_unfinished_copy_is_refused(tables, tmp_path):
    with pytest.raises(ValueError, match="no finished copy"):
        StoredTables(tables, str(tmp_path))


def test_a_second_session_opens_the_copy(copy, tables):
    again = StoredTables(tables, copy.base)
    assert again.orders().count() == tables.orders().count()
    again.close()


def test_two_queries_scan_lines_once(spark, monkeypatch):
    t, asked = ParquetTestbed(spark, SMALL), []
    compute = t.master_once
    monkeypatch.setattr(t, "master_once", lambda columns: asked.append(tuple(columns)) or compute(columns))
    want = rows(promo.order_promo(t)), rows(promo.promo_units(t))
    asked.clear()
    with t.reuse():
        t.lines(["order_item_id", "order_status", "order_id", "order_date", "line_revenue", "quantity", "discount_amount",
                 "promo_id", "category"])
        a, b = promo.order_promo(t), promo.promo_units(t)
        assert len(asked) == 1 and "InMemoryTableScan" in plan(a) and "InMemoryTableScan" in plan(b)
        assert (rows(a), rows(b)) == want
        t.lines(["order_item_id", "segment"])  # not held: loaded together with what is held
        assert len(asked) == 2 and {"segment", "promo_id"} <= set(asked[1])
        t.lines(["promo_id", "segment"])
        assert len(asked) == 2
    assert t.registry is None and "InMemoryTableScan" not in plan(promo.order_promo(t))


def test_distinct_counts_equal_sparks_own(spark):
    ids = [None, 0, -1, -64, -65, 63, 64, 65, 2 ** 62, -2 ** 62, 2 ** 63 - 1, -2 ** 63, 5, 5]
    df = spark.createDataFrame([(k, i, (i or 0) % 7, v) for k in ("a", "b", None) for v, i in enumerate(ids)]
                               + [("none", None, None, None)], "k string, x long, y int, v int")
    got = distinct_counts(df, "k", {"xs": "x", "ys": "y"}, {"total": "v"})
    want = df.where("k is not null").groupBy("k").agg(F.countDistinct("x").alias("xs"), F.countDistinct("y").alias("ys"),
                                                      F.coalesce(F.sum("v"), F.lit(0)).alias("total"))
    assert rows(got) == rows(want)
    text = distinct_counts(df.select("k", F.col("x").cast("string").alias("x")), "k", {"xs": "x"})
    assert rows(text) == rows(want.select("k", "xs"))
    assert distinct_counts(df.limit(0), "k", {"xs": "x"}).count() == 0


@pytest.mark.parametrize("build", [tr.window_conversion, tr.source_value])
def test_distinct_counts_need_no_expand(tables, build):
    text = plan(build(tables))
    assert "Expand" not in text and "partial_bit_or" in text


def test_a_query_stores_only_what_it_reads(tables, tmp_path, monkeypatch):
    """Orders alone for a query over orders; no product columns in the lines, and the same rows with them."""
    monkeypatch.setattr(type(tables), "master_once", lambda *_: pytest.fail("lines were computed"))
    folder = tmp_path / "retail"
    copy = StoredTables.store(tables, str(folder), buckets=2, tables=())
    assert rows(tr.window_orders(copy)) == rows(tr.window_orders(tables))
    assert {p.name for p in folder.iterdir() if not p.name.startswith(".")} == {"layout", "done", "orders", "web_traffic"}
    monkeypatch.undo()
    wide = ["order_item_id", "product_name", "category", "segment", "line_cogs"]
    assert rows(copy.lines(wide)) == rows(tables.lines(wide))
    stored_columns = copy.spark.read.parquet(f"{folder}/lines").columns
    assert not {"product_name", "category", "segment", "line_cogs"} & set(stored_columns)
    copy.close()


def test_lines_with_product_columns_of_their_own_keep_them(tables, tmp_path, monkeypatch):
    """Where the source does not look products up, what the lines hold is stored."""
    monkeypatch.setattr(type(tables), "products_apart", lambda _: False)
    copy = StoredTables.store(tables, str(tmp_path / "retail"), buckets=2, tables=("lines",))
    assert "product_name" in copy.spark.read.parquet(f"{copy.base}/lines").columns
    monkeypatch.setattr(type(tables), "products", lambda _: pytest.fail("products were looked up"))
    assert copy.lines(["order_item_id", "product_name"]).count() > 0
    copy.close()


def test_a_table_that_was_not_written_to_its_end_is_written_again(tables, tmp_path):
    copy = StoredTables.store(tables, str(tmp_path / "retail"), buckets=2, tables=())
    tables.orders().limit(3).write.parquet(f"{copy.base}/orders")
    assert copy.orders().count() == tables.orders().count()
    copy.close()
