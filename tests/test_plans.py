"""What the plans must look like on big tables."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from shelfline.catalog import RETAIL

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def unaided(spark):
    """No table is small enough to be broadcast by its size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield spark
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(RETAIL) - {"c39_top_sku"}))
def test_no_product_of_tables(unaided, name):
    """A loop join is allowed against a single row only: the result of an aggregate without keys."""
    text = plan(QUERIES[name](unaided, SMALL))
    assert "CartesianProduct" not in text
    for part in text.split("BroadcastExchange IdentityBroadcastMode")[1:]:
        first = next(line for line in part.splitlines() if "Aggregate(" in line or "Scan" in line)
        assert "keys=[]" in first


@pytest.mark.parametrize("name", ["master_dedup", "c09_margin", "channel_summary"])
def test_copies_are_dropped_before_the_shuffle(unaided, name):
    assert "partial_min(struct(" in plan(QUERIES[name](unaided, SMALL))


@pytest.mark.parametrize("name,columns", [
    ("q03_return_reason", {"l_partkey", "l_linenumber", "l_returnflag"}),
    ("q05_promo_rate", {"l_partkey", "l_discount"}),
    ("q07_region_revenue", {"l_orderkey", "l_quantity", "l_extendedprice", "l_discount"}),
    ("q09_size_return_rate", {"l_partkey", "l_returnflag"}),
])
def test_scans_read_only_what_is_used(unaided, name, columns):
    text = plan(QUERIES[name](unaided, SMALL))
    read = set()
    for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", text):
        read |= {c.split("#")[0] for c in scan.split(",") if c.strip().startswith("l_")}
    assert read == columns


def test_filter_reaches_the_scan(unaided):
    assert "EqualTo(l_returnflag,R)" in plan(QUERIES["q03_return_reason"](unaided, SMALL))


def test_products_are_not_joined_where_unused(unaided):
    assert "p_partkey" not in plan(QUERIES["channel_summary"](unaided, SMALL))
    assert "p_partkey" in plan(QUERIES["c09_margin"](unaided, SMALL))


def test_big_groups_are_summed_before_they_are_joined(unaided):
    """Returns and sales meet the products as one row per product."""
    text = plan(QUERIES["q09_size_return_rate"](unaided, SMALL))
    assert text.count("partial_count(1)") == 2


def test_order_statistics_scan_once(spark):
    """All uses of the counts read one shuffle."""
    df = QUERIES["c23_category_str"](spark, SMALL)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan parquet [l_") == 1 and "ReusedExchange" in final


def test_order_questions_leave_customers_alone(spark, tables):
    from shelfline.plans import questions as q

    scans = lambda df, name: df._jdf.queryExecution().optimizedPlan().toString().count(name)
    for df in (q.median_gap(tables), q.order_gaps(tables), q.cancelled_payments(tables)):
        assert scans(df, "c_custkey") == 0
    from shelfline.plans import traffic

    assert traffic.window_lines(tables)._jdf.queryExecution().optimizedPlan().toString().count("o_orderkey") > 0
