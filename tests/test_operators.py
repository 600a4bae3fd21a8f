import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfline.operators import distribution as D
from shelfline.operators.joins import contract_join, key_profile, unique_by
from shelfline.operators.keyed import best, first_per_key, group, ranked, seeded_sample, share_of_total, share_within
from shelfline.operators.reshape import to_long, to_wide


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- keyed -------------------------------------------------------------------

def test_group_leaves_out_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    assert rows(group(df, "k").agg(F.sum("x"))) == [("a", 1)]


def test_first_per_key_takes_the_smallest_row_with_nulls_first(spark):
    data = [(1, 5, "x"), (1, None, "y"), (2, 3, "b"), (2, 3, "a"), (3, 1, "z")]
    df = spark.createDataFrame(data, "k int, a int, b string")
    assert rows(first_per_key(df, ["k"], ["a", "b"])) == [(1, None, "y"), (2, 3, "a"), (3, 1, "z")]


def test_first_per_key_combines_a_hot_key_before_the_shuffle(spark):
    df = spark.range(30_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    out = first_per_key(df, ["k"], ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert out.count() == 20_001 and out.where("k = 0").first().id == 0


def test_best_and_ranked_break_ties_by_label(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None)], "k string, x double")
    assert best(df, "x", "k").first().k == "a"
    assert [r.k for r in ranked(df, [("x", True), ("k", True)], 3).collect()] == ["b", "a", "c"]


def test_shares(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 4)], "k string, v string, n int")
    assert rows(share_within(df, ["k"], "n", "p").select("k", "v", "p")) == [
        ("a", "x", 25.0), ("a", "y", 75.0), ("b", "x", 100.0)]
    assert rows(share_of_total(df, p="n").select("p")) == [(12.5,), (37.5,), (50.0,)]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("unique_id"), F.col("id").alias("ds"))
    picks = [rows(seeded_sample(df.repartition(n), ["unique_id", "ds"], 100, 42)) for n in (1, 3, 11)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 100
    assert rows(seeded_sample(df, ["unique_id", "ds"], 100, 43)) != picks[0]


# --- joins -------------------------------------------------------------------

def test_contract_is_enforced(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "A"), (2, "B")], "k int, y string")
    doubled = right.unionByName(right)
    assert contract_join(left, right, "k", "left", validate="many_to_one").count() == 3
    with pytest.raises(Exception, match="not unique"):
        contract_join(left, doubled, "k", "left", validate="many_to_one").collect()
    with pytest.raises(Exception, match="not unique"):
        contract_join(left, right, "k", validate="one_to_one").collect()
    assert contract_join(right, left, "k", validate="one_to_many").count() == 3
    with pytest.raises(ValueError):
        contract_join(left, right, "k", validate="many_to_many")


def test_null_keys_do_not_break_the_contract(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, x int")
    assert unique_by(df, ["k"]).count() == 3


@pytest.mark.parametrize("how,expected", [("inner", 2), ("left", 3), ("outer", 4), ("left_semi", 2), ("left_anti", 1)])
def test_null_safe_join(spark, how, expected):
    left = spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "k int, x int")
    right = spark.createDataFrame([(None, 10), (1, 20), (9, 30)], "k int, y int")
    assert contract_join(left, right, "k", how, null_safe=True).count() == expected
    if how == "outer":
        keys = {r.k for r in contract_join(left, right, "k", how, null_safe=True).collect()}
        assert keys == {None, 1, 2, 9}


def test_key_profile(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert rows(key_profile(df, ["k"], "t")) == [("t", 2, 1, 3)]


# --- reshape -----------------------------------------------------------------

def test_long_and_wide(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    long = to_long(df, ["id"], ["a", "b"], "name", "value", {"a": "A", "b": "B"})
    assert rows(long) == [(1, "A", 2.0), (1, "B", 3.0)]
    assert rows(to_wide(long, ["id"], "name", "value", ["A", "B", "C"], 0.0)) == [(1, 2.0, 3.0, 0.0)]


# --- order statistics ----------------------------------------------------------

def skewed(n=6000, seed=1):
    """A third of the rows share one value, one group holds most rows, and a few values are huge."""
    rng = np.random.default_rng(seed)
    value = np.round(rng.lognormal(3, 2, n), 3)
    value[rng.random(n) < 1 / 3] = 7.0
    value[:3] = 1e12
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    return pd.DataFrame({"k": key, "v": value})


def test_quantiles_equal_numpy_on_skewed_data(spark):
    pdf = skewed()
    got = {r.k: r for r in D.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v",
                                             {"q1": 0.25, "q2": 0.5, "q3": 0.75, "lo": 0.0, "hi": 1.0}).collect()}
    for k, part in pdf.groupby("k")["v"]:
        for name, p in {"q1": 0.25, "q2": 0.5, "q3": 0.75, "lo": 0.0, "hi": 1.0}.items():
            assert math.isclose(got[k][name], np.quantile(part, p), rel_tol=1e-12)


def test_quantiles_of_tiny_decimal_and_null_groups(spark):
    df = spark.createDataFrame([("a", Decimal("1.50")), ("b", Decimal("1.00")), ("b", Decimal("2.00")), ("c", None)],
                               "k string, v decimal(10,2)")
    assert rows(D.exact_quantiles(df, ["k"], "v", {"m": 0.5})) == [("a", 1.5), ("b", 1.5)]
    assert D.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 1.5


def test_cells_follow_the_number_of_values(spark, monkeypatch):
    """More cells change the work, never the counts."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))
    counts = D.value_counts(df, ["k"], "v")
    few = D.ordered_counts(counts, ["k"], "v")
    monkeypatch.setattr(D, "VALUES_PER_CELL", 1)
    many = D.ordered_counts(counts, ["k"], "v")
    assert few.agg(F.countDistinct("cell")).first()[0] <= 256 < many.agg(F.countDistinct("cell")).first()[0]
    assert sorted(few.drop("cell").collect()) == sorted(many.drop("cell").collect())


def test_percentile_ranks_equal_pandas(spark):
    pdf = skewed(3000, 2).assign(id=range(3000))
    pdf["w"] = pdf["v"].rank(ascending=False).round(-2)
    out = D.percentile_ranks(spark.createDataFrame(pdf), rv="v", rw="w").toPandas().set_index("id").sort_index()
    assert np.allclose(out["rv"], pdf["v"].rank(pct=True)) and np.allclose(out["rw"], pdf["w"].rank(pct=True))


def test_rank_within_small_groups(spark):
    pdf = pd.DataFrame({"k": list("aaabb"), "v": [2.0, 2.0, 1.0, 5.0, 4.0]})
    got = spark.createDataFrame(pdf).select("k", "v", D.rank_pct_within("v", ["k"]).alias("r"))
    assert rows(got) == [("a", 1.0, 1 / 3), ("a", 2.0, 2.5 / 3), ("a", 2.0, 2.5 / 3), ("b", 4.0, 0.5), ("b", 5.0, 1.0)]


def test_histogram_counts_every_row(spark):
    pdf = skewed(1000, 3)
    pdf = pdf[pdf.v < 1e6]
    out = D.histogram(spark.createDataFrame(pdf), "v", 40).toPandas().sort_values("bin")
    counts, edges = np.histogram(pdf["v"], 40)
    assert out["records"].sum() == len(pdf)
    assert dict(zip(out["bin"], out["records"])) == {i: c for i, c in enumerate(counts) if c}
    same = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert rows(D.histogram(same, "v", 40).select("bin", "records")) == [(0, 5)]


def test_density_integrates_to_one_on_a_wide_grid(spark):
    x = np.r_[np.random.default_rng(4).normal(0, 1, 500), [-8.0, 8.0]]
    out = D.density(spark.createDataFrame(pd.DataFrame({"v": x})), "v", 200).toPandas().sort_values("point")
    assert (out["density"] >= 0).all()
    assert abs(np.trapezoid(out["density"], out["x"]) - 1) < 0.02


def test_box_leaves_outliers_outside(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "k string, v double")
    r = D.box_stats(df, "k", "v").first()
    assert (r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high, r.records) == (2.25, 3.5, 4.75, 1.0, 5.0, 6)


def test_wide_form_fails_on_a_value_without_a_column(spark):
    import pytest

    from shelfline.operators.reshape import to_wide, values_of

    df = spark.createDataFrame([("a", "X", 1.0), ("a", "Y", 2.0), ("b", None, 3.0)], "i string, k string, v double")
    assert values_of(df, "k") == ("X", "Y")
    assert {r.i: (r.X, r.Y) for r in to_wide(df, ["i"], "k", "v", ("X", "Y")).collect()} == {"a": (1.0, 2.0), "b": (None, None)}
    with pytest.raises(Exception, match="without a column"):
        to_wide(df, ["i"], "k", "v", ("X",)).collect()


def test_contract_counts_keys_without_gathering_them(spark):
    import pytest
    from pyspark.sql import functions as F

    from shelfline.operators.joins import unique_by

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id")
    assert unique_by(df, ["k"]).count() == 3000
    with pytest.raises(Exception, match="not unique"):
        unique_by(df.unionByName(df.where("id = 1")), ["k"]).collect()


def test_density_is_within_its_error_bound(spark):
    """Against the plain sum over all values, for even, skewed, far-off and few values."""
    import numpy as np

    from shelfline.operators.distribution import density

    rng = np.random.default_rng(8)
    for values in (rng.normal(3, 2, 4000), rng.gamma(0.3, 5, 3000), np.r_[rng.normal(0, 1, 500), 400.0], np.array([1.0, 2.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = {r.point: (r.x, r.density) for r in density(df, "v", 50).collect()}
        width = values.std(ddof=1) * len(values) ** -0.2
        at = np.linspace(values.min(), values.max(), 50)
        want = np.exp(-0.5 * ((at[:, None] - values) / width) ** 2).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))
        assert sorted(got) == list(range(50)) and np.allclose([got[k][0] for k in range(50)], at)
        assert np.abs(np.array([got[k][1] for k in range(50)]) - want).max() <= 2e-11 / (width * np.sqrt(2 * np.pi))
    plan = density(df, "v", 50)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Generate"):] if "_bin" not in plan else plan[plan.index("Aggregate [_bin"):]
    assert "Aggregate [_bin" in plan and "Generate explode" not in below.split("Generate explode(sequence(0, 49")[0].split("Aggregate [_bin", 1)[-1]
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert all(r.density is None for r in density(same, "v", 5).collect())
    assert density(same.where("false"), "v", 5).count() == 0
