"""Gini, top shares, Lorenz and half-of-total."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrapanel.operators.concentration import concentration, gini, half_of_total, lorenz_curve, territorial_half


def values(spark, vals):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double")


def test_gini_equal_is_zero(spark):
    assert gini(values(spark, [10.0] * 50), "x").collect()[0].gini == pytest.approx(0.0, abs=1e-12)


def test_gini_concentrated(spark):
    assert gini(values(spark, [1.0] * 99 + [10000.0]), "x").collect()[0].gini > 0.9


def test_gini_all_null_is_empty(spark):
    assert gini(values(spark, [None, None]), "x").count() == 0


def test_gini_matches_formula_with_ties(spark):
    vals = [3.0, 1.0, 3.0, 7.0, 1.0, 2.0]
    s = sorted(vals)
    n = len(s)
    exp = 2 * sum((i + 1) * x for i, x in enumerate(s)) / (n * sum(s)) - (n + 1) / n
    assert gini(values(spark, vals), "x").collect()[0].gini == pytest.approx(exp)


def test_top_shares(spark):
    vals = [float(i) for i in range(1, 201)]   # n=200: top 1% = 2 values, top 10% = 20
    r = concentration(values(spark, vals), "x").collect()[0]
    total = sum(vals)
    assert r.n == 200
    assert r.share_top_1pct == pytest.approx((200 + 199) / total * 100)
    assert r.share_top_10pct == pytest.approx(sum(range(181, 201)) / total * 100)
    assert r.share_top_100 == pytest.approx(sum(range(101, 201)) / total * 100)


def test_lorenz_monotone_and_ends_at_100(spark):
    pts = lorenz_curve(values(spark, [5.0, 1.0, 3.0, 3.0]), "x", "id").orderBy("pct_entidades").collect()
    ys = [p.pct_acumulado for p in pts]
    assert ys == sorted(ys) and ys[-1] == pytest.approx(100.0) and pts[-1].pct_entidades == 100.0
    assert ys[0] == pytest.approx(100 / 12)


def test_half_of_total(spark):
    # 10 + 5 + 3 + 2 = 20: first entity holds exactly half → count(cum < half) + 1 = 1
    r = half_of_total(values(spark, [10.0, 5.0, 3.0, 2.0]), "x", "id").collect()[0]
    assert r.n_metade == 1 and r.pct_metade == 25.0 and r.share_top_10 == pytest.approx(100.0)


def test_territorial_half(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 1000, 10.0), (2, 10.0, 500, 50.0), (3, 1.0, 600, 600.0)], "id long, d double, p long, a double"
    )
    r = territorial_half(df, "d", "p", "a", "id").collect()[0]
    assert r.n_entidades_metade_pop == 2 and r.area_metade_pop == 60.0
    assert r.pct_area_metade_pop == pytest.approx(60 / 660 * 100)


@pytest.mark.parametrize("vals", [
    [10, 5, 3, 2], [5, 5, 5, 5], [7, 7, 7, 1, 1, 1, 1], [0, 0, 4, 4, 0], [9, 1, -3, -3, -2], [-1, -2, -3], [3, 3, 3, 3, 3, 1], [100] + [1] * 99, [6, -6, 2, -1, 0, 0],
])
def test_half_of_total_with_ties_zeros_and_negatives(spark, vals):
    """Against the running sum, largest first, value by value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x long").withColumn("x", F.col("x").cast("decimal(38,4)"))
    total, cum, below = sum(vals), 0, 0
    for v in sorted(vals, reverse=True):
        cum += v
        below += 2 * cum < total
    r = half_of_total(df, "x", "id").collect()[0]
    assert r.n_metade == below + 1 and r.n == len(vals)
    if total:
        assert r.share_top_10 == pytest.approx(100 * sum(sorted(vals, reverse=True)[:10]) / total)


def test_one_ordering_serves_all(spark):
    """The plan of the metrics holds one range partitioning, already staged."""
    df = values(spark, [float(i % 17) for i in range(200)])
    blocks = []
    from terrapanel.operators import concentration as module

    staged = module.running_totals
    module.running_totals = lambda *a, **kw: blocks.append(a) or staged(*a, **kw)
    try:
        half_of_total(df, "x", "id").collect()
    finally:
        module.running_totals = staged
    assert len(blocks) == 1
