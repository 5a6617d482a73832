"""The distributed prefix operators must equal Spark's single-partition
windows on every row (ties, NULLs, groups, many ranges)."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrapanel.operators.prefix import range_running_sum, rank_table, running_totals, with_rank


def data(spark, n=600, seed=7, nulls=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = rnd.choice([None]) if nulls and rnd.random() < 0.05 else float(rnd.randint(0, 40))
        rows.append((i, rnd.choice(["a", "b", "c"]), v, rnd.randint(1, 9)))
    # a hot value holding a third of the rows
    rows += [(n + i, "a", 17.0, 1) for i in range(n // 2)]
    return spark.createDataFrame(rows, "id long, g string, v double, w long")


def test_running_totals_equal_window(spark):
    df = data(spark, nulls=False)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = running_totals(df, order, {"cum_w": F.col("w")}, ["g"], n_ranges=7)
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).alias("rn"),
                    F.sum("w").over(w).alias("cw"))
    a = {r.id: (r.row_number, r.cum_w) for r in got.collect()}
    b = {r.id: (r.rn, r.cw) for r in exp.collect()}
    assert a == b


def test_running_totals_no_groups(spark):
    df = data(spark, nulls=False)
    order = [F.col("v").asc(), F.col("id").asc()]
    got = {r.id: r.c for r in running_totals(df, order, {"c": F.col("w")}, n_ranges=5).collect()}
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    exp = {r.id: r.c for r in df.select("id", F.sum("w").over(w).alias("c")).collect()}
    assert got == exp


def test_rank_and_percent_rank_match_sql(spark):
    df = data(spark)
    for desc, nulls_last in [(True, True), (False, False), (True, False), (False, True)]:
        o = F.col("v")
        o = (o.desc_nulls_last() if nulls_last else o.desc_nulls_first()) if desc else (
            o.asc_nulls_last() if nulls_last else o.asc_nulls_first())
        w = Window.partitionBy("g").orderBy(o)
        exp = {r.id: (r.rk, r.pr) for r in df.select("id", F.rank().over(w).alias("rk"),
                                                        F.percent_rank().over(w).alias("pr")).collect()}
        got = with_rank(df, "v", ["g"], descending=desc, nulls_last=nulls_last, rank_col="rk",
                        percent_col="pr", n_ranges=4)
        got = {r.id: (r.rk, r.pr) for r in got.collect()}
        assert got.keys() == exp.keys()
        for k in exp:
            assert got[k][0] == exp[k][0], (desc, nulls_last, k)
            assert abs(got[k][1] - exp[k][1]) < 1e-12


def test_nulls_at_the_start_of_a_range(spark):
    """A range that begins with NULLs carries the sum so far, as a window does;
    before the first value the sum is NULL."""
    rows = [(i, None if i in (1, 4, 5, 6) else float(i)) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "id long, v double")
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    exp = {r.id: r.c for r in df.select("id", F.sum("v").over(w).alias("c")).collect()}
    for n in (1, 4, 12):
        got = {r.id: r.c for r in running_totals(df, [F.col("id").asc()], {"c": F.col("v")}, n_ranges=n).collect()}
        assert got == exp


def test_no_single_partition_exchange_of_rows(spark):
    """Nothing but per-range totals meets in one task."""
    df = data(spark)
    plan = running_totals(df, [F.col("id").asc()], {"c": F.col("w")}, n_ranges=4)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and plan.count("SinglePartition") <= 1


def test_rank_without_broadcast_lookup(spark):
    """The join-back of the per-value ranks gives the window's ranks."""
    df = data(spark)
    w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    exp = {r.id: r.rk for r in df.select("id", F.rank().over(w).alias("rk")).collect()}
    got = {r.id: r.rk for r in with_rank(df, "v", ["g"], rank_col="rk", n_ranges=4).collect()}
    assert got == exp


def test_rank_table_counts(spark):
    df = data(spark)
    t = rank_table(df, "v", ["g"])
    assert t.agg(F.max("group_rows")).collect()[0][0] == df.groupBy("g").count().agg(F.max("count")).collect()[0][0]


def test_range_running_sum_ties_share(spark):
    df = data(spark, nulls=False)
    got = {r.id: r.c for r in range_running_sum(df, "v", F.sum("w"), "c", n_ranges=6).collect()}
    w = Window.orderBy(F.col("v").desc())  # default RANGE frame
    exp = {r.id: r.c for r in df.select("id", F.sum("w").over(w).alias("c")).collect()}
    assert got == exp


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, None, 5.0), (3, "a", 1.0), (4, "a", 2.0)],
                               "id long, g string, v double")
    got = {r.id: r.rk for r in with_rank(df, "v", ["g"], rank_col="rk").collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 1}
    rt = {r.id: (r.row_number, r.c) for r in running_totals(df, [F.col("v").asc(), F.col("id").asc()],
                                                          {"c": F.col("v")}, ["g"]).collect()}
    assert rt == {1: (1, 3.0), 2: (2, 8.0), 3: (1, 1.0), 4: (2, 3.0)}


def _parent(lines, i):
    """The plan line of the parent operator of line ``i`` (tree text)."""
    depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
    for j in range(i - 1, -1, -1):
        d = len(lines[j]) - len(lines[j].lstrip(" :+-"))
        if d < depth:
            return lines[j]
    return ""


def test_distributed_prefix_reads_staged_rows_without_exchange(spark):
    df = data(spark, nulls=False)
    out = running_totals(df, [F.col("v").desc(), F.col("id").asc()], {"c": F.col("w")}, ["g"], n_ranges=4)
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "_prefix_" in line]
    assert scans, "the staged table is read"
    assert all("Exchange" not in _parent(lines, i) for i in scans)


def test_exact_quantiles_equal_percentile(spark):
    """Against Spark's own exact percentile: groups, NULL groups, ties."""
    from terrapanel.operators.quantiles import exact_quantiles

    df = data(spark).withColumn("g", F.when(F.col("id") % 5 > 0, F.col("g")))
    fractions = [0.0, 1 / 7, 0.5, 0.9, 1.0]
    exp = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", fractions).alias("q")).collect()}
    got = {r.g: r.quantiles for r in exact_quantiles(df, F.col("v"), fractions, ["g"]).collect()}
    assert got.keys() == exp.keys() and all(got[g] == pytest.approx(exp[g]) for g in exp)
    whole = exact_quantiles(df, F.col("v"), [0.5]).collect()
    assert whole[0].quantiles == pytest.approx([df.agg(F.median("v")).first()[0]])
    assert exact_quantiles(df.limit(0), F.col("v"), [0.5]).collect()[0].quantiles == [None]
    assert exact_quantiles(df.limit(0), F.col("v"), [0.5], ["g"]).count() == 0
