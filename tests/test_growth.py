"""Series operators: CAGR known answers, steps, base-100 index, nearest year."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrapanel.operators.growth import growth_first_last, growth_step, index_base100
from terrapanel.operators.nearest import nearest_published_year, nearest_year_global, nearest_year_per_key


def series(spark, rows):
    return spark.createDataFrame(rows, "k string, ano int, populacao double")


def test_cagr_known_answer(spark):
    df = series(spark, [("a", 2010, 1000.0), ("a", 2020, 2000.0)])
    r = growth_first_last(df, "k").collect()[0]
    assert r.cagr_pct == pytest.approx(7.177, abs=1e-3)
    assert r.variacao_pct == pytest.approx(100.0)
    assert r.variacao_absoluta == 1000.0
    assert (r.ano_inicial, r.ano_final, r.anos, r.n_observacoes) == (2010, 2020, 10, 2)


def test_unordered_rows_same_ends(spark):
    df = series(spark, [("a", 2020, 2000.0), ("a", 2015, 1500.0), ("a", 2010, 1000.0)])
    r = growth_first_last(df, "k").collect()[0]
    assert (r.valor_inicial, r.valor_final) == (1000.0, 2000.0)


def test_single_year_has_no_cagr(spark):
    r = growth_first_last(series(spark, [("a", 2020, 500.0)]), "k").collect()[0]
    assert r.cagr_pct is None and r.anos == 0


def test_leading_null_year_ignored(spark):
    df = series(spark, [("a", 2009, None), ("a", 2010, 1000.0), ("a", 2020, 2000.0)])
    r = growth_first_last(df, "k").collect()[0]
    assert r.ano_inicial == 2010


def test_non_positive_start_dropped(spark):
    df = series(spark, [("a", 2010, 0.0), ("a", 2020, 10.0), ("b", 2010, 5.0), ("b", 2011, 6.0)])
    assert [r.k for r in growth_first_last(df, "k").collect()] == ["b"]


def test_rounding_before_banding(spark):
    df = series(spark, [("a", 2010, 1000.0), ("a", 2020, 2000.0)])
    r = growth_first_last(df, "k", decimals=4, growth_edges=[-0.5, 0.0, 0.5, 1.0]).collect()[0]
    assert r.cagr_pct == 7.1773 and r.faixa_crescimento == "Crescimento acelerado"


def test_growth_step_annualised(spark):
    df = series(spark, [("a", 2021, 1000.0), ("a", 2024, 1331.0), ("a", 2025, 1331.0)])
    rows = {r.ano: r for r in growth_step(df, "k").collect()}
    assert rows[2021].populacao_anterior is None
    assert rows[2024].anos_desde_anterior == 3
    assert rows[2024].var_pct_anualizada == pytest.approx(10.0)
    assert rows[2024].variacao_pct == pytest.approx(33.1)
    assert rows[2025].variacao_pct == 0.0


def test_index_base100(spark):
    df = series(spark, [("a", 2010, 50.0), ("a", 2011, 100.0), ("b", 2011, 10.0)])
    got = {(r.k, r.ano): r.indice for r in index_base100(df, "k").collect()}
    assert got[("a", 2010)] == 100.0 and got[("a", 2011)] == 200.0
    assert got[("b", 2011)] is None  # absent in the base year


def test_nearest_year_tie_goes_to_earlier(spark):
    df = series(spark, [("a", 2021, 1.0), ("a", 2025, 2.0), ("b", 2024, 3.0), ("b", 2021, 4.0)])
    got = {r.k: (r.ano_proximo, r.populacao) for r in nearest_year_per_key(df, "k", 2023).collect()}
    assert got["a"] == (2021, 1.0)          # 2021 and 2025 are both 2 away
    assert got["b"] == (2024, 3.0)


def test_nearest_year_skips_nulls(spark):
    df = series(spark, [("a", 2023, None), ("a", 2020, 5.0)])
    assert nearest_year_per_key(df, "k", 2023).collect()[0].ano_proximo == 2020


def test_nearest_published_year_global(spark):
    df = series(spark, [("a", 2020, 1.0), ("a", 2021, 1.0), ("a", 2024, 1.0), ("a", 2025, 1.0)])
    y = spark.range(1).select(nearest_published_year(df, 2023).alias("y")).collect()[0].y
    assert y == 2024
    g = nearest_year_global(df, "k", 2023).collect()
    assert [r.ano_proximo for r in g] == [2024]
    # 2021 and 2024 are both 1.5 away from 2022.5: the earlier year wins
    assert spark.range(1).select(nearest_published_year(df, 2022.5).alias("y")).collect()[0].y == 2021


def test_cagr_constant_series(spark):
    df = series(spark, [("a", 2010, 10.0), ("a", 2015, 10.0)])
    assert growth_first_last(df, "k").select(F.col("cagr_pct")).collect()[0][0] == 0.0
