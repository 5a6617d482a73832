"""Column operators at exact edges (known answers of the original tests)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrapanel import registry
from terrapanel.functions import (
    band_density, band_growth, band_quotient, band_size, bucketize, fmt_compact_br, fmt_number_br, pad_id,
    parse_feed_number, ratio, round_to, safe_denominator, sum_skipping_nulls,
)


def one_col(spark, values, typ, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_safe_denominator(spark):
    assert one_col(spark, [10.0, 0.0, -5.0, 2.0], "double", safe_denominator) == [10.0, None, None, 2.0]


def test_density_with_zero_area(spark):
    df = spark.createDataFrame([(100, 10.0), (50, 0.0)], "pop long, area double")
    got = [r[0] for r in df.select(ratio("pop", "area")).collect()]
    assert got == [10.0, None]


def test_growth_bands_right_closed(spark):
    vals = [-1.5, -0.2, 0.3, 0.7, 2.0, -0.5, 0.0, 0.5, 1.0, None]
    got = one_col(spark, vals, "double", band_growth)
    labels = registry.GROWTH_LABELS
    assert got[:5] == labels
    # edges fall in the LOWER band
    assert got[5:9] == [labels[0], labels[1], labels[2], labels[3]]
    assert got[9] is None


@pytest.mark.parametrize(
    "value,label",
    [(0, "Até 5 mil"), (4999, "Até 5 mil"), (5000, "5 a 10 mil"), (19999, "10 a 20 mil"), (20000, "20 a 50 mil"),
     (100000, "100 a 500 mil"), (499999, "100 a 500 mil"), (500000, "Mais de 500 mil"),
     (12000000, "Mais de 500 mil")],
)
def test_size_bands_left_closed(spark, value, label):
    assert one_col(spark, [value], "long", band_size) == [label]


def test_size_band_null_and_negative(spark):
    assert one_col(spark, [None, -1], "long", band_size) == [None, None]


@pytest.mark.parametrize(
    "value,idx", [(0, 0), (0.99, 0), (1, 1), (5, 2), (24.99, 2), (25, 3), (100, 4), (500, 5), (13000, 5)]
)
def test_density_bands(spark, value, idx):
    assert one_col(spark, [float(value)], "double", band_density) == [registry.DENSITY_LABELS[idx]]


def test_quotient_reading(spark):
    got = one_col(spark, [1.6, 1.5, 1.3, 1.0, 0.5, None], "double", band_quotient)
    L = registry.QUOTIENT_LABELS
    assert got == [L[0], L[0], L[1], L[2], L[3], L[3]]


def test_bucketize_label_count():
    with pytest.raises(ValueError):
        bucketize(F.col("x"), [1, 2], ["a", "b"], right=True)


def test_sector_parts_sum_to_100(spark):
    df = spark.createDataFrame([(25.0, 25.0, 25.0, 25.0), (0.0, 0.0, 0.0, 0.0), (None, None, None, None),
                                (10.0, None, 30.0, None)], "a double, b double, c double, d double")
    tot = sum_skipping_nulls(["a", "b", "c", "d"])
    rows = df.select(tot.alias("t"), (F.col("a") / safe_denominator(tot) * 100).alias("pa")).collect()
    assert rows[0]["t"] == 100.0 and rows[0]["pa"] == 25.0
    assert rows[1]["t"] == 0.0 and rows[1]["pa"] is None          # all zero → NULL share
    assert rows[2]["t"] is None                                     # all NULL → NULL total
    assert rows[3]["t"] == 40.0 and rows[3]["pa"] == 25.0           # NULL parts skipped


def test_number_format(spark):
    df = spark.createDataFrame([(1234567.0,), (1234.5,), (None,)], "x double")
    assert [r[0] for r in df.select(fmt_number_br("x", 0)).collect()] == ["1.234.567", "1.234", "—"]
    assert [r[0] for r in df.select(fmt_number_br("x", 1)).collect()][1] == "1.234,5"


def test_compact_format(spark):
    df = spark.createDataFrame([(2300000.0,), (2300000000.0,), (4500.0,), (999.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fmt_compact_br("x")).collect()] == ["2,3 mi", "2,3 bi", "4,5 mil", "999", "—"]


def test_pad_id_keeps_long_codes(spark):
    df = spark.createDataFrame([(7,), (1234567,), (123456789012,)], "x long")
    assert [r[0] for r in df.select(pad_id("x")).collect()] == ["0000007", "1234567", "123456789012"]


def test_feed_sentinels(spark):
    vals = ["...", "..", "X", "-", "", "12.5", "abc", "nan", "inf", " 7 ", None]
    got = one_col(spark, vals, "string", parse_feed_number)
    assert got == [None, None, None, None, None, 12.5, None, None, None, 7.0, None]


def test_round_half_up(spark):
    got = one_col(spark, [0.125, 2.5, -2.5, 1.005, None], "double", lambda c: round_to(c, 2))
    assert got[0] == 0.13 and got[1] == 2.5 and got[4] is None
