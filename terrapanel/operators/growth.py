"""Series operators over irregular yearly series (holes are absent rows).

All are per-entity computations: a ``groupBy`` or a window partitioned by
the entity key, whose groups are bounded by the number of years — no global
ordering is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_double, band_growth, fixed_point, from_fixed_point, nullif_zero, round_to


def growth_first_last(
    df: DataFrame,
    key: str | list[str],
    value: str = "populacao",
    year: str = "ano",
    *,
    decimals: int | None = None,
    growth_edges=None,
) -> DataFrame:
    """First/last non-null observation per key and the growth between them.

    Output: key, ``ano_inicial, ano_final, anos, n_observacoes,
    valor_inicial, valor_final, variacao_absoluta, variacao_pct, cagr_pct``
    (+ ``faixa_crescimento`` when ``growth_edges`` is given). Keys whose
    first value is ``<= 0`` are dropped; a one-point series has NULL CAGR.
    ``decimals`` rounds ``variacao_pct``/``cagr_pct`` (half-up) *before*
    banding, as the SQL layer of the original does; ``None`` keeps doubles.
    """
    keys = [key] if isinstance(key, str) else list(key)
    v, y = F.col(value), F.col(year)
    ext = (
        df.filter(v.isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(y).alias("ano_inicial"),
            F.max(y).alias("ano_final"),
            F.min_by(v, y).alias("valor_inicial"),
            F.max_by(v, y).alias("valor_final"),
            F.count(F.lit(1)).alias("n_observacoes"),
        )
        .filter(F.col("valor_inicial") > 0)
    )
    r = as_double("valor_final") / as_double("valor_inicial")
    anos = F.col("ano_final") - F.col("ano_inicial")
    var_pct = (r - F.lit(1.0)) * F.lit(100.0)
    cagr = (F.pow(r, F.lit(1.0) / as_double(nullif_zero(anos))) - F.lit(1.0)) * F.lit(100.0)
    if decimals is not None:
        var_pct, cagr = round_to(var_pct, decimals), round_to(cagr, decimals)
    out = ext.select(
        *keys,
        "ano_inicial",
        "ano_final",
        anos.alias("anos"),
        "n_observacoes",
        "valor_inicial",
        "valor_final",
        (F.col("valor_final") - F.col("valor_inicial")).alias("variacao_absoluta"),
        var_pct.alias("variacao_pct"),
        cagr.alias("cagr_pct"),
    )
    if growth_edges is not None:
        out = out.withColumn("faixa_crescimento", band_growth(F.col("cagr_pct"), growth_edges))
    return out


def growth_step(
    df: DataFrame, key: str, value: str = "populacao", year: str = "ano", *, decimals: int | None = 4
) -> DataFrame:
    """Change between consecutive *observations* of each key.

    Adds ``<value>_anterior``, ``anos_desde_anterior``, ``variacao_absoluta``,
    ``variacao_pct`` and the annualised ``var_pct_anualizada`` (the gap in
    years is the exponent, so a 3-year hole is not read as one year).
    """
    w = Window.partitionBy(key).orderBy(year)
    prev_v, prev_y = F.lag(value).over(w), F.lag(year).over(w)
    base = df.filter(F.col(value).isNotNull()).select(
        "*", prev_v.alias(f"{value}_anterior"), prev_y.alias("_ano_anterior")
    )
    r = as_double(value) / as_double(nullif_zero(F.col(f"{value}_anterior")))
    gap = F.col(year) - F.col("_ano_anterior")
    pct = (r - F.lit(1.0)) * F.lit(100.0)
    ann = (F.pow(r, F.lit(1.0) / as_double(nullif_zero(gap))) - F.lit(1.0)) * F.lit(100.0)
    if decimals is not None:
        pct, ann = round_to(pct, decimals), round_to(ann, decimals)
    return base.select(
        *[c for c in df.columns],
        F.col(f"{value}_anterior"),
        gap.alias("anos_desde_anterior"),
        (F.col(value) - F.col(f"{value}_anterior")).alias("variacao_absoluta"),
        pct.alias("variacao_pct"),
        ann.alias("var_pct_anualizada"),
    )


def pct_change(df: DataFrame, value: str, order: str = "ano", *, decimals: int | None = None) -> DataFrame:
    """Change vs the previous row of a *short* series (one row per year).

    The window has no partition: only for already-aggregated yearly series
    (one row per year), never for entity-level tables.
    """
    prev = F.lag(value).over(Window.orderBy(order))
    pct = (as_double(value) / as_double(nullif_zero(prev)) - F.lit(1.0)) * F.lit(100.0)
    if decimals is not None:
        pct = round_to(pct, decimals)
    return df.withColumn("variacao_pct", pct)


def index_base100(df: DataFrame, key: str, value: str = "populacao", year: str = "ano", base_year=None) -> DataFrame:
    """``value / value(base year) * 100`` per key; base = given or first year.

    The base value comes from a window partitioned by the key (one shuffle,
    groups bounded by the number of years). Keys absent in the base year get
    NULL.
    """
    d = df.filter(F.col(value).isNotNull())
    if base_year is None:
        base = d.select(F.min(year)).scalar()
    else:
        base = F.lit(base_year)
    w = Window.partitionBy(key)
    base_v = F.max(F.when(F.col(year) == base, F.col(value))).over(w)
    return d.withColumn("indice", as_double(value) / as_double(nullif_zero(base_v)) * F.lit(100.0))


def national_series(df: DataFrame, value: str = "populacao", year: str = "ano") -> DataFrame:
    """Sum over entities per year + % change vs previous year."""
    s = df.groupBy(year).agg(F.sum(value).alias(value))
    return pct_change(s, value, year)


def fixed_point_mean(c, decimals: int = 4):
    """Mean of a rounded measure, computed on exact fixed-point integers so
    the result does not depend on summation order."""
    fp = fixed_point(c, decimals)
    mean = F.sum(fp).cast("double") / F.count(fp).cast("double")
    return round_to(from_fixed_point(mean, decimals), decimals)
