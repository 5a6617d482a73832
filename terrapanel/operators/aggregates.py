"""Grouped summaries, rankings and reshapes used by the analysis layer.

All are single grouped passes (partial aggregation before the shuffle)
plus, where a percentage of the whole is needed, a one-row total joined
by broadcast. Top-k operators are ``orderBy(...).limit(k)`` — Spark plans
them as per-partition top-k plus a merge (TakeOrderedAndProject), never a
global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import registry
from ..functions import as_double, band_density, band_size, fixed_point, from_fixed_point, nullif_zero, ordinal, round_to
from .prefix import running_totals
from .quantiles import exact_quantiles, with_median


def _pct(col: str, total: str) -> F.Column:
    return as_double(col) * F.lit(100.0) / as_double(nullif_zero(F.col(total)))


def with_total_shares(grouped: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add ``out = col / sum(col) * 100`` for each ``out: col`` pair using a
    one-row total (the grouped frame is small: one row per group)."""
    tot = grouped.agg(*[F.sum(c).alias(f"_t_{c}") for c in set(cols.values())])
    j = grouped.crossJoin(F.broadcast(tot))
    return j.select(*grouped.columns, *[_pct(c, f"_t_{c}").alias(o) for o, c in cols.items()])


# --------------------------------------------------------------------------
# Distributions by band
# --------------------------------------------------------------------------


def size_distribution(panel: DataFrame, edges=registry.SIZE_EDGES, population: str = "populacao_atual") -> DataFrame:
    """Count and population per size band (NULL bands dropped), with shares
    and the canonical band position ``ordem``."""
    d = panel.withColumn("porte", band_size(F.col(population), edges)).filter(F.col("porte").isNotNull())
    g = d.groupBy("porte").agg(F.count(F.lit(1)).alias("n_municipios"), F.sum(population).alias("populacao"))
    out = with_total_shares(g, {"pct_municipios": "n_municipios", "pct_populacao": "populacao"})
    return out.withColumn("ordem", ordinal("porte", registry.SIZE_LABELS))


def density_distribution(panel: DataFrame, edges=registry.DENSITY_EDGES, density: str = "densidade_atual") -> DataFrame:
    """Count, area and population per density band, with shares."""
    d = panel.withColumn("faixa_densidade", band_density(F.col(density), edges)).filter(
        F.col("faixa_densidade").isNotNull()
    )
    g = d.groupBy("faixa_densidade").agg(
        F.count(F.lit(1)).alias("n_municipios"),
        F.sum("area_km2").cast("decimal(38,3)").alias("area_km2"),
        F.sum("populacao_atual").alias("populacao"),
    )
    out = with_total_shares(g, {"pct_area": "area_km2", "pct_populacao": "populacao"})
    return out.withColumn("ordem", ordinal("faixa_densidade", registry.DENSITY_LABELS))


def growth_band_distribution(growth: DataFrame) -> DataFrame:
    """Entities and final population per growth band, % of entities."""
    g = (
        growth.filter(F.col("faixa_crescimento").isNotNull())
        .groupBy("faixa_crescimento")
        .agg(F.count(F.lit(1)).alias("n_municipios"), F.sum("valor_final").alias("populacao"))
    )
    out = with_total_shares(g, {"pct_municipios": "n_municipios"})
    return out.withColumn("ordem", ordinal("faixa_crescimento", registry.GROWTH_LABELS))


def band_subset_share(distribution: DataFrame, band_col: str, bands: Sequence[str],
                      cols: Sequence[str] = ("pct_municipios", "pct_populacao")) -> DataFrame:
    """Share of entities / population held by a chosen subset of bands."""
    d = distribution.filter(F.col(band_col).isin(list(bands)))
    return d.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])


# --------------------------------------------------------------------------
# Growth summaries
# --------------------------------------------------------------------------


def _add_median(grouped: DataFrame, df: DataFrame, col: str, decimals: int | None, out: str, groups: Sequence[str] = ()):
    """``grouped`` with the exact median of ``col``; with ``decimals`` it runs
    on fixed-point integers of the rounded measure (reproducible across
    engines)."""
    if decimals is None:
        return with_median(grouped, df, F.col(col), out, groups)
    publish = lambda c: round_to(from_fixed_point(c, decimals), decimals)
    return with_median(grouped, df, fixed_point(F.col(col), decimals), out, groups, publish)


def growth_by_region(growth: DataFrame, decimals: int | None = None) -> DataFrame:
    """Per region: entities, shrinking ones, median CAGR, summed initial and
    final values, % shrinking and growth of the summed values."""
    known = growth.filter(F.col("regiao_nome").isNotNull())
    g = known.groupBy("regiao_nome").agg(
        F.count("municipio_id").alias("n_municipios"),
        F.count_if(F.col("variacao_absoluta") < 0).alias("n_perdendo"),
        F.sum("valor_inicial").alias("populacao_inicial"),
        F.sum("valor_final").alias("populacao_final"),
    )
    return _add_median(g, known, "cagr_pct", decimals, "cagr_mediano", ["regiao_nome"]).select(
        "regiao_nome", "n_municipios", "n_perdendo", "cagr_mediano", "populacao_inicial", "populacao_final",
        (as_double("n_perdendo") / as_double("n_municipios") * F.lit(100.0)).alias("pct_perdendo"),
        ((as_double("populacao_final") / as_double(nullif_zero(F.col("populacao_inicial"))) - F.lit(1.0))
         * F.lit(100.0)).alias("crescimento_regional_pct"),
    )


def decline_summary(growth: DataFrame, decimals: int | None = None) -> DataFrame:
    """Total entities, shrinking ones, their %, people lost (positive) and
    the median CAGR — one row; an empty input gives zeros."""
    shrinking = F.col("variacao_absoluta") < 0
    totals = growth.agg(
        F.count(F.lit(1)).alias("total_municipios"),
        F.count_if(shrinking).alias("n_perdendo"),
        F.coalesce(as_double(F.count_if(shrinking)) / as_double(nullif_zero(F.count(F.lit(1)))) * F.lit(100.0),
                   F.lit(0.0)).alias("pct_perdendo"),
        F.coalesce(-F.sum(F.when(shrinking, F.col("variacao_absoluta"))), F.lit(0)).alias("populacao_perdida"),
    )
    return _add_median(totals, growth, "cagr_pct", decimals, "cagr_mediano")


def declining(growth: DataFrame) -> DataFrame:
    """Entities that lost population over their whole series, the steepest
    loss by CAGR first."""
    return growth.filter(F.col("variacao_absoluta") < 0).orderBy(F.col("cagr_pct").asc_nulls_last())


# --------------------------------------------------------------------------
# Series by year
# --------------------------------------------------------------------------


def share_of_group(df: DataFrame, value: str, group: str = "ano", out: str = "part_pib_brasil") -> DataFrame:
    """``value / sum(value) per group * 100`` (rows with NULL value dropped).

    Per-group totals are a grouped aggregate joined back; the planner
    broadcasts them by their run-time size, or splits a group that holds
    many of the rows."""
    d = df.filter(F.col(value).isNotNull())
    tot = d.groupBy(group).agg(F.sum(value).alias("_t"))
    return d.join(tot, group).withColumn(out, _pct(value, "_t")).drop("_t")


def region_year_share(pib_uf_enriched: DataFrame, value: str = "pib_mil_reais") -> DataFrame:
    """Share of the national value per (year, region)."""
    s = share_of_group(pib_uf_enriched, value, "ano", "part_pib_brasil")
    return s.groupBy("ano", "regiao_nome").agg(F.sum("part_pib_brasil").alias("part_pib_brasil"))


def region_year_sum(df: DataFrame, value: str = "populacao") -> DataFrame:
    return df.groupBy("ano", "regiao_nome").agg(F.sum(value).alias(value))


def region_sums(df: DataFrame, cols: Sequence[str], region_order: Sequence[str] | None = None) -> DataFrame:
    """Sum of the available columns by region (all-NULL → NULL); with an
    order given, sorted by the region's canonical position ``ordem``."""
    present = [c for c in cols if c in df.columns]
    g = df.groupBy("regiao_nome").agg(*[F.sum(c).alias(c) for c in present])
    if region_order:
        g = g.withColumn("ordem", ordinal("regiao_nome", region_order)).orderBy(F.col("ordem").asc_nulls_last(), "regiao_nome")
    return g


def numbered(df: DataFrame, order: str, out: str = "posicao") -> DataFrame:
    """A short sorted table (one row per region) with the place of each row."""
    place = F.row_number().over(Window.orderBy(F.col(order).asc_nulls_last()))
    return df.withColumn(out, place.cast("int"))


# --------------------------------------------------------------------------
# Rankings
# --------------------------------------------------------------------------


def topk(df: DataFrame, col: str, n: int = 20, *, ascending: bool = False, key: str = "municipio_id",
         cols: Sequence[str] | None = None) -> DataFrame:
    """Top/bottom ``n`` by ``col`` (NULLs dropped, id tiebreak), with ``posicao``."""
    order = [F.col(col).asc() if ascending else F.col(col).desc(), F.col(key).asc()]
    top = df.filter(F.col(col).isNotNull()).orderBy(*order).limit(int(n))
    top = top.withColumn("posicao", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return top.select("posicao", *(cols or top.columns[:-1]))


def top_growth(growth: DataFrame, n: int = 20, min_population: int = 20_000, *, ascending: bool = False) -> DataFrame:
    """Fastest growing (or shrinking) entities among those with at least
    ``min_population`` at the end of the series."""
    base = growth.filter(F.col("valor_final") >= F.lit(min_population))
    return topk(base, "cagr_pct", n, ascending=ascending,
                cols=["municipio_id", "municipio_nome", "uf_sigla", "regiao_nome", "valor_inicial", "valor_final",
                      "cagr_pct"])


def extremes(panel: DataFrame, n: int = 15) -> DataFrame:
    """Densest, emptiest and largest-area entities as one labelled table."""
    cols = ["municipio_id", "municipio_nome", "uf_sigla", "regiao_nome", "populacao_atual", "area_km2",
            "densidade_atual"]
    valid = panel.filter(F.col("densidade_atual").isNotNull())
    parts = [
        ("mais_densos", topk(valid, "densidade_atual", n, cols=cols)),
        ("mais_vazios", topk(valid, "densidade_atual", n, ascending=True, cols=cols)),
        ("maiores_areas", topk(valid, "area_km2", n, cols=cols)),
    ]
    out = None
    for label, df in parts:
        df = df.withColumn("grupo", F.lit(label))
        out = df if out is None else out.unionByName(df)
    return out


def rank_ufs(uf_panel: DataFrame, col: str = "pib_mil_reais") -> DataFrame:
    """Every state with its position by an indicator (``posicao`` 1 =
    largest; states without the indicator come last), sorted."""
    cols = [c for c in ["uf_sigla", "uf_nome", "regiao_nome", col, "part_pib_brasil", "pib_per_capita"]
            if c in uf_panel.columns]
    order = [F.col(col).desc_nulls_last(), F.col("uf_sigla").asc()]
    return running_totals(uf_panel.select(*cols), order, row_number="posicao").orderBy("posicao")


def gdp_pop_ratio(uf_panel: DataFrame) -> DataFrame:
    """Share of GDP over share of population per state."""
    return uf_panel.select(
        "uf_sigla", "uf_nome", "regiao_nome", "part_pib_brasil", "part_pop_brasil",
        (F.col("part_pib_brasil") / nullif_zero(F.col("part_pop_brasil"))).alias("razao_pib_pop"),
        "pib_per_capita",
    ).orderBy(F.col("razao_pib_pop").desc_nulls_last())


def sector_structure_long(panel: DataFrame, key: str = "uf_sigla") -> DataFrame:
    """Sector shares in long form ``(key, regiao_nome, setor, participacao)``,
    NULL shares dropped (``UNPIVOT`` excludes NULLs)."""
    present = [c for c in registry.SECTORS if f"part_{c}" in panel.columns]
    long = panel.unpivot([key, "regiao_nome"], [f"part_{c}" for c in present], "setor", "participacao")
    labels = F.create_map(*[x for c in present for x in (F.lit(f"part_{c}"), F.lit(registry.SECTORS[c]))])
    return long.filter(F.col("participacao").isNotNull()).withColumn("setor", labels[F.col("setor")])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-NULL members of a column (filter choices)."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def filter_members(df: DataFrame, regions: Sequence[str] = (), states: Sequence[str] = ()) -> DataFrame:
    """Optional multi-select on region / state; empty selection = everything."""
    out = df
    if regions:
        out = out.filter(F.col("regiao_nome").isin(list(regions)))
    if states:
        out = out.filter(F.col("uf_sigla").isin(list(states)))
    return out


def selection_share(df: DataFrame, selected: DataFrame, value: str = "populacao_atual") -> DataFrame:
    """Share (%) of the selected subset's total in the whole total."""
    a = selected.agg(F.sum(value).alias("_s"))
    b = df.agg(F.sum(value).alias("_t"))
    return a.crossJoin(b).select(_pct("_s", "_t").alias("pct_selecao"))


# --------------------------------------------------------------------------
# Report-shaped aggregates
# --------------------------------------------------------------------------


def headline(panel: DataFrame, growth: DataFrame) -> DataFrame:
    """National KPIs: totals, density and per capita from the sums (Σ/Σ),
    entities, shrinking entities and the largest entity."""
    p = panel.agg(
        F.sum("populacao_atual").alias("populacao_total"),
        F.sum("pib_mil_reais").alias("pib_total"),
        F.sum("area_km2").cast("decimal(38,3)").alias("area_total"),
        F.count(F.lit(1)).alias("n_municipios"),
        F.max_by("municipio_nome", F.struct(F.col("populacao_atual"), -F.col("municipio_id").cast("long")))
        .alias("maior_municipio"),
        F.max("populacao_atual").alias("maior_populacao"),
    )
    g = growth.agg(F.count_if(F.col("variacao_absoluta") < 0).alias("n_em_declinio"))
    return p.crossJoin(g).select(
        "populacao_total", "pib_total", "area_total", "n_municipios",
        (as_double("populacao_total") / as_double(nullif_zero(F.col("area_total")))).alias("densidade"),
        (as_double("pib_total") * F.lit(1000.0) / as_double(nullif_zero(F.col("populacao_total")))).alias(
            "pib_per_capita"),
        "n_em_declinio",
        (as_double("n_em_declinio") / as_double(nullif_zero(F.col("n_municipios"))) * F.lit(100.0)).alias(
            "pct_em_declinio"),
        "maior_municipio", "maior_populacao",
    )


def min_median_max(df: DataFrame, col: str, decimals: int | None = None) -> DataFrame:
    """Count of non-NULL values, min, median and max of an indicator."""
    ends = df.agg(F.count(col).alias("n"), F.min(col).alias("minimo"), F.max(col).alias("maximo"))
    return _add_median(ends, df, col, decimals, "mediana").select("n", "minimo", "mediana", "maximo")


def quantile_breaks(df: DataFrame, col: str, n: int = registry.QUANTILE_CLASSES, decimals: int = 6) -> DataFrame:
    """Distinct sorted quantile cut points (0, 1/n, …, 1), exact with linear
    interpolation; rounded half away from zero to ``decimals``. One row; an
    input without a value gives NULL cut points."""
    q = exact_quantiles(df, as_double(col), [i / n for i in range(n + 1)])
    rounded = F.transform("quantiles", lambda x: round_to(x, decimals))
    return q.select(F.array_sort(F.array_distinct(rounded)).alias("quebras"))


def histogram(df: DataFrame, col: str, bins: int = 30, *, log10: bool = False) -> DataFrame:
    """Counts in ``bins`` equal-width bins (NULLs dropped; with ``log10``
    only positive values, binned on log10). Columns: bin, lower, upper, n."""
    x = F.log10(col) if log10 else as_double(col)
    d = df.filter(F.col(col).isNotNull() & ((F.col(col) > 0) if log10 else F.lit(True))).select(x.alias("x"))
    rng = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(w > 0, F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = d.crossJoin(F.broadcast(rng)).withColumn("bin", b.cast("int"))
    g = binned.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return g.select("bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), "n")


def last_point(df: DataFrame, series: str, year: str = "ano", value: str = "valor",
               order: Sequence[str] | None = None) -> DataFrame:
    """Last observation of each series (direct labels), canonical order."""
    g = df.filter(F.col(value).isNotNull()).groupBy(series).agg(
        F.max_by(F.struct(F.col(year), F.col(value)), F.col(year)).alias("_p")
    ).select(series, F.col(f"_p.{year}").alias(year), F.col(f"_p.{value}").alias(value))
    if order:
        g = g.withColumn("ordem", ordinal(series, order))
    return g


def growth_table(growth: DataFrame) -> DataFrame:
    """Every entity's growth row, CAGR descending (NULLs last), id tiebreak."""
    return growth.orderBy(F.col("cagr_pct").desc_nulls_last(), F.col("municipio_id"))


def density_by_region(region_panel: DataFrame) -> DataFrame:
    return region_panel.select("regiao_nome", "populacao_atual", "area_km2", "densidade_atual",
                               "part_pop_brasil", "part_area_brasil")


def choropleth_input(panel: DataFrame, value: str, *, log10: bool = False, key: str = "municipio_id",
                     name: str = "municipio_nome") -> DataFrame:
    """Map input: id as string, value, name; NULL values dropped; optional
    log10 with non-positive values clipped to the smallest positive one."""
    d = panel.filter(F.col(value).isNotNull()).select(
        F.col(key).cast("string").alias("codarea"), F.col(name).alias("nome"), as_double(value).alias("valor")
    )
    if not log10:
        return d
    floor_v = d.filter(F.col("valor") > 0).agg(F.min("valor").alias("_m"))
    return d.crossJoin(F.broadcast(floor_v)).select(
        "codarea", "nome", "valor", F.log10(F.greatest(F.col("valor"), F.col("_m"))).alias("valor_log10")
    )

