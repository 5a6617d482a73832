"""Entity panels and analytic views over the star schema.

These are the contracts of the original SQL layer, rebuilt as DataFrame
plans. Design notes for scale:

* the municipality panel is a chain of left joins on ``municipio_id``;
  every aggregated input (growth, nearest year) is already hash-partitioned
  on that key, so the chain shuffles each input once;
* "latest year" selections are scalar subqueries (``DataFrame.scalar()``),
  executed once and pruned into the fact scan as a filter;
* national totals for shares are one-row aggregates joined by broadcast
  (never an un-partitioned ``OVER ()`` window);
* every global ordering (ranks, Lorenz curve) goes through the distributed
  prefix operators.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..functions import (
    as_double,
    band_size,
    nullif_zero,
    ordinal,
    ratio,
    round_to,
    safe_denominator,
    sum_skipping_nulls,
)
from ..operators.growth import growth_first_last, growth_step
from ..operators.nearest import nearest_year_per_key
from ..operators.prefix import running_totals, with_rank
from ..registry import Bands
from ..session import broadcast_if_small
from ..sources.star import SECTOR_COLUMNS, Star

MONEY = "decimal(38,4)"
MUNICIPAL_TABLES = ("dim_municipio", "fato_populacao_municipio", "fato_censo_municipio", "fato_pib_municipio")


def hierarchy(star: Star) -> DataFrame:
    """``vw_municipio``: municipality → state → region in one row (inner joins).

    The state and region dimensions are broadcast if their files are measured
    to be small (they are tens of rows by the territory's nature), so the large
    municipality dimension keeps its bucketing on ``municipio_id``.
    """
    m = star.dim_municipio
    u = broadcast_if_small(star.dim_uf.select("uf_id", "uf_sigla", "uf_nome", "regiao_id"))
    r = broadcast_if_small(star.dim_regiao.select("regiao_id", "regiao_sigla", "regiao_nome"))
    return m.join(u, "uf_id").join(r, "regiao_id").select(
        "municipio_id",
        "municipio_nome",
        "microrregiao_id",
        "microrregiao_nome",
        "mesorregiao_id",
        "mesorregiao_nome",
        "uf_id",
        "uf_sigla",
        "uf_nome",
        "regiao_id",
        "regiao_sigla",
        "regiao_nome",
    )


def available_years(star: Star) -> DataFrame:
    """``vw_anos_disponiveis``: (serie, nivel, ano, linhas) for each fact."""
    parts = [
        ("populacao", "municipio", star.fato_populacao_municipio),
        ("populacao", "uf", star.fato_populacao_uf),
        ("pib", "municipio", star.fato_pib_municipio),
        ("pib", "uf", star.fato_pib_uf),
        ("censo", "municipio", star.fato_censo_municipio),
    ]
    out = None
    for serie, nivel, df in parts:
        g = df.groupBy("ano").agg(F.count(F.lit(1)).alias("linhas")).select(
            F.lit(serie).alias("serie"), F.lit(nivel).alias("nivel"), "ano", "linhas"
        )
        out = g if out is None else out.unionByName(g)
    return out


def growth_view(star: Star, bands: Bands = registry.REAL_BANDS, decimals: int | None = 4) -> DataFrame:
    """``vw_crescimento_municipio``: CAGR between first and last observation."""
    g = growth_first_last(
        star.fato_populacao_municipio, "municipio_id", decimals=decimals, growth_edges=bands.growth
    )
    h = hierarchy(star).select("municipio_id", "municipio_nome", "uf_sigla", "uf_nome", "regiao_nome")
    return g.join(h, "municipio_id").select(
        "municipio_id",
        "municipio_nome",
        "uf_sigla",
        "uf_nome",
        "regiao_nome",
        "ano_inicial",
        "ano_final",
        "anos",
        "n_observacoes",
        "valor_inicial",
        "valor_final",
        "variacao_absoluta",
        "variacao_pct",
        "cagr_pct",
        "faixa_crescimento",
    )


def population_view(star: Star) -> DataFrame:
    """``vw_populacao_municipio``: series with change between observations."""
    s = growth_step(star.fato_populacao_municipio, "municipio_id")
    h = hierarchy(star).select("municipio_id", "municipio_nome", "uf_sigla", "uf_nome", "regiao_nome")
    return s.join(h, "municipio_id").select(
        "municipio_id",
        "municipio_nome",
        "uf_sigla",
        "uf_nome",
        "regiao_nome",
        "ano",
        "populacao",
        "populacao_anterior",
        "anos_desde_anterior",
        "variacao_absoluta",
        "variacao_pct",
        "var_pct_anualizada",
    )


def _sector_shares(decimals: int) -> list:
    total = F.col("vab_total")
    return [
        round_to(as_double(s) * F.lit(100.0) / as_double(safe_denominator(total)), decimals).alias(f"part_{s}")
        for s in SECTOR_COLUMNS
    ]


def _latest_year(df: DataFrame, where=None):
    d = df if where is None else df.filter(where)
    return d.select(F.max("ano")).scalar()


def municipality_panel(star: Star, bands: Bands = registry.REAL_BANDS, *, live: bool = False, only: DataFrame | None = None) -> DataFrame:
    """``mv_painel_municipio``: one row per municipality of the dimension.

    Returns the materialised panel when the star carries one built with the
    same bands (unless ``live``); otherwise computes it.

    Latest population year, census, latest GDP year, latest year *with*
    sector value added (a different year on purpose), growth, and the
    population contemporary with GDP (nearest non-null year per entity,
    ties → earlier). Ratios are NULL on zero denominators; the sector total
    skips NULL parts and shares are NULL when it is not positive. ``only``
    (``municipio_id``, distinct) computes the rows of these municipalities;
    the years are still those of the whole facts.
    """
    if not live and star.mv_painel_municipio is not None and star.panel_bands == bands:
        return star.mv_painel_municipio
    pop, pib = star.fato_populacao_municipio, star.fato_pib_municipio
    ano_pop = _latest_year(pop)
    ano_pib = _latest_year(pib)
    ano_vab = _latest_year(pib, F.col("vab_industria").isNotNull())
    ano_censo = _latest_year(star.fato_censo_municipio)
    if only is not None:
        star = replace(star, **{n: getattr(star, n).join(only, "municipio_id", "left_semi") for n in MUNICIPAL_TABLES})
        pop, pib = star.fato_populacao_municipio, star.fato_pib_municipio

    pop_now = pop.filter(F.col("ano") == ano_pop).select("municipio_id", F.col("populacao").alias("populacao_atual"))
    censo = star.fato_censo_municipio.filter(F.col("ano") == ano_censo).select(
        "municipio_id", "populacao_censo", "area_km2", "densidade_hab_km2"
    )
    pib_now = pib.filter(F.col("ano") == ano_pib).select("municipio_id", "pib_mil_reais")
    vab_now = pib.filter(F.col("ano") == ano_vab).select("municipio_id", "impostos_liquidos", *SECTOR_COLUMNS)
    cresc = growth_first_last(pop, "municipio_id", decimals=4, growth_edges=bands.growth).select(
        "municipio_id",
        "cagr_pct",
        "variacao_pct",
        "variacao_absoluta",
        "faixa_crescimento",
        F.col("ano_inicial").alias("ano_inicial_serie"),
    )
    pop_pib = nearest_year_per_key(
        pop, "municipio_id", ano_pib, year_alias="ano_populacao_pib", value_alias="populacao_ano_pib"
    )
    h = hierarchy(star).select(
        "municipio_id", "municipio_nome", "uf_id", "uf_sigla", "uf_nome", "regiao_id", "regiao_nome", "mesorregiao_nome"
    )
    j = (
        h.join(pop_now, "municipio_id", "left")
        .join(censo, "municipio_id", "left")
        .join(pib_now, "municipio_id", "left")
        .join(vab_now, "municipio_id", "left")
        .join(cresc, "municipio_id", "left")
        .join(pop_pib, "municipio_id", "left")
        .withColumn("vab_total", sum_skipping_nulls(SECTOR_COLUMNS).cast(MONEY))
    )
    return j.select(
        "municipio_id",
        "municipio_nome",
        "uf_id",
        "uf_sigla",
        "uf_nome",
        "regiao_id",
        "regiao_nome",
        "mesorregiao_nome",
        ano_pop.alias("ano_populacao"),
        ano_pib.alias("ano_pib"),
        ano_vab.alias("ano_vab"),
        "populacao_atual",
        "populacao_censo",
        "area_km2",
        "densidade_hab_km2",
        "pib_mil_reais",
        "impostos_liquidos",
        *SECTOR_COLUMNS,
        "cagr_pct",
        "variacao_pct",
        "variacao_absoluta",
        "faixa_crescimento",
        "ano_inicial_serie",
        round_to(ratio("populacao_atual", "area_km2", mask="zero"), 2).alias("densidade_atual"),
        "ano_populacao_pib",
        "populacao_ano_pib",
        round_to(
            as_double("pib_mil_reais") * F.lit(1000.0) / as_double(nullif_zero(F.col("populacao_ano_pib"))), 2
        ).alias("pib_per_capita"),
        *_sector_shares(4),
        "vab_total",
        band_size(F.col("populacao_atual"), bands.size).alias("porte"),
    )


def _share_of_total(col: str, total_col: str, decimals: int):
    return round_to(as_double(col) * F.lit(100.0) / as_double(nullif_zero(F.col(total_col))), decimals)


def uf_panel(star: Star, *, live: bool = False) -> DataFrame:
    """``vw_painel_uf``: state panel with shares of the national totals
    (the materialised copy when the star carries one, unless ``live``)."""
    if not live and star.mv_painel_uf is not None:
        return star.mv_painel_uf
    pop, pib = star.fato_populacao_uf, star.fato_pib_uf
    ano_pop, ano_pib = _latest_year(pop), _latest_year(pib)
    ano_vab = _latest_year(pib, F.col("vab_industria").isNotNull())
    ano_censo = _latest_year(star.fato_censo_uf)
    u = star.dim_uf.join(star.dim_regiao.select("regiao_id", "regiao_nome"), "regiao_id")
    base = (
        u.join(
            pop.filter(F.col("ano") == ano_pop).select("uf_id", F.col("populacao").alias("populacao_atual")),
            "uf_id",
            "left",
        )
        .join(
            star.fato_censo_uf.filter(F.col("ano") == ano_censo).select(
                "uf_id", "populacao_censo", "area_km2", "densidade_hab_km2"
            ),
            "uf_id",
            "left",
        )
        .join(pib.filter(F.col("ano") == ano_pib).select("uf_id", "pib_mil_reais"), "uf_id", "left")
        .join(
            pib.filter(F.col("ano") == ano_vab).select("uf_id", "impostos_liquidos", *SECTOR_COLUMNS), "uf_id", "left"
        )
        .join(
            nearest_year_per_key(pop, "uf_id", ano_pib, year_alias="ano_populacao_pib", value_alias="populacao_ano_pib"),
            "uf_id",
            "left",
        )
    )
    totals = base.agg(
        F.sum("pib_mil_reais").alias("_t_pib"),
        F.sum("populacao_atual").alias("_t_pop"),
        F.sum("area_km2").alias("_t_area"),
    )
    b = base.crossJoin(F.broadcast(totals)).withColumn("vab_total", sum_skipping_nulls(SECTOR_COLUMNS).cast(MONEY))
    return b.select(
        "uf_id",
        "uf_sigla",
        "uf_nome",
        "regiao_id",
        "regiao_nome",
        ano_pop.alias("ano_populacao"),
        ano_pib.alias("ano_pib"),
        ano_vab.alias("ano_vab"),
        "populacao_atual",
        "populacao_censo",
        "area_km2",
        "densidade_hab_km2",
        "pib_mil_reais",
        "impostos_liquidos",
        *SECTOR_COLUMNS,
        "ano_populacao_pib",
        "populacao_ano_pib",
        round_to(ratio("populacao_atual", "area_km2", mask="zero"), 2).alias("densidade_atual"),
        round_to(
            as_double("pib_mil_reais") * F.lit(1000.0) / as_double(nullif_zero(F.col("populacao_ano_pib"))), 2
        ).alias("pib_per_capita"),
        _share_of_total("pib_mil_reais", "_t_pib", 4).alias("part_pib_brasil"),
        _share_of_total("populacao_atual", "_t_pop", 4).alias("part_pop_brasil"),
        _share_of_total("area_km2", "_t_area", 4).alias("part_area_brasil"),
        *_sector_shares(4),
        "vab_total",
    )


REGION_SUMS = [
    "populacao_atual",
    "populacao_ano_pib",
    "populacao_censo",
    "area_km2",
    "pib_mil_reais",
    *SECTOR_COLUMNS,
]


def region_panel(star: Star, region_order=None) -> DataFrame:
    """``vw_painel_regiao``: sums of the state panel (so the two levels close),
    ratios from the sums (never a mean of ratios), shares, counts of states
    and municipalities. ``ordem`` is the canonical position of the region."""
    ufp = uf_panel(star)
    agg = ufp.groupBy("regiao_id", "regiao_nome").agg(
        F.count(F.lit(1)).alias("n_ufs"),
        *[F.sum(c).alias(c) for c in REGION_SUMS],
        F.min("ano_populacao").alias("ano_populacao"),
        F.min("ano_pib").alias("ano_pib"),
        F.min("ano_vab").alias("ano_vab"),
    )
    n_mun = hierarchy(star).groupBy("regiao_id").agg(F.count(F.lit(1)).alias("n_municipios"))
    agg = agg.join(n_mun, "regiao_id", "left").withColumn(
        "n_municipios", F.coalesce(F.col("n_municipios"), F.lit(0)).cast("long")
    )
    totals = agg.agg(
        F.sum("pib_mil_reais").alias("_t_pib"),
        F.sum("populacao_atual").alias("_t_pop"),
        F.sum("area_km2").alias("_t_area"),
    )
    out = agg.crossJoin(F.broadcast(totals)).select(
        "regiao_id",
        "regiao_nome",
        "n_ufs",
        *[F.col(c).cast(MONEY).alias(c) if c in ("pib_mil_reais", *SECTOR_COLUMNS) else F.col(c) for c in REGION_SUMS],
        "ano_populacao",
        "ano_pib",
        "ano_vab",
        "n_municipios",
        round_to(ratio("populacao_atual", "area_km2", mask="zero"), 2).alias("densidade_atual"),
        round_to(
            as_double("pib_mil_reais") * F.lit(1000.0) / as_double(nullif_zero(F.col("populacao_ano_pib"))), 2
        ).alias("pib_per_capita"),
        _share_of_total("pib_mil_reais", "_t_pib", 4).alias("part_pib_brasil"),
        _share_of_total("populacao_atual", "_t_pop", 4).alias("part_pop_brasil"),
        _share_of_total("area_km2", "_t_area", 4).alias("part_area_brasil"),
    )
    if region_order:
        out = out.withColumn("ordem", ordinal("regiao_nome", region_order))
    return out


RANK_INDICATORS = {
    "rank_populacao": "populacao_atual",
    "rank_pib": "pib_mil_reais",
    "rank_pib_per_capita": "pib_per_capita",
    "rank_densidade": "densidade_atual",
    "rank_crescimento": "cagr_pct",
}


RANKS_IN_STATE = {"rank_populacao_uf": "populacao_atual", "rank_pib_uf": "pib_mil_reais"}
PERCENTILES = {"percentil_pib_per_capita": "pib_per_capita", "percentil_crescimento": "cagr_pct"}


def ranking_view(panel: DataFrame) -> DataFrame:
    """``vw_ranking_municipio``: national ranks (DESC NULLS LAST) of five
    indicators, ranks within the state for two, and two percentiles
    (``percent_rank`` ASC NULLS FIRST × 100, 2 decimals).

    All nine orderings run in *one* distributed rank pass: the indicators
    are unpivoted to ``(metric, group, value)`` — group is the state for the
    in-state ranks, the value is negated for the ascending percentiles and
    the NULL placement is a per-metric flag — and pivoted back by id.
    """
    ids = ["municipio_id"]
    base = panel.select(
        "municipio_id", "municipio_nome", "uf_sigla", "regiao_nome",
        "populacao_atual", "pib_mil_reais", "pib_per_capita", "densidade_atual", "cagr_pct",
    )

    def item(metric: str, col: str, in_state: bool = False, ascending: bool = False):
        v = as_double(col)
        return F.struct(
            F.lit(metric).alias("metric"),
            (F.coalesce(F.col("uf_sigla"), F.lit("")) if in_state else F.lit("")).alias("grp"),
            (-v if ascending else v).alias("v"),
            F.lit(not ascending).alias("nl"),
        )

    items = [item(m, c) for m, c in RANK_INDICATORS.items()]
    items += [item(m, c, in_state=True) for m, c in RANKS_IN_STATE.items()]
    items += [item(m, c, ascending=True) for m, c in PERCENTILES.items()]
    long = base.select(*ids, "uf_sigla", F.explode(F.array(*items)).alias("x")).select(
        *ids, "x.metric", "x.grp", "x.v", "x.nl"
    )
    ranked = with_rank(
        long, "v", ["metric", "grp"], descending=True, nulls_last=F.col("nl"), rank_col="r", percent_col="p"
    )
    # Back to one row per entity with conditional aggregates (one shuffle on
    # the id, partial aggregation), then joined to the panel on its bucket key.
    wide = ranked.groupBy(*ids).agg(
        *[F.max(F.when(F.col("metric") == F.lit(m), F.col("r"))).cast("long").alias(m)
          for m in [*RANK_INDICATORS, *RANKS_IN_STATE]],
        *[round_to(F.max(F.when(F.col("metric") == F.lit(m), F.col("p"))) * F.lit(100.0), 2).alias(m)
          for m in PERCENTILES],
    )
    out = base.join(wide, ids, "left")
    return out.select(*base.columns, *[*RANK_INDICATORS, *RANKS_IN_STATE], *PERCENTILES)


def ranking_for(star: Star, bands: Bands = registry.REAL_BANDS) -> DataFrame:
    """The materialised ranking view when available, else computed."""
    if star.mv_ranking_municipio is not None and star.panel_bands == bands:
        return star.mv_ranking_municipio
    return ranking_view(municipality_panel(star, bands))


def concentration_for(star: Star, bands: Bands = registry.REAL_BANDS) -> DataFrame:
    """The materialised Lorenz table when available, else computed."""
    if star.mv_concentracao_municipio is not None and star.panel_bands == bands:
        return star.mv_concentracao_municipio
    return concentration_table(municipality_panel(star, bands))


def concentration_table(panel: DataFrame) -> DataFrame:
    """``mv_concentracao_municipio``: the Lorenz table of population and GDP.

    Per metric, entities sorted by value DESC then id; position, running
    value and running area (ROWS frame), shares rounded to 6 decimals. The
    two metrics are one unpivoted table ranked with the metric as group.
    """
    base = panel.select("municipio_id", "municipio_nome", "uf_sigla", "regiao_nome",
                        "populacao_atual", "pib_mil_reais", "area_km2")
    long = base.select(
        "municipio_id", "municipio_nome", "uf_sigla", "regiao_nome", "area_km2",
        F.explode(
            F.array(
                F.struct(F.lit("populacao").alias("metrica"), F.col("populacao_atual").cast(MONEY).alias("valor")),
                F.struct(F.lit("pib").alias("metrica"), F.col("pib_mil_reais").cast(MONEY).alias("valor")),
            )
        ).alias("x"),
    ).select("municipio_id", "municipio_nome", "uf_sigla", "regiao_nome", "area_km2", "x.metrica", "x.valor")
    long = long.filter(F.col("valor").isNotNull())
    pref = running_totals(
        long,
        [F.col("valor").desc(), F.col("municipio_id").asc()],
        {"valor_acumulado": F.col("valor"), "area_acumulada": F.coalesce(F.col("area_km2"), F.lit(0))},
        ["metrica"],
        row_number="posicao",
    )
    totals = long.groupBy("metrica").agg(
        F.sum("valor").alias("_t_v"), F.sum("area_km2").alias("_t_a"), F.count(F.lit(1)).alias("_n")
    )
    # One row per metric (two rows): a proven bound, broadcast.
    j = pref.join(F.broadcast(totals), "metrica")
    return j.select(
        "metrica",
        "posicao",
        "municipio_id",
        "municipio_nome",
        "uf_sigla",
        "regiao_nome",
        F.col("valor").cast(MONEY).alias("valor"),
        F.col("valor_acumulado").cast(MONEY).alias("valor_acumulado"),
        _share_of_total("valor", "_t_v", 6).alias("share_pct"),
        _share_of_total("valor_acumulado", "_t_v", 6).alias("share_acumulado_pct"),
        round_to(as_double("posicao") * F.lit(100.0) / as_double("_n"), 6).alias("pct_municipios"),
        _share_of_total("area_acumulada", "_t_a", 6).alias("area_acumulada_pct"),
    )
