"""Registered builders ``(spark, sf_dir) -> DataFrame``, one per operator,
view or named query, over the star derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import registry
from . import panels
from . import queries as nq
from .warehouse import star_for

BANDS = registry.TPCH_BANDS
PROFILE_ID = "0000007"

Builder = Callable[[SparkSession, str], DataFrame]


def _named(name: str, **params) -> Builder:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nq.run(name, star_for(spark, sf_dir), BANDS, **params)

    return build


def _qualidade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with the orders as its load log, at a fixed moment: the
    age of the newest is computed, whenever the query runs."""
    from pyspark.sql import functions as F

    from ..sources.tables import read_table

    log = read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("iniciado_em"))
    return nq.qualidade(star_for(spark, sf_dir), BANDS, load_log=log, as_of=F.lit(registry.QUALITY_AS_OF).cast("timestamp"))


def _upper(name: str) -> Builder:
    return lambda s, d: star_for(s, d).upper_facts()[name]


QUERIES: dict[str, Builder] = {
    # facts above the stored levels
    **{name: _upper(name) for name in ("fato_censo_regiao", "fato_pib_regiao", "fato_populacao_brasil", "fato_pib_brasil")},
    # the eleven named queries
    "top_municipios": _named("top_municipios"),
    "top_municipios_pib": _named("top_municipios", metrica="pib", limite=25),
    "top_municipios_pib_per_capita": _named("top_municipios", metrica="pib_per_capita", limite=20),
    "concentracao": _named("concentracao"),
    "declinio_populacional": _named("declinio_populacional"),
    "porte_populacional": _named("porte_populacional"),
    "quociente_locacional": _named("quociente_locacional"),
    "regioes": _named("regioes"),
    "serie_uf": _named("serie_uf"),
    "serie_uf_one_state": _named("serie_uf", uf="n07"),
    "descolamento_pib_populacao": _named("descolamento_pib_populacao"),
    "densidade_extremos": _named("densidade_extremos"),
    "perfil_municipio": _named("perfil_municipio", municipio=PROFILE_ID),
    "perfil_municipio_by_name": _named("perfil_municipio", municipio="CUSTOMER#000000042"),
    "qualidade": _qualidade,
    # views and panels
    "join_hierarchy": lambda s, d: panels.hierarchy(star_for(s, d)),
    "agg_available_years": lambda s, d: panels.available_years(star_for(s, d)),
    "growth_first_last": lambda s, d: panels.growth_view(star_for(s, d), BANDS),
    "growth_step": lambda s, d: panels.population_view(star_for(s, d)),
    "join_panel_municipality": lambda s, d: panels.municipality_panel(star_for(s, d), BANDS, live=True),
    "agg_uf_panel": lambda s, d: panels.uf_panel(star_for(s, d), live=True),
    "agg_region_panel": lambda s, d: panels.region_panel(star_for(s, d)),
    "ranking_view": lambda s, d: panels.ranking_view(panels.municipality_panel(star_for(s, d), BANDS)),
    "concentration_table": lambda s, d: panels.concentration_table(panels.municipality_panel(star_for(s, d), BANDS)),
}

from .load_queries import QUERIES as _LOAD_QUERIES  # noqa: E402
from .operator_queries import ALIASES  # noqa: E402
from .operator_queries import QUERIES as _OPERATOR_QUERIES  # noqa: E402

QUERIES.update(_OPERATOR_QUERIES)
QUERIES.update(_LOAD_QUERIES)
QUERIES.update({alias: QUERIES[target] for alias, target in ALIASES.items()})
