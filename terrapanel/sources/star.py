"""The star schema every operator and query reads.

Three dimensions (region → state → municipality), population / census /
GDP facts at the three levels, and the load log. Grains:

* ``dim_regiao(regiao_id, regiao_sigla, regiao_nome)``
* ``dim_uf(uf_id, uf_sigla, uf_nome, regiao_id)``
* ``dim_municipio(municipio_id, municipio_nome, microrregiao_id/nome,
  mesorregiao_id/nome, uf_id)`` — ``municipio_id`` is a zero-padded string
* ``fato_populacao_{municipio,uf,regiao}(<id>, ano, populacao)``
* ``fato_censo_{municipio,uf}(<id>, ano, populacao_censo, area_km2,
  densidade_hab_km2)``
* ``fato_pib_{municipio,uf}(<id>, ano, pib_mil_reais, impostos_liquidos,
  vab_agropecuaria, vab_industria, vab_servicos, vab_administracao_publica)``

Holes in a series are absent rows, never NULL-valued rows.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio, round_to

DIM_TABLES = ("dim_regiao", "dim_uf", "dim_municipio")
FACT_TABLES = (
    "fato_populacao_municipio",
    "fato_populacao_uf",
    "fato_populacao_regiao",
    "fato_censo_municipio",
    "fato_censo_uf",
    "fato_pib_municipio",
    "fato_pib_uf",
)

#: Primary keys, used by the constraint checks and the append load.
PRIMARY_KEYS = {
    "dim_regiao": ["regiao_id"],
    "dim_uf": ["uf_id"],
    "dim_municipio": ["municipio_id"],
    "fato_populacao_municipio": ["municipio_id", "ano"],
    "fato_populacao_uf": ["uf_id", "ano"],
    "fato_populacao_regiao": ["regiao_id", "ano"],
    "fato_censo_municipio": ["municipio_id", "ano"],
    "fato_censo_uf": ["uf_id", "ano"],
    "fato_pib_municipio": ["municipio_id", "ano"],
    "fato_pib_uf": ["uf_id", "ano"],
}

#: Foreign keys: table → (column, parent table, parent column).
FOREIGN_KEYS = {
    "dim_uf": ("regiao_id", "dim_regiao", "regiao_id"),
    "dim_municipio": ("uf_id", "dim_uf", "uf_id"),
    "fato_populacao_municipio": ("municipio_id", "dim_municipio", "municipio_id"),
    "fato_populacao_uf": ("uf_id", "dim_uf", "uf_id"),
    "fato_populacao_regiao": ("regiao_id", "dim_regiao", "regiao_id"),
    "fato_censo_municipio": ("municipio_id", "dim_municipio", "municipio_id"),
    "fato_censo_uf": ("uf_id", "dim_uf", "uf_id"),
    "fato_pib_municipio": ("municipio_id", "dim_municipio", "municipio_id"),
    "fato_pib_uf": ("uf_id", "dim_uf", "uf_id"),
}

SECTOR_COLUMNS = ["vab_agropecuaria", "vab_industria", "vab_servicos", "vab_administracao_publica"]


@dataclass
class Star:
    dim_regiao: DataFrame
    dim_uf: DataFrame
    dim_municipio: DataFrame
    fato_populacao_municipio: DataFrame
    fato_populacao_uf: DataFrame
    fato_populacao_regiao: DataFrame
    fato_censo_municipio: DataFrame
    fato_censo_uf: DataFrame
    fato_pib_municipio: DataFrame
    fato_pib_uf: DataFrame
    # Materialised panels (``plans.warehouse.refresh_panels``) and the band
    # parameters they were built with; None until refreshed.
    mv_painel_municipio: DataFrame | None = None
    mv_concentracao_municipio: DataFrame | None = None
    mv_painel_uf: DataFrame | None = None
    mv_ranking_municipio: DataFrame | None = None
    panel_bands: Any = None

    def tables(self) -> dict[str, DataFrame]:
        """The base tables (dimensions and facts)."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name in (*DIM_TABLES, *FACT_TABLES)}

    def upper_facts(self) -> dict[str, DataFrame]:
        """Facts of the levels above the stored ones, as sums of the states:
        census and GDP by region, population and GDP of the country. Sums of
        NULLs alone stay NULL; the density is that of the sums."""
        amounts = ["pib_mil_reais", "impostos_liquidos", *SECTOR_COLUMNS]
        total = lambda cols, kind: [F.sum(c).cast(kind).alias(c) for c in cols]
        region = self.dim_uf.select("uf_id", "regiao_id")
        census = self.fato_censo_uf.join(region, "uf_id").groupBy("regiao_id", "ano")
        census = census.agg(*total(["populacao_censo"], "long"), *total(["area_km2"], "decimal(38,3)"))
        density = round_to(ratio(F.col("populacao_censo"), F.col("area_km2")), 2)
        return {
            "fato_censo_regiao": census.withColumn("densidade_hab_km2", density),
            "fato_pib_regiao": self.fato_pib_uf.join(region, "uf_id").groupBy("regiao_id", "ano").agg(*total(amounts, "decimal(38,4)")),
            "fato_populacao_brasil": self.fato_populacao_uf.groupBy("ano").agg(*total(["populacao"], "long")),
            "fato_pib_brasil": self.fato_pib_uf.groupBy("ano").agg(*total(amounts, "decimal(38,4)")),
        }

    @property
    def spark(self):
        return self.dim_regiao.sparkSession
