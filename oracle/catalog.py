"""Oracle SQL per registered key (keys without SQL get the rows-only check)."""

from __future__ import annotations

from . import named
from .loads import ORACLE as _LOADS
from .operators import ORACLE as _OPERATORS
from .sql import CONC_CTE, D, GROWTH_CTE, PANEL_CTE, R, RANKING_CTE, REGION_CTE, SECTORS, UF_PANEL_CTE, with_ctes

_MONEY = ", ".join(f"CAST(sum({c}) AS DECIMAL(38,4)) AS {c}" for c in ["pib_mil_reais", "impostos_liquidos", *SECTORS])

ORACLE = {
    "fato_censo_regiao": lambda: with_ctes(body=f"""
SELECT *, CASE WHEN area_km2 > 0 THEN {R(f"{D('populacao_censo')} / {D('area_km2')}", 2)} END AS densidade_hab_km2 FROM (
  SELECT u.regiao_id, a.ano, CAST(sum(a.populacao_censo) AS BIGINT) AS populacao_censo, CAST(sum(a.area_km2) AS DECIMAL(38,3)) AS area_km2
  FROM censo_rows a JOIN dim_uf u USING (uf_id) GROUP BY ALL)"""),
    "fato_pib_regiao": lambda: with_ctes(body=f"SELECT regiao_id, ano, {_MONEY} FROM pib_rows JOIN dim_uf USING (uf_id) GROUP BY ALL"),
    "fato_populacao_brasil": lambda: with_ctes(body="SELECT ano, CAST(sum(populacao) AS BIGINT) AS populacao FROM fpm GROUP BY ano"),
    "fato_pib_brasil": lambda: with_ctes(body=f"SELECT ano, {_MONEY} FROM pib_rows GROUP BY ano"),
    "top_municipios": lambda: named.top_municipios(),
    "top_municipios_pib": lambda: named.top_municipios("pib", 25),
    "top_municipios_pib_per_capita": lambda: named.top_municipios("pib_per_capita", 20),
    "concentracao": named.concentracao,
    "declinio_populacional": named.declinio_populacional,
    "porte_populacional": named.porte_populacional,
    "quociente_locacional": named.quociente_locacional,
    "regioes": named.regioes,
    "serie_uf": lambda: named.serie_uf(None),
    "serie_uf_one_state": lambda: named.serie_uf("n07"),
    "descolamento_pib_populacao": lambda: named.descolamento_pib_populacao(30),
    "densidade_extremos": lambda: named.densidade_extremos(15),
    "perfil_municipio": lambda: named.perfil_municipio("0000007"),
    "perfil_municipio_by_name": lambda: named.perfil_municipio("CUSTOMER#000000042"),
    "qualidade": named.qualidade,
    "join_hierarchy": lambda: with_ctes(body="SELECT * FROM hier"),
    "agg_available_years": lambda: with_ctes(body="""
SELECT 'populacao' AS serie, 'municipio' AS nivel, ano, count(*) AS linhas FROM fpm GROUP BY ano
UNION ALL SELECT 'populacao', 'uf', ano, count(*) FROM fpu GROUP BY ano
UNION ALL SELECT 'pib', 'municipio', ano, count(*) FROM fpib GROUP BY ano
UNION ALL SELECT 'pib', 'uf', ano, count(*) FROM fpibu GROUP BY ano
UNION ALL SELECT 'censo', 'municipio', ano, count(*) FROM fcm GROUP BY ano"""),
    "growth_first_last": lambda: with_ctes(GROWTH_CTE, body="SELECT * FROM vw_cresc"),
    "join_panel_municipality": lambda: with_ctes(GROWTH_CTE, PANEL_CTE, body="SELECT * FROM painel"),
    "agg_uf_panel": lambda: with_ctes(UF_PANEL_CTE, body="SELECT * FROM painel_uf2"),
    "agg_region_panel": lambda: with_ctes(UF_PANEL_CTE, REGION_CTE, body="SELECT * FROM painel_regiao"),
    "ranking_view": lambda: with_ctes(GROWTH_CTE, PANEL_CTE, RANKING_CTE, body="SELECT * FROM ranking"),
    "concentration_table": lambda: with_ctes(GROWTH_CTE, PANEL_CTE, CONC_CTE, body="SELECT * EXCLUDE (n) FROM conc"),
}

ORACLE.update(_OPERATORS)
ORACLE.update(_LOADS)

# Inventory ids exercised by another registered query share its oracle.
from terrapanel.plans.operator_queries import ALIASES  # noqa: E402

ORACLE.update({alias: ORACLE[target] for alias, target in ALIASES.items()})
