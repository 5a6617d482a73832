"""Oracle SQL of the per-operator registered queries (TPC-H mapping)."""

from __future__ import annotations

from .named import panel_columns
from .sql import (
    CONC_CTE, D, FP_MEDIAN, GROWTH, GROWTH_CTE, GROWTH_LABELS, DENSITY, DENSITY_LABELS, PANEL_CTE, R, REGION_CTE,
    SECTOR_LABELS, SECTORS, SIZE, SIZE_LABELS, SKIPSUM, UF_PANEL_CTE, _PCT100, left_bands, right_bands, with_ctes,
)

REGION_ORDER = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def R6(x: str) -> str:
    return R(x, 6)


def _fix(sql: str) -> str:
    return sql.replace("\n\n, ", ",\n", 1)


def W(*ctes: str, body: str) -> str:
    return _fix(with_ctes(*ctes, body=body))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --------------------------------------------------------------------------
# Series rebuilt from the facts
# --------------------------------------------------------------------------

TIDY = """
, tidy AS (
  SELECT p.municipio_id AS localidade_id, m.municipio_nome AS localidade_nome, 'N6' AS nivel, p.ano,
         93 AS variavel_id, 'População residente estimada' AS variavel_nome, 'Pessoas' AS unidade,
         CAST(p.populacao AS DOUBLE) AS valor
  FROM fpm p JOIN dim_municipio m ON m.municipio_id = p.municipio_id
  UNION ALL
  SELECT g.municipio_id, m.municipio_nome, 'N6', g.ano, 37, 'Produto Interno Bruto a preços correntes', 'Mil Reais',
         CAST(g.pib_mil_reais AS DOUBLE)
  FROM fpib g JOIN dim_municipio m ON m.municipio_id = g.municipio_id
  UNION ALL
  SELECT g.municipio_id, m.municipio_nome, 'N6', g.ano, 516, 'Valor adicionado bruto da Indústria', 'Mil Reais',
         CAST(g.vab_industria AS DOUBLE)
  FROM fpib g JOIN dim_municipio m ON m.municipio_id = g.municipio_id
  UNION ALL
  SELECT CAST(u.uf_id AS VARCHAR), d.uf_nome, 'N3', u.ano, 93, 'População residente estimada', 'Pessoas',
         CAST(u.populacao AS DOUBLE)
  FROM fpu u JOIN dim_uf d ON d.uf_id = u.uf_id)
"""


def series_flatten() -> str:
    return W(body=TIDY + "SELECT * FROM tidy")


def series_select() -> str:
    return W(body=TIDY + "SELECT * FROM tidy WHERE variavel_id IN (93) AND ano IN (1995, 1999, 2001)")


def series_wide() -> str:
    return W(body=TIDY + """
SELECT localidade_id, localidade_nome, nivel, ano,
       max(CASE WHEN variavel_id = 93 THEN valor END) AS populacao,
       max(CASE WHEN variavel_id = 37 THEN valor END) AS pib_mil_reais,
       max(CASE WHEN variavel_id = 516 THEN valor END) AS vab_industria
FROM tidy WHERE nivel = 'N6' AND valor IS NOT NULL GROUP BY 1, 2, 3, 4""")


def windowed_extract() -> str:
    return W(body=TIDY + "SELECT * FROM tidy WHERE nivel <> 'N6' OR ano >= 1997")


def sentinel_parse() -> str:
    t = "trim(texto)"
    v = f"TRY_CAST({t} AS DOUBLE)"
    return f"""
SELECT event_id, texto,
       CASE WHEN {t} IN ('...', '..', 'X', '-', '') OR isnan({v}) OR isinf({v}) THEN NULL ELSE {v} END AS valor
FROM (SELECT event_id, json_extract_string(props, '$.k') AS texto FROM events
      UNION ALL SELECT event_id, CASE event_type WHEN 'error' THEN '...' ELSE '-' END FROM events WHERE event_type IN ('error', 'signup'))"""


def published_years() -> str:
    return W(body="""
, req AS (SELECT CAST(range AS INTEGER) AS ano FROM range(1994, 2003)),
pub AS (SELECT DISTINCT ano FROM fpm)
SELECT ano, 'publicado' AS situacao FROM req WHERE ano IN (SELECT ano FROM pub)
UNION ALL SELECT ano, 'ignorado' FROM req WHERE ano NOT IN (SELECT ano FROM pub)""")


def dataset_catalog() -> str:
    return W(body="""
SELECT CAST(r.regiao_id AS VARCHAR) AS pesquisa_id, r.regiao_nome AS pesquisa_nome,
       u.uf_id AS agregado_id, u.uf_nome AS agregado_nome
FROM dim_uf u JOIN dim_regiao r ON r.regiao_id = u.regiao_id""")


def dim_uf_json() -> str:
    return W(body="""
SELECT u.uf_id, u.uf_sigla, u.uf_nome, r.regiao_id, r.regiao_sigla, r.regiao_nome
FROM dim_uf u JOIN dim_regiao r ON r.regiao_id = u.regiao_id""")


def dim_region_json() -> str:
    return W(body="SELECT regiao_id, regiao_sigla, regiao_nome FROM dim_regiao")


def dim_municipality_json() -> str:
    return W(body="""
SELECT CAST(c.c_custkey AS VARCHAR) AS municipio_id, c.c_name AS municipio_nome,
       CASE WHEN c.c_mktsegment <> 'AUTOMOBILE' THEN CAST(c.c_nationkey * 10 + length(c.c_mktsegment) AS INTEGER) END
         AS microrregiao_id,
       CASE WHEN c.c_mktsegment <> 'AUTOMOBILE' THEN 'Micro ' || c.c_mktsegment END AS microrregiao_nome,
       CASE WHEN c.c_mktsegment <> 'AUTOMOBILE' THEN CAST(c.c_nationkey AS INTEGER) END AS mesorregiao_id,
       CASE WHEN c.c_mktsegment <> 'AUTOMOBILE' THEN c.c_mktsegment END AS mesorregiao_nome,
       u.uf_id, u.uf_sigla, u.uf_nome, r.regiao_id, r.regiao_sigla, r.regiao_nome
FROM customer c JOIN dim_uf u ON u.uf_id = c.c_nationkey JOIN dim_regiao r ON r.regiao_id = u.regiao_id""")


# --------------------------------------------------------------------------
# Geometry
# --------------------------------------------------------------------------

MESH = """
, mesh AS (
  SELECT municipio_id AS codarea, municipio_nome, populacao_atual,
         CAST(CAST(municipio_id AS BIGINT) % 100 AS DOUBLE) AS x, CAST(floor(CAST(municipio_id AS BIGINT) / 100) AS DOUBLE) AS y,
         CASE WHEN area_km2 > 0 THEN sqrt(CAST(area_km2 AS DOUBLE)) END AS s, CAST(municipio_id AS BIGINT) % 3 = 0 AS hole
  FROM painel)
"""


def geo_features() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=MESH + """
SELECT codarea, CASE WHEN s IS NULL THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type, CASE WHEN s IS NULL THEN 0 ELSE 1 END AS n_poligonos,
       CASE WHEN s IS NULL THEN 0 WHEN hole THEN 2 ELSE 1 END AS n_aneis FROM mesh""")


def geo_reorient() -> str:
    outer = "((x + s) - x) * ((y + s) + (y + s)) + (x - (x + s)) * (y + y)"
    xi, yi, d = "(x + s / 4.0)", "(y + s / 4.0)", "(s / 2.0)"
    xi2, yi2 = f"({xi} + {d})", f"({yi} + {d})"
    hole = f"({xi2} - {xi}) * ({yi} + {yi}) + ({xi} - {xi2}) * ({yi2} + {yi2})"
    return W(GROWTH_CTE, PANEL_CTE, body=MESH + f"""
SELECT codarea, {R6(outer)} AS area_externa, CASE WHEN hole THEN {R6(hole)} END AS area_buraco FROM mesh""")


def geo_codes() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body="""
SELECT municipio_id AS codarea FROM painel WHERE pib_mil_reais IS NOT NULL""")


def geo_data() -> str:
    fmt = "translate(format('{:,}', populacao_atual), ',.', '.,')"
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
SELECT municipio_id AS codarea, municipio_nome AS nome, populacao_atual AS valor,
       coalesce({fmt}, '—') AS valor_fmt
FROM painel""")


def choropleth() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
, d AS (SELECT municipio_id AS codarea, municipio_nome AS nome, CAST(densidade_atual AS DOUBLE) AS valor
        FROM painel WHERE densidade_atual IS NOT NULL),
m AS (SELECT min(valor) AS mn FROM d WHERE valor > 0)
SELECT codarea, nome, {R6('valor')} AS valor, {R6('log10(greatest(valor, mn))')} AS valor_log10 FROM d CROSS JOIN m""")


# --------------------------------------------------------------------------
# Loads, filters, joins
# --------------------------------------------------------------------------


def load_prepare() -> str:
    return W(body="""
SELECT municipio_id, ano, CAST(round_even(CAST(populacao AS DOUBLE) / 2.0, 0) AS BIGINT) AS populacao FROM fpm""")


STAR_COUNTS = [
    ("dim_regiao", "dim_regiao"), ("dim_uf", "dim_uf"), ("dim_municipio", "dim_municipio"),
    ("fato_populacao_municipio", "fpm"), ("fato_populacao_uf", "fpu"), ("fato_populacao_regiao", "fpr"),
    ("fato_censo_municipio", "fcm"), ("fato_censo_uf", "fcu"), ("fato_pib_municipio", "fpib"),
    ("fato_pib_uf", "fpibu"),
]
STAR_WIDTHS = {"dim_regiao": 3, "dim_uf": 4, "dim_municipio": 7, "fpm": 3, "fpu": 3, "fpr": 3, "fcm": 5, "fcu": 5,
               "fpib": 8, "fpibu": 8}


def latest_year() -> str:
    return W(body="SELECT * FROM fpm WHERE ano = (SELECT max(ano) FROM fpm)")


def latest_nonnull_year() -> str:
    return W(body="SELECT * FROM fpib WHERE ano = (SELECT max(ano) FROM fpib WHERE vab_industria IS NOT NULL)")


def members() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
SELECT {D("(SELECT sum(populacao_atual) FROM painel WHERE regiao_nome IN ('AMERICA', 'ASIA'))")} * {_PCT100}
       / {D('NULLIF((SELECT sum(populacao_atual) FROM painel), 0)')} AS pct_selecao""")


def declining() -> str:
    return W(GROWTH_CTE, body="SELECT * FROM vw_cresc WHERE variacao_absoluta < 0")


def top_growth(ascending: bool) -> str:
    order = "cagr_pct ASC" if ascending else "cagr_pct DESC"
    return W(GROWTH_CTE, body=f"""
SELECT row_number() OVER (ORDER BY {order}, municipio_id) AS posicao, municipio_id, municipio_nome, uf_sigla,
       regiao_nome, valor_inicial, valor_final, cagr_pct
FROM vw_cresc WHERE valor_final >= 300 AND cagr_pct IS NOT NULL
ORDER BY {order}, municipio_id LIMIT 20""")


def enrich_uf() -> str:
    return W(body="SELECT p.uf_id, p.ano, p.pib_mil_reais, u.uf_sigla, u.uf_nome, u.regiao_id, u.uf_id IS NULL AS orfao FROM fpibu p "
                  "LEFT JOIN dim_uf u ON u.uf_id = p.uf_id")


def nearest_global() -> str:
    return W(body="""
, yrs AS (SELECT DISTINCT ano FROM fpm),
chosen AS (SELECT ano FROM yrs ORDER BY abs(ano - (SELECT max(ano) FROM fpib)), ano LIMIT 1)
SELECT municipio_id, ano AS ano_populacao_pib, populacao AS populacao_ano_pib FROM fpm
WHERE ano = (SELECT ano FROM chosen)""")


# --------------------------------------------------------------------------
# Derived metrics
# --------------------------------------------------------------------------


def density() -> str:
    return W(body=f"""
SELECT municipio_id, ano, populacao_censo, area_km2, {R6('densidade_hab_km2')} AS densidade_hab_km2,
       {R6(f"{D('populacao_censo')} / {D('CASE WHEN area_km2 > 0 THEN area_km2 END')}")} AS densidade_calculada
FROM fcm""")


def per_capita() -> str:
    return W(body=f"""
SELECT g.*, c.populacao_censo,
       {R6(f"{D('g.pib_mil_reais')} * CAST(1000.0 AS DOUBLE) / {D('CASE WHEN c.populacao_censo > 0 THEN c.populacao_censo END')}")} AS pib_per_capita
FROM fpib g JOIN fcm c ON c.municipio_id = g.municipio_id""")


def sector_structure() -> str:
    tot = SKIPSUM(SECTORS)
    parts = ", ".join(
        f"{R6(f'{D(s)} / {D(f"CASE WHEN vab_total > 0 THEN vab_total END")} * {_PCT100}')} AS part_{s}" for s in SECTORS)
    return W(body=f"""
, t AS (SELECT *, {tot} AS vab_total FROM fpib)
SELECT *, {parts} FROM t""")


def growth_uf() -> str:
    r = f"{D('valor_final')} / {D('valor_inicial')}"
    cagr = (f"(pow({r}, CAST(1.0 AS DOUBLE) / {D('NULLIF(ano_final - ano_inicial, 0)')}) - CAST(1.0 AS DOUBLE))"
            f" * CAST(100.0 AS DOUBLE)")
    return W(body=f"""
, e AS (
  SELECT uf_id, min(ano) AS ano_inicial, max(ano) AS ano_final, arg_min(populacao, ano) AS valor_inicial,
         arg_max(populacao, ano) AS valor_final, count(*) AS n_observacoes
  FROM fpu WHERE populacao IS NOT NULL GROUP BY uf_id),
g AS (SELECT *, {cagr} AS cagr FROM e WHERE valor_inicial > 0)
SELECT uf_id, ano_inicial, ano_final, ano_final - ano_inicial AS anos, n_observacoes, valor_inicial, valor_final,
       valor_final - valor_inicial AS variacao_absoluta,
       {R6(f"({r} - CAST(1.0 AS DOUBLE)) * CAST(100.0 AS DOUBLE)")} AS variacao_pct, {R6('cagr')} AS cagr_pct,
       {right_bands('cagr', GROWTH, GROWTH_LABELS)} AS faixa_crescimento
FROM g""")


def index_base100() -> str:
    return W(body=f"""
, b AS (SELECT uf_id, max(CASE WHEN ano = (SELECT min(ano) FROM fpu WHERE populacao IS NOT NULL) THEN populacao END) AS bv
        FROM fpu WHERE populacao IS NOT NULL GROUP BY uf_id)
SELECT f.uf_id, f.ano, f.populacao, {R6(f"{D('f.populacao')} / {D('NULLIF(b.bv, 0)')} * {_PCT100}")} AS indice
FROM fpu f JOIN b ON b.uf_id = f.uf_id WHERE f.populacao IS NOT NULL""")


def share_of_group() -> str:
    return W(body=f"""
, t AS (SELECT ano, sum(pib_mil_reais) AS tot FROM fpibu WHERE pib_mil_reais IS NOT NULL GROUP BY ano)
SELECT f.*, {R6(f"{D('f.pib_mil_reais')} * {_PCT100} / {D('NULLIF(t.tot, 0)')}")} AS part_pib_brasil
FROM fpibu f JOIN t ON t.ano = f.ano WHERE f.pib_mil_reais IS NOT NULL""")


def gdp_pop_ratio() -> str:
    return W(UF_PANEL_CTE, body=f"""
SELECT uf_sigla, uf_nome, regiao_nome, {R6('part_pib_brasil')} AS part_pib_brasil,
       {R6('part_pop_brasil')} AS part_pop_brasil, {R6('part_pib_brasil / NULLIF(part_pop_brasil, 0)')} AS razao_pib_pop,
       {R6('pib_per_capita')} AS pib_per_capita
FROM painel_uf2""")


# --------------------------------------------------------------------------
# Aggregations
# --------------------------------------------------------------------------


def region_sums() -> str:
    return W(UF_PANEL_CTE, body=f"""
SELECT regiao_nome, CAST(sum(populacao_atual) AS BIGINT) AS populacao_atual, sum(area_km2) AS area_km2,
       sum(pib_mil_reais) AS pib_mil_reais, sum(impostos_liquidos) AS impostos_liquidos,
       list_position({_list(REGION_ORDER)}, regiao_nome) AS ordem,
       CAST(row_number() OVER (ORDER BY list_position({_list(REGION_ORDER)}, regiao_nome)) AS INTEGER) AS posicao
FROM painel_uf2 GROUP BY regiao_nome""")


def national_series() -> str:
    return W(body=f"""
, s AS (SELECT ano, CAST(sum(populacao) AS BIGINT) AS populacao FROM fpu GROUP BY ano)
SELECT ano, populacao,
       {R6(f"({D('populacao')} / {D('NULLIF(lag(populacao) OVER (ORDER BY ano), 0)')} - CAST(1.0 AS DOUBLE)) * {_PCT100}")} AS variacao_pct
FROM s""")


def region_year_share() -> str:
    return W(body=f"""
, e AS (SELECT p.*, r.regiao_nome FROM fpibu p JOIN dim_uf u ON u.uf_id = p.uf_id JOIN dim_regiao r ON r.regiao_id = u.regiao_id
        WHERE p.pib_mil_reais IS NOT NULL),
t AS (SELECT ano, sum(pib_mil_reais) AS tot FROM e GROUP BY ano),
s AS (SELECT e.ano, e.regiao_nome, {D('e.pib_mil_reais')} * {_PCT100} / {D('NULLIF(t.tot, 0)')} AS part
      FROM e JOIN t ON t.ano = e.ano)
SELECT ano, regiao_nome, {R6('sum(part)')} AS part_pib_brasil FROM s GROUP BY ano, regiao_nome""")


def region_year_population() -> str:
    return W(body="""
SELECT p.ano, r.regiao_nome, CAST(sum(p.populacao) AS BIGINT) AS populacao
FROM fpu p JOIN dim_uf u ON u.uf_id = p.uf_id JOIN dim_regiao r ON r.regiao_id = u.regiao_id GROUP BY 1, 2""")


def growth_by_region() -> str:
    return W(GROWTH_CTE, body=f"""
SELECT regiao_nome, count(municipio_id) AS n_municipios, count(*) FILTER (WHERE variacao_absoluta < 0) AS n_perdendo,
       {FP_MEDIAN('cagr_pct', 4)} AS cagr_mediano,
       CAST(sum(valor_inicial) AS BIGINT) AS populacao_inicial, CAST(sum(valor_final) AS BIGINT) AS populacao_final,
       {R6(f"{D('count(*) FILTER (WHERE variacao_absoluta < 0)')} / {D('count(municipio_id)')} * {_PCT100}")} AS pct_perdendo,
       {R6(f"({D('sum(valor_final)')} / {D('NULLIF(sum(valor_inicial), 0)')} - CAST(1.0 AS DOUBLE)) * {_PCT100}")} AS crescimento_regional_pct
FROM vw_cresc WHERE regiao_nome IS NOT NULL GROUP BY regiao_nome""")


def decline_summary() -> str:
    return W(GROWTH_CTE, body=f"""
SELECT count(*) AS total_municipios, count(*) FILTER (WHERE variacao_absoluta < 0) AS n_perdendo,
       {R6(f"coalesce({D('count(*) FILTER (WHERE variacao_absoluta < 0)')} / {D('NULLIF(count(*), 0)')} * {_PCT100}, 0.0)")} AS pct_perdendo,
       CAST(coalesce(-sum(variacao_absoluta) FILTER (WHERE variacao_absoluta < 0), 0) AS BIGINT) AS populacao_perdida,
       {FP_MEDIAN('cagr_pct', 4)} AS cagr_mediano
FROM vw_cresc""")


def _dist(band_expr: str, label_col: str, labels, cols: str, shares: dict[str, str], where: str = "",
          rounded: bool = True) -> str:
    rnd = R6 if rounded else (lambda x: x)
    share_sql = ", ".join(
        f"{rnd(f'{D(c)} * {_PCT100} / {D(f"NULLIF((SELECT sum({c}) FROM g), 0)")}')} AS {o}" for o, c in shares.items())
    return f"""
, b AS (SELECT populacao_atual, area_km2, densidade_atual, {band_expr} AS {label_col} FROM painel {where}),
g AS (SELECT {label_col}, {cols} FROM b WHERE {label_col} IS NOT NULL GROUP BY {label_col})
SELECT *, {share_sql}, list_position({_list(labels)}, {label_col}) AS ordem FROM g"""


def size_bands(rounded: bool = True) -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=_dist(
        left_bands("populacao_atual", SIZE, SIZE_LABELS), "porte", SIZE_LABELS,
        "count(*) AS n_municipios, CAST(sum(populacao_atual) AS BIGINT) AS populacao",
        {"pct_municipios": "n_municipios", "pct_populacao": "populacao"}, rounded=rounded))


def density_bands() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=_dist(
        left_bands("densidade_atual", DENSITY, DENSITY_LABELS), "faixa_densidade", DENSITY_LABELS,
        "count(*) AS n_municipios, sum(area_km2) AS area_km2, CAST(sum(populacao_atual) AS BIGINT) AS populacao",
        {"pct_area": "area_km2", "pct_populacao": "populacao"}))


def growth_bands() -> str:
    return W(GROWTH_CTE, body=f"""
, g AS (SELECT faixa_crescimento, count(*) AS n_municipios, CAST(sum(valor_final) AS BIGINT) AS populacao
        FROM vw_cresc WHERE faixa_crescimento IS NOT NULL GROUP BY 1)
SELECT *, {R6(f"{D('n_municipios')} * {_PCT100} / {D('NULLIF((SELECT sum(n_municipios) FROM g), 0)')}")} AS pct_municipios,
       list_position({_list(GROWTH_LABELS)}, faixa_crescimento) AS ordem
FROM g""")


def band_subset() -> str:
    labels = ", ".join(f"'{x}'" for x in SIZE_LABELS[:3])
    inner = size_bands(rounded=False)
    return f"""
SELECT {R6('coalesce(sum(pct_municipios), 0.0)')} AS pct_municipios,
       {R6('coalesce(sum(pct_populacao), 0.0)')} AS pct_populacao
FROM ({inner}) WHERE porte IN ({labels})"""


def headline() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
, p AS (SELECT CAST(sum(populacao_atual) AS BIGINT) AS populacao_total, sum(pib_mil_reais) AS pib_total,
               sum(area_km2) AS area_total, count(*) AS n_municipios, max(populacao_atual) AS maior_populacao
        FROM painel),
g AS (SELECT count(*) FILTER (WHERE variacao_absoluta < 0) AS n_em_declinio FROM vw_cresc)
SELECT populacao_total, pib_total, area_total, n_municipios,
       {R6(f"{D('populacao_total')} / {D('NULLIF(area_total, 0)')}")} AS densidade,
       {R6(f"{D('pib_total')} * CAST(1000.0 AS DOUBLE) / {D('NULLIF(populacao_total, 0)')}")} AS pib_per_capita,
       n_em_declinio,
       {R6(f"{D('n_em_declinio')} / {D('NULLIF(n_municipios, 0)')} * {_PCT100}")} AS pct_em_declinio,
       (SELECT municipio_nome FROM painel WHERE populacao_atual IS NOT NULL
        ORDER BY populacao_atual DESC, municipio_id LIMIT 1) AS maior_municipio,
       maior_populacao
FROM p CROSS JOIN g""")


def min_median_max() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
SELECT count(pib_per_capita) AS n, {R6('min(pib_per_capita)')} AS minimo,
       {R6(FP_MEDIAN('pib_per_capita', 2))} AS mediana, {R6('max(pib_per_capita)')} AS maximo
FROM painel""")


def quantile_breaks() -> str:
    fr = ", ".join(repr(i / 7) for i in range(8))
    m = "CAST(1000000 AS DOUBLE)"
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
SELECT list_sort(list_distinct(list_transform(
         quantile_cont(CAST(densidade_atual AS DOUBLE), [{fr}]),
         lambda x: floor(x * {m} + CAST(0.5 AS DOUBLE)) / {m}))) AS quebras
FROM painel WHERE densidade_atual IS NOT NULL""")


def histogram(col: str, bins: int, log: bool) -> str:
    x = f"log10({col})" if log else D(col)
    where = f"{col} IS NOT NULL" + (f" AND {col} > 0" if log else "")
    w = f"((hi - lo) / CAST({bins}.0 AS DOUBLE))"
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
, d AS (SELECT {x} AS x FROM painel WHERE {where}),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
b AS (SELECT CAST(CASE WHEN {w} > 0 THEN least(floor((x - lo) / {w}), {bins - 1}) ELSE 0 END AS INTEGER) AS bin, lo, hi
      FROM d CROSS JOIN r)
SELECT bin, {R6(f'lo + bin * {w}')} AS lower, {R6(f'lo + (bin + 1) * {w}')} AS upper, count(*) AS n
FROM b GROUP BY bin, lo, hi""")


def last_point() -> str:
    return W(body=f"""
, s AS (SELECT p.ano, r.regiao_nome, CAST(sum(p.populacao) AS BIGINT) AS populacao
        FROM fpu p JOIN dim_uf u ON u.uf_id = p.uf_id JOIN dim_regiao r ON r.regiao_id = u.regiao_id GROUP BY 1, 2)
SELECT regiao_nome, arg_max(ano, ano) AS ano, arg_max(populacao, ano) AS populacao,
       list_position({_list(REGION_ORDER)}, regiao_nome) AS ordem
FROM s WHERE populacao IS NOT NULL GROUP BY regiao_nome""")


# --------------------------------------------------------------------------
# Concentration
# --------------------------------------------------------------------------


def _conc_select(v: str) -> str:
    return f"""
, v AS (SELECT {v} AS x FROM painel WHERE {v} IS NOT NULL),
o AS (SELECT x, row_number() OVER (ORDER BY x) AS i, row_number() OVER (ORDER BY x DESC) AS d FROM v),
a AS (SELECT count(*) AS n, sum(x) AS t, sum(CAST(i AS DOUBLE) * CAST(x AS DOUBLE)) AS six FROM o),
k AS (SELECT (SELECT sum(x) FROM o WHERE d <= greatest(1, floor(n / 100))) AS t1,
             (SELECT sum(x) FROM o WHERE d <= greatest(1, floor(n / 10))) AS t10,
             (SELECT sum(x) FROM o WHERE d <= 100) AS t100 FROM a),
cc AS (
  SELECT {R6(f"CAST(2.0 AS DOUBLE) * six / ({D('n')} * {D('NULLIF(t, 0)')}) - ({D('n')} + CAST(1.0 AS DOUBLE)) / {D('n')}")} AS gini,
         n,
         {R6(f"{D('t1')} / {D('NULLIF(t, 0)')} * {_PCT100}")} AS share_top_1pct,
         {R6(f"{D('t10')} / {D('NULLIF(t, 0)')} * {_PCT100}")} AS share_top_10pct,
         {R6(f"{D('t100')} / {D('NULLIF(t, 0)')} * {_PCT100}")} AS share_top_100
  FROM a CROSS JOIN k)"""


def gini_top_share() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=_conc_select("populacao_atual") + "\nSELECT * FROM cc")


def gdp_concentration() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=_conc_select("pib_mil_reais") + "\nSELECT * FROM cc")


def running_sum_ties() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body="""
SELECT municipio_id, populacao_atual, pib_mil_reais,
       CASE WHEN populacao_atual IS NOT NULL THEN CAST(sum(pib_mil_reais) OVER (ORDER BY populacao_atual DESC NULLS LAST) AS DECIMAL(38,4)) END AS pib_acumulado
FROM painel""")


def lorenz() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
, l AS (SELECT municipio_id, row_number() OVER w AS i, sum(populacao_atual) OVER w AS cum,
               count(*) OVER () AS n, sum(populacao_atual) OVER () AS t
        FROM painel WHERE populacao_atual IS NOT NULL
        WINDOW w AS (ORDER BY populacao_atual, municipio_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT municipio_id, {D('i')} * {_PCT100} / {D('n')} AS pct_entidades,
       {D('cum')} * {_PCT100} / {D('NULLIF(t, 0)')} AS pct_acumulado
FROM l""")


def half_of_total() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=_conc_select("pib_mil_reais") + f"""
, h AS (SELECT municipio_id, pib_mil_reais AS x, row_number() OVER w AS i, sum(pib_mil_reais) OVER w AS cum
        FROM painel WHERE pib_mil_reais IS NOT NULL
        WINDOW w AS (ORDER BY pib_mil_reais DESC, municipio_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hh AS (SELECT count(*) AS n, sum(x) AS t FROM h),
r AS (SELECT (SELECT count(*) FROM h WHERE cum * 2 < (SELECT t FROM hh)) + 1 AS n_metade,
             (SELECT sum(x) FROM h WHERE i <= 10) AS top10 FROM hh)
SELECT n_metade, {R6(f"{D('n_metade')} / {D('(SELECT n FROM hh)')} * {_PCT100}")} AS pct_metade,
       {R6(f"{D('top10')} / {D('NULLIF((SELECT t FROM hh), 0)')} * {_PCT100}")} AS share_top_10, cc.*
FROM r CROSS JOIN cc""")


def territorial_half() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
, d AS (SELECT * FROM painel WHERE densidade_atual IS NOT NULL AND area_km2 IS NOT NULL AND populacao_atual IS NOT NULL),
h AS (SELECT row_number() OVER w AS i, sum(populacao_atual) OVER w AS cp, sum(area_km2) OVER w AS ca
      FROM d WINDOW w AS (ORDER BY densidade_atual DESC, municipio_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT sum(populacao_atual) AS tp, sum(area_km2) AS ta FROM d),
c AS (SELECT count(*) FILTER (WHERE cp * 2 < (SELECT tp FROM t)) + 1 AS cut FROM h)
SELECT c.cut AS n_entidades_metade_pop, h.ca AS area_metade_pop,
       {R6(f"{D('h.ca')} / {D('NULLIF(t.ta, 0)')} * {_PCT100}")} AS pct_area_metade_pop, t.ta AS area_total
FROM c JOIN h ON h.i = c.cut CROSS JOIN t""")


# --------------------------------------------------------------------------
# Sort / top-k / reshape
# --------------------------------------------------------------------------


def topk() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body="""
SELECT row_number() OVER (ORDER BY pib_per_capita DESC, municipio_id) AS posicao, municipio_id, municipio_nome,
       uf_sigla, pib_per_capita
FROM painel WHERE pib_per_capita IS NOT NULL ORDER BY pib_per_capita DESC, municipio_id LIMIT 25""")


def rank_ufs() -> str:
    return W(UF_PANEL_CTE, body=f"""
SELECT row_number() OVER (ORDER BY pib_mil_reais DESC NULLS LAST, uf_sigla) AS posicao, uf_sigla, uf_nome, regiao_nome,
       pib_mil_reais, {R6('part_pib_brasil')} AS part_pib_brasil, {R6('pib_per_capita')} AS pib_per_capita
FROM painel_uf2""")


def extremes() -> str:
    cols = "municipio_id, municipio_nome, uf_sigla, regiao_nome, populacao_atual, area_km2, densidade_atual"

    def part(label, order):
        return (f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}, municipio_id) AS posicao, {cols}, "
                f"'{label}' AS grupo FROM d WHERE {order.split()[0]} IS NOT NULL "
                f"ORDER BY {order}, municipio_id LIMIT 10)")

    return W(GROWTH_CTE, PANEL_CTE, body=f"""
, d AS (SELECT * FROM painel WHERE densidade_atual IS NOT NULL)
{part('mais_densos', 'densidade_atual DESC')}
UNION ALL {part('mais_vazios', 'densidade_atual ASC')}
UNION ALL {part('maiores_areas', 'area_km2 DESC')}""")


def distinct_values() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body="SELECT DISTINCT uf_sigla FROM painel WHERE uf_sigla IS NOT NULL")


def unpivot_sectors() -> str:
    unions = " UNION ALL ".join(
        f"SELECT uf_sigla, regiao_nome, '{lab}' AS setor, {R6('part_' + s)} AS participacao FROM painel_uf2 "
        f"WHERE part_{s} IS NOT NULL" for s, lab in zip(SECTORS, SECTOR_LABELS))
    return W(UF_PANEL_CTE, body=unions)


def density_by_region() -> str:
    return W(UF_PANEL_CTE, REGION_CTE, body="""
SELECT regiao_nome, populacao_atual, area_km2, densidade_atual, part_pop_brasil, part_area_brasil FROM painel_regiao""")


def label_city() -> str:
    fmt = "translate(format('{:,}', populacao_atual), ',.', '.,')"
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
SELECT municipio_id, municipio_nome || ' (' || uf_sigla || ')' AS rotulo, coalesce({fmt}, '—') AS populacao_fmt
FROM painel""")


# --------------------------------------------------------------------------
# Quality
# --------------------------------------------------------------------------

PKS = {
    "dim_regiao": ("dim_regiao", ["regiao_id"]), "dim_uf": ("dim_uf", ["uf_id"]),
    "dim_municipio": ("dim_municipio", ["municipio_id"]),
    "fato_populacao_municipio": ("fpm", ["municipio_id", "ano"]), "fato_populacao_uf": ("fpu", ["uf_id", "ano"]),
    "fato_populacao_regiao": ("fpr", ["regiao_id", "ano"]), "fato_censo_municipio": ("fcm", ["municipio_id", "ano"]),
    "fato_censo_uf": ("fcu", ["uf_id", "ano"]), "fato_pib_municipio": ("fpib", ["municipio_id", "ano"]),
    "fato_pib_uf": ("fpibu", ["uf_id", "ano"]),
}
FKS = {
    "dim_uf": ("regiao_id", "dim_regiao", "regiao_id"), "dim_municipio": ("uf_id", "dim_uf", "uf_id"),
    "fato_populacao_municipio": ("municipio_id", "dim_municipio", "municipio_id"),
    "fato_populacao_uf": ("uf_id", "dim_uf", "uf_id"), "fato_populacao_regiao": ("regiao_id", "dim_regiao", "regiao_id"),
    "fato_censo_municipio": ("municipio_id", "dim_municipio", "municipio_id"),
    "fato_censo_uf": ("uf_id", "dim_uf", "uf_id"),
    "fato_pib_municipio": ("municipio_id", "dim_municipio", "municipio_id"),
    "fato_pib_uf": ("uf_id", "dim_uf", "uf_id"),
}


def panel_invariants() -> str:
    def row(label, expr):
        return f"SELECT '{label}' AS invariante, {R6(D(expr))} AS valor"

    body = f"""
, su AS (SELECT sum(part_pop_brasil) AS uf_share_pop, sum(part_pib_brasil) AS uf_share_pib,
                sum(populacao_atual) AS uf_pop, sum(pib_mil_reais) AS uf_pib FROM painel_uf2),
sr AS (SELECT sum(part_pop_brasil) AS reg_share_pop, sum(populacao_atual) AS reg_pop FROM painel_regiao),
sm AS (SELECT sum(populacao_atual) AS mun_pop, sum(pib_mil_reais) AS mun_pib FROM painel),
am AS (SELECT uf_id, sum(area_km2) AS a_mun FROM painel GROUP BY uf_id)
{row('soma part_pop_brasil (UF)', '(SELECT uf_share_pop FROM su)')}
UNION ALL {row('soma part_pib_brasil (UF)', '(SELECT uf_share_pib FROM su)')}
UNION ALL {row('soma part_pop_brasil (região)', '(SELECT reg_share_pop FROM sr)')}
UNION ALL {row('população municípios - UFs', f"{D('(SELECT mun_pop FROM sm)')} - {D('(SELECT uf_pop FROM su)')}")}
UNION ALL {row('população UFs - regiões', f"{D('(SELECT uf_pop FROM su)')} - {D('(SELECT reg_pop FROM sr)')}")}
UNION ALL {row('PIB municípios - UFs', f"{D('(SELECT mun_pib FROM sm)')} - {D('(SELECT uf_pib FROM su)')}")}
UNION ALL {row('UFs com área municipal > área da UF (1%)',
               '(SELECT count(*) FROM am JOIN painel_uf2 u ON u.uf_id = am.uf_id WHERE am.a_mun > u.area_km2 * 1.01)')}
UNION ALL {row('densidade recalculada ≠ armazenada',
               f"(SELECT count(*) FROM painel WHERE densidade_atual IS NOT NULL AND abs(densidade_atual - "
               f"{D('populacao_atual')} / {D('NULLIF(area_km2, 0)')}) > 0.005)")}"""
    return W(GROWTH_CTE, PANEL_CTE, UF_PANEL_CTE, REGION_CTE, body=body)


def all_null_columns() -> str:
    cols = panel_columns()
    counts = ", ".join(f"count({c}) AS {c}" for c in cols)
    return W(GROWTH_CTE, PANEL_CTE, body=f"""
, c AS (SELECT {counts} FROM painel)
SELECT coluna FROM (UNPIVOT c ON COLUMNS(*) INTO NAME coluna VALUE nao_nulos) WHERE nao_nulos = 0""")


def population_view() -> str:
    r = f"{D('populacao')} / {D('NULLIF(populacao_anterior, 0)')}"
    return W(body=f"""
, s AS (SELECT municipio_id, ano, populacao, lag(populacao) OVER w AS populacao_anterior, lag(ano) OVER w AS ano_ant
        FROM fpm WHERE populacao IS NOT NULL WINDOW w AS (PARTITION BY municipio_id ORDER BY ano))
SELECT s.municipio_id, h.municipio_nome, h.uf_sigla, h.uf_nome, h.regiao_nome, s.ano, s.populacao,
       s.populacao_anterior, s.ano - s.ano_ant AS anos_desde_anterior,
       s.populacao - s.populacao_anterior AS variacao_absoluta,
       {R(f"({r} - CAST(1.0 AS DOUBLE)) * {_PCT100}", 4)} AS variacao_pct,
       {R(f"(pow({r}, CAST(1.0 AS DOUBLE) / {D('NULLIF(s.ano - s.ano_ant, 0)')}) - CAST(1.0 AS DOUBLE)) * {_PCT100}", 4)} AS var_pct_anualizada
FROM s JOIN hier h ON h.municipio_id = s.municipio_id""")


ORACLE = {
    "src_series_flatten": series_flatten,
    "src_sentinel_parse": sentinel_parse,
    "src_series_dedupe": series_flatten,
    "src_series_select": series_select,
    "src_series_wide": series_wide,
    "src_windowed_extract": windowed_extract,
    "src_published_years": published_years,
    "src_dataset_catalog": dataset_catalog,
    "src_dim_uf": dim_uf_json,
    "src_dim_region": dim_region_json,
    "src_dim_municipality": dim_municipality_json,
    "src_geo_features": geo_features,
    "src_parquet_table": lambda: "SELECT * FROM region",
    "load_prepare": load_prepare,
    "filter_latest_year": latest_year,
    "filter_latest_nonnull_year": latest_nonnull_year,
    "filter_members": members,
    "filter_declining": declining,
    "filter_min_population": lambda: top_growth(False),
    "top_declinio": lambda: top_growth(True),
    "filter_geo_codes": geo_codes,
    "join_enrich_uf": enrich_uf,
    "join_nearest_year_global": nearest_global,
    "join_geo_data": geo_data,
    "density": density,
    "gdp_per_capita": per_capita,
    "sector_structure": sector_structure,
    "growth_pandas_path": growth_uf,
    "index_base100": index_base100,
    "share_of_group": share_of_group,
    "gdp_pop_ratio": gdp_pop_ratio,
    "agg_region_sum": region_sums,
    "agg_national_series": national_series,
    "agg_region_year": region_year_share,
    "agg_region_year_population": region_year_population,
    "agg_growth_by_region": growth_by_region,
    "agg_decline_summary": decline_summary,
    "agg_growth_bands": growth_bands,
    "agg_size_bands": size_bands,
    "agg_density_bands": density_bands,
    "agg_band_subset": band_subset,
    "agg_headline": headline,
    "agg_min_median_max": min_median_max,
    "agg_quantile_breaks": quantile_breaks,
    "agg_histogram": lambda: histogram("populacao_atual", 20, False),
    "agg_histogram_log": lambda: histogram("densidade_atual", 15, True),
    "agg_last_point": last_point,
    "gini_top_share": gini_top_share,
    "gdp_concentration": gdp_concentration,
    "win_running_sum_ties": running_sum_ties,
    "lorenz_curve": lorenz,
    "half_of_total": half_of_total,
    "territorial_half": territorial_half,
    "topk": topk,
    "rank_ufs": rank_ufs,
    "extremes": extremes,
    "distinct_values": distinct_values,
    "full_growth_table": lambda: W(GROWTH_CTE, body="SELECT * FROM vw_cresc"),
    "unpivot_sectors": unpivot_sectors,
    "density_by_region": density_by_region,
    "label_city": label_city,
    "geo_reorient": geo_reorient,
    "geo_choropleth_input": choropleth,
    "panel_invariants": panel_invariants,
    "all_null_columns": all_null_columns,
    "growth_step": population_view,
    "mv_concentration_refresh": lambda: W(GROWTH_CTE, PANEL_CTE, CONC_CTE, body="SELECT * EXCLUDE (n) FROM conc"),
}


def sink_csv() -> str:
    from .named import declinio_populacional

    return declinio_populacional()


def compact() -> str:
    def fmt(x: str) -> str:
        def br(v: str, d: int) -> str:
            return f"translate(format('{{:,.{d}f}}', {v}), ',.', '.,')"

        v = D(x)
        return (f"CASE WHEN {v} IS NULL THEN '—' WHEN abs({v}) >= 1e9 THEN {br(f'{v} / 1e9', 1)} || ' bi' "
                f"WHEN abs({v}) >= 1e6 THEN {br(f'{v} / 1e6', 1)} || ' mi' "
                f"WHEN abs({v}) >= 1e3 THEN {br(f'{v} / 1e3', 1)} || ' mil' ELSE {br(v, 0)} END")

    return W(GROWTH_CTE, PANEL_CTE, body=f"""
SELECT municipio_id, {fmt('pib_mil_reais')} AS pib_fmt, {fmt('populacao_atual')} AS populacao_fmt FROM painel""")


ORACLE.update({
    "fmt_compact_br": compact,
    "sink_parquet": lambda: W(body="SELECT * FROM fpm"),
    "sink_csv": sink_csv,
    "sink_geojson": lambda: W(GROWTH_CTE, PANEL_CTE, body="SELECT municipio_id AS codarea, 'MultiPolygon' AS geom_type, "
                                                          "CAST(CASE WHEN area_km2 IS NULL OR area_km2 <= 0 THEN 0 WHEN CAST(municipio_id AS BIGINT) % 3 = 0 THEN 10 ELSE 5 END AS BIGINT) AS n_pontos "
                                                          "FROM painel"),
    "load_append": lambda: W(body="SELECT * FROM fpm"),
    "join_nearest_year": lambda: W(body="""
SELECT municipio_id, ano AS ano_populacao_pib, populacao AS populacao_ano_pib FROM (
  SELECT *, row_number() OVER (PARTITION BY municipio_id ORDER BY abs(ano - (SELECT max(ano) FROM fpib)), ano) AS rn
  FROM fpm WHERE populacao IS NOT NULL) WHERE rn = 1"""),
    "agg_ordered_array": lambda: W(body="""
SELECT municipio_id, list(CAST(ano AS VARCHAR) || ':' || CAST(populacao AS VARCHAR) ORDER BY ano) AS serie_populacao
FROM fpm WHERE populacao IS NOT NULL GROUP BY municipio_id"""),
    "agg_distinct_years": lambda: W(body="""
SELECT 'populacao' AS serie, count(DISTINCT ano) AS anos FROM fpm
UNION ALL SELECT 'pib', count(DISTINCT ano) FROM fpib
UNION ALL SELECT 'censo', count(DISTINCT ano) FROM fcm"""),
})
