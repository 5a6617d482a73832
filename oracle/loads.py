"""Oracle SQL of the load half: what a reader finds after each operation."""

from __future__ import annotations

from .operators import FKS, PKS, STAR_COUNTS, W
from .sql import CONC_CTE, D, GROWTH_CTE, PANEL_CTE, R, REGION_CTE, SECTORS, UF_PANEL_CTE
from .named import panel_columns

_AMOUNTS = ["pib_mil_reais", "impostos_liquidos", *SECTORS]
_CENSUS = ["populacao_censo", "area_km2", "densidade_hab_km2"]
_SUMS = ", ".join(f"CAST(sum({c}) AS DECIMAL(38,4)) AS {c}" for c in _AMOUNTS)

#: Facts of the levels that the star doesn't store.
UPPER = f"""
, fcr AS (
  SELECT *, CASE WHEN area_km2 > 0 THEN {R(f"{D('populacao_censo')} / {D('area_km2')}", 2)} END AS densidade_hab_km2 FROM (
    SELECT u.regiao_id, a.ano, CAST(sum(a.populacao_censo) AS BIGINT) AS populacao_censo, CAST(sum(a.area_km2) AS DECIMAL(38,3)) AS area_km2
    FROM censo_rows a JOIN dim_uf u USING (uf_id) GROUP BY ALL)),
fpibr AS (SELECT regiao_id, ano, {_SUMS} FROM pib_rows JOIN dim_uf USING (uf_id) GROUP BY ALL),
fpb AS (SELECT ano, CAST(sum(populacao) AS BIGINT) AS populacao FROM fpm GROUP BY ano),
fpibb AS (SELECT ano, {_SUMS} FROM pib_rows GROUP BY ano)
"""


def _long(table: str, cte: str, key: str | None, measures: list[str], text: tuple[str, ...] = (), where: str = "", year: bool = True) -> str:
    id_ = f"CAST({key} AS VARCHAR)" if key else "'1'"
    ano = "CAST(ano AS INTEGER)" if year else "CAST(NULL AS INTEGER)"
    value = lambda c: f"CAST({c} AS VARCHAR)" if c in text else f"CAST(CAST({c} AS DECIMAL(38,4)) AS VARCHAR)"
    return " UNION ALL ".join(f"SELECT '{table}' AS tabela, {id_} AS id, {ano} AS ano, '{c}' AS medida, {value(c)} AS valor FROM {cte} {where}" for c in measures)


_DIMS = [
    _long("dim_regiao", "dim_regiao", "regiao_id", ["regiao_sigla", "regiao_nome"], ("regiao_sigla", "regiao_nome"), year=False),
    _long("dim_uf", "dim_uf", "uf_id", ["uf_sigla", "uf_nome", "regiao_id"], ("uf_sigla", "uf_nome"), year=False),
    _long(
        "dim_municipio", "dim_municipio", "municipio_id",
        ["municipio_nome", "microrregiao_id", "microrregiao_nome", "mesorregiao_id", "mesorregiao_nome", "uf_id"],
        ("municipio_nome", "microrregiao_nome", "mesorregiao_nome"), year=False,
    ),
]


def _facts(window: str = "") -> list[str]:
    return [
        _long("fato_populacao_municipio", "fpm", "municipio_id", ["populacao"]),
        _long("fato_populacao_uf", "fpu", "uf_id", ["populacao"]),
        _long("fato_populacao_regiao", "fpr", "regiao_id", ["populacao"]),
        _long("fato_censo_municipio", "fcm", "municipio_id", _CENSUS),
        _long("fato_censo_uf", "fcu", "uf_id", _CENSUS),
        _long("fato_pib_municipio", "fpib", "municipio_id", _AMOUNTS, where=window),
        _long("fato_pib_uf", "fpibu", "uf_id", _AMOUNTS),
    ]


def load_snapshot() -> str:
    return W(body=" UNION ALL ".join([*_DIMS, *_facts()]))


def feed_star() -> str:
    upper = [
        _long("fato_populacao_brasil", "fpb", None, ["populacao"]),
        _long("fato_censo_regiao", "fcr", "regiao_id", _CENSUS),
        _long("fato_pib_regiao", "fpibr", "regiao_id", _AMOUNTS),
        _long("fato_pib_brasil", "fpibb", None, _AMOUNTS),
    ]
    return W(body=UPPER + " UNION ALL ".join([*_DIMS, *_facts("WHERE ano >= 1994"), *upper]))


_PANELS = [("mv_painel_municipio", "painel"), ("mv_painel_uf", "painel_uf2"), ("mv_concentracao_municipio", "conc"), ("mv_ranking_municipio", "painel")]
_INPUTS = {"dim_regiao": "region", "dim_uf": "nation", "dim_municipio": "customer", "fato_populacao_regiao": "lineitem, part, orders, customer, nation"}


def load_lineage() -> str:
    rows = [(t, c, _INPUTS.get(t, "lineitem, part, orders, customer")) for t, c in STAR_COUNTS] + [(t, c, "star") for t, c in _PANELS]
    flags = ", ".join(f"true AS {c}" for c in ("com_id", "com_carga", "bytes_origem_ok", "bytes_ok", "iniciado_ok", "duracao_ok", "usuario_ok"))
    return W(GROWTH_CTE, PANEL_CTE, UF_PANEL_CTE, CONC_CTE, body=" UNION ALL ".join(f"SELECT '{t}' AS tabela, '{o}' AS origem, (SELECT count(*) FROM {c}) AS linhas, {flags}" for t, c, o in rows))


_WIDTHS = {
    "dim_regiao": 3, "dim_uf": 4, "dim_municipio": 7, "fpm": 3, "fpu": 3, "fpr": 3, "fcm": 5, "fcu": 5, "fpib": 8, "fpibu": 8,
    "hier": 12, "painel_uf2": 30, "painel_regiao": 21, "conc": 12,
}


def catalog_inventory() -> str:
    objects = [(t, "tabela", c, _WIDTHS[c]) for t, c in STAR_COUNTS]
    objects += [(t, "materializada", c, {"mv_painel_municipio": len(panel_columns()), "mv_ranking_municipio": 18}.get(t, _WIDTHS.get(c))) for t, c in _PANELS]
    objects += [("vw_municipio", "view", "hier", 12), ("vw_painel_regiao", "view", "painel_regiao", _WIDTHS["painel_regiao"])]
    return W(GROWTH_CTE, PANEL_CTE, UF_PANEL_CTE, REGION_CTE, CONC_CTE, body=" UNION ALL ".join(
        f"SELECT '{t}' AS objeto, '{k}' AS tipo, (SELECT count(*) FROM {c}) AS linhas, {w} AS colunas, true AS tamanho_ok, {'false' if k == 'view' else 'true'} AS com_tamanho"
        for t, k, c, w in objects))


def panel_refresh() -> str:
    """The panel twice: with the first year of every third municipality
    missing from the population, and with all rows."""
    less = lambda sql: sql.replace("FROM fpm", "FROM fpm_less")
    # the same steps over the smaller population, under names of their own
    names = ["ext", "growth_b", "growth", "vw_cresc", "m_span", "m_people", "m_money", "m_land", "m_figures", "painel"]
    twin = less(GROWTH_CTE + ",\n" + PANEL_CTE)
    import re

    for n in names:
        twin = re.sub(rf"\b{n}\b", f"{n}_less", twin)
    first = "fpm_less AS (SELECT * FROM fpm WHERE NOT (ano = (SELECT min(ano) FROM fpm) AND CAST(municipio_id AS BIGINT) % 3 = 0))"
    return W(GROWTH_CTE, PANEL_CTE, first, twin, body="SELECT *, 'antes' AS momento FROM painel_less UNION ALL BY NAME SELECT *, 'depois' AS momento FROM painel")


def panel_statistics() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body=" UNION ALL ".join(f"SELECT '{c}' AS coluna, count({c}) AS nao_nulos, count(*) AS linhas FROM painel" for c in panel_columns()))


#: Population as delivered: the first year again under unknown ids.
_DELIVERED = """
, raw AS (
  SELECT municipio_id, ano, populacao FROM fpm
  UNION ALL SELECT '9' || substr(municipio_id, 2), ano, populacao FROM fpm WHERE ano = (SELECT min(ano) FROM fpm))
"""


def enrich() -> str:
    return W(body=_DELIVERED + "SELECT p.municipio_id, p.ano, p.populacao, h.* EXCLUDE (municipio_id), h.municipio_id IS NULL AS orfao FROM raw p LEFT JOIN hier h ON h.municipio_id = p.municipio_id")


def orphans() -> str:
    return W(body=_DELIVERED + "SELECT count(*) FILTER (WHERE municipio_id NOT IN (SELECT municipio_id FROM hier)) AS orfaos, count(*) AS linhas FROM raw")


def coverage_gap() -> str:
    return W(GROWTH_CTE, PANEL_CTE, body="SELECT municipio_id, municipio_nome, uf_sigla, mesorregiao_nome = 'BUILDING' AS esperado FROM painel WHERE pib_mil_reais IS NULL")


# --------------------------------------------------------------------------
# Rules: label, table, condition that breaks it
# --------------------------------------------------------------------------

_PREFIX = "left(municipio_id, 2) = uf_id"


def _row_rules() -> list[tuple[str, str, str]]:
    rules = [
        ("dim_municipio", "municipio_id ~ '^[0-9]{7}$'", "NOT regexp_full_match(municipio_id, '[0-9]{7}')"),
        ("dim_municipio", _PREFIX, "left(municipio_id, 2) <> CAST(uf_id AS VARCHAR)"),
    ]
    for name in PKS:
        if name.startswith("fato_"):
            rules.append((name, "ano between 1990 and 2100", "ano NOT BETWEEN 1990 AND 2100"))
        if name.startswith("fato_populacao"):
            rules.append((name, "populacao >= 0", "populacao < 0"))
        if name.startswith("fato_censo"):
            rules.append((name, "area_km2 > 0", "area_km2 <= 0"))
    return rules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def constraint_checks() -> str:
    rows = []
    for name, (cte, key) in PKS.items():
        k = ", ".join(key)
        rows.append(f"SELECT '{name}' AS tabela, 'pk({','.join(key)})' AS regra, (SELECT count(*) FROM (SELECT {k} FROM {cte} GROUP BY {k} HAVING count(*) > 1)) AS violacoes")
        rows.append(f"SELECT '{name}', 'not null({','.join(key)})', (SELECT count(*) FROM {cte} WHERE {' OR '.join(f'{c} IS NULL' for c in key)})")
    for name, (col, parent, pcol) in FKS.items():
        rows.append(f"SELECT '{name}', 'fk({col})->{parent}', (SELECT count(*) FROM {PKS[name][0]} c WHERE c.{col} IS NOT NULL AND c.{col} NOT IN (SELECT {pcol} FROM {PKS[parent][0]}))")
    for name, rule, broken in _row_rules():
        rows.append(f"SELECT '{name}', {_quoted(rule)}, (SELECT count(*) FROM {PKS[name][0]} WHERE {broken})")
    return W(body="\n UNION ALL ".join(rows))


def constraint_quarantine() -> str:
    """Rows by row rule; keys and references hold in these tables."""

    def key_json(name: str) -> str:
        part = lambda c: f"'\"{c}\":' || " + (f"'\"' || {c} || '\"'" if c == "municipio_id" else f"CAST({c} AS VARCHAR)")
        return "'{' || " + " || ',' || ".join(part(c) for c in PKS[name][1]) + " || '}'"

    return W(body="\n UNION ALL ".join(f"SELECT '{name}' AS tabela, {_quoted(rule)} AS regra, {key_json(name)} AS chave FROM {PKS[name][0]} WHERE {broken}" for name, rule, broken in _row_rules()))


ORACLE = {
    "load_snapshot": load_snapshot,
    "load_lineage": load_lineage,
    "src_catalog_inventory": catalog_inventory,
    "panel_refresh": panel_refresh,
    "panel_statistics": panel_statistics,
    "feed_star": feed_star,
    "join_enrich_municipality": enrich,
    "join_orphan_count": orphans,
    "constraint_checks": constraint_checks,
    "constraint_quarantine": constraint_quarantine,
    "coverage_gap": coverage_gap,
}
