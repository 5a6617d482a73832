"""End to end on the miniature country: which year matches which, missing
GDP kept, shares close to 100, and every named query runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrapanel import registry
from terrapanel.operators import aggregates as agg
from terrapanel.operators.concentration import half_of_total
from terrapanel.plans import panels
from terrapanel.plans import queries as nq

BANDS = registry.REAL_BANDS


@pytest.fixture(scope="module")
def panel(mini_star):
    return panels.municipality_panel(mini_star, BANDS).cache()


def test_one_row_per_municipality(panel):
    assert panel.count() == 7
    assert panel.select("municipio_id").distinct().count() == 7


def test_years_recorded(panel):
    r = panel.filter(F.col("municipio_id") == "3550308").collect()[0]
    assert (r.ano_populacao, r.ano_pib, r.ano_vab) == (2025, 2023, 2023)
    # GDP 2023 is matched with population 2024 (2022/2023 are not published)
    assert r.ano_populacao_pib == 2024 and r.populacao_ano_pib == 11880000
    assert r.pib_per_capita == pytest.approx(round(950000000 * 1000 / 11880000, 2))


def test_missing_gdp_kept(panel):
    r = panel.filter(F.col("municipio_nome") == "Campinas").collect()[0]
    assert r.pib_mil_reais is None and r.pib_per_capita is None and r.populacao_atual == 1250000


def test_sector_shares_sum_to_100(panel):
    for r in panel.filter(F.col("vab_total").isNotNull()).collect():
        s = sum(getattr(r, f"part_{c}") for c in ["vab_agropecuaria", "vab_industria", "vab_servicos",
                                                   "vab_administracao_publica"])
        assert s == pytest.approx(100.0, abs=1e-3)


def test_declining(mini_star):
    g = panels.growth_view(mini_star, BANDS)
    names = {r.municipio_nome for r in agg.declining(g).collect()}
    assert names == {"Alta Floresta D'Oeste", "Porto Alegre"}


def test_top3_gdp_and_half(panel):
    top = agg.topk(panel, "pib_mil_reais", 3, cols=["municipio_nome"]).orderBy("posicao").collect()
    assert [r.municipio_nome for r in top] == ["São Paulo", "Rio de Janeiro", "Porto Alegre"]
    assert half_of_total(panel, "pib_mil_reais", "municipio_id").collect()[0].n_metade == 1


def test_uf_and_region_panels(mini_star):
    u = panels.uf_panel(mini_star)
    assert sum(r.part_pop_brasil for r in u.collect()) == pytest.approx(100.0, abs=1e-3)
    reg = {r.regiao_nome: r for r in panels.region_panel(mini_star, registry.REGION_ORDER).collect()}
    assert reg["Sudeste"].n_ufs == 2 and reg["Sudeste"].n_municipios == 3
    assert reg["Norte"].ordem == 1 and reg["Centro-Oeste"].ordem == 5
    # density of a region is population / area of the sums
    se = reg["Sudeste"]
    assert se.densidade_atual == pytest.approx(round(se.populacao_atual / float(se.area_km2), 2))


def test_ranking_view(panel):
    r = {x.municipio_nome: x for x in panels.ranking_view(panel).collect()}
    assert r["São Paulo"].rank_populacao == 1 and r["São Paulo"].rank_pib == 1
    assert r["Campinas"].rank_pib == 7            # NULL ranked last
    assert r["Campinas"].percentil_pib_per_capita == 0.0   # NULL first in ascending percent rank
    assert r["São Paulo"].rank_populacao_uf == 1 and r["Campinas"].rank_populacao_uf == 2


def test_concentration_table(panel):
    t = panels.concentration_table(panel).filter(F.col("metrica") == "pib").orderBy("posicao").collect()
    assert [x.posicao for x in t] == list(range(1, 7))
    assert t[-1].share_acumulado_pct == pytest.approx(100.0)


@pytest.mark.parametrize("name", sorted(nq.QUERIES))
def test_every_named_query_runs(mini_star, name):
    out = nq.run(name, mini_star, BANDS)
    assert out.count() >= 1 or name in ("descolamento_pib_populacao",)


def test_named_query_contracts(mini_star):
    with pytest.raises(nq.UnknownQueryError):
        nq.get("nope")
    with pytest.raises(TypeError):
        nq.run("regioes", mini_star, BANDS, limite=3)
    top = nq.run("top_municipios", mini_star, BANDS, metrica="pib", limite=3).orderBy("posicao").collect()
    assert [r.municipio_nome for r in top] == ["São Paulo", "Rio de Janeiro", "Porto Alegre"]
    from tests.conftest import MUNICIPALITIES

    total_2023 = sum(m[6][1] for m in MUNICIPALITIES if m[6])
    assert top[0].share_pct == pytest.approx(round(950000000 / total_2023 * 100, 4))
    ratio_only = nq.run("top_municipios", mini_star, BANDS, metrica="densidade", limite=2).collect()
    assert all(r.share_pct is None for r in ratio_only)
    prof = nq.run("perfil_municipio", mini_star, BANDS, municipio="são paulo").collect()
    assert len(prof) == 1 and prof[0].serie_populacao == ["2020:11800000", "2021:11820000", "2024:11880000",
                                                           "2025:11900000"]


def test_quality_report(mini_star):
    q = {r.verificacao: r for r in nq.run("qualidade", mini_star, BANDS).collect()}
    assert len(q) == 15
    assert q["UFs na dimensão"].valor == 6.0
    assert q["municípios sem PIB no último ano"].valor == 1.0
    assert q["soma dos municípios vs. total das UFs (população)"].status == "OK"
    assert q["horas desde a última carga"].status == "FALHA"   # no load log given


def test_serie_uf(mini_star):
    rows = {r.ano: r for r in nq.run("serie_uf", mini_star, BANDS, uf="sp").collect()}
    assert set(rows) == {2020, 2021, 2023, 2024, 2025}     # full outer join keeps both ends
    assert rows[2023].populacao is None and rows[2023].pib_mil_reais is not None
    assert rows[2020].uf == "SP"


def test_sql_surface(spark, mini_star):
    from terrapanel.plans.warehouse import register_views

    names = register_views(mini_star, BANDS)
    assert "mv_painel_municipio" in names and "vw_ranking_municipio" in names
    r = spark.sql("SELECT municipio_nome FROM vw_crescimento_municipio WHERE cagr_pct < 0 ORDER BY municipio_nome")
    assert [x.municipio_nome for x in r.collect()] == ["Alta Floresta D'Oeste", "Porto Alegre"]
    n = spark.sql("SELECT count(*) AS n FROM mv_painel_municipio p JOIN vw_ranking_municipio r USING (municipio_id)")
    assert n.collect()[0].n == 7


def test_sql_and_pandas_paths_agree(mini_star):
    """The rounded (SQL-layer) and unrounded (pandas-path) growth agree
    within the rounding, and so do their bands away from the cut points."""
    from terrapanel.operators.growth import growth_first_last

    pop = mini_star.fato_populacao_municipio
    sql = {r.municipio_id: r for r in growth_first_last(pop, "municipio_id", decimals=4,
                                                         growth_edges=BANDS.growth).collect()}
    py = {r.municipio_id: r for r in growth_first_last(pop, "municipio_id", growth_edges=BANDS.growth).collect()}
    assert sql.keys() == py.keys()
    for k in sql:
        assert abs(sql[k].cagr_pct - py[k].cagr_pct) <= 5e-5 + 1e-12
        assert sql[k].faixa_crescimento == py[k].faixa_crescimento


def test_registry_contract():
    """Every named query declares exactly the parameters its builder takes."""
    import inspect

    for q in nq.QUERIES.values():
        params = set(inspect.signature(q.builder).parameters) - {"star", "bands"}
        required = {p for p, v in inspect.signature(q.builder).parameters.items()
                    if v.default is inspect.Parameter.empty} - {"star"}
        assert set(q.params) <= params, q.name
        assert not required, q.name
    assert {q.name for q in nq.QUERIES.values()} == {
        "top_municipios", "concentracao", "declinio_populacional", "porte_populacional", "quociente_locacional",
        "regioes", "serie_uf", "descolamento_pib_populacao", "densidade_extremos", "perfil_municipio", "qualidade"}


def test_panel_invariants(mini_star, panel):
    from terrapanel.operators.quality import coverage_gap, panel_invariants

    inv = {r.invariante: r.valor for r in panel_invariants(
        mini_star, panel, panels.uf_panel(mini_star), panels.region_panel(mini_star)).collect()}
    assert inv["soma part_pop_brasil (UF)"] == pytest.approx(100.0, abs=1e-3)
    assert inv["soma part_pop_brasil (região)"] == pytest.approx(100.0, abs=1e-3)
    assert inv["população municípios - UFs"] == 0.0 and inv["população UFs - regiões"] == 0.0
    assert inv["PIB municípios - UFs"] == 0.0
    assert inv["densidade recalculada ≠ armazenada"] == 0.0
    assert [r.municipio_nome for r in coverage_gap(panel).collect()] == ["Campinas"]
