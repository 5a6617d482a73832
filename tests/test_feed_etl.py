"""Feed to star, enrichment with enforcement, incremental panel refresh."""

from __future__ import annotations

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from terrapanel import registry
from terrapanel.operators.metrics import enrich_municipalities, enrich_ufs, orphan_count
from terrapanel.operators.quality import enforce
from terrapanel.plans import feed_etl, panels, warehouse
from terrapanel.plans.load_queries import feed_hierarchy, feed_payloads, long_tables
from terrapanel.sinks.snapshot import append_rows, load_log, manifest, read_snapshot, versions, write_snapshot
from terrapanel.sources.tables import MissingTableError


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def payloads(mini_star):
    return feed_payloads(mini_star)


def test_feed_builds_the_whole_star(spark, mini_star, payloads):
    base = feed_etl.run(spark, [payloads], feed_hierarchy(mini_star), buckets=1, validate=enforce())
    m = manifest(spark, base)
    assert len(m["tables"]) == 14 == len(feed_etl.RAW_TABLES)
    got = read_snapshot(spark, base, list(m["tables"]))
    want = {**mini_star.tables(), **mini_star.upper_facts()}
    assert rows(long_tables(got)) == rows(long_tables(want))
    log = {r.tabela: r for r in load_log(spark, base).collect()}
    assert log["fato_pib_uf"].origem.endswith("/pib_ufs.parquet") and all(r.bytes_origem > 0 and r.linhas > 0 for r in log.values())


def test_redelivery_replaces_its_own_partitions_only(spark, tmp_dir, payloads):
    target = f"{tmp_dir}/landed"
    feed_etl.land(payloads, target)
    before = rows(feed_etl.landed(spark, target))
    feed_etl.land(payloads.unionByName(payloads), target)               # again, and twice within the delivery
    assert rows(feed_etl.landed(spark, target)) == before
    population = payloads.where("conjunto = 'populacao_estimada'")
    doubled = population.withColumn("payload", F.regexp_replace("payload", r'"2024":"[0-9]+"', '"2024":"1"')).withColumn("payload", F.regexp_replace("payload", r'"(2020|2021|2025)":"[0-9]+",?', ""))
    doubled = doubled.withColumn("payload", F.regexp_replace("payload", r",\}", "}"))
    feed_etl.land(doubled, target)                                      # one year of one variable, corrected
    after = feed_etl.landed(spark, target)
    changed = after.where("conjunto = 'populacao_estimada' and ano = 2024")
    assert {r.valor for r in changed.collect()} == {1.0}
    assert rows(after.where("conjunto <> 'populacao_estimada' or ano <> 2024")) == [r for r in before if not (r[5] == "populacao_estimada" and r[8] == 2024)]


def test_window_and_missing_raw_table(spark, mini_star, payloads, tmp_dir):
    target, folder = f"{tmp_dir}/landed", f"{tmp_dir}/raw"
    feed_etl.land(payloads, target)
    feed_etl.write_raw(spark, feed_etl.landed(spark, target), feed_hierarchy(mini_star), folder, first_municipal_year=2022)
    years = lambda t: {r.ano for r in spark.read.parquet(f"{folder}/{t}.parquet").select("ano").distinct().collect()}
    assert years("pib_municipios") == {2023} and years("pib_ufs") == {2021, 2023} and years("pop_municipios") == {2020, 2021, 2024, 2025}
    import os

    os.rename(f"{folder}/pib_ufs.parquet", f"{folder}/kept.parquet")
    with pytest.raises(MissingTableError, match="pib_ufs"):
        feed_etl.load_star(spark, folder, f"{tmp_dir}/wh")
    assert versions(spark, f"{tmp_dir}/wh") == []


def test_enrichment_is_many_to_one_and_counts_orphans(spark, mini_star):
    facts = spark.createDataFrame([(1100015, 2020, 5), (9999999, 2020, 6), (None, 2020, 7)], "localidade_id long, ano int, populacao long")
    facts = facts.withColumn("localidade_nome", F.lit("x")).withColumn("nivel", F.lit("N6"))
    dim = panels.hierarchy(mini_star)
    seen = Observation()
    out = enrich_municipalities(facts, dim, observation=seen).collect()
    assert {(r.populacao, r.uf_sigla, r.orfao) for r in out} == {(5, "RO", False), (6, None, True), (7, None, True)}
    assert seen.get == {"orfaos": 2, "linhas": 3}
    assert tuple(orphan_count(enrich_municipalities(facts, dim)).first()) == (2, 3)
    with pytest.raises(SparkRuntimeException, match="'municipio_id' is not unique: 1100015"):
        enrich_municipalities(facts, dim.unionByName(dim.where("municipio_id = '1100015'"))).collect()
    ufs = spark.createDataFrame([("35", 2020), ("77", 2020)], "localidade_id string, ano int").withColumn("localidade_nome", F.lit("x")).withColumn("nivel", F.lit("N3"))
    assert {(r.uf_id, r.orfao) for r in enrich_ufs(ufs, mini_star.dim_uf).collect()} == {(35, False), (77, True)}


# --------------------------------------------------------------------------
# Refresh
# --------------------------------------------------------------------------


def test_second_refresh_computes_what_changed(spark, mini_star, tmp_dir, monkeypatch):
    base = f"{tmp_dir}/wh"
    bands = registry.REAL_BANDS
    late = (F.col("ano") == 2020) & F.col("municipio_id").isin("3550308", "5208707")
    pop = mini_star.fato_populacao_municipio
    write_snapshot({**mini_star.tables(), "fato_populacao_municipio": pop.where(~late)}, base)
    first = warehouse.refresh_panels(spark, base, bands)
    assert versions(spark, base) == [1, 2] and warehouse.stale_panels(manifest(spark, base), bands) == []
    warehouse.refresh_panels(spark, base, bands)
    assert versions(spark, base) == [1, 2]                              # nothing to do, nothing published
    old = rows(first.mv_painel_municipio)

    append_rows(pop.where(late), base, "fato_populacao_municipio")
    m = manifest(spark, base)
    assert warehouse.stale_panels(m, bands) == ["mv_painel_municipio", "mv_concentracao_municipio", "mv_ranking_municipio"]
    computed = []
    panel = panels.municipality_panel
    monkeypatch.setattr(panels, "municipality_panel", lambda *a, **kw: computed.append(kw.get("only")) or panel(*a, **kw))
    star = warehouse.refresh_panels(spark, base, bands)
    assert sorted(r[0] for r in computed[0].collect()) == ["3550308", "5208707"]
    assert rows(read_snapshot(spark, base, ["mv_painel_municipio"], version=m["version"])["mv_painel_municipio"]) == old
    whole = panel(mini_star, bands, live=True)
    assert rows(star.mv_painel_municipio.select(whole.columns)) == rows(whole) != old
    assert rows(star.mv_concentracao_municipio) == rows(panels.concentration_table(whole))
    counts = {r.coluna: r.nao_nulos for r in warehouse.panel_statistics(spark, base).collect()}
    assert counts["municipio_id"] == 7 and counts["pib_mil_reais"] == 6


def test_refresh_of_all_when_a_year_moves(spark, mini_star, tmp_dir):
    base = f"{tmp_dir}/wh"
    write_snapshot(mini_star.tables(), base)
    warehouse.refresh_panels(spark, base)
    append_rows(spark.createDataFrame([("1100015", 2030, 99)], "municipio_id string, ano int, populacao long"), base, "fato_populacao_municipio")
    m = manifest(spark, base)
    star = read_snapshot(spark, base)
    years = warehouse.reference_years(type(mini_star)(**star))
    assert years[0] == 2030 and warehouse.touched_municipalities(spark, m, years) is None
    got = warehouse.refresh_panels(spark, base).mv_painel_municipio
    assert {(r.ano_populacao, r.populacao_atual) for r in got.collect()} == {(2030, 99), (2030, None)}
    write_snapshot({"dim_regiao": mini_star.dim_regiao}, base)          # a dimension was replaced
    assert warehouse.touched_municipalities(spark, manifest(spark, base), years) is None
    assert len(warehouse.stale_panels(manifest(spark, base), registry.REAL_BANDS)) == 4
    assert len(warehouse.stale_panels(manifest(spark, base), registry.TPCH_BANDS)) == 4
