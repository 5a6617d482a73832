"""Load preparation, snapshot flip, append and the load log."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from terrapanel.operators.quality import all_null_columns, constraint_checks, count_violations, enforce, quarantine
from terrapanel.session import max_buckets, stage_bucketed
from terrapanel.sinks import snapshot
from terrapanel.sinks.loads import MissingColumnsError, Source, prepare, write_csv
from terrapanel.sinks.snapshot import (
    LOG_SCHEMA, PublicationConflict, PublicationRejected, append_rows, column_counts, current_snapshot, latest_loads, load_log, manifest, path_bytes,
    read_snapshot, recover, versions, write_snapshot,
)


def test_prepare(spark):
    raw = spark.createDataFrame([(3550308, "SP", "N6", 2024, 46000000.0), (1100015, "x", "N6", 2024, None),
                                 (7, "x", "N6", 2024, 2.5)],
                                "localidade_id long, localidade_nome string, nivel string, ano int, populacao double")
    src = Source("pop.parquet", "fato_populacao_municipio", "municipio_id", ["ano", "populacao"], ["populacao"])
    rows = {r.municipio_id: r for r in prepare(raw, src).collect()}
    assert rows["3550308"].populacao == 46000000 and rows["1100015"].populacao is None
    assert rows["0000007"].populacao == 2                           # half-even
    uf = spark.createDataFrame([("35", 2024, 1.0)], "localidade_id string, ano int, v double")
    assert prepare(uf, Source("u", "t", "uf_id", ["ano", "v"])).collect()[0].uf_id == 35


def test_prepare_missing_column_names_file(spark):
    raw = spark.createDataFrame([(1, 2024)], "localidade_id long, ano int")
    with pytest.raises(MissingColumnsError, match="pib.parquet"):
        prepare(raw, Source("pib.parquet", "t", "municipio_id", ["ano", "pib_mil_reais"]))


REGIAO = "regiao_id int, regiao_sigla string, regiao_nome string"


def regions(spark, *ids):
    return spark.createDataFrame([(i, f"R{i}", f"Região {i}") for i in ids], REGIAO)


def ids(df, col="regiao_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_snapshot_flip_and_log(spark, tmp_dir):
    base = f"{tmp_dir}/wh"
    first = write_snapshot({"dim_regiao": regions(spark, 1)}, base, source="t1")
    snap1 = current_snapshot(spark, base)
    assert first.endswith(snap1)

    def boom(spark_, written):
        assert written["dim_regiao"].count() == 2                     # what is validated is what was written
        raise RuntimeError("validation failed")

    with pytest.raises(RuntimeError):
        write_snapshot({"dim_regiao": regions(spark, 1, 2)}, base, validate=boom)
    assert current_snapshot(spark, base) == snap1                     # failed load: old snapshot stays live
    assert recover(spark, base, 0) == []                              # and nothing is left of the new one
    write_snapshot({"dim_regiao": regions(spark, 1, 2)}, base, source="t2")
    assert read_snapshot(spark, base, ["dim_regiao"])["dim_regiao"].count() == 2
    assert read_snapshot(spark, base, ["dim_regiao"], version=1)["dim_regiao"].count() == 1
    log = load_log(spark, base)
    latest = latest_loads(log).collect()
    assert len(latest) == 1 and latest[0].linhas == 2 and latest[0].origem == "t2" and latest[0].bytes > 0
    assert [r.id for r in log.orderBy("id").collect()] == [1000, 2000] and log.schema == LOG_SCHEMA


def test_log_tells_bytes_of_every_origin(spark, tmp_dir):
    for name in ("a", "b"):
        regions(spark, 1, 2).write.parquet(f"{tmp_dir}/{name}.parquet")
    own = {"dim_regiao": [f"{tmp_dir}/a.parquet", f"{tmp_dir}/b.parquet"]}
    write_snapshot({"dim_regiao": regions(spark, 1)}, f"{tmp_dir}/wh", origins=own)
    row = load_log(spark, f"{tmp_dir}/wh").first()
    assert row.bytes_origem == sum(path_bytes(spark, p) for p in own["dim_regiao"]) > row.bytes > 0
    assert row.origem == ", ".join(own["dim_regiao"]) and row.executado_por and row.duracao_ms >= 0


def test_enforced_rules_reject_a_publication(spark, tmp_dir):
    base = f"{tmp_dir}/wh"
    uf = "uf_id int, uf_sigla string, uf_nome string, regiao_id int"
    good = {"dim_regiao": regions(spark, 1), "dim_uf": spark.createDataFrame([(11, "RO", "Rondônia", 1)], uf)}
    write_snapshot(good, base, validate=enforce())
    bad = spark.createDataFrame([(11, "RO", "Rondônia", 1), (11, "RO", "Rondônia", 1), (12, "AC", "Acre", 9), (None, "XX", "x", 1)], uf)
    with pytest.raises(PublicationRejected, match=r"fk\(regiao_id\)->dim_regiao: 1 rows.*not null\(uf_id\): 1 rows.*pk\(uf_id\): 2 rows"):
        write_snapshot({**good, "dim_uf": bad}, base, validate=enforce())
    assert ids(read_snapshot(spark, base, ["dim_uf"])["dim_uf"], "uf_id") == [11]
    write_snapshot({**good, "dim_uf": bad}, base, validate=enforce(["pk(uf_id)", "not null(uf_id)", "fk(regiao_id)->dim_regiao"]))


def test_two_writers(spark, tmp_dir):
    """Of two that replace the same table the later one fails and leaves no
    trace; two that replace different tables both get through."""
    base = f"{tmp_dir}/wh"
    write_snapshot({"dim_regiao": regions(spark, 1)}, base)

    def other_first(tables):
        def validate(spark_, written):  # runs after the writing, before the manifest
            write_snapshot(tables, base)

        return validate

    with pytest.raises(PublicationConflict, match="dim_regiao"):
        write_snapshot({"dim_regiao": regions(spark, 1, 2)}, base, validate=other_first({"dim_regiao": regions(spark, 1, 2, 3)}))
    assert ids(read_snapshot(spark, base, ["dim_regiao"])["dim_regiao"]) == [1, 2, 3] and versions(spark, base) == [1, 2]
    assert recover(spark, base, 0) == []
    uf = spark.createDataFrame([(11, "RO", "Rondônia", 1)], "uf_id int, uf_sigla string, uf_nome string, regiao_id int")
    write_snapshot({"dim_regiao": regions(spark, 4)}, base, validate=other_first({"dim_uf": uf}))
    got = read_snapshot(spark, base, ["dim_regiao", "dim_uf"])
    assert ids(got["dim_regiao"]) == [4] and ids(got["dim_uf"], "uf_id") == [11] and versions(spark, base) == [1, 2, 3, 4]


def test_racing_threads(spark, tmp_dir):
    """Eight writers at once: every version has one publisher, and the newest
    manifest holds the table of each."""
    base = f"{tmp_dir}/wh"
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: write_snapshot({f"t{i}": regions(spark, i)}, base), range(8)))
    assert versions(spark, base) == list(range(1, 9))
    got = read_snapshot(spark, base, [f"t{i}" for i in range(8)])
    assert all(ids(got[f"t{i}"]) == [i] for i in range(8))
    assert sorted(r.id for r in load_log(spark, base).collect()) == [1000 * v for v in range(1, 9)]


def test_recovery_removes_what_no_manifest_names(spark, tmp_dir):
    base = f"{tmp_dir}/wh"
    write_snapshot({"dim_regiao": regions(spark, 1)}, base)
    write_snapshot({"dim_regiao": regions(spark, 2)}, base)
    regions(spark, 3).write.parquet(f"{base}/data/dead-writer/dim_regiao.parquet")
    assert recover(spark, base) == []                                 # too young to be taken for lost
    assert recover(spark, base, 0) == ["dead-writer"] and not os.path.exists(f"{base}/data/dead-writer")
    assert ids(read_snapshot(spark, base, ["dim_regiao"], version=1)["dim_regiao"]) == [1]
    assert ids(read_snapshot(spark, base, ["dim_regiao"])["dim_regiao"]) == [2]


FACT = "municipio_id string, ano int, populacao long"


def test_append(spark, tmp_dir):
    base, name = f"{tmp_dir}/wh", "fato_populacao_municipio"
    rows = lambda *r: spark.createDataFrame(list(r), FACT)
    with pytest.raises(FileNotFoundError):
        append_rows(rows(("1", 2020, 5)), base, name)
    write_snapshot({name: rows(("1", 2020, 5), ("2", 2020, 6))}, base, bucket_by={name: ["municipio_id"]}, partition_by={name: ["ano"]}, buckets=2)
    refused = {
        "present already": [("3", 2020, 1), ("2", 2020, 9)],          # one collision rejects all
        "repeated": [("3", 2021, 1), ("3", 2021, 2)],
        "NULL": [("3", None, 1)],
    }
    for why, new in refused.items():
        with pytest.raises(PublicationRejected, match=why):
            append_rows(rows(*new), base, name)
    assert versions(spark, base) == [1] and recover(spark, base, 0) == []
    assert append_rows(rows(("1", 2021, 7)), base, name, source="more") == 1
    read = lambda **kw: sorted(map(tuple, read_snapshot(spark, base, [name], **kw)[name].select("municipio_id", "ano", "populacao").collect()))
    assert read() == [("1", 2020, 5), ("1", 2021, 7), ("2", 2020, 6)] and read(version=1) == [("1", 2020, 5), ("2", 2020, 6)]
    with pytest.raises(PublicationRejected, match="present already"):
        append_rows(rows(("1", 2021, 8)), base, name)                 # collides with a segment that was appended
    assert latest_loads(load_log(spark, base)).first().origem == "more"


def test_append_reads_only_segments_whose_keys_may_meet(spark, tmp_dir, monkeypatch):
    base, name = f"{tmp_dir}/wh", "fato_populacao_municipio"
    rows = lambda *r: spark.createDataFrame(list(r), FACT)
    write_snapshot({name: rows(("1", 2020, 5))}, base)
    append_rows(rows(("1", 2021, 5)), base, name)
    read = []
    frame = snapshot._frame
    monkeypatch.setattr(snapshot, "_frame", lambda s, segment: read.append(segment["low"].get("ano")) or frame(s, segment))
    append_rows(rows(("0", 2021, 5), ("5", 2022, 5)), base, name)
    # the new rows, the first segment for its types; 2020 lies outside of 2021 to 2022 and isn't compared
    assert read.count(2021) == 2 and read.count(2020) == 1


def test_appends_side_by_side(spark, tmp_dir):
    """Appends of different keys all get through, of one key only one."""
    base, name = f"{tmp_dir}/wh", "fato_populacao_municipio"
    write_snapshot({name: spark.createDataFrame([("1", 2000, 1)], FACT)}, base)

    def append(i):
        try:
            return append_rows(spark.createDataFrame([("1", 2001 + i % 4, i)], FACT), base, name)
        except PublicationRejected:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(append, range(8))) == 4
    got = read_snapshot(spark, base, [name])[name]
    assert sorted(r.ano for r in got.collect()) == [2000, 2001, 2002, 2003, 2004] and recover(spark, base, 0) == []


def test_observed_counts(spark, tmp_dir):
    base = f"{tmp_dir}/wh"
    df = spark.createDataFrame([("1", 2020, 5), ("2", 2020, None), ("3", 2021, None)], FACT)
    write_snapshot({"fato_populacao_municipio": df, "t": df.limit(0)}, base)
    got = {r.coluna: (r.nao_nulos, r.linhas) for r in column_counts(spark, base, "fato_populacao_municipio").collect()}
    assert got == {"municipio_id": (3, 3), "ano": (3, 3), "populacao": (1, 3)}
    segment = manifest(spark, base)["tables"]["fato_populacao_municipio"]["segments"][0]
    assert segment["low"] == {"municipio_id": "1", "ano": 2020} and segment["high"] == {"municipio_id": "3", "ano": 2021}
    assert manifest(spark, base)["tables"]["t"]["segments"][0]["rows"] == 0 and read_snapshot(spark, base, ["t"])["t"].count() == 0


def test_violating_rows_are_quarantined(spark, mini_star):
    tables = mini_star.tables()
    f = tables["fato_populacao_uf"]
    tables["fato_populacao_uf"] = f.unionByName(spark.createDataFrame([(35, 1800, -5), (99, 2020, 1), (11, 2020, 1), (None, 2020, None)], "uf_id int, ano int, populacao long"))
    found = quarantine(tables).collect()
    got = {(r.regra, r.chave) for r in found}
    assert got == {
        ("ano between 1990 and 2100", '{"uf_id":35,"ano":1800}'), ("populacao >= 0", '{"uf_id":35,"ano":1800}'),
        ("fk(uf_id)->dim_uf", '{"uf_id":99,"ano":2020}'), ("pk(uf_id,ano)", '{"uf_id":11,"ano":2020}'), ("not null(uf_id,ano)", '{"ano":2020}'),
    }
    assert len(found) == 6 and {r.tabela for r in found} == {"fato_populacao_uf"}     # both rows of the repeated key
    counts = {(r.tabela, r.regra): r.violacoes for r in count_violations(tables, quarantine(tables)).collect()}
    assert counts[("fato_populacao_uf", "pk(uf_id,ano)")] == 1 and sum(counts.values()) == 5
    moved = mini_star.dim_municipio.withColumn("uf_id", F.when(F.col("uf_id") == 33, 35).otherwise(F.col("uf_id")))
    prefix = quarantine({**mini_star.tables(), "dim_municipio": moved}).collect()
    assert [(r.regra, r.chave) for r in prefix] == [("left(municipio_id, 2) = uf_id", '{"municipio_id":"3304557"}')]


def test_constraints_on_mini_star(mini_star):
    v = {(r.tabela, r.regra): r.violacoes for r in constraint_checks(mini_star).collect()}
    assert v[("dim_municipio", "pk(municipio_id)")] == 0
    assert v[("fato_populacao_municipio", "fk(municipio_id)->dim_municipio")] == 0
    assert all(n == 0 for n in v.values())


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert [r.coluna for r in all_null_columns(df).collect()] == ["b"]


def test_csv_sink(spark, tmp_dir):
    df = spark.createDataFrame([(1, "São Paulo")], "id int, nome string")
    write_csv(df, f"{tmp_dir}/out")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/out")
    assert back.select(F.col("nome")).collect()[0][0] == "São Paulo"


def test_plain_parquet_fallback_without_bucketed_tables(spark, tmp_dir, monkeypatch):
    """A catalog that cannot hold bucketed tables still gets the same rows."""
    from pyspark.sql import DataFrameWriter
    from pyspark.sql import Window

    from terrapanel.operators import prefix

    def refuse(self, *args, **kwargs):
        raise AnalysisException("no bucketed tables here")

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", refuse)
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 5)) for i in range(40)],
                               "id long, municipio_id string, v double")
    with pytest.warns(UserWarning):
        write_snapshot({"fato_populacao_municipio": df}, f"{tmp_dir}/wh", bucket_by={"fato_populacao_municipio":
                                                                                 ["municipio_id"]})
    assert read_snapshot(spark, f"{tmp_dir}/wh", ["fato_populacao_municipio"])["fato_populacao_municipio"].count() == 40
    order = [F.col("v").desc(), F.col("id").asc()]
    got = {r.id: r.c for r in prefix.running_totals(df, order, {"c": F.col("v")}, ["municipio_id"], n_ranges=3).collect()}
    w = Window.partitionBy("municipio_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    assert got == {r.id: r.c for r in df.select("id", F.sum("v").over(w).alias("c")).collect()}


def test_too_many_buckets_is_an_error(spark, tmp_dir):
    """Only a catalog without bucketed tables is fallen back from."""
    n = max_buckets(spark) + 1
    df = spark.createDataFrame([("1", 2020, 5)], FACT)
    with pytest.raises(AnalysisException, match="INVALID_BUCKET_COUNT"):
        stage_bucketed(df, ["municipio_id"], n)
    with pytest.raises(AnalysisException, match="INVALID_BUCKET_COUNT"):
        write_snapshot({"fato_populacao_municipio": df.limit(1)}, f"{tmp_dir}/wh", bucket_by={"fato_populacao_municipio": ["municipio_id"]}, buckets=n)
    assert versions(spark, f"{tmp_dir}/wh") == []


def test_buckets_and_ranges_follow_the_bytes(spark, tmp_dir, monkeypatch):
    from terrapanel.operators import prefix
    from terrapanel.plans import warehouse

    spark.range(1000).write.parquet(f"{tmp_dir}/t")
    df = spark.read.parquet(f"{tmp_dir}/t")
    assert warehouse.choose_buckets(df) == prefix._n_ranges(df, None) == 1
    monkeypatch.setattr(warehouse, "BUCKET_BYTES", 100)
    monkeypatch.setattr(prefix, "RANGE_BYTES", 100)
    size = warehouse.input_bytes(df)
    assert warehouse.choose_buckets(df) == prefix._n_ranges(df, None) == -(-size // 100)
    monkeypatch.setattr(warehouse, "max_buckets", lambda s: 7)
    monkeypatch.setattr(prefix, "max_buckets", lambda s: 7)
    assert warehouse.choose_buckets(df) == prefix._n_ranges(df, None) == 7


def test_a_table_of_some_megabytes_is_spread(spark, tmp_dir, monkeypatch):
    """A task's share of the facts stays small: 200 MB are no two tasks."""
    from terrapanel.operators import prefix
    from terrapanel.plans import warehouse

    spark.range(10).write.parquet(f"{tmp_dir}/t")
    df = spark.read.parquet(f"{tmp_dir}/t")
    bytes_of = lambda n: [monkeypatch.setattr(m, "input_bytes", lambda _: n) for m in (warehouse, prefix)]
    bytes_of(200 << 20)
    assert (warehouse.choose_buckets(df), prefix._n_ranges(df, None)) == (25, 50)
    bytes_of(1 << 40)  # many pieces have grown to their largest size
    assert (warehouse.choose_buckets(df), prefix._n_ranges(df, None)) == ((1 << 40) // warehouse.BUCKET_BYTES, (1 << 40) // prefix.RANGE_BYTES)


def test_second_warehouses_follow_the_bytes(spark, mini_star, tmp_dir, monkeypatch):
    """Publications of a star have as many buckets as its bytes ask for."""
    from terrapanel.plans import load_queries, warehouse
    from terrapanel.sources.star import Star

    write_snapshot(mini_star.tables(), f"{tmp_dir}/wh")
    star = Star(**read_snapshot(spark, f"{tmp_dir}/wh"))
    monkeypatch.setattr(load_queries, "star_for", lambda *_: star)
    monkeypatch.setattr(warehouse, "input_bytes", lambda _: 24 << 20)
    buckets = lambda base, name: manifest(spark, base)["tables"][name]["segments"][0]["bucket"]["n"]
    assert buckets(load_queries._publish_star(spark, star), "fato_pib_municipio") == 3
    base, _ = load_queries._second_refresh(spark, "x")
    assert [buckets(base, n) for n in ("fato_pib_municipio", "mv_painel_municipio")] == [3, 3]


def test_nearest_year_hashes_its_groups(spark):
    """Same rows as by distance, then year, with NULL years first; no sort."""
    from terrapanel.operators.nearest import nearest_year_per_key

    df = spark.createDataFrame([("a", 2020, 1), ("a", 2024, 2), ("b", 2023, 3), ("b", 2022, None), ("c", None, 4), ("c", 2022, 5)], FACT)
    got = nearest_year_per_key(df, "municipio_id", 2022, value_alias="v")
    assert sorted(map(tuple, got.collect())) == [("a", 2020, 1), ("b", 2023, 3), ("c", None, 4)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
