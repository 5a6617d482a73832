"""Feed parsing (series payloads, hierarchy), GeoJSON and geometry."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from terrapanel.operators import geo
from terrapanel.sources import feeds


def payload(localities, years=("2024", "2025")):
    series = [
        {"localidade": {"id": lid, "nivel": {"id": "N6", "nome": "Município"}, "nome": name},
         "serie": dict(zip(years, vals))}
        for lid, name, vals in localities
    ]
    return [{"id": "9324", "variavel": "População residente estimada", "unidade": "Pessoas",
             "resultados": [{"classificacoes": [], "series": series}]}]


SAMPLE = payload([("3550308", "São Paulo - SP", ["11895578", "11904961"]),
                  ("3304557", "Rio de Janeiro - RJ", ["6729894", "..."])])


def text_df(spark, docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string")


def test_flatten_payload(spark):
    rows = feeds.flatten_payload_text(text_df(spark, [SAMPLE])).orderBy("localidade_id", "ano").collect()
    assert len(rows) == 4
    assert rows[-1].localidade_id == "3550308" and rows[-1].valor == 11904961.0
    rio = [r for r in rows if r.localidade_id == "3304557"]
    assert rio[1].valor is None and rio[0].valor == 6729894.0     # "..." → NULL
    assert rows[0].ano == 2024 and rows[0].variavel_id == 9324 and rows[0].unidade == "Pessoas"


def test_read_series_files(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "p.json"), "w") as f:
        json.dump(SAMPLE, f)
    assert feeds.read_series(spark, tmp_dir, level="N6").count() == 4


def wide_payload():
    vals = {"93": ("População", "44411238"), "6318": ("Área", "248219.481"), "614": ("Densidade", "178.92")}
    out = []
    for vid, (name, v) in vals.items():
        out.append({"id": vid, "variavel": name, "unidade": "u", "resultados": [{"classificacoes": [], "series": [
            {"localidade": {"id": "35", "nivel": {"id": "N3", "nome": "UF"}, "nome": "São Paulo"},
             "serie": {"2022": v}}]}]})
    return out


def test_wide_and_dedupe(spark):
    doc = wide_payload()
    tidy = feeds.flatten_payload_text(text_df(spark, [doc, doc]))     # re-delivered batch
    assert tidy.count() == 6
    dedup = feeds.dedupe_series(tidy)
    assert dedup.count() == 3
    wide = feeds.series_wide(dedup, {93: "populacao", 6318: "area_km2", 614: "densidade", 1: "ausente"}).collect()
    assert len(wide) == 1
    r = wide[0]
    assert (r.populacao, r.area_km2, r.densidade) == (44411238.0, 248219.481, 178.92)
    assert r.ausente is None      # declared column always emitted


def test_all_null_entity_year_dropped_from_wide(spark):
    doc = payload([("1", "a", ["...", "5"])])
    wide = feeds.series_wide(feeds.flatten_payload_text(text_df(spark, [doc])), {9324: "pop"}).collect()
    assert [(r.ano, r.pop) for r in wide] == [(2025, 5.0)]


def test_published_years(spark):
    tidy = feeds.flatten_payload_text(text_df(spark, [SAMPLE]))
    kept, ignored = feeds.published_years(tidy, [2023, 2024, 2025])
    assert sorted(r.ano for r in kept.collect()) == [2024, 2025]
    assert [r.ano for r in ignored.collect()] == [2023]


UF_SP = {"id": 35, "sigla": "SP", "nome": "São Paulo", "regiao": {"id": 3, "sigla": "SE", "nome": "Sudeste"}}
UF_MT = {"id": 51, "sigla": "MT", "nome": "Mato Grosso", "regiao": {"id": 5, "sigla": "CO", "nome": "Centro-Oeste"}}
HIERARCHY = [
    {"id": 3550308, "nome": "São Paulo",
     "microrregiao": {"id": 35061, "nome": "São Paulo", "mesorregiao": {"id": 3515, "nome": "Metropolitana",
                                                                         "UF": UF_SP}},
     "regiao-imediata": {"id": 350001, "nome": "São Paulo",
                         "regiao-intermediaria": {"id": 3501, "nome": "São Paulo", "UF": UF_SP}}},
    {"id": 5101837, "nome": "Boa Esperança do Norte", "microrregiao": None,
     "regiao-imediata": {"id": 510001, "nome": "x", "regiao-intermediaria": {"id": 5101, "nome": "y", "UF": UF_MT}}},
    {"id": 9999999, "nome": "Sem hierarquia", "microrregiao": None, "regiao-imediata": None},
]


def test_municipality_hierarchy_fallback(spark):
    df = spark.createDataFrame([(json.dumps(d),) for d in HIERARCHY], "doc string")
    rows = {r.municipio_id: r for r in feeds.flatten_municipalities_text(df).collect()}
    assert set(rows) == {"3550308", "5101837"}                 # no hierarchy → dropped
    assert rows["3550308"].mesorregiao_nome == "Metropolitana" and rows["3550308"].uf_sigla == "SP"
    mt = rows["5101837"]
    assert mt.uf_sigla == "MT" and mt.regiao_nome == "Centro-Oeste" and mt.microrregiao_id is None


def test_catalog(spark):
    doc = {"id": "1", "nome": "Pesquisa", "agregados": [{"id": "6579", "nome": "Pop"}, {"id": "5938", "nome": "PIB"}]}
    c = feeds.flatten_catalog(spark.read.json(spark.sparkContext.parallelize([json.dumps(doc)]), schema=feeds.CATALOG))
    assert sorted(r.agregado_id for r in c.collect()) == [5938, 6579]


CCW = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
CW = list(reversed(CCW))


def fc(features):
    return {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"codarea": code}, "geometry": {"type": t, "coordinates": c}}
        for code, t, c in features]}


def features(spark, tmp_dir, items, name="a.json"):
    with open(os.path.join(tmp_dir, name), "w") as f:
        json.dump(fc(items), f)
    return geo.read_features(spark, os.path.join(tmp_dir, "*.json"))


def areas(df):
    ring_area = F.transform("coordinates", lambda p: F.transform(p, lambda r: geo.ring_signed_area(r)))
    return {r.codarea: r.a for r in df.select("codarea", ring_area.alias("a")).collect()}


def test_reorient_cases(spark, tmp_dir):
    outer = [[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]]          # clockwise already
    hole_cw = [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]             # clockwise hole → must flip
    f = features(spark, tmp_dir, [
        ("1", "Polygon", [CCW]), ("2", "Polygon", [CW]), ("3", "Polygon", [outer, hole_cw]),
        ("4", "MultiPolygon", [[CCW], [[[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]]]),
        ("5", "Polygon", [[[0, 0], [1, 1], [0, 0]]]),
    ])
    assert areas(f)["1"] == [[-2.0]]                               # CCW unit square → −2
    fixed = geo.reorient_features(f)
    a = areas(fixed)
    assert a["1"] == [[2.0]] and a["2"] == [[2.0]]
    assert a["3"][0][0] > 0 and a["3"][0][1] < 0                   # outer CW, hole CCW
    assert a["4"] == [[2.0], [2.0]]
    assert a["5"] == [[0.0]]                                       # < 4 points untouched
    twice = geo.reorient_features(fixed)
    assert twice.select("coordinates").collect() == fixed.select("coordinates").collect()  # idempotent


def test_clip_and_attach(spark, tmp_dir):
    f = features(spark, tmp_dir, [("1", "Polygon", [CCW]), ("2", "Polygon", [CW]), ("3", "Polygon", [CW])],
                 name="b.json")
    codes = spark.createDataFrame([(1,), (3,)], "id long")
    assert sorted(r.codarea for r in geo.clip_to_codes(f, codes, "id").collect()) == ["1", "3"]
    data = spark.createDataFrame([(1, "um", 1234567.0)], "id long, nome string, v double")
    out = {r.codarea: r for r in geo.attach_data(f, data, "id", "nome", "v").collect()}
    assert out["1"].valor_fmt == "1.234.567" and out["2"].valor_fmt == "—"


def test_feature_sink_roundtrip(spark, tmp_dir):
    from terrapanel.sinks.loads import write_features

    f = features(spark, tmp_dir, [("1", "Polygon", [CCW])], name="c.json")
    write_features(geo.reorient_features(f), f"{tmp_dir}/mesh")
    back = geo.read_features(spark, f"{tmp_dir}/mesh", lines=True)
    assert back.collect() == geo.reorient_features(f).collect() and back.first().codarea == "1"


def test_large_collection_is_split(spark, tmp_dir):
    """A mesh in one file, pretty-printed or on one line, is read by several
    tasks: the same rows as by one."""
    import json

    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    features = [
        {"type": "Feature", "properties": {"codarea": str(i), "nome": 'a "Featured" place, {"type": x'},
         "geometry": None if i % 50 == 3 else {"type": "Polygon", "coordinates": [ring]} if i % 2 else {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}
        for i in range(400)
    ]
    whole = {"type": "FeatureCollection", "features": features, "after": {"x": 1}}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for name, indent in (("line", None), ("pretty", 2)):
            path = f"{tmp_dir}/{name}.json"
            with open(path, "w") as f:
                json.dump(whole, f, indent=indent)
            got = geo.read_large_features(spark, path)
            assert got.select(F.spark_partition_id()).distinct().count() > 3
            assert sorted(map(str, got.collect())) == sorted(map(str, geo.read_features(spark, path).collect())) and got.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(f"{tmp_dir}/empty.json", "w") as f:
        json.dump({"type": "FeatureCollection", "features": []}, f)
    assert geo.read_large_features(spark, f"{tmp_dir}/empty.json").count() == 0


def test_redelivered_series_builds_no_panel_and_groups_its_facts_once(spark, tmp_dir, monkeypatch):
    """The deliveries are made of the published facts: no panel is built for
    them, and each fact is read once for all its variables and copies."""
    from datetime import datetime

    from terrapanel.plans import warehouse
    from terrapanel.plans.operator_queries import QUERIES, delivered_twice, payloads

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/{name}.parquet")

    write("region", [(0, "AFRICA")], "r_regionkey int, r_name string")
    write("nation", [(3, "KENYA", 0)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(1, "one", 3, 10.0, "A"), (2, "two", 3, 0.0, "B")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    write("part", [(1, "MEDIUM TIN")], "p_partkey long, p_type string")
    write("orders", [(1, 1, datetime(1995, 5, 1)), (2, 1, datetime(1996, 5, 1)), (3, 2, datetime(1995, 6, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    write("lineitem", [(1, 1, 5.0, 100.0, 0.0), (2, 1, 6.0, 200.0, 0.5), (3, 9, 7.0, 300.0, 0.0)], "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_tax double")

    def no_panels(*args, **kwargs):
        raise AssertionError("a panel is built")

    monkeypatch.setattr(warehouse, "refresh_panels", no_panels)
    df = QUERIES["src_series_dedupe"](spark, tmp_dir)
    got = {(r.localidade_id, r.ano, r.variavel_id): r.valor for r in df.collect()}
    assert df.count() == len(got) == 3 + 2 + 3 + 3
    assert {k: v for k, v in got.items() if k[0].endswith("1")} == {
        ("0000001", 1995, 93): 5.0, ("0000001", 1996, 93): 6.0, ("0000001", 1995, 37): 100.0,
        ("0000001", 1996, 37): 300.0, ("0000001", 1995, 516): 100.0, ("0000001", 1996, 516): 200.0}
    assert got[("0000002", 1995, 516)] is None and got[("3", 1995, 93)] == 12.0
    once, twice = payloads(spark, tmp_dir), delivered_twice(payloads(spark, tmp_dir))
    assert sorted(r.payload for r in twice.collect()) == sorted(2 * [r.payload for r in once.collect()])
    read = [f for f in df.inputFiles() if "/fato_pib_municipio.parquet/" in f]
    scans = df._jdf.queryExecution().optimizedPlan().toString().count("vab_servicos")
    assert read and scans == 1, df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    star = warehouse.star_for(spark, tmp_dir)
    assert star.mv_painel_municipio.count() == 2
    assert warehouse.facts_for(spark, tmp_dir).fato_pib_municipio.inputFiles() == star.fato_pib_municipio.inputFiles()
