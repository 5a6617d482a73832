"""One registered query per operator of the inventory that the named
queries and panels do not already exercise.

Every builder reads the star that the ETL derived from the driver's
tables (``star_for``) — or data Spark derives from it, like the series
payloads and meshes rebuilt from the facts to exercise the feed and
geometry readers — so the work grows with the input. Double outputs whose
value depends on summation order are rounded (half-up, 6 decimals) for a
reproducible comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import registry
from ..functions import as_double, fmt_number_br, label_city, parse_feed_number, round_to
from ..operators import aggregates as agg
from ..operators import concentration as conc
from ..operators import geo
from ..operators import quality
from ..operators.growth import growth_first_last, index_base100, national_series
from ..operators.metrics import density, enrich_ufs, gdp_per_capita, sector_structure
from ..operators.nearest import nearest_year_global
from ..operators.prefix import range_running_sum
from ..sinks.loads import Source, prepare
from ..sources import feeds
from ..sources.star import SECTOR_COLUMNS
from ..sources.tables import read_table
from . import panels
from .warehouse import facts_for, star_for

BANDS = registry.TPCH_BANDS
REGION_ORDER = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Variables of the series payloads rebuilt from the facts.
VAR_POP = ("93", "População residente estimada", "Pessoas")
VAR_PIB = ("37", "Produto Interno Bruto a preços correntes", "Mil Reais")
VAR_VAB_IND = ("516", "Valor adicionado bruto da Indústria", "Mil Reais")
WIDE_NAMES = {93: "populacao", 37: "pib_mil_reais", 516: "vab_industria"}


def r6(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column half-up to 6 decimals."""
    return df.select(
        *[round_to(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
          for f in df.schema.fields]
    )


# --------------------------------------------------------------------------
# Payloads and documents rebuilt from the star (feed readers at scale)
# --------------------------------------------------------------------------


def _payloads(df: DataFrame, key: str, name: str, level: tuple[str, str],
              variables: list[tuple[tuple[str, str, str], F.Column]]) -> DataFrame:
    """One payload text per (entity, variable): ``[{id, variavel, unidade,
    resultados: [{classificacoes: [], series: [{localidade, serie}]}]}]``.
    The ``serie`` map holds one entry per year of the entity (bounded); the
    entity's rows are grouped once for all its variables."""
    g = df.groupBy(key, name).agg(
        *[F.map_from_entries(F.collect_list(F.struct(F.col("ano").cast("string"), value))).alias(f"serie_{i}")
          for i, (_, value) in enumerate(variables)]
    )
    loc = F.struct(
        F.col(key).cast("string").alias("id"),
        F.struct(F.lit(level[0]).alias("id"), F.lit(level[1]).alias("nome")).alias("nivel"),
        F.col(name).alias("nome"),
    )

    def text(i: int, var: tuple[str, str, str]) -> F.Column:
        item = F.struct(
            F.lit(var[0]).alias("id"), F.lit(var[1]).alias("variavel"), F.lit(var[2]).alias("unidade"),
            F.array(F.struct(F.array().cast("array<string>").alias("classificacoes"),
                             F.array(F.struct(loc.alias("localidade"), F.col(f"serie_{i}").alias("serie")))
                             .alias("series")))
            .alias("resultados"),
        )
        return F.to_json(F.array(item))

    return g.select(F.explode(F.array(*[text(i, var) for i, (var, _) in enumerate(variables)])).alias("payload"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series payloads of population, GDP and industry value added at the
    municipal level and population at the state level. Unpublished value
    added (the lag years) is the feed's ``...`` sentinel."""
    s = facts_for(spark, sf_dir)
    names = s.dim_municipio.select("municipio_id", "municipio_nome")
    pop = s.fato_populacao_municipio.join(names, "municipio_id")
    pib = s.fato_pib_municipio.join(names, "municipio_id")
    uf = s.fato_populacao_uf.join(s.dim_uf.select("uf_id", "uf_nome"), "uf_id")
    mun = ("N6", "Município")
    return (
        _payloads(pop, "municipio_id", "municipio_nome", mun, [(VAR_POP, F.col("populacao").cast("string"))])
        .unionByName(_payloads(pib, "municipio_id", "municipio_nome", mun, [
            (VAR_PIB, F.col("pib_mil_reais").cast("string")),
            (VAR_VAB_IND, F.coalesce(F.col("vab_industria").cast("string"), F.lit("..."))),
        ]))
        .unionByName(_payloads(uf, "uf_id", "uf_nome", ("N3", "Unidade da Federação"),
                               [(VAR_POP, F.col("populacao").cast("string"))]))
    )


def delivered_twice(batch: DataFrame) -> DataFrame:
    """A batch of payloads and its re-delivery: every payload twice, built
    once. Both copies are parsed."""
    return batch.select(F.explode(F.array("payload", "payload")).alias("payload"))


def tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.flatten_payload_text(payloads(spark, sf_dir))


def _uf_struct(s) -> DataFrame:
    u = s.dim_uf.join(s.dim_regiao, "regiao_id")
    return u.select(
        "uf_id",
        F.struct(
            F.col("uf_id").cast("long").alias("id"), F.col("uf_sigla").alias("sigla"), F.col("uf_nome").alias("nome"),
            F.struct(F.col("regiao_id").cast("long").alias("id"), F.col("regiao_sigla").alias("sigla"),
                     F.col("regiao_nome").alias("nome")).alias("regiao"),
        ).alias("UF"),
    )


def hierarchy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hierarchy document per customer: the micro-region path, or only
    the immediate-region path (segment AUTOMOBILE)."""
    s = star_for(spark, sf_dir)
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment",
                                                    F.col("c_nationkey").cast("int").alias("uf_id"))
    c = c.join(_uf_struct(s), "uf_id")
    seg = F.col("c_mktsegment")
    micro = F.struct(
        (F.col("uf_id") * 10 + F.length(seg)).cast("long").alias("id"),
        F.concat(F.lit("Micro "), seg).alias("nome"),
        F.struct(F.col("uf_id").cast("long").alias("id"), seg.alias("nome"), F.col("UF").alias("UF")).alias(
            "mesorregiao"),
    )
    immediate = F.struct(
        (F.col("uf_id") * 100).cast("long").alias("id"), F.concat(F.lit("Imediata "), seg).alias("nome"),
        F.struct((F.col("uf_id") * 1000).cast("long").alias("id"), F.lit("Intermediária").alias("nome"),
                 F.col("UF").alias("UF")).alias("regiao-intermediaria"),
    )
    doc = F.struct(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"),
        F.when(seg != F.lit("AUTOMOBILE"), micro).alias("microrregiao"),
        F.when(seg == F.lit("AUTOMOBILE"), immediate).alias("regiao-imediata"),
    )
    return c.select(F.to_json(doc).alias("doc"))


def meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square mesh per municipality, empty without area (counter-clockwise
    for even ids, holes for ids divisible by 3)."""
    p = star_for(spark, sf_dir).mv_painel_municipio
    k = F.col("municipio_id").cast("long")
    return geo.square_meshes(p, "municipio_id", "area_km2", ccw=(k % 2 == 0), hole=(k % 3 == 0))


def feature_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FeatureCollection documents of at most 100 features each (per state
    and id block), as the mesh endpoint delivers one collection per state.
    Single-polygon features are written as ``Polygon`` (one array level
    less), the others as ``MultiPolygon``."""
    m = meshes(spark, sf_dir).join(
        star_for(spark, sf_dir).dim_municipio.select("municipio_id", "uf_id"), F.col("codarea") == F.col("municipio_id")
    )
    single = F.size(F.col("coordinates")) == 1
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"codarea":"'), F.col("codarea"),
        F.lit('"},"geometry":{"type":"'), F.when(single, F.lit("Polygon")).otherwise(F.lit("MultiPolygon")),
        F.lit('","coordinates":'),
        F.when(single, F.to_json(F.col("coordinates")[0])).otherwise(F.to_json(F.col("coordinates"))),
        F.lit("}}"),
    )
    block = F.floor(F.col("codarea").cast("long") / 100)
    g = m.groupBy("uf_id", block.alias("bloco")).agg(F.collect_list(feature).alias("features"))
    return g.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", "features"),
                             F.lit("]}")).alias("fc"))


# --------------------------------------------------------------------------
# Builders
# --------------------------------------------------------------------------


def _src_geo_features(spark, sf_dir):
    from ..session import scratch_path

    path = scratch_path(spark, "collections")
    feature_collections(spark, sf_dir).write.text(path)
    f = geo.read_large_features(spark, path)
    return f.select("codarea", "geom_type", F.size("coordinates").alias("n_poligonos"),
                    F.coalesce(F.size(F.get(F.col("coordinates"), 0)), F.lit(0)).alias("n_aneis"))


def _geo_reorient(spark, sf_dir):
    f = geo.reorient_features(meshes(spark, sf_dir))
    ring_area = F.transform("coordinates", lambda p: F.transform(p, lambda r: geo.ring_signed_area(r)))
    a = f.select("codarea", ring_area.alias("a"))
    return a.select(
        "codarea",
        round_to(F.get(F.get("a", 0), 0), 6).alias("area_externa"),
        round_to(F.get(F.get("a", 0), 1), 6).alias("area_buraco"),
    )


def _filter_geo_codes(spark, sf_dir):
    p = star_for(spark, sf_dir).mv_painel_municipio.filter(F.col("pib_mil_reais").isNotNull())
    return geo.clip_to_codes(meshes(spark, sf_dir), p.select(F.col("municipio_id").alias("codarea"))).select("codarea")


def _join_geo_data(spark, sf_dir):
    p = star_for(spark, sf_dir).mv_painel_municipio
    f = geo.attach_data(meshes(spark, sf_dir).select("codarea"), p, "municipio_id", "municipio_nome",
                        "populacao_atual", 0)
    return f.select("codarea", "nome", "valor", "valor_fmt")


def _choropleth(spark, sf_dir):
    p = star_for(spark, sf_dir).mv_painel_municipio
    return r6(agg.choropleth_input(p, "densidade_atual", log10=True))


def _sentinels(spark, sf_dir):
    """The number in every event's properties, and for two kinds of event a
    second text that is one of the feed's sentinels."""
    e = read_table(spark, sf_dir, "events")
    own = e.select("event_id", F.get_json_object("props", "$.k").alias("texto"))
    sentinel = F.when(F.col("event_type") == "error", F.lit("...")).when(F.col("event_type") == "signup", F.lit("-"))
    marked = e.select("event_id", sentinel.alias("texto")).where(F.col("texto").isNotNull())
    return own.unionByName(marked).select("event_id", "texto", parse_feed_number("texto").alias("valor"))


def _published_years(spark, sf_dir):
    kept, ignored = feeds.published_years(star_for(spark, sf_dir).fato_populacao_municipio, list(range(1994, 2003)))
    return kept.withColumn("situacao", F.lit("publicado")).unionByName(ignored.withColumn("situacao", F.lit("ignorado")))


def _series_wide(spark, sf_dir):
    """Delivered twice, the second time every value one higher: the first
    delivered value of a cell stays."""
    rows = tidy(spark, sf_dir).filter(F.col("nivel") == "N6")
    twice = rows.withColumn("entrega", F.lit(1)).unionByName(rows.withColumn("valor", F.col("valor") - 1).withColumn("entrega", F.lit(2)))
    return feeds.series_wide(twice, WIDE_NAMES, delivery="entrega")


def _catalog(spark, sf_dir):
    s = star_for(spark, sf_dir)
    docs = s.dim_uf.join(s.dim_regiao, "regiao_id").groupBy("regiao_id", "regiao_nome").agg(
        F.collect_list(F.struct(F.col("uf_id").cast("string").alias("id"), F.col("uf_nome").alias("nome")))
        .alias("agregados")
    ).select(F.to_json(F.struct(F.col("regiao_id").cast("string").alias("id"), F.col("regiao_nome").alias("nome"),
                                "agregados")).alias("doc"))
    return feeds.flatten_catalog(docs.select(F.from_json("doc", feeds.CATALOG).alias("c")).select("c.*"))


def _dim_uf_json(spark, sf_dir):
    s = star_for(spark, sf_dir)
    docs = _uf_struct(s).select(F.to_json("UF").alias("doc"))
    return feeds.flatten_ufs(docs.select(F.from_json("doc", feeds.UF).alias("u")).select("u.*"))


def _dim_region_json(spark, sf_dir):
    s = star_for(spark, sf_dir)
    docs = s.dim_regiao.select(F.to_json(F.struct(F.col("regiao_id").cast("long").alias("id"),
                                                   F.col("regiao_sigla").alias("sigla"),
                                                   F.col("regiao_nome").alias("nome"))).alias("doc"))
    return feeds.flatten_regions(docs.select(F.from_json("doc", feeds.REGION).alias("r")).select("r.*"))


def _load_prepare(spark, sf_dir):
    s = star_for(spark, sf_dir)
    raw = s.fato_populacao_municipio.select(
        F.col("municipio_id").cast("long").alias("localidade_id"), F.lit("x").alias("localidade_nome"),
        F.lit("N6").alias("nivel"), "ano", (F.col("populacao").cast("double") / 2).alias("populacao"),
    )
    src = Source("pop_municipios.parquet", "fato_populacao_municipio", "municipio_id", ["ano", "populacao"],
                 ["populacao"])
    return prepare(raw, src)


def _enrich_uf(spark, sf_dir):
    s = star_for(spark, sf_dir)
    raw = s.fato_pib_uf.select(F.col("uf_id").cast("string").alias("localidade_id"),
                               F.lit("x").alias("localidade_nome"), F.lit("N3").alias("nivel"), "ano", "pib_mil_reais")
    return enrich_ufs(raw, s.dim_uf)


def _growth_pandas_path(spark, sf_dir):
    s = star_for(spark, sf_dir)
    return r6(growth_first_last(s.fato_populacao_uf, "uf_id", growth_edges=BANDS.growth))


def _concentration_pop(spark, sf_dir):
    return r6(conc.concentration(star_for(spark, sf_dir).mv_painel_municipio, "populacao_atual"))


def _concentration_gdp(spark, sf_dir):
    return r6(conc.concentration(star_for(spark, sf_dir).mv_painel_municipio, "pib_mil_reais"))


def _region_sums(spark, sf_dir):
    """Sorted by the canonical order; ``posicao`` is the place of the row."""
    sums = agg.region_sums(panels.uf_panel(star_for(spark, sf_dir)), ["populacao_atual", "area_km2", "pib_mil_reais", "impostos_liquidos"], REGION_ORDER)
    return agg.numbered(sums, "ordem")


def _running_sum_ties(spark, sf_dir):
    """GDP gathered from the largest population on; equal populations share
    one sum."""
    p = star_for(spark, sf_dir).mv_painel_municipio
    out = range_running_sum(p.select("municipio_id", "populacao_atual", "pib_mil_reais"), "populacao_atual", F.sum("pib_mil_reais"), "pib_acumulado")
    return out.withColumn("pib_acumulado", F.col("pib_acumulado").cast("decimal(38,4)"))


def _growth_uf_enriched(s):
    return s.fato_pib_uf.join(s.dim_uf, "uf_id").join(s.dim_regiao, "regiao_id")


QUERIES = {
    # sources
    "src_series_flatten": lambda s, d: tidy(s, d),
    "src_sentinel_parse": _sentinels,
    "src_series_dedupe": lambda s, d: feeds.dedupe_series(
        feeds.flatten_payload_text(delivered_twice(payloads(s, d)))),
    "src_series_select": lambda s, d: feeds.select_series(tidy(s, d), variables=[93], years=[1995, 1999, 2001]),
    "src_series_wide": _series_wide,
    "src_windowed_extract": lambda s, d: feeds.window_years(tidy(s, d), first_year=1997),
    "src_published_years": _published_years,
    "src_dataset_catalog": _catalog,
    "src_dim_uf": _dim_uf_json,
    "src_dim_region": _dim_region_json,
    "src_dim_municipality": lambda s, d: feeds.flatten_municipalities_text(hierarchy_docs(s, d)),
    "src_geo_features": _src_geo_features,
    "src_parquet_table": lambda s, d: read_table(s, d, "region"),
    # loads
    "load_prepare": _load_prepare,
    # filters
    "filter_latest_year": lambda s, d: (lambda p: p.filter(F.col("ano") == p.select(F.max("ano")).scalar()))(
        star_for(s, d).fato_populacao_municipio),
    "filter_latest_nonnull_year": lambda s, d: (lambda p: p.filter(
        F.col("ano") == p.filter(F.col("vab_industria").isNotNull()).select(F.max("ano")).scalar()))(
        star_for(s, d).fato_pib_municipio),
    "filter_members": lambda s, d: agg.selection_share(
        star_for(s, d).mv_painel_municipio,
        agg.filter_members(star_for(s, d).mv_painel_municipio, regions=["AMERICA", "ASIA"])),
    "filter_declining": lambda s, d: agg.declining(panels.growth_view(star_for(s, d), BANDS)),
    "filter_min_population": lambda s, d: agg.top_growth(panels.growth_view(star_for(s, d), BANDS), 20, 300),
    "top_declinio": lambda s, d: agg.top_growth(panels.growth_view(star_for(s, d), BANDS), 20, 300, ascending=True),
    "filter_geo_codes": _filter_geo_codes,
    # joins
    "join_enrich_uf": _enrich_uf,
    "join_nearest_year_global": lambda s, d: nearest_year_global(
        star_for(s, d).fato_populacao_municipio, "municipio_id",
        star_for(s, d).fato_pib_municipio.select(F.max("ano")).scalar(),
        year_alias="ano_populacao_pib", value_alias="populacao_ano_pib"),
    "join_geo_data": _join_geo_data,
    # derived metrics
    "density": lambda s, d: r6(density(star_for(s, d).fato_censo_municipio)),
    "gdp_per_capita": lambda s, d: r6(gdp_per_capita(
        star_for(s, d).fato_pib_municipio.join(
            star_for(s, d).fato_censo_municipio.select("municipio_id", "populacao_censo"), "municipio_id"))),
    "sector_structure": lambda s, d: r6(sector_structure(star_for(s, d).fato_pib_municipio)),
    "growth_pandas_path": _growth_pandas_path,
    "index_base100": lambda s, d: r6(index_base100(star_for(s, d).fato_populacao_uf, "uf_id")),
    "share_of_group": lambda s, d: r6(agg.share_of_group(star_for(s, d).fato_pib_uf, "pib_mil_reais")),
    "gdp_pop_ratio": lambda s, d: r6(agg.gdp_pop_ratio(panels.uf_panel(star_for(s, d)))),
    # aggregations
    "agg_region_sum": _region_sums,
    "win_running_sum_ties": _running_sum_ties,
    "agg_national_series": lambda s, d: r6(national_series(star_for(s, d).fato_populacao_uf)),
    "agg_region_year": lambda s, d: r6(agg.region_year_share(_growth_uf_enriched(star_for(s, d)))),
    "agg_region_year_population": lambda s, d: agg.region_year_sum(
        star_for(s, d).fato_populacao_uf.join(star_for(s, d).dim_uf, "uf_id").join(star_for(s, d).dim_regiao,
                                                                                       "regiao_id")),
    "agg_growth_by_region": lambda s, d: r6(agg.growth_by_region(panels.growth_view(star_for(s, d), BANDS), 4)),
    "agg_decline_summary": lambda s, d: r6(agg.decline_summary(panels.growth_view(star_for(s, d), BANDS), 4)),
    "agg_growth_bands": lambda s, d: r6(agg.growth_band_distribution(panels.growth_view(star_for(s, d), BANDS))),
    "agg_size_bands": lambda s, d: r6(agg.size_distribution(star_for(s, d).mv_painel_municipio, BANDS.size)),
    "agg_density_bands": lambda s, d: r6(agg.density_distribution(star_for(s, d).mv_painel_municipio,
                                                                  BANDS.density)),
    "agg_band_subset": lambda s, d: r6(agg.band_subset_share(
        agg.size_distribution(star_for(s, d).mv_painel_municipio, BANDS.size), "porte",
        registry.SIZE_LABELS[:3])),
    "agg_headline": lambda s, d: r6(agg.headline(star_for(s, d).mv_painel_municipio,
                                                 panels.growth_view(star_for(s, d), BANDS))),
    "agg_min_median_max": lambda s, d: r6(agg.min_median_max(star_for(s, d).mv_painel_municipio,
                                                             "pib_per_capita", 2)),
    "agg_quantile_breaks": lambda s, d: agg.quantile_breaks(star_for(s, d).mv_painel_municipio, "densidade_atual"),
    "agg_histogram": lambda s, d: r6(agg.histogram(star_for(s, d).mv_painel_municipio, "populacao_atual", 20)),
    "agg_histogram_log": lambda s, d: r6(agg.histogram(star_for(s, d).mv_painel_municipio, "densidade_atual", 15,
                                                       log10=True)),
    "agg_last_point": lambda s, d: agg.last_point(
        agg.region_year_sum(star_for(s, d).fato_populacao_uf.join(star_for(s, d).dim_uf, "uf_id")
                            .join(star_for(s, d).dim_regiao, "regiao_id")),
        "regiao_nome", value="populacao", order=REGION_ORDER),
    # concentration
    "gini_top_share": _concentration_pop,
    "gdp_concentration": _concentration_gdp,
    "lorenz_curve": lambda s, d: lorenz(s, d),
    "half_of_total": lambda s, d: r6(conc.half_of_total(star_for(s, d).mv_painel_municipio, "pib_mil_reais",
                                                        "municipio_id")),
    "territorial_half": lambda s, d: r6(conc.territorial_half(star_for(s, d).mv_painel_municipio, "densidade_atual",
                                                              "populacao_atual", "area_km2", "municipio_id")),
    # sort / top-k / reshape
    "topk": lambda s, d: agg.topk(star_for(s, d).mv_painel_municipio, "pib_per_capita", 25,
                                  cols=["municipio_id", "municipio_nome", "uf_sigla", "pib_per_capita"]),
    "rank_ufs": lambda s, d: r6(agg.rank_ufs(panels.uf_panel(star_for(s, d)))),
    "extremes": lambda s, d: agg.extremes(star_for(s, d).mv_painel_municipio, 10),
    "distinct_values": lambda s, d: agg.distinct_values(star_for(s, d).mv_painel_municipio, "uf_sigla"),
    "full_growth_table": lambda s, d: agg.growth_table(panels.growth_view(star_for(s, d), BANDS)),
    "unpivot_sectors": lambda s, d: r6(agg.sector_structure_long(panels.uf_panel(star_for(s, d)))),
    "density_by_region": lambda s, d: agg.density_by_region(panels.region_panel(star_for(s, d))),
    "label_city": lambda s, d: star_for(s, d).mv_painel_municipio.select(
        "municipio_id", label_city("municipio_nome", "uf_sigla").alias("rotulo"),
        fmt_number_br(F.col("populacao_atual"), 0).alias("populacao_fmt")),
    # geometry and quality
    "geo_reorient": _geo_reorient,
    "geo_choropleth_input": _choropleth,
    "constraint_checks": lambda s, d: quality.constraint_checks(star_for(s, d)),
    "panel_invariants": lambda s, d: r6(quality.panel_invariants(
        star_for(s, d), star_for(s, d).mv_painel_municipio, panels.uf_panel(star_for(s, d)),
        panels.region_panel(star_for(s, d)))),
    "all_null_columns": lambda s, d: quality.all_null_columns(star_for(s, d).mv_painel_municipio),
}


def lorenz(spark, sf_dir):
    return conc.lorenz_curve(star_for(spark, sf_dir).mv_painel_municipio, "populacao_atual", "municipio_id")


__all__ = ["QUERIES", "payloads", "tidy", "hierarchy_docs", "meshes", "feature_collections", "as_double",
           "SECTOR_COLUMNS"]


# --------------------------------------------------------------------------
# Sinks and loads (round trips through storage) and a few more operators
# --------------------------------------------------------------------------


def _sink_parquet(spark, sf_dir):
    from ..session import scratch_path
    from ..sinks.loads import write_parquet

    path = scratch_path(spark, "sink-parquet")
    write_parquet(star_for(spark, sf_dir).fato_populacao_municipio, path, partition_by=["ano"])
    return spark.read.parquet(path).select("municipio_id", F.col("ano").cast("int").alias("ano"), "populacao")


def _sink_csv(spark, sf_dir):
    from ..session import scratch_path
    from ..sinks.loads import write_csv

    path = scratch_path(spark, "sink-csv")
    write_csv(nq_run("declinio_populacional", spark, sf_dir), path)
    schema = "uf_sigla string, uf_nome string, regiao_nome string, n_municipios long, n_em_declinio long, " \
             "pct_em_declinio double, n_perda_acentuada long, populacao_perdida long, populacao_ganha long, " \
             "saldo_liquido long, cagr_medio double, cagr_mediano double"
    return spark.read.option("header", True).schema(schema).csv(path)


def _sink_geojson(spark, sf_dir):
    from ..session import scratch_path
    from ..sinks.loads import write_features

    path = scratch_path(spark, "sink-geojson")
    write_features(geo.reorient_features(meshes(spark, sf_dir)), path)
    back = geo.read_features(spark, path, lines=True)
    # what came back, down to the points of every ring
    points = F.aggregate("coordinates", F.lit(0), lambda n, polygon: n + F.aggregate(polygon, F.lit(0), lambda m, ring: m + F.size(ring)))
    return back.select("codarea", "geom_type", points.cast("long").alias("n_pontos"))


def _nearest_per_entity(spark, sf_dir):
    from ..operators.nearest import nearest_year_per_key

    s = star_for(spark, sf_dir)
    return nearest_year_per_key(s.fato_populacao_municipio, "municipio_id",
                                s.fato_pib_municipio.select(F.max("ano")).scalar(),
                                year_alias="ano_populacao_pib", value_alias="populacao_ano_pib")


def _ordered_arrays(spark, sf_dir):
    f = star_for(spark, sf_dir).fato_populacao_municipio.filter(F.col("populacao").isNotNull())
    g = f.groupBy("municipio_id").agg(F.array_sort(F.collect_list(F.struct("ano", "populacao"))).alias("_s"))
    return g.select("municipio_id", F.transform(
        "_s", lambda x: F.concat(x["ano"].cast("string"), F.lit(":"), x["populacao"].cast("string"))
    ).alias("serie_populacao"))


def _distinct_years(spark, sf_dir):
    s = star_for(spark, sf_dir)
    parts = [("populacao", s.fato_populacao_municipio), ("pib", s.fato_pib_municipio),
             ("censo", s.fato_censo_municipio)]
    out = None
    for name, df in parts:
        r = df.agg(F.countDistinct("ano").alias("anos")).select(F.lit(name).alias("serie"), "anos")
        out = r if out is None else out.unionByName(r)
    return out


def nq_run(name, spark, sf_dir, **params):
    from . import queries as nq

    return nq.run(name, star_for(spark, sf_dir), BANDS, **params)


def _compact(spark, sf_dir):
    from ..functions import fmt_compact_br

    p = star_for(spark, sf_dir).mv_painel_municipio
    return p.select("municipio_id", fmt_compact_br(F.col("pib_mil_reais")).alias("pib_fmt"),
                    fmt_compact_br(F.col("populacao_atual")).alias("populacao_fmt"))


QUERIES.update({
    "fmt_compact_br": _compact,
    "sink_parquet": _sink_parquet,
    "sink_csv": _sink_csv,
    "sink_geojson": _sink_geojson,
    "join_nearest_year": _nearest_per_entity,
    "agg_ordered_array": _ordered_arrays,
    "agg_distinct_years": _distinct_years,
})

#: Inventory ids whose operator is exercised by another registered query.
ALIASES = {
    "filter_optional_param": "serie_uf", "filter_id_or_name": "perfil_municipio_by_name",
    "filter_xor": "descolamento_pib_populacao", "project_existing": "rank_ufs", "drop_nulls": "topk",
    "join_growth_dim": "growth_first_last", "join_full_outer_series": "serie_uf",
    "join_self_endpoints": "descolamento_pib_populacao", "join_cross_thresholds": "concentracao",
    "join_semi_in": "perfil_municipio", "join_using_rank": "perfil_municipio", "join_map_lookup": "index_base100",
    "safe_denominator": "density", "nullif_ratio": "join_panel_municipality", "pct_change": "agg_national_series",
    "share_of_total": "agg_uf_panel", "location_quotient": "quociente_locacional",
    "divergence_pp": "descolamento_pib_populacao", "common_window": "descolamento_pib_populacao",
    "abs_rel_tolerance_check": "qualidade", "bucketize": "growth_pandas_path", "band_growth": "growth_first_last",
    "band_size": "agg_size_bands", "band_density": "agg_density_bands", "band_quotient": "quociente_locacional",
    "quality_status": "qualidade", "agg_uf_series": "serie_uf_one_state", "agg_decline_by_uf": "declinio_populacional",
    "gini": "gini_top_share", "top_share": "gini_top_share", "population_concentration": "gini_top_share",
    "concentration_cutoffs": "concentracao", "win_lag": "growth_step", "win_first_last": "growth_first_last",
    "win_rank": "ranking_view", "win_percent_rank": "ranking_view", "win_row_number": "concentration_table",
    "win_running_sum": "concentration_table",
    "win_total": "agg_uf_panel", "win_transform_sum": "share_of_group", "win_cumsum": "lorenz_curve",
    "topk_metric_param": "top_municipios_pib_per_capita", "extremes_union": "densidade_extremos",
    "canonical_sort": "agg_region_sum", "distinct_on": "concentracao", "pivot_wide": "src_series_wide",
    "union_all": "agg_available_years", "regions_comparison": "regioes", "profile": "perfil_municipio",
    "geo_signed_area": "geo_reorient", "quality_checks": "qualidade", "coverage_gap_report": "coverage_gap",
}
