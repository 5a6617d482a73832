"""Registered queries of the load half: each performs its operation on tables
derived from the given ones, in a base folder of its own, and returns what a
reader sees afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..operators import quality
from ..operators.metrics import enrich_municipalities, orphan_count
from ..session import checkpoint, scratch_path
from ..sinks.snapshot import (
    MUNICIPAL_BUCKETS, YEAR_PARTITIONS, PublicationRejected, append_rows, latest_loads, load_log, manifest, read_snapshot, recover, versions, write_snapshot,
)
from ..sources.star import DIM_TABLES, FACT_TABLES, PRIMARY_KEYS, Star
from ..sources.tables import inventory
from . import feed_etl, panels
from .warehouse import TPCH_WAIVED, base_for, choose_buckets, panel_statistics, refresh_panels, star_for

BANDS = registry.TPCH_BANDS

#: Year from which the municipal GDP of the rebuilt feed is extracted.
FEED_WINDOW = 1994


# --------------------------------------------------------------------------
# Whole tables as long rows
# --------------------------------------------------------------------------


def long_rows(name: str, df: DataFrame) -> DataFrame:
    """(``tabela``, ``id``, ``ano``, ``medida``, ``valor``): every value of
    every row, numbers with four decimals, so that tables of different shapes
    can be compared whole."""
    key = [c for c in df.columns if c in ("municipio_id", "uf_id", "regiao_id")]
    own = PRIMARY_KEYS.get(name, key[:1])
    own = [c for c in own if c != "ano"]
    year = F.col("ano").cast("int") if "ano" in df.columns else F.lit(None).cast("int")
    id_ = F.col(own[0]).cast("string") if own else F.lit("1")
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    measures = [c for c in df.columns if c not in (*own, "ano")]
    value = lambda c: F.col(c) if c in text else F.col(c).cast("decimal(38,4)").cast("string")
    pairs = F.array(*(F.struct(F.lit(c).alias("medida"), value(c).alias("valor")) for c in measures))
    return df.select(F.lit(name).alias("tabela"), id_.alias("id"), year.alias("ano"), F.explode(pairs).alias("p")).select("tabela", "id", "ano", "p.*")


def long_tables(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        rows = long_rows(name, df)
        out = rows if out is None else out.unionByName(rows)
    return out


def _rejected(act: Callable[[], object]) -> None:
    """Run what must be rejected."""
    try:
        act()
    except PublicationRejected:
        return
    raise AssertionError("a publication that breaks a rule went through")


# --------------------------------------------------------------------------
# Publication, append, lineage
# --------------------------------------------------------------------------


def _publish_star(spark: SparkSession, star: Star) -> str:
    base = scratch_path(spark, "published")
    write_snapshot(star.tables(), base, source="star", bucket_by=MUNICIPAL_BUCKETS, partition_by=YEAR_PARTITIONS, buckets=choose_buckets(star.fato_pib_municipio), validate=quality.enforce(TPCH_WAIVED))
    return base


def load_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the star; fail to publish it again with a broken table (a key
    twice, an unknown state, a negative population); what is then read is the
    first publication, all ten tables."""
    star = star_for(spark, sf_dir)
    base = _publish_star(spark, star)
    f = star.fato_populacao_uf
    broken = f.unionByName(f.where("uf_id = 1")).unionByName(f.where("uf_id = 2").withColumn("uf_id", F.lit(999))).unionByName(f.where("uf_id = 3").withColumn("ano", F.col("ano") + 50).withColumn("populacao", -F.col("populacao")))
    _rejected(lambda: write_snapshot({**star.tables(), "fato_populacao_uf": broken}, base, validate=quality.enforce(TPCH_WAIVED)))
    if len(versions(spark, base)) != 1 or recover(spark, base, 0):
        raise AssertionError("a rejected publication left something behind")
    return long_tables(read_snapshot(spark, base))


def load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the first year of the municipal population, append the others,
    one by one; a colliding row, a NULL key and an unknown municipality are
    rejected. The table as read afterwards."""
    star = star_for(spark, sf_dir)
    name, facts = "fato_populacao_municipio", star.fato_populacao_municipio
    years = sorted(r.ano for r in facts.select("ano").distinct().collect())  # one per year
    base = scratch_path(spark, "appended")
    write_snapshot({"dim_municipio": star.dim_municipio, name: facts.where(F.col("ano") == years[0])}, base, source="star")
    parent = read_snapshot(spark, base, ["dim_municipio"])
    enforced = quality.enforce(TPCH_WAIVED)
    check = lambda s, t: enforced(s, {**parent, **t})
    for year in years[1:]:
        append_rows(facts.where(F.col("ano") == year), base, name, validate=check)
    late = facts.where(F.col("ano") == years[-1])
    _rejected(lambda: append_rows(late.where("municipio_id like '%7'"), base, name))
    _rejected(lambda: append_rows(late.withColumn("ano", F.lit(None).cast("int")), base, name))
    _rejected(lambda: append_rows(late.withColumn("municipio_id", F.concat(F.lit("9"), F.substring("municipio_id", 2, 6))), base, name, validate=check))
    m = manifest(spark, base)
    if len(m["tables"][name]["segments"]) != len(years) or recover(spark, base, 0):
        raise AssertionError("a rejected append left something behind")
    return read_snapshot(spark, base, [name])[name]


def load_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest load of every table of the warehouse, all columns of the
    log; those that differ from run to run as whether they are as they must be."""
    log = latest_loads(load_log(spark, base_for(spark, sf_dir)))
    inputs = F.array_join(F.transform(F.split("origem", ", "), lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.parquet$", "")), ", ")
    panel = F.col("tabela").startswith("mv_")
    return log.select(
        "tabela",
        inputs.alias("origem"),
        "linhas",
        (F.col("id") > 0).alias("com_id"),
        F.col("carga_id").isNotNull().alias("com_carga"),
        F.when(panel, F.col("bytes_origem").isNull()).otherwise(F.col("bytes_origem") > 0).alias("bytes_origem_ok"),
        (F.col("bytes") > 0).alias("bytes_ok"),
        (F.col("iniciado_em") <= F.current_timestamp()).alias("iniciado_ok"),
        (F.col("duracao_ms") >= 0).alias("duracao_ok"),
        (F.length("executado_por") > 0).alias("usuario_ok"),
    )


def catalog_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, views and materialised panels with rows, columns and whether
    the size that was found equals the one logged when they were written."""
    star, base = star_for(spark, sf_dir), base_for(spark, sf_dir)
    m = manifest(spark, base)
    tables = {**star.tables(), **{n: getattr(star, n) for n in m["tables"] if n.startswith("mv_")}}
    views = {"vw_municipio": panels.hierarchy(star), "vw_painel_regiao": panels.region_panel(star)}
    paths = {n: [s["path"] for s in t["segments"]] for n, t in m["tables"].items()}
    logged = spark.createDataFrame([(n, sum(s["bytes"] for s in t["segments"])) for n, t in m["tables"].items()], "objeto string, logged long")
    found = inventory({**tables, **views}, paths=paths)
    return found.join(logged, "objeto", "left").select("objeto", "tipo", "linhas", "colunas", F.col("bytes").eqNullSafe(F.col("logged")).alias("tamanho_ok"), F.coalesce(F.col("bytes") > 0, F.lit(False)).alias("com_tamanho"))


# --------------------------------------------------------------------------
# Refresh
# --------------------------------------------------------------------------


def _second_refresh(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A warehouse of its own whose first refresh lacks the first year of a
    third of the municipalities; the rows are appended and the panels
    refreshed again. Its base, and the version before the second refresh."""
    star = star_for(spark, sf_dir)
    facts = star.fato_populacao_municipio
    first = facts.select(F.min("ano")).scalar()
    late = (F.col("ano") == first) & (F.col("municipio_id").cast("long") % 3 == 0)
    base = scratch_path(spark, "refreshed")
    buckets = choose_buckets(star.fato_pib_municipio)
    begin = Star(**{**star.tables(), "fato_populacao_municipio": facts.where(~late)})
    write_snapshot(begin.tables(), base, source="star", bucket_by=MUNICIPAL_BUCKETS, partition_by=YEAR_PARTITIONS, buckets=buckets)
    refresh_panels(spark, base, BANDS, buckets=buckets)
    append_rows(checkpoint(facts.where(late), "late-rows"), base, "fato_populacao_municipio")
    before = manifest(spark, base)["version"]
    refresh_panels(spark, base, BANDS, buckets=buckets)
    return base, before


def panel_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The municipal panel as a reader of the version before the second
    refresh still has it, and as it is after."""
    base, before = _second_refresh(spark, sf_dir)
    name = "mv_painel_municipio"
    old = read_snapshot(spark, base, [name], version=before)[name].withColumn("momento", F.lit("antes"))
    new = read_snapshot(spark, base, [name])[name].withColumn("momento", F.lit("depois"))
    return old.unionByName(new)


def concentration_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concentration panel after the second refresh: built from the new
    municipal panel, not from the one it replaced."""
    base, _ = _second_refresh(spark, sf_dir)
    return read_snapshot(spark, base, ["mv_concentracao_municipio"])["mv_concentracao_municipio"]


def refresh_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column counts of the municipal panel, as observed by its refresh."""
    star_for(spark, sf_dir)
    return panel_statistics(spark, base_for(spark, sf_dir))


# --------------------------------------------------------------------------
# Feed to star
# --------------------------------------------------------------------------


def _payload(df: DataFrame, dataset: str, key: str | None, name: str | None, level: tuple[str, str], variable: int, column: str) -> DataFrame:
    """One payload text per place: a variable with the place's series (one
    entry per year), missing values as the feed's sentinel."""
    id_ = F.col(key).cast("string") if key else F.lit("1")
    nome = F.col(name) if name else F.lit("Brasil")
    value = F.coalesce(F.col(column).cast("string"), F.lit("..."))
    g = df.groupBy(id_.alias("id"), nome.alias("nome")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("ano").cast("string"), value))).alias("serie"))
    place = F.struct("id", F.struct(F.lit(level[0]).alias("id"), F.lit(level[1]).alias("nome")).alias("nivel"), "nome")
    item = F.struct(
        F.lit(str(variable)).alias("id"), F.lit(column).alias("variavel"), F.lit("u").alias("unidade"),
        F.array(F.struct(F.array().cast("array<string>").alias("classificacoes"), F.array(F.struct(place.alias("localidade"), "serie")).alias("series"))).alias("resultados"),
    )
    return g.select(F.lit(dataset).alias("conjunto"), F.to_json(F.array(item)).alias("payload"))


LEVELS = {"N6": ("N6", "Município"), "N3": ("N3", "Unidade da Federação"), "N2": ("N2", "Grande Região"), "N1": ("N1", "Brasil")}


def feed_payloads(star: Star) -> DataFrame:
    """The payloads of every dataset, level and variable that the star's
    facts would have come from."""
    facts = {**star.tables(), **star.upper_facts()}
    names = {
        "N6": ("municipio_id", "municipio_nome", star.dim_municipio.select("municipio_id", "municipio_nome")),
        "N3": ("uf_id", "uf_nome", star.dim_uf.select("uf_id", "uf_nome")),
        "N2": ("regiao_id", "regiao_nome", star.dim_regiao.select("regiao_id", "regiao_nome")),
    }
    out = None
    for raw, (dataset, level, source) in feed_etl.SERIES_SOURCES.items():
        df = facts[source.table]
        key, name = None, None
        if level in names:
            key, name, dim = names[level]
            df = df.join(dim, key)
        for variable, column in registry.DATASETS[dataset]["variables"].items():
            p = _payload(df, dataset, key, name, LEVELS[level], variable, column)
            out = p if out is None else out.unionByName(p)
    return out


def feed_hierarchy(star: Star) -> DataFrame:
    """One hierarchy document per municipality of the star."""
    m = panels.hierarchy(star)
    struct = lambda **cols: F.struct(*(c.alias(n) for n, c in cols.items()))
    id_ = lambda c: F.col(c).cast("long")
    region = struct(id=id_("regiao_id"), sigla=F.col("regiao_sigla"), nome=F.col("regiao_nome"))
    uf = struct(id=id_("uf_id"), sigla=F.col("uf_sigla"), nome=F.col("uf_nome"), regiao=region)
    meso = struct(id=id_("mesorregiao_id"), nome=F.col("mesorregiao_nome"), UF=uf)
    micro = struct(id=id_("microrregiao_id"), nome=F.col("microrregiao_nome"), mesorregiao=meso)
    return m.select(F.to_json(struct(id=id_("municipio_id"), nome=F.col("municipio_nome"), microrregiao=micro)).alias("doc"))


def feed_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen tables, built from payloads and hierarchy documents. The
    GDP is delivered wrong first (every value a sentinel), then right."""
    star = star_for(spark, sf_dir)
    payloads = checkpoint(feed_payloads(star), "payloads")
    docs = checkpoint(feed_hierarchy(star), "hierarchy")
    wrong = payloads.where("conjunto = 'pib'").withColumn("payload", F.regexp_replace("payload", r'"([0-9]{4})":"[^"]*"', '"$1":"X"'))
    base = feed_etl.run(spark, [payloads.where("conjunto <> 'pib'"), wrong, payloads.where("conjunto = 'pib'")], docs, first_municipal_year=FEED_WINDOW, buckets=choose_buckets(star.fato_pib_municipio), validate=quality.enforce(TPCH_WAIVED))
    m = manifest(spark, base)
    return long_tables(read_snapshot(spark, base, list(m["tables"])))


# --------------------------------------------------------------------------
# Enrichment and rules
# --------------------------------------------------------------------------


def _raw_population(star: Star) -> DataFrame:
    """Municipal population as the feed delivers it, with the first year once
    more under ids that no municipality has."""
    f = star.fato_populacao_municipio
    strange = f.where(F.col("ano") == f.select(F.min("ano")).scalar()).withColumn("municipio_id", F.concat(F.lit("9"), F.substring("municipio_id", 2, 6)))
    both = f.unionByName(strange)
    return both.select(F.col("municipio_id").cast("long").alias("localidade_id"), F.lit("x").alias("localidade_nome"), F.lit("N6").alias("nivel"), "ano", "populacao")


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = star_for(spark, sf_dir)
    return enrich_municipalities(_raw_population(star), panels.hierarchy(star))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_count(enrich(spark, sf_dir))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The violating rows of the star, with the rule that each breaks."""
    return quality.quarantine(star_for(spark, sf_dir).tables()).select("tabela", "regra", "chave")


def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipalities without GDP; those of one segment are on the allow-list."""
    star = star_for(spark, sf_dir)
    known = star.dim_municipio.where(F.col("mesorregiao_nome") == "BUILDING").select("municipio_id")
    return quality.coverage_gap(star.mv_painel_municipio, known)


QUERIES = {
    "load_snapshot": load_snapshot,
    "load_append": load_append,
    "load_lineage": load_lineage,
    "src_catalog_inventory": catalog_inventory,
    "panel_refresh": panel_refresh,
    "mv_concentration_refresh": concentration_refresh,
    "panel_statistics": refresh_statistics,
    "feed_star": feed_star,
    "join_enrich_municipality": enrich,
    "join_orphan_count": orphans,
    "constraint_quarantine": quarantined,
    "coverage_gap": coverage_gap,
}

__all__ = ["QUERIES", "DIM_TABLES", "FACT_TABLES", "feed_hierarchy", "feed_payloads", "long_rows", "long_tables"]
