"""From series payloads and hierarchy documents to the published star.

1. **Landing**: payload texts are flattened and land in one long table,
   partitioned by (dataset, level, variable, year). A delivery holds whole
   variable-years, as the feed's batches do; it overwrites the partitions it
   has rows for and no others (dynamic partition overwrite), so delivering
   something again, corrected or not, leaves one copy of it.
2. **Raw tables**: each of the eleven series tables is the landed long table,
   restricted to its dataset and level (partition pruning), with the municipal
   year window, pivoted to the dataset's canonical columns; the three
   dimensions come from the hierarchy documents. All fourteen are written.
3. **Star**: every raw table is prepared (level key, integer columns, missing
   columns named) and published in one validated step with its lineage.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..session import scratch_path
from ..sinks.loads import Source, prepare, write_parquet
from ..sinks.snapshot import MUNICIPAL_BUCKETS, YEAR_PARTITIONS, write_snapshot
from ..sources import feeds
from ..sources.tables import read_table

#: Partitions of the landed table.
LANDED_BY = ("conjunto", "nivel", "variavel_id", "ano")

#: Suffix of the raw tables of every level.
LEVEL_NAMES = {"N6": "municipios", "N3": "ufs", "N2": "regioes", "N1": "brasil"}
LEVEL_KEYS = {"N6": "municipio_id", "N3": "uf_id", "N2": "regiao_id", "N1": ""}
_LEVEL_TABLES = {"N6": "municipio", "N3": "uf", "N2": "regiao", "N1": "brasil"}

_MONEY = "decimal(38,4)"
_AREA = "decimal(38,3)"


def _series_sources() -> dict[str, tuple[str, str, Source]]:
    """Raw table → (dataset, level, how it is loaded)."""
    out = {}
    for dataset, spec in registry.DATASETS.items():
        for level in spec["levels"]:
            raw = f"{spec['raw']}_{LEVEL_NAMES[level]}"
            columns = ["ano", *spec["variables"].values()]
            integers = [c for c in columns if c in ("ano", "populacao", "populacao_censo")]
            out[raw] = dataset, level, Source(f"{raw}.parquet", f"fato_{spec['fact']}_{_LEVEL_TABLES[level]}", LEVEL_KEYS[level], columns, integers)
    return out


SERIES_SOURCES = _series_sources()
DIM_SOURCES = {
    "dim_regioes": Source("dim_regioes.parquet", "dim_regiao", "regiao_id", ["regiao_id", "regiao_sigla", "regiao_nome"], []),
    "dim_estados": Source("dim_estados.parquet", "dim_uf", "uf_id", ["uf_id", "uf_sigla", "uf_nome", "regiao_id"], ["regiao_id"]),
    "dim_municipios": Source(
        "dim_municipios.parquet", "dim_municipio", "municipio_id",
        ["municipio_id", "municipio_nome", "microrregiao_id", "microrregiao_nome", "mesorregiao_id", "mesorregiao_nome", "uf_id"],
        ["microrregiao_id", "mesorregiao_id", "uf_id"],
    ),
}
RAW_TABLES = (*DIM_SOURCES, *SERIES_SOURCES)

#: Column types of the star where they differ from the raw ones.
_TYPES = {
    **{c: "int" for c in ("ano", "microrregiao_id", "mesorregiao_id", "uf_id", "regiao_id")},
    **{c: _MONEY for c in registry.DATASETS["pib"]["variables"].values()},
    "area_km2": _AREA,
}


# --------------------------------------------------------------------------
# Landing
# --------------------------------------------------------------------------


def land(payloads: DataFrame, target: str, *, dataset_col: str = "conjunto", payload_col: str = "payload") -> None:
    """Land a delivery (one payload text per row, with its dataset).

    Observations that the delivery itself repeats are settled first. The
    partitions with rows in the delivery are replaced, all others stay."""
    variables = payloads.select(F.col(dataset_col).alias("conjunto"), F.explode(F.from_json(F.col(payload_col), feeds.PAYLOAD)).alias("v")).select("conjunto", "v.*")
    tidy = feeds.flatten_variables(variables, keep=["conjunto"])
    key = ["conjunto", "nivel", "localidade_id", "ano", "variavel_id"]
    rest = [c for c in tidy.columns if c not in key]
    once = tidy.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    # rows of a folder are brought together, and a large one is split again by its run-time size
    dealt = once.hint("rebalance", *LANDED_BY)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LANDED_BY).parquet(target)


def landed(spark: SparkSession, target: str) -> DataFrame:
    schema = "localidade_id string, localidade_nome string, variavel_nome string, unidade string, valor double, conjunto string, nivel string, variavel_id int, ano int"
    return spark.read.schema(schema).parquet(target)


# --------------------------------------------------------------------------
# Raw tables
# --------------------------------------------------------------------------


def series_table(long: DataFrame, raw: str, *, first_municipal_year: int | None = None) -> DataFrame:
    """One wide raw table from the landed long one. The window holds for the
    municipal level of datasets that ask for it."""
    dataset, level, _ = SERIES_SOURCES[raw]
    spec = registry.DATASETS[dataset]
    rows = long.where((F.col("conjunto") == dataset) & (F.col("nivel") == level) & F.col("variavel_id").isin(list(spec["variables"])))
    first = spec["first_municipal_year"] if first_municipal_year is None else first_municipal_year
    if spec["first_municipal_year"] is not None:
        rows = feeds.window_years(rows, first_year=first)
    return feeds.series_wide(rows, spec["variables"])


def hierarchy_tables(docs: DataFrame, text_col: str = "doc") -> dict[str, DataFrame]:
    """The three dimensions from the municipalities' hierarchy documents."""
    flat = feeds.flatten_municipalities_text(docs, text_col)
    uf, region = ["uf_id", "uf_sigla", "uf_nome"], ["regiao_id", "regiao_sigla", "regiao_nome"]
    return {"dim_municipios": flat, "dim_estados": flat.select(*uf, *region).distinct(), "dim_regioes": flat.select(*region).distinct()}


def write_raw(spark: SparkSession, long: DataFrame, docs: DataFrame, folder: str, *, first_municipal_year: int | None = None) -> list[str]:
    """Write the fourteen raw tables; their paths."""
    tables = hierarchy_tables(docs) | {raw: series_table(long, raw, first_municipal_year=first_municipal_year) for raw in SERIES_SOURCES}
    paths = {name: f"{folder}/{name}.parquet" for name in tables}
    with ThreadPoolExecutor(max_workers=4) as pool:  # independent jobs, side by side
        list(pool.map(lambda name: write_parquet(tables[name], paths[name]), tables))
    return list(paths.values())


# --------------------------------------------------------------------------
# Star
# --------------------------------------------------------------------------


def load_star(spark: SparkSession, folder: str, base: str, *, buckets: int | None = None, validate=None) -> str:
    """Prepare all raw tables under ``folder`` and publish them as one
    snapshot under ``base``. All are read before anything is written, so a
    missing table or column fails with the base untouched."""
    tables, origins = {}, {}
    for raw, source in {**DIM_SOURCES, **{r: s for r, (_, _, s) in SERIES_SOURCES.items()}}.items():
        df = prepare(read_table(spark, folder, raw), source)
        tables[source.table] = df.select(*(F.col(c).cast(_TYPES[c]).alias(c) if c in _TYPES else F.col(c) for c in df.columns))
        origins[source.table] = [f"{folder}/{raw}.parquet"]
    return write_snapshot(tables, base, source=folder, origins=origins, bucket_by=MUNICIPAL_BUCKETS, partition_by=YEAR_PARTITIONS, buckets=buckets, validate=validate)


def run(spark: SparkSession, deliveries: list[DataFrame], docs: DataFrame, *, base: str | None = None, first_municipal_year: int | None = None, buckets: int | None = None, validate=None) -> str:
    """Land the deliveries in order, write the raw tables, publish the star.
    Returns the base that holds it."""
    target, folder, base = scratch_path(spark, "landed"), scratch_path(spark, "raw"), base or scratch_path(spark, "feed-star")
    for delivery in deliveries:
        land(delivery, target)
    write_raw(spark, landed(spark, target), docs, folder, first_municipal_year=first_municipal_year)
    load_star(spark, folder, base, buckets=buckets, validate=validate)
    return base
