"""The ETL entry point: derive the star, publish it (validated) under a base
folder, build the materialised panels on top, and hand out DataFrames that
read the published tables.

Writing the star cuts the lineage of the heavy ``lineitem ⋈ part ⋈ orders``
derivation: every panel and query reads the written tables, and a lost
executor re-reads files instead of recomputing the derivation.

Panels are tables of the same base. Each one's part of the manifest tells the
segments of its inputs that it was built from, so a refresh knows which panels
are stale, and of the municipal panel which municipalities: those in segments
that were appended since, as long as the reference years stand.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, input_bytes, max_buckets, pieces, scratch_path
from .. import registry
from ..operators.quality import AREA_RULE, PREFIX_RULE, enforce
from ..registry import Bands
from ..sinks.snapshot import column_counts, manifest, read_segments, read_snapshot, write_snapshot, write_star
from . import panels
from ..sources.star import DIM_TABLES, FACT_TABLES, Star
from ..sources.tpch import derive_star, origins

_STARS: dict[tuple[str, str], tuple[Star, str]] = {}
_FACTS: dict[tuple[str, str], tuple[Star, str, int]] = {}
_LOCK = threading.Lock()

#: Inputs of every materialised panel; a panel stands after those it reads.
PANEL_INPUTS = {
    "mv_painel_municipio": ("dim_regiao", "dim_uf", "dim_municipio", "fato_populacao_municipio", "fato_censo_municipio", "fato_pib_municipio"),
    "mv_painel_uf": ("dim_regiao", "dim_uf", "fato_populacao_uf", "fato_censo_uf", "fato_pib_uf"),
    "mv_concentracao_municipio": ("mv_painel_municipio",),
    "mv_ranking_municipio": ("mv_painel_municipio",),
}
PANEL_TABLES = tuple(PANEL_INPUTS)
_PANEL_BUCKETS = {"mv_painel_municipio": ["municipio_id"], "mv_ranking_municipio": ["municipio_id"]}

#: Rules that the TPC-H tables break by their nature: areas of zero, codes
#: without the state in front.
TPCH_WAIVED = (AREA_RULE, PREFIX_RULE)


def _built_from(m: dict, name: str) -> dict[str, list[str]]:
    """Segments of the panel's base tables; a panel that it reads makes it
    stale when it is built anew."""
    return {i: [s["path"] for s in m["tables"][i]["segments"]] for i in PANEL_INPUTS[name] if i not in PANEL_INPUTS}


def stale_panels(m: dict, bands: Bands) -> list[str]:
    """Panels to be built anew for manifest ``m``, in the order to build."""
    out: list[str] = []
    for name in PANEL_INPUTS:
        have = m["tables"].get(name)
        fresh = have and have["built_from"] == _built_from(m, name) and have["bands"] == repr(bands)
        if not fresh or any(i in out for i in PANEL_INPUTS[name]):
            out.append(name)
    return out


def reference_years(star: Star) -> list[int | None]:
    """The years that the municipal panel looks at: latest population, GDP,
    GDP with value added, census."""
    pib = star.fato_pib_municipio
    newest = lambda df: df.agg(F.max("ano").alias("y"))
    parts = [newest(star.fato_populacao_municipio), newest(pib), newest(pib.where(F.col("vab_industria").isNotNull())), newest(star.fato_censo_municipio)]
    tagged = [p.select(F.lit(i).alias("i"), "y") for i, p in enumerate(parts)]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
    return [r.y for r in sorted(rows.collect())]  # four rows


def touched_municipalities(spark: SparkSession, m: dict, years: list[int | None]) -> DataFrame | None:
    """Ids of the municipalities whose panel rows may differ from the stored
    ones: those in fact segments appended since the panel was built. None
    means all: another input changed, a segment went, or a reference year
    moved."""
    have = m["tables"].get("mv_painel_municipio")
    if not have or have["years"] != years:
        return None
    ids = None
    for name, paths in have["built_from"].items():
        segments = m["tables"][name]["segments"]
        added = [s for s in segments if s["path"] not in paths]
        if not added:
            if len(segments) != len(paths):
                return None
            continue
        if len(segments) - len(added) != len(paths) or not name.startswith("fato_"):
            return None
        own = read_segments(spark, added).select("municipio_id")
        ids = own if ids is None else ids.unionByName(own)
    return None if ids is None else ids.distinct()


def refresh_panels(spark: SparkSession, base: str, bands: Bands = registry.REAL_BANDS, buckets: int | None = None) -> Star:
    """Bring the panels of ``base`` up to date in one publication and return
    the star with them. Readers of the version before keep their rows.

    Only stale panels are built, inputs first. Of the municipal panel only the
    touched municipalities are computed; the others' rows are taken over.
    Column counts of the new panels are observed while they are written
    (``panel_statistics``), so a check of all-null columns reads the new state.
    """
    m = manifest(spark, base)
    star = Star(**read_snapshot(spark, base, (*DIM_TABLES, *FACT_TABLES), version=m["version"]))
    todo = stale_panels(m, bands)
    if todo:
        years = reference_years(star) if "mv_painel_municipio" in todo else None

        def municipal() -> DataFrame:
            same_bands = m["tables"].get("mv_painel_municipio", {}).get("bands") == repr(bands)
            ids = touched_municipalities(spark, m, years) if same_bands else None
            if ids is None:
                return panels.municipality_panel(star, bands, live=True)
            ids = checkpoint(ids, "touched")
            kept = read_segments(spark, m["tables"]["mv_painel_municipio"]["segments"]).join(ids, "municipio_id", "left_anti")
            return kept.unionByName(panels.municipality_panel(star, bands, live=True, only=ids))

        def stored(written: dict, name: str) -> DataFrame:
            return written[name] if name in written else read_segments(spark, m["tables"][name]["segments"])

        build = {
            "mv_painel_municipio": municipal,
            "mv_painel_uf": lambda: panels.uf_panel(star, live=True),
            "mv_concentracao_municipio": lambda: lambda w: panels.concentration_table(stored(w, "mv_painel_municipio")),
            "mv_ranking_municipio": lambda: lambda w: panels.ranking_view(stored(w, "mv_painel_municipio")),
        }

        def extra(name: str) -> dict:
            return {"built_from": _built_from(m, name), "bands": repr(bands), "years": years}

        write_snapshot({n: build[n]() for n in todo}, base, source="star", bucket_by=_PANEL_BUCKETS, buckets=buckets, extra=extra)
    mv = read_snapshot(spark, base, PANEL_TABLES)
    return Star(**star.tables(), **mv, panel_bands=bands)


def panel_statistics(spark: SparkSession, base: str, panel: str = "mv_painel_municipio") -> DataFrame:
    """(``coluna``, ``nao_nulos``, ``linhas``) of a panel, as of its refresh."""
    return column_counts(spark, base, panel)


#: Bytes of a municipal fact per bucket: at least, and at most once there are many.
MIN_BUCKET_BYTES = 8 << 20
BUCKET_BYTES = 128 * 1024 * 1024


def choose_buckets(df: DataFrame) -> int:
    """One bucket (a task of every co-located join) for ``MIN_BUCKET_BYTES``
    of the staged table that the facts are made of, which is far smaller than
    the inputs (some hundred thousand rows a bucket); many buckets grow to
    ``BUCKET_BYTES``. As many as the session allows at most."""
    return min(pieces(input_bytes(df), MIN_BUCKET_BYTES, BUCKET_BYTES), max_buckets(df.sparkSession))


def publish(spark: SparkSession, sf_dir: str, base: str, buckets: int | None = None) -> int:
    """Derive, validate and publish the dimensions and facts of ``sf_dir``
    under ``base``, without the panels. Returns the bucket count."""
    star = derive_star(spark, sf_dir, stage=checkpoint)
    n = buckets or choose_buckets(star.fato_populacao_municipio)
    write_star(star, base, source=sf_dir, origins=origins(sf_dir), buckets=n, validate=enforce(TPCH_WAIVED))
    return n


def build(spark: SparkSession, sf_dir: str, base: str | None = None, bands: Bands = registry.TPCH_BANDS,
          buckets: int | None = None) -> Star:
    """Run the ETL for ``sf_dir``: derive, validate and publish the star, then
    build the materialised panels. Returns the star reading the written
    tables."""
    base = base or scratch_path(spark, "star")
    return refresh_panels(spark, base, bands, buckets=publish(spark, sf_dir, base, buckets))


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir


def _published(spark: SparkSession, sf_dir: str) -> tuple[Star, str, int]:
    """(star without panels, base, buckets) of ``sf_dir``; under the lock."""
    key = _key(spark, sf_dir)
    if key not in _FACTS:
        base = scratch_path(spark, "star")
        n = publish(spark, sf_dir, base)
        _FACTS[key] = (Star(**read_snapshot(spark, base)), base, n)
    return _FACTS[key]


def facts_for(spark: SparkSession, sf_dir: str) -> Star:
    """The dimensions and facts of ``sf_dir`` for this application (published
    once, the same tables that ``star_for`` reads): for what reads no panel,
    so that none is built for it."""
    with _LOCK:
        return _published(spark, sf_dir)[0]


def star_for(spark: SparkSession, sf_dir: str) -> Star:
    """The materialised star of ``sf_dir`` for this application (built once)."""
    key = _key(spark, sf_dir)
    with _LOCK:  # concurrent callers share one ETL run
        if key not in _STARS:
            _, base, n = _published(spark, sf_dir)
            _STARS[key] = (refresh_panels(spark, base, registry.TPCH_BANDS, buckets=n), base)
    return _STARS[key][0]


def base_for(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the star's snapshots and load log."""
    star_for(spark, sf_dir)
    return _STARS[_key(spark, sf_dir)][1]


def register_views(star: Star, bands: Bands = registry.REAL_BANDS) -> list[str]:
    """Expose the star and its views/panels to SQL under their usual names
    (session temp views): ``spark.sql("SELECT … FROM mv_painel_municipio")``."""
    views = dict(star.tables())
    views.update(
        {
            "vw_municipio": panels.hierarchy(star),
            "vw_anos_disponiveis": panels.available_years(star),
            "vw_populacao_municipio": panels.population_view(star),
            "vw_crescimento_municipio": panels.growth_view(star, bands),
            "mv_painel_municipio": panels.municipality_panel(star, bands),
            "mv_concentracao_municipio": panels.concentration_for(star, bands),
            "vw_painel_uf": panels.uf_panel(star),
            "vw_painel_regiao": panels.region_panel(star, registry.REGION_ORDER),
            "vw_ranking_municipio": panels.ranking_for(star, bands),
        }
    )
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
