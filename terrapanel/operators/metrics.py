"""Enrichment joins and the derived metrics of the processed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import as_double, pad_id, safe_denominator, sum_skipping_nulls
from ..sources.star import SECTOR_COLUMNS


def unique_dimension(dim: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``dim`` with one row per key; the plan itself fails, with the key in
    the message, on a key that repeats. The check rides on the aggregation by
    key that the join needs anyway: no job of its own."""
    cols = [c for c in cols or dim.columns if c != key]
    one = dim.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(F.struct(*cols)).alias("_row"))
    message = F.concat(F.lit(f"dimension key '{key}' is not unique: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(message).cast(one.schema["_row"].dataType))
    return one.select(key, checked.alias("_row")).select(key, "_row.*")


def _enrich(facts: DataFrame, dim: DataFrame, key: str, key_of: Column, observation: Observation | None) -> DataFrame:
    f = facts.withColumn(key, key_of).drop("localidade_id", "localidade_nome", "nivel")
    known = unique_dimension(dim, key).withColumn("_known", F.lit(True))
    out = f.join(known, key, "left").withColumn("orfao", F.col("_known").isNull()).drop("_known")
    return out.observe(observation, F.count_if("orfao").alias("orfaos"), F.count("*").alias("linhas")) if observation else out


def enrich_municipalities(facts: DataFrame, dim: DataFrame, *, observation: Observation | None = None) -> DataFrame:
    """Municipal facts keyed by a raw ``localidade_id`` → LEFT JOIN the
    municipality dimension on the normalised (zero-padded string) id. The
    feed's own name/level columns are dropped; ``orfao`` flags rows without
    a dimension match. The join is many-to-one: a dimension key that repeats
    fails the plan. ``observation`` receives the number of orphans
    (``orfaos``) and rows (``linhas``) when the result is computed."""
    return _enrich(facts, dim.withColumn("municipio_id", pad_id(F.col("municipio_id"))), "municipio_id", pad_id(F.col("localidade_id")), observation)


def enrich_ufs(facts: DataFrame, dim_uf: DataFrame, *, observation: Observation | None = None) -> DataFrame:
    """The same for state facts; ids are integers."""
    return _enrich(facts, dim_uf, "uf_id", F.col("localidade_id").cast("int"), observation)


def orphan_count(enriched: DataFrame) -> DataFrame:
    """Rows without a dimension match, and all rows."""
    return enriched.agg(F.count_if("orfao").alias("orfaos"), F.count("*").alias("linhas"))


def density(df: DataFrame, area: str = "area_km2") -> DataFrame:
    """``densidade_calculada`` = census population (else population) / area,
    with zero and negative areas masked to NULL."""
    pop = "populacao_censo" if "populacao_censo" in df.columns else "populacao"
    return df.withColumn("densidade_calculada", as_double(pop) / as_double(safe_denominator(F.col(area))))


def gdp_per_capita(df: DataFrame) -> DataFrame:
    """GDP (thousands) × 1000 / population (census population if present)."""
    pop = "populacao_censo" if "populacao_censo" in df.columns else "populacao"
    return df.withColumn(
        "pib_per_capita", as_double("pib_mil_reais") * F.lit(1000.0) / as_double(safe_denominator(F.col(pop)))
    )


def sector_structure(df: DataFrame) -> DataFrame:
    """``vab_total`` (NULL parts skipped, all-NULL → NULL) and each sector's
    share of it in percentage points (NULL when the total is not positive)."""
    present = [c for c in SECTOR_COLUMNS if c in df.columns]
    if not present:
        return df
    out = df.withColumn("vab_total", sum_skipping_nulls(present))
    for c in present:
        out = out.withColumn(
            f"part_{c}", as_double(c) / as_double(safe_denominator(F.col("vab_total"))) * F.lit(100.0)
        )
    return out
