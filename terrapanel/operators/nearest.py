"""Nearest-period matching (as-of-like join on an integer year).

Two modes, because the two computations of the original disagree:

* per entity (default): for each entity, the non-null observation whose year
  is closest to the target, ties → earlier year. One ``groupBy`` with a
  ``min_by`` on ``(distance, year)`` — a single shuffle, partial aggregation
  map-side, groups bounded by the number of years;
* global: one year for everybody — the published year closest to the target
  (ties → earlier), then a plain equi-filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_year_per_key(
    df: DataFrame, key: str, target, value: str = "populacao", year: str = "ano",
    *, year_alias: str = "ano_proximo", value_alias: str | None = None,
) -> DataFrame:
    """``key, year_alias, value_alias`` — the nearest non-null observation."""
    t = target if isinstance(target, Column) else F.lit(target)
    y = F.col(year)
    # distance, then year, in one number: of fixed width, so groups are hashed, not sorted
    distance = F.coalesce(F.abs(y - t).cast("long"), F.lit(-1))
    order = distance * F.lit(1 << 32) + F.coalesce(y.cast("long"), F.lit(-(1 << 31)))
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(key)
        .agg(F.min_by(y, order).alias(year_alias), F.min_by(F.col(value), order).alias(value_alias or value))
    )


def nearest_published_year(df: DataFrame, target, year: str = "ano") -> Column:
    """Scalar subquery: the published year closest to ``target`` (ties → earlier)."""
    t = target if isinstance(target, Column) else F.lit(target)
    y = F.col(year)
    return df.select(y).distinct().select(F.min_by(y, F.struct(F.abs(y - t), y))).scalar()


def nearest_year_global(
    df: DataFrame, key: str, target, value: str = "populacao", year: str = "ano",
    *, year_alias: str = "ano_proximo", value_alias: str | None = None,
) -> DataFrame:
    chosen = nearest_published_year(df, target, year)
    return df.filter(F.col(year) == chosen).select(
        key, F.col(year).alias(year_alias), F.col(value).alias(value_alias or value)
    )
