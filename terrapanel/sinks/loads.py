"""Preparing raw tables for the load, and the output sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pad_id


class MissingColumnsError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """One raw table to load: file name, target table, level key, columns
    to keep, and which of them are integers."""

    file: str
    table: str
    key: str  # "municipio_id" (7-char string) | "uf_id" | "regiao_id" | "" (national)
    columns: Sequence[str]
    integers: Sequence[str] = ()


def prepare(df: DataFrame, source: Source) -> DataFrame:
    """Derive the level key from ``localidade_id`` (municipality → zero-padded
    7-char string, other levels → int), check the columns (error names the
    file), project, and round integer columns half-even before the cast
    (NULLs kept, text that is no number becomes NULL). A table without
    ``localidade_id`` brings its level key itself, as the dimensions do."""
    origin = "localidade_id" if "localidade_id" in df.columns or not source.key else source.key
    missing = [c for c in ([origin] if source.key else []) + list(source.columns) if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{source.file}: missing columns {missing}")
    if source.key == "municipio_id":
        key = [pad_id(F.col(origin)).alias("municipio_id")]
    elif source.key:
        key = [F.trim(F.col(origin).cast("string")).try_cast("int").alias(source.key)]
    else:
        key = []
    cols = [
        F.bround(F.col(c).try_cast("double")).try_cast("long").alias(c) if c in source.integers else F.col(c)
        for c in source.columns
        if c != source.key
    ]
    return df.select(*key, *cols)


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Query result as UTF-8 CSV with a header (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_features(features: DataFrame, path: str) -> None:
    """Persist a mesh (rows of ``operators.geo``) as GeoJSON, one
    FeatureCollection with one feature per line; ``operators.geo.read_features``
    reads it back with ``lines=True``."""
    polygon = F.col("geom_type") == F.lit("Polygon")
    coordinates = F.when(polygon, F.to_json(F.col("coordinates")[0])).otherwise(F.to_json("coordinates"))
    geometry = F.concat(F.lit('{"type":'), F.to_json(F.array("geom_type")).substr(F.lit(2), F.length("geom_type") + 2), F.lit(',"coordinates":'), coordinates, F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("codarea")), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))
    features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))).write.mode("overwrite").text(path)
