"""Reading named Parquet tables and the table inventory."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingTableError(FileNotFoundError):
    """A named table is not where it should be; the message says how to fix it."""


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of ``<base>/<name>.parquet`` with an actionable error."""
    path = table_path(base, name)
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:  # path does not exist / unreadable
        raise MissingTableError(
            f"table '{name}' not found at {path}: run the ETL (terrapanel.plans.warehouse.build) "
            f"or point the reader at the folder that holds it"
        ) from exc


def tables_available(spark: SparkSession, base: str, names) -> bool:
    try:
        for n in names:
            read_table(spark, base, n)
        return True
    except MissingTableError:
        return False


def _kind(name: str) -> str:
    return "materializada" if name.startswith("mv_") else "view" if name.startswith("vw_") else "tabela"


def inventory(tables: dict[str, DataFrame], paths: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per object: ``objeto``, ``tipo`` (tabela, view, materializada),
    ``linhas``, ``colunas``, ``bytes`` of its files (NULL for a view).

    Rows are counted from the Parquet footers, sizes from the file listing
    (``binaryFile`` without the content column reads no file); both are
    distributed aggregates, and only the final small table is assembled.
    """
    paths = paths or {}
    parts = []
    for name, df in tables.items():
        own = paths.get(name)
        rows = df.agg(F.count(F.lit(1)).alias("linhas"))
        if own:
            spark = df.sparkSession
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(list(own))
            size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        else:
            size = rows.select(F.lit(None).cast("long").alias("bytes"))
        parts.append(rows.crossJoin(size).select(F.lit(name).alias("objeto"), F.lit(_kind(name)).alias("tipo"), "linhas", F.lit(len(df.columns)).alias("colunas"), "bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
