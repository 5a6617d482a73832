"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.session import checkpoint, scratch_path

#: Largest stored table, in bytes, that is ever marked for broadcast.
BROADCAST_LIMIT_BYTES = 48 << 20

__all__ = ["BROADCAST_LIMIT_BYTES", "ascii_lower", "bind", "checkpoint", "fresh", "scratch_path", "small_side", "stored_bytes", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept.

    ``lower`` does exactly that where a text has one byte per character;
    other texts are translated letter by letter.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores after it as keep it from
    clashing with a column of ``df`` (upper and lower case alike)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often
    ``use`` names it, also within the functions it hands to ``transform``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stored_bytes(stored: DataFrame) -> int:
    """Size in bytes of the files behind a table written by ``checkpoint``."""
    spark = stored.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, stored.inputFiles()))


def small_side(stored: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``stored`` (a table written by ``checkpoint``), marked for broadcast
    when its files are measured to hold at most ``limit`` bytes; beyond that
    the planner shuffles both sides and splits skewed keys."""
    return F.broadcast(stored) if stored_bytes(stored) <= limit else stored
