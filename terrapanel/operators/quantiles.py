"""Exact quantiles by value counts and the distributed prefix.

Spark's own exact percentile merges one value-to-count map per group in one
task. Here equal values are counted first (partial sums before the shuffle),
the running counts come from the range-partitioned prefix, and only the rows
that hold a wanted position meet in an aggregation: two values per quantile.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .prefix import running_totals


def exact_quantiles(df: DataFrame, value: Column, fractions: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """``groups`` and ``quantiles`` (array of doubles, one per fraction),
    interpolated linearly between neighbouring positions.

    NULL values take no part; a group of nothing else has no row, and without
    groups an empty input gives one row of NULLs. A NULL group is a group.
    """
    groups = list(groups)
    kept = df.select(*groups, value.alias("_value")).where(F.col("_value").isNotNull())
    counts = checkpoint(kept.groupBy(*groups, "_value").agg(F.count(F.lit(1)).alias("_times")), "value-counts")
    placed = running_totals(counts, [F.col("_value").asc()], {"_upto": F.col("_times")}, groups)
    sizes = counts.groupBy(*groups).agg(F.sum("_times").alias("_size"))
    if groups:
        sizes = sizes.select(*(F.col(g).alias(f"_of_{g}") for g in groups), "_size")
        same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups))
        placed = placed.join(sizes, same)
    else:
        placed = placed.crossJoin(F.broadcast(sizes))  # one row
    at = [(F.col("_size") - 1) * F.lit(float(f)) for f in fractions]
    holds = lambda position: (F.col("_upto") - F.col("_times") <= position) & (position < F.col("_upto"))
    wanted = [(holds(F.floor(p)), holds(F.ceil(p))) for p in at]
    few = placed.where(reduce(lambda a, b: a | b, (x for pair in wanted for x in pair)))
    ends = few.groupBy(*groups).agg(
        F.max("_size").alias("_size"),
        *(F.max(F.when(hit, F.col("_value"))).cast("double").alias(f"_{side}{i}") for i, pair in enumerate(wanted) for side, hit in zip("lh", pair, strict=True)),
    )
    between = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (p - F.floor(p)) for i, p in enumerate(at)]
    return ends.select(*groups, F.array(*between).alias("quantiles"))


def with_median(grouped: DataFrame, df: DataFrame, value: Column, out: str, groups: Sequence[str] = (), finish=lambda c: c) -> DataFrame:
    """``grouped`` (one row per group of ``df``, or one row) with the median
    of ``value``; ``finish`` turns it into the published number."""
    medians = exact_quantiles(df, value, [0.5], groups).withColumn(out, finish(F.col("quantiles")[0])).drop("quantiles")
    if not groups:
        return grouped.crossJoin(F.broadcast(medians))
    medians = medians.select(*(F.col(g).alias(f"_m_{g}") for g in groups), out)
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_m_{g}")) for g in groups))
    return grouped.join(medians, same, "left").drop(*(f"_m_{g}" for g in groups))
