"""Distributed prefix sums, row numbers and ranks over a *global* order.

``Window.orderBy`` without ``partitionBy`` moves the whole table into one
task. These operators compute the same numbers with every step
distributed:

1. ``repartitionByRange(N, *groups, *order)`` — the range partitioner
   splits on the *full* key (order columns + id tiebreak), so one hot value
   or one big group is spread over many ranges;
2. the tagged layout (``spark_partition_id``) is written to the shared
   checkpoint folder, bucketed on ``(groups, range)``: sampled range bounds
   are not stable under recomputation, both later steps must see the same
   layout, and the bucketing satisfies their distribution (no second
   shuffle of the large side);
3. local running sums: a window partitioned by ``(groups, range)``;
4. per-range totals (at most ``N`` rows per group) → exclusive offsets
   with a window partitioned by group;
5. offsets joined back on ``(groups, range)``.

Ranks use the same machinery on per-value counts (``groupBy(value)`` with
map-side partial aggregation, so hot values collapse before the shuffle),
then join the small per-value lookup back with null-safe equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, input_bytes, max_buckets, pieces, stage_bucketed

_PID = "_range_id"

#: Bytes of input files per range: at least, and at most once there are many.
MIN_RANGE_BYTES = 4 << 20
RANGE_BYTES = 64 << 20


def _n_ranges(df: DataFrame, n_ranges: int | None) -> int:
    """One range for every ``MIN_RANGE_BYTES`` of input files; many ranges
    grow to ``RANGE_BYTES``, and further where the session allows no more buckets."""
    return n_ranges or min(pieces(input_bytes(df), MIN_RANGE_BYTES, RANGE_BYTES), max_buckets(df.sparkSession))


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    sums: dict[str, Column] | None = None,
    partition_by: Sequence[str] = (),
    *,
    row_number: str = "row_number",
    n_ranges: int | None = None,
) -> DataFrame:
    """Inclusive running count (``row_number``) and running sums.

    ``order_by`` must be a *total* order within each group (append an id
    tiebreak); the frame is ROWS UNBOUNDED PRECEDING..CURRENT ROW. ``sums``
    maps output column → value expression. As in a window, NULL values add
    nothing and a sum is NULL until the first value.
    """
    sums = dict(sums or {})
    groups = list(partition_by)
    tmp = {name: f"_v_{i}" for i, name in enumerate(sums)}
    # Non-null surrogate group keys (NULL flag + value as text): plain
    # equality joins on them keep the window's partitioning, and a NULL
    # group stays a group.
    keys = []
    surrogate = []
    for i, g in enumerate(groups):
        keys += [f"_gn{i}", f"_gv{i}"]
        surrogate += [F.col(g).isNull().alias(f"_gn{i}"), F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_gv{i}")]
    base = df.select("*", *surrogate, *[expr.alias(tmp[name]) for name, expr in sums.items()])
    n = _n_ranges(df, n_ranges)
    ranged = base.repartitionByRange(n, *[F.col(g) for g in groups], *order_by)
    # Stage the tagged layout bucketed on (group keys, range): the window,
    # the per-range totals and the offsets join below read it without an
    # exchange of the large side.
    ranged = stage_bucketed(ranged.withColumn(_PID, F.spark_partition_id()), [*keys, _PID], n, "prefix")

    local_w = Window.partitionBy(*keys, _PID).orderBy(*order_by)
    local_frame = local_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "*",
        F.row_number().over(local_w).alias("_rn_local"),
        *[F.sum(F.col(t)).over(local_frame).alias(f"_cum_{t}") for t in tmp.values()],
    )

    totals = ranged.groupBy(*keys, _PID).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(t)).alias(f"_s_{t}") for t in tmp.values()]
    )
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        _PID,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        *[F.sum(f"_s_{t}").over(before).alias(f"_off_{t}") for t in tmp.values()],
    )
    # Offsets have one row per (group, range): without groups at most as many
    # as the session allows buckets (``_n_ranges``), so they are broadcast;
    # with groups AQE decides from their size.
    if not groups:
        offsets = F.broadcast(offsets)
    joined = local.join(offsets, [*keys, _PID], "left")
    out_cols = [F.col(c) for c in df.columns]
    out_cols.append((F.col("_rn_local") + F.col("_off_n")).alias(row_number))
    for name, t in tmp.items():
        here, before_here = F.col(f"_cum_{t}"), F.col(f"_off_{t}")
        out_cols.append(F.when(before_here.isNull(), here).when(here.isNull(), before_here).otherwise(here + before_here).alias(name))
    return joined.select(*out_cols)


def _null_safe_keys(groups, prefix: str, extra=()) -> Column:
    """Join condition: each group column equals its prefixed copy, NULL
    matching NULL (a NULL group is a group, as in a window partition)."""
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
    for left, right in extra:
        cond = cond & (F.col(left) == F.col(right))
    return cond


def _order(c: Column, descending: bool, nulls_last: bool) -> Column:
    if descending:
        return c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    return c.asc_nulls_last() if nulls_last else c.asc_nulls_first()


def rank_table(
    df: DataFrame,
    value: str,
    partition_by: Sequence[str] = (),
    *,
    descending: bool = True,
    nulls_last=True,
    n_ranges: int | None = None,
) -> DataFrame:
    """Per distinct ``(groups, value)``: SQL ``rank()`` and ``percent_rank()``.

    Columns: groups, ``value``, ``rank``, ``percent_rank``, ``group_rows``.
    A NULL value is one more distinct entry, placed first or last;
    ``nulls_last`` may be a boolean column that is constant per group (so
    groups with different NULL placement share one pass).
    """
    groups = list(partition_by)
    v = F.col(value)
    nl = nulls_last if isinstance(nulls_last, Column) else F.lit(bool(nulls_last))
    # Per-value counts feed three branches below; stage them once (they are
    # far smaller than the rows: one per distinct value and group).
    counts = checkpoint(
        df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"), F.first(nl).alias("_nl")), "rank-counts"
    )
    stats = counts.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_c"))), F.lit(0)).alias("_nn"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("_c"))), F.lit(0)).alias("_nulls"),
    )
    non_null = running_totals(
        counts.filter(v.isNotNull()),
        [_order(v, descending, True)],
        {"_cum": F.col("_c")},
        groups,
        n_ranges=n_ranges,
    ).drop("row_number")
    nulls = counts.filter(v.isNull()).withColumn("_cum", F.lit(None).cast("long"))
    lookup = non_null.unionByName(nulls)
    # ``stats`` has one row per group: broadcast only when there is no group
    # (one row); with groups AQE picks the strategy from its runtime size.
    if groups:
        stats = stats.select(*[F.col(g).alias(f"_s_{g}") for g in groups], "_nn", "_nulls")
        lookup = lookup.join(stats, _null_safe_keys(groups, "_s_"), "inner").drop(*[f"_s_{g}" for g in groups])
    else:
        lookup = lookup.crossJoin(F.broadcast(stats))
    last = F.col("_nl")
    rank = (
        F.when(v.isNull(), F.when(last, F.col("_nn") + 1).otherwise(F.lit(1)))
        .otherwise(F.col("_cum") - F.col("_c") + 1 + F.when(last, F.lit(0)).otherwise(F.col("_nulls")))
        .cast("long")
    )
    total = F.col("_nn") + F.col("_nulls")
    return lookup.select(
        *groups,
        value,
        rank.alias("rank"),
        F.when(total > 1, (rank - 1).cast("double") / (total - 1).cast("double"))
        .otherwise(F.lit(0.0))
        .alias("percent_rank"),
        total.alias("group_rows"),
    )


def with_rank(
    df: DataFrame,
    value: str,
    partition_by: Sequence[str] = (),
    *,
    descending: bool = True,
    nulls_last=True,
    rank_col: str = "rank",
    percent_col: str | None = None,
    n_ranges: int | None = None,
) -> DataFrame:
    """``df`` plus SQL-style ``rank()`` (and optionally ``percent_rank()``).

    Per-value counts go through the distributed prefix and are joined back.
    """
    groups = list(partition_by)
    lk = rank_table(df, value, groups, descending=descending, nulls_last=nulls_last, n_ranges=n_ranges)
    lk = lk.select(
        *[F.col(g).alias(f"_k_{g}") for g in groups],
        F.col(value).alias("_k_v"),
        F.col("rank").alias(rank_col),
        *([F.col("percent_rank").alias(percent_col)] if percent_col else []),
    )
    cond = F.col(value).eqNullSafe(F.col("_k_v")) & _null_safe_keys(groups, "_k_")
    out = df.join(lk, cond, "left")
    return out.drop("_k_v", *[f"_k_{g}" for g in groups])


def range_running_sum(
    df: DataFrame,
    value: str,
    sum_expr: Column,
    out: str,
    partition_by: Sequence[str] = (),
    *,
    descending: bool = True,
    n_ranges: int | None = None,
) -> DataFrame:
    """``sum(x) OVER (ORDER BY value)`` with the default RANGE frame.

    Ties on ``value`` share one cumulative: the prefix runs over distinct
    values (aggregated first) and is joined back.
    """
    groups = list(partition_by)
    v = F.col(value)
    per_value = df.filter(v.isNotNull()).groupBy(*groups, value).agg(sum_expr.alias("_s"))
    pref = running_totals(
        per_value, [_order(v, descending, True)], {out: F.col("_s")}, groups, n_ranges=n_ranges
    ).select(*[F.col(g).alias(f"_k_{g}") for g in groups], F.col(value).alias("_k_v"), F.col(out))
    cond = (v == F.col("_k_v")) & _null_safe_keys(groups, "_k_")
    return df.join(pref, cond, "left").drop("_k_v", *[f"_k_{g}" for g in groups])
