"""Concentration of a distribution: Gini, top shares, Lorenz curve, the
number of entities holding half of a total, and the territory needed for
half of the population.

Everything rests on ordered prefixes computed by ``operators.prefix``
(no un-partitioned window). Tie order never matters: the Gini sum
Σ i·xᵢ and the top-k sums are computed per *distinct value* (a value v
with c copies starting at position s contributes v·(c·s + c(c−1)/2)),
so results are exact and independent of how ties are broken. Results are
one-row DataFrames (the original returns dicts built on the driver).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_double, nullif_zero
from ..session import checkpoint
from .prefix import running_totals


def value_blocks(df: DataFrame, value: str) -> DataFrame:
    """Distinct non-null values with count ``c``, and on both sides of the
    block the rows and the sum: ``below_n``, ``below_s`` (smaller values),
    ``above_n``, ``above_s`` (larger ones), beside the totals ``n`` and
    ``total``. One ascending order serves both directions: what lies above is
    the total less what has been counted up to the block."""
    v = F.col(value)
    blocks = df.filter(v.isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"), F.sum(value).alias("s"))
    pref = checkpoint(running_totals(blocks, [v.asc()], {"_n": F.col("c"), "_s": F.col("s")}).drop("row_number"), "value-blocks")
    totals = pref.agg(F.sum("c").alias("n"), F.sum("s").alias("total"))  # one row
    return pref.crossJoin(F.broadcast(totals)).select(
        value, "c", "s", "n", "total",
        (F.col("_n") - F.col("c")).alias("below_n"), (F.col("_s") - F.col("s")).alias("below_s"),
        (F.col("n") - F.col("_n")).alias("above_n"), (F.col("total") - F.col("_s")).alias("above_s"),
    )


def _rank_weighted(value: str) -> Column:
    """Sum of position times value over a block, positions ascending from 1:
    below_n+1 .. below_n+c add up to c·(below_n+1) + c(c−1)/2."""
    positions = F.col("c") * (F.col("below_n") + F.lit(1)) + F.col("c") * (F.col("c") - F.lit(1)) / F.lit(2)
    return as_double(value) * positions.cast("double")


def _gini(six: Column) -> Column:
    n = as_double("n")
    return F.lit(2.0) * six / (n * as_double(nullif_zero(F.col("total")))) - (n + F.lit(1.0)) / n


def _top(value: str, k: Column) -> Column:
    """Sum of a block's values that are among the ``k`` largest."""
    return F.col(value) * F.least(F.col("c"), F.greatest(F.lit(0), k - F.col("above_n")))


def _before_half(value: str) -> Column:
    """Of a block's entities, largest first: how many leave the running sum
    below half of the total. The running sum after the j-th is above_s + j·v,
    so for v > 0 these are the first ones, for v < 0 the last ones; the
    quotient is only a guess, the neighbouring counts are tried exactly."""
    v, c = F.col(value), F.col("c")
    holds = lambda j: (F.col("above_s") + v * j) * F.lit(2) < F.col("total")
    within = lambda j: F.greatest(F.lit(0), F.least(c, j)).cast("long")
    guess = F.floor((as_double("total") - F.lit(2.0) * as_double("above_s")) / as_double(nullif_zero(F.lit(2) * v)))
    below, here, after = within(guess - 1), within(guess), within(guess + 1)
    rising = F.when((after > here) & holds(after), after).when((here > 0) & holds(here), here).when((below > 0) & holds(below), below).otherwise(F.lit(0))
    # for v < 0: the count of entities that don't hold yet, at the front
    front = F.when((after > here) & ~holds(after), after).when((here > 0) & ~holds(here), here).when((below > 0) & ~holds(below), below).otherwise(F.lit(0))
    return F.when(v == 0, F.when(holds(F.lit(1)), c).otherwise(F.lit(0))).when(v > 0, rising).otherwise(c - front)


def gini(df: DataFrame, value: str) -> DataFrame:
    """``2·Σ(i·xᵢ)/(n·Σx) − (n+1)/n`` over non-null values, i ascending.

    One row ``(gini, n)``; no row when there is no value.
    """
    one = value_blocks(df, value).groupBy("n", "total").agg(F.sum(_rank_weighted(value)).alias("_six"))
    return one.select(_gini(F.col("_six")).alias("gini"), F.col("n").cast("long").alias("n"))


def _concentration_sums(value: str) -> list[Column]:
    n = F.col("n")
    ks = {"_t1": F.greatest(F.lit(1), F.floor(n / F.lit(100))), "_t10": F.greatest(F.lit(1), F.floor(n / F.lit(10))), "_t100": F.lit(100)}
    return [F.sum(_rank_weighted(value)).alias("_six"), *(F.sum(_top(value, k)).alias(name) for name, k in ks.items())]


def _share(c: str) -> Column:
    return as_double(c) / as_double(nullif_zero(F.col("total"))) * F.lit(100.0)


def _concentration_columns() -> list[Column]:
    return [
        _gini(F.col("_six")).alias("gini"), F.col("n").cast("long").alias("n"),
        _share("_t1").alias("share_top_1pct"), _share("_t10").alias("share_top_10pct"), _share("_t100").alias("share_top_100"),
    ]


def concentration(df: DataFrame, value: str) -> DataFrame:
    """Gini and the shares (%) of the top 1%, top 10% and top 100 entities,
    from one ordering of the distinct values."""
    return value_blocks(df, value).groupBy("n", "total").agg(*_concentration_sums(value)).select(*_concentration_columns())


def lorenz_curve(df: DataFrame, value: str, key: str) -> DataFrame:
    """Points of the Lorenz curve: (``pct_entidades``, ``pct_acumulado``),
    ascending order, one point per entity."""
    d = df.filter(F.col(value).isNotNull()).select(key, value)
    pref = running_totals(d, [F.col(value).asc(), F.col(key).asc()], {"_cum": F.col(value)}, row_number="_i")
    tot = d.agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_t"))
    return pref.crossJoin(F.broadcast(tot)).select(
        key,
        (as_double("_i") * F.lit(100.0) / as_double("_n")).alias("pct_entidades"),
        (as_double("_cum") * F.lit(100.0) / as_double(nullif_zero(F.col("_t")))).alias("pct_acumulado"),
    )


def half_of_total(df: DataFrame, value: str, key: str) -> DataFrame:
    """How many entities (largest first) make half of the total:
    ``count(cum < total/2) + 1``, its % of entities, the share of the top 10
    and the concentration metrics, all from one ordering of the distinct
    values (``key`` tells the entities; ties share a value, so their order
    doesn't matter)."""
    d = df.select(key, value)
    one = value_blocks(d, value).groupBy("n", "total").agg(
        (F.sum(_before_half(value)) + F.lit(1)).alias("_metade"), F.sum(_top(value, F.lit(10))).alias("_top10"), *_concentration_sums(value)
    )
    return one.select(
        F.col("_metade").cast("long").alias("n_metade"),
        (as_double("_metade") / as_double("n") * F.lit(100.0)).alias("pct_metade"),
        _share("_top10").alias("share_top_10"),
        *_concentration_columns(),
    )


def territorial_half(df: DataFrame, density: str, population: str, area: str, key: str) -> DataFrame:
    """Entities sorted by density (densest first): how many, and how much
    area, are needed to gather half of the population."""
    d = df.filter(F.col(density).isNotNull() & F.col(area).isNotNull() & F.col(population).isNotNull()).select(
        key, density, population, area
    )
    pref = running_totals(
        d,
        [F.col(density).desc(), F.col(key).asc()],
        {"_cp": F.col(population), "_ca": F.col(area)},
        row_number="_i",
    )
    tot = d.agg(F.sum(population).alias("_tp"), F.sum(area).alias("_ta"))
    j = pref.crossJoin(F.broadcast(tot))
    cut = j.groupBy("_tp", "_ta").agg((F.count_if(F.col("_cp") * F.lit(2) < F.col("_tp")) + F.lit(1)).alias("_cut"))
    at_cut = j.join(F.broadcast(cut.select("_cut")), F.col("_i") == F.col("_cut")).select("_cut", "_ca")
    return at_cut.crossJoin(F.broadcast(tot)).select(
        F.col("_cut").cast("long").alias("n_entidades_metade_pop"),
        F.col("_ca").cast("decimal(38,3)").alias("area_metade_pop"),
        (as_double("_ca") / as_double(nullif_zero(F.col("_ta"))) * F.lit(100.0)).alias("pct_area_metade_pop"),
        F.col("_ta").cast("decimal(38,3)").alias("area_total"),
    )
