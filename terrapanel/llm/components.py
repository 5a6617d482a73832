"""Connected components of a link table, by alternating star contraction.

Each round joins every node to the smallest node it knows: first among all
neighbours (larger neighbours move to it), then among the smaller ones. The
rounds end when the link table is a forest of stars; their number grows with
the logarithm of the longest chain. Links are written to the shared folder
between rounds; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import checkpoint


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(links: DataFrame, all_neighbours: bool) -> DataFrame:
    """One contraction. Links are (a, b) with a > b."""
    if all_neighbours:
        known = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = known.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = known.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        known = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = known.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        moved = known.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``component``) for every node of the links (columns ``a``
    and ``b``): the smallest node of its component. Links may be repeated,
    in either direction or from a node to itself; no links give no rows.
    """
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpoint(pairs, "links")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        wide = checkpoint(_star(now, True), "links")
        now = checkpoint(_star(wide, False), "links")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"the links did not contract in {max_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.unionByName(roots)
