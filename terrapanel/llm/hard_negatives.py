"""Hard-negative mining by slot-decomposed selection.

An anchor's positives each ask for the best negatives of a score window below
their own score; the windows overlap. Their upper limits, in descending order,
cut the scores into disjoint slots. A row falls into one slot, so each slot's
best ``k`` are kept by combiners (in a task, before the shuffle, after it), and
the windows are answered by merging slots downwards from a window's upper
limit: the best ``k`` of such a suffix, less those below the window's lower
limit.

Anchors are dealt into blocks and all rows into cells of bounded size; a task
scores a block against a cell with one matrix product. Every row meets every
anchor once per pass (positives, then negatives); what leaves a task is ``k``
rows per anchor and slot, and the windows that follow keep ``k`` per key in
every task before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import checkpoint
from terrapanel.llm.vector_codes import integers, matrix

#: Anchors of a block, rows of a cell: what a task holds at a time.
BLOCK_ANCHORS, CELL_ROWS = 1024, 8192
#: Anchors whose scores are held at a time.
_STRIP = 128
#: Scores must stay below it: doubles are exact there, tie-breaks included.
_EXACT = 1 << 53


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest allowed scores of every row; of equal
    scores the earlier columns."""
    n = scores.shape[1]
    # one number tells scores and, among equals, columns apart
    key = np.where(allowed, scores * n + np.arange(n - 1, -1, -1.0), -np.inf)
    top = np.argpartition(key, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), key.shape)
    row, place = np.nonzero(np.isfinite(np.take_along_axis(key, top, 1)))
    return row, top[row, place]


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of two columns."""
    values = pc.unique(pa.chunked_array([*a.chunks, *b.chunks], a.type))
    return tuple(pc.index_in(x, value_set=values).to_numpy(zero_copy_only=False) for x in (a, b))


def _scored(anchors: DataFrame, rows: DataFrame, width: int, blocks: int, cells: int, select: Callable, slots: bool) -> DataFrame:
    """(``a``, ``slot``, ``score``, ``id``) that ``select`` keeps of every
    block of anchors and every cell of rows."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("id", rows.schema["id"].dataType)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("id", "ascending")])  # null ids come last
        mine, theirs = matrix(left.column("v"), width).astype(float), matrix(right.column("v"), width).astype(float)
        label_of, label = _codes(left.column("label"), right.column("label"))
        id_of, id_ = _codes(left.column("id"), right.column("id"))
        found = [(np.zeros(0, np.int64),) * 4]
        if len(mine) and len(theirs):
            tops = left.column("tops").to_pylist() if slots else [None] * len(mine)
            floors = left.column("floor").to_pylist() if slots else [None] * len(mine)
            for at in range(0, len(mine), _STRIP):
                strip = slice(at, at + _STRIP)
                scores = mine[strip] @ theirs.T
                same = label_of[strip, None] == label[None]
                other = id_of[strip, None] != id_[None]
                for slot, row, column in select(scores, same, other, tops[strip], floors[strip]):
                    found.append((row + at, np.full(len(row), slot), scores[row, column], column))
        anchor, slot, score, column = (np.concatenate(x) for x in zip(*found, strict=True))
        names = schema.names
        out = [left.column("a").combine_chunks().take(pa.array(anchor, pa.int64())), pa.array(slot, pa.int32()), pa.array(score.astype(np.int64)), right.column("id").combine_chunks().take(pa.array(column, pa.int64()))]
        return pa.Table.from_arrays(out, names)

    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = anchors.select("*", F.explode(number(cells)).alias("cell")).groupBy("block", "cell")
    right = rows.select("*", F.explode(number(blocks)).alias("block")).groupBy("block", "cell")
    return left.cogroup(right).applyInArrow(run, schema)


def _first(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each key, with their place. The limit is applied
    in every task before the rows are dealt out by key."""
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    block_anchors: int = BLOCK_ANCHORS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``) for the rows where ``is_anchor``
    holds, against all rows.

    Components become ``floor(scale * x)``; a score is an integer inner
    product; higher scores come first, equal ones by ascending id (null ids
    last). An anchor's positives are the first ``positives`` rows of its label
    whose id isn't its own; for each of them the first ``negatives`` rows of
    other labels with ``low_percent * positive_score <= 100 * negative_score <=
    high_percent * positive_score`` are returned, numbered from 1. A positive
    with a negative score has an empty window.

    Rows with a null label or a vector that is null, empty or holds a null or
    non-finite component take no part, nor does an anchor without an id.
    Repeated rows are rows of their own, as anchors too. All vectors must have
    one length and scores that doubles hold exactly, or a ValueError says so.
    No anchors, or no rows, give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), integers(F.col(f"`{vector_col}`"), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = checkpoint(named.where(F.col("v").isNotNull() & F.col("label").isNotNull()), "negative-rows")
    asks = F.col("anchor") & F.col("id").isNotNull()
    n, asked, shortest, width, largest = rows.agg(F.count("*"), F.count_if(asks), F.min(F.size("v")), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    id_type = rows.schema["id"].dataType
    kinds = (("anchor_id", id_type), ("positive_id", id_type), ("rank", T.IntegerType()), ("negative_id", id_type), ("positive_score", T.LongType()), ("negative_score", T.LongType()))
    if not asked:
        return spark.createDataFrame([], T.StructType([T.StructField(*x) for x in kinds]))
    if shortest != width or width * largest**2 * cell_rows * 4 >= _EXACT:
        raise ValueError(f"vectors of {shortest} to {width} components up to {largest}: all must have one length, and scores below {_EXACT // cell_rows // 4}")
    blocks, cells = -(-asked // block_anchors), -(-n // cell_rows)
    # stored rows are numbered alike when a task is run again
    number = F.monotonically_increasing_id()
    own = rows.where(asks).select("id", "label", "v", number.alias("a"))
    anchors = checkpoint(own.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")), "anchors")
    dealt = rows.select("id", "label", "v", F.pmod(F.xxhash64(number), F.lit(cells)).cast("int").alias("cell"))

    def nearest(scores, same, other, *_):
        yield 0, *_best(scores, same & other, positives)

    of_label = _scored(anchors, dealt, width, blocks, cells, nearest, slots=False)
    limits = [F.expr(f"(score * {high_percent}) div 100").alias("high"), F.expr(f"(score * {low_percent} + 99) div 100").alias("low")]
    found = _first(of_label, ["a"], positives).where("score >= 0")  # below 0 a window is empty
    chosen = checkpoint(found.select("a", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), *limits), "positives")
    tops = chosen.groupBy("a").agg(F.sort_array(F.collect_set("high"), asc=False).alias("tops"), F.min("low").alias("floor"))
    asking = checkpoint(anchors.join(tops, "a"), "asking-anchors")

    def slotted(scores, same, other, tops, floors):
        """Each slot's best: above the next lower limit, the last one from the
        lowest window's lower limit on."""
        high = np.full((len(tops), positives), -np.inf)
        for i, t in enumerate(tops):
            high[i, : len(t)] = t
        below = np.hstack([high[:, 1:], np.full((len(tops), 1), -np.inf)])
        least = np.array(floors, float)[:, None]
        for slot in range(positives):
            if np.isfinite(high[:, slot]).any():
                within = ~same & (scores <= high[:, slot, None]) & (scores > below[:, slot, None]) & (scores >= least)
                yield slot, *_best(scores, within, negatives)

    kept = _first(_scored(asking, dealt, width, blocks, cells, slotted, slots=True), ["a", "slot"], negatives)
    # at most positives * negatives a anchor; sorted, a suffix of slots is what lies at or below its upper limit
    entry = F.struct((-F.col("score")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "score")
    merged = kept.groupBy("a").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    suffix = F.slice(F.filter("entries", lambda e: e["score"] <= F.col("high")), 1, negatives)
    windows = chosen.join(merged, "a").join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    answered = windows.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter(suffix, lambda e: e["score"] >= F.col("low"))).alias("at", "e"))
    return answered.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score"))
