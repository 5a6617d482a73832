"""Vector code compression with anchors-hierarchy metric trees.

Every vector is cut into equal consecutive parts; each part position has a
codebook, and a vector's code is the index of the nearest entry per part.
The codebooks are refined by rounds of assigning and averaging.

The rows are dealt into shards of bounded size. A shard holds, for each part
position, a metric tree built middle-out: the square root of its points become
anchors (the furthest point of the widest anchor is the next one, and takes
what lies closer to it; the triangle inequality tells which points need no
look), each anchor's points are divided again in the same way, and the anchors'
balls are merged pairwise, the most compact pair first. Balls keep the sum and
the number of their points.

A round hands a ball the entries that its parent could not rule out. An entry
goes when every point of the ball is nearer to another; a ball with one entry
left is wholly owned, and its sum and number are added without a look at its
points. Points of leaves with several entries left are compared one by one. All
sums are of integers, so no result depends on the shards.

Trees are written once to the shared folder and read in every round; the driver
gets the sums per entry, whose number is a parameter.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import checkpoint

#: Rows whose trees one task builds at a time.
SHARD_ROWS = 8192
#: A ball of so few points is a leaf.
LEAF_POINTS = 24
#: Largest integer component: squared distances are then exact in doubles.
LARGEST = 1 << 22


# ------------------------------------------------------------ the metric tree


def _anchors(points: np.ndarray, want: int) -> np.ndarray:
    """The anchor that owns each point, of at most ``want`` anchors."""
    own = np.zeros(len(points), np.int64)
    away = np.sqrt(((points - points[0]) ** 2).sum(1))
    at = [0]
    while len(at) < want:
        far = int(away.argmax())  # the furthest point of the widest anchor
        if not away[far]:
            break  # all points lie on their anchors
        between = np.sqrt(((points[at] - points[far]) ** 2).sum(1))
        near = np.flatnonzero(2 * away > between[own])  # no other can be closer to the new anchor
        distance = np.sqrt(((points[near] - points[far]) ** 2).sum(1))
        stolen = distance < away[near]
        own[near[stolen]] = len(at)
        away[near[stolen]] = distance[stolen]
        at.append(far)
    return own


class _Builder:
    """Balls of one tree, children before parents."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.left: list[int] = []
        self.right: list[int] = []
        self.members: list[np.ndarray | None] = []  # of leaves
        self.rough: list[tuple[np.ndarray, float, int]] = []  # centre, radius (a bound), points

    def ball(self, left: int, right: int, members: np.ndarray | None, rough: tuple) -> int:
        for store, value in ((self.left, left), (self.right, right), (self.members, members), (self.rough, rough)):
            store.append(value)
        return len(self.left) - 1

    def grow(self, index: np.ndarray) -> int:
        own = _anchors(self.points[index], math.isqrt(len(index) - 1) + 1) if len(index) > LEAF_POINTS else np.zeros(1, np.int64)
        if not own.any():
            x = self.points[index]
            centre = x.mean(0)
            return self.ball(-1, -1, index, (centre, float(np.sqrt(((x - centre) ** 2).sum(1).max())), len(index)))
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        return self.merged([self.grow(part) for part in np.split(index[order], cuts)])

    def merged(self, balls: list[int]) -> int:
        """One ball over ``balls``, joining the pair whose common ball is
        smallest again and again."""
        centre = np.array([self.rough[b][0] for b in balls])
        radius = np.array([self.rough[b][1] for b in balls])
        size = np.array([self.rough[b][2] for b in balls], float)
        apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
        cost = apart + radius[:, None] + radius
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(balls) - 1):
            i, j = divmod(int(cost.argmin()), len(balls))
            middle = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
            reach = max(np.sqrt(((middle - centre[k]) ** 2).sum()) + radius[k] for k in (i, j))
            size[i] += size[j]
            centre[i], radius[i] = middle, reach
            balls[i] = self.ball(balls[i], balls[j], None, (middle, float(reach), int(size[i])))
            cost[j], cost[:, j] = np.inf, np.inf
            gone = np.isinf(cost[i])
            cost[i] = np.where(gone, np.inf, np.sqrt(((centre - middle) ** 2).sum(1)) + radius + reach)
            cost[:, i] = cost[i]
        return balls[i] if len(balls) > 1 else balls[0]


def build_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree over integer ``points`` (at least one): ``order`` puts the
    points of every ball next to each other, from ``low`` to ``high``; a ball
    has a ``centre``, a ``radius``, the ``total`` of its points, and two
    children, -1 in leaves. The last ball is the root."""
    builder = _Builder(points.astype(float))
    root = builder.grow(np.arange(len(points)))
    m = len(builder.left)
    low, high, order = np.zeros(m, np.int64), np.zeros(m, np.int64), []
    stack, at = [(root, False)], 0
    while stack:
        ball, done = stack.pop()
        if done:
            low[ball], high[ball] = low[builder.left[ball]], high[builder.right[ball]]
        elif builder.members[ball] is not None:
            order.append(builder.members[ball])
            low[ball], high[ball] = at, at + len(order[-1])
            at = int(high[ball])
        else:
            stack += [(ball, True), (builder.right[ball], False), (builder.left[ball], False)]
    order = np.concatenate(order)
    placed = points[order]
    sums = np.vstack([np.zeros((1, points.shape[1]), np.int64), placed.cumsum(0)])
    total = sums[high] - sums[low]
    centre = total / (high - low)[:, None]
    radius = np.array([np.sqrt(((placed[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(low, high, centre, strict=True)])
    return {"order": order, "low": low, "high": high, "centre": centre, "radius": radius, "total": total, "left": np.array(builder.left), "right": np.array(builder.right)}


def owners(tree: dict[str, np.ndarray], placed: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For ``placed`` (the points in the tree's order): the nearest of
    ``entries`` of each (the lower index of equals), the sum and the number of
    each entry's points, and how many points were compared one by one."""
    k, e = len(entries), entries.astype(float)
    norm = (e * e).sum(1)
    apart = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    code, loose = np.zeros(len(placed), np.int64), np.zeros(len(placed), bool)
    total, number = np.zeros(entries.shape, np.int64), np.zeros(k, np.int64)
    centre, radius, low, high, left, right = (tree[n] for n in ("centre", "radius", "low", "high", "left", "right"))
    # of equal entries only the first can own anything
    first = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    stack = [(len(left) - 1, first)]
    while stack:
        ball, entry = stack.pop()
        if len(entry) > 1:
            score = norm[entry] - 2 * (e[entry] @ centre[ball])  # squared distance to the centre, less a constant
            best = int(score.argmin())
            # difference of squared distances to two entries over the ball: at least the one at its
            # centre less twice the radius times the distance of the entries
            over = score - score[best] - 2 * radius[ball] * apart[entry[best]][entry]
            entry = entry[over <= 1e-9 * (1 + np.abs(score))]
        a, b = low[ball], high[ball]
        if len(entry) == 1:
            code[a:b] = entry[0]
            total[entry[0]] += tree["total"][ball]
            number[entry[0]] += b - a
        elif left[ball] < 0:
            code[a:b] = entry[(norm[entry] - 2 * (placed[a:b].astype(float) @ e[entry].T)).argmin(1)]
            loose[a:b] = True
        else:
            stack += [(left[ball], entry), (right[ball], entry)]
    mine, points = code[loose], placed[loose]
    number += np.bincount(mine, minlength=k)
    for i in range(placed.shape[1]):  # exact: doubles hold these integers
        total[:, i] += np.bincount(mine, points[:, i], k).astype(np.int64)
    return code, total, number, int(loose.sum())


# ------------------------------------------------------------ in Spark


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, or null where the vector is
    null or empty or has a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & whole, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column whose lists have ``width`` numbers each, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as stored:
        return dict(stored)


def compress(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    shard_rows: int = SHARD_ROWS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors and the codebooks (one integer matrix per part).

    The table has the id column, the label column, ``codes`` (an index per
    part), ``error`` (squared distances summed over the parts) and
    ``label_error`` (``error`` summed over rows of equal labels; null labels
    are one group). A codebook begins as the ``entries`` rows with the smallest
    ids, or all rows if there are fewer; equal ids are ordered by their vectors,
    null ids come last. Entries without a point stay as they are.

    Rows whose vector is null, empty or has a null or non-finite component are
    left out. Repeated rows count as often as they occur. All vectors must have
    the same length, a multiple of ``parts``, and integer components of at most
    4,194,304; otherwise a ValueError says so. No rows give no rows and empty
    codebooks. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), integers(F.col(f"`{vector_col}`"), scale).alias("v"))
    rows = checkpoint(slim.where(F.col("v").isNotNull()), "code-vectors")
    of = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    n, shortest, width, largest = of
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    if n and (shortest != width or width % parts or largest > LARGEST):
        raise ValueError(f"vectors of {shortest} to {width} components up to {largest}: all must have one length, a multiple of {parts}, and at most {LARGEST} after scaling")
    of_part = (width or 0) // parts
    coded_type = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not n:
        empty = spark.createDataFrame([], coded_type).withColumn("label_error", F.col("error"))
        return empty.withColumnsRenamed({"id": id_col, "label": label_col}), [np.zeros((0, 0), np.int64)] * parts

    lowest = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    begin = np.array([r.v for r in lowest], np.int64)
    books = [begin[:, p * of_part : (p + 1) * of_part] for p in range(parts)]

    def plant(table: pa.Table) -> pa.Table:
        whole = matrix(table.column("v"), width)
        arrays: dict[str, np.ndarray] = {}
        for p in range(parts):
            points = np.ascontiguousarray(whole[:, p * of_part : (p + 1) * of_part])
            tree = build_tree(points)
            arrays |= {f"{name}{p}": x for name, x in tree.items()} | {f"placed{p}": points[tree["order"]].astype(np.int32)}
        lists = [pa.array([table.column(c).combine_chunks()], pa.list_(table.schema.field(c).type)) for c in ("id", "label")]
        return pa.Table.from_arrays([*lists, pa.array([_packed(arrays)], pa.binary())], ["ids", "labels", "trees"])

    # stored rows are numbered alike when a task is run again
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-n // shard_rows)))
    planted_type = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("trees", T.BinaryType())])
    trees = checkpoint(rows.withColumn("shard", shard).groupBy("shard").applyInArrow(plant, planted_type), "code-trees")

    def trees_of(blob: pa.Scalar) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        stored = _unpacked(blob.as_py())
        for p in range(parts):
            yield {k: stored[f"{k}{p}"] for k in ("order", "low", "high", "centre", "radius", "total", "left", "right")}, stored[f"placed{p}"].astype(np.int64)

    def summing(now: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, number = [np.zeros_like(b) for b in now], [np.zeros(len(b), np.int64) for b in now]
            for batch in batches:
                for blob in batch.column(0):
                    for p, (tree, placed) in enumerate(trees_of(blob)):
                        _, t, k, _ = owners(tree, placed, now[p])
                        total[p] += t
                        number[p] += k
            part, entry = np.indices((parts, len(begin))).reshape(2, -1)
            sums = pa.array(list(np.concatenate(total)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(np.concatenate(number)), sums], ["part", "entry", "n", "total"])

        return run

    for _ in range(rounds):
        partial = trees.select("trees").mapInArrow(summing(books), "part int, entry int, n long, total array<long>")
        summed = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(of_part)))
        books = [b.copy() for b in books]
        for part, entry, points, *total in summed.where("n > 0").collect():
            books[part][entry] = np.array(total) // points

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, blobs = batch.columns
            for i, blob in enumerate(blobs):
                own = ids.slice(i, 1).flatten()
                codes, error = np.zeros((len(own), parts), np.int32), np.zeros(len(own), np.int64)
                for p, (tree, placed) in enumerate(trees_of(blob)):
                    nearest, *_ = owners(tree, placed, books[p])
                    codes[tree["order"], p] = nearest
                    error[tree["order"]] += ((placed - books[p][nearest]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([own, labels.slice(i, 1).flatten(), pa.array(list(codes), pa.list_(pa.int32())), pa.array(error)], coded_type.names)

    coded = checkpoint(trees.mapInArrow(code, coded_type), "codes")
    # one row per label, stored: the planner broadcasts it by its size, or shuffles and splits a hot label
    by_label = checkpoint(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"), books


def books_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and position, as
    decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def hex_code(codes: Column, entries: int = 256) -> Column:
    """The indexes of ``codes`` in lowercase hex, two digits each or as many
    as the largest index needs."""
    digits = max(2, len(f"{entries - 1:x}"))
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")
