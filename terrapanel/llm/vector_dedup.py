"""Embedding near-duplicates through a flat, robust-pruned neighbour graph.

Vectors of one label are dealt to the cluster shards of their nearest
centroids, several each, so that shards overlap. Each shard gets a graph of its
own: a node's candidates are its nearest vectors and some random ones, pruned
so that a neighbour goes when a nearer one already leads to it. A vector's
adjacency list is the union of its lists in all its shards.

A search starts at the medoid of each shard of the query, walks greedily to the
query with a beam of open nodes, then expands its range: every neighbour of a
vector within range is looked at, until none is new. Where a list leads from a
vector in range to one in a shard that the query isn't in, the pair is handed
on: it is verified by a join, and if it holds the search goes on from there.
Every link is verified by the cosine in doubles. Recall is audited against all
rows for a fixed number of queries; below the floor the graph is built again
with more overlap and a wider beam.

Links within a shard are counted where they are found, and leave it as a
spanning forest, so that a group of near copies isn't written out as pairs. A
pair that shares several shards counts in the first. A shard of more than
``cell_rows`` vectors is divided: each division has a graph, and each part of
the shard's queries searches each of them, so no task holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import bind, checkpoint
from terrapanel.llm.components import connected_components
from terrapanel.llm.vector_codes import matrix

#: Vectors for each centroid, and the largest number of centroids that tasks load (8 MB at 64 components).
SHARD_ROWS, MAX_CENTROIDS = 256, 16384
#: Vectors that a task holds as index, and as queries.
CELL_ROWS = 2048
#: Shards of a vector, neighbours of a node in one shard, width of the search.
OVERLAP, DEGREE, BEAM = 3, 16, 16
#: A neighbour goes when one that is nearer by this factor leads to it.
ALPHA = 1.2
#: Queries whose links are counted by brute force, least share that must be found, builds at most.
AUDITED, RECALL_FLOOR, ATTEMPTS = 256, 0.95, 3
#: Centroids are less alike than this, so a group of near copies has one at most.
APART = 0.9
_NEAR, _FAR, _STRIP = 48, 16, 256


# ------------------------------------------------------------ graph of a cell


def pruned_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 0) -> np.ndarray:
    """(n, up to ``2 * degree``) neighbours of every unit vector, -1 where
    there are fewer: robust pruning of the nearest and some random others, and
    of what the reverse edges add."""
    n = len(points)
    if n < 2:
        return np.full((n, 1), -1, np.int64)
    away = np.sqrt(np.maximum(0, 2 - 2 * (points @ points.T)))
    np.fill_diagonal(away, np.inf)
    near = min(_NEAR, n - 1)
    pool = np.argpartition(away, near - 1, axis=1)[:, :near]
    far = np.random.default_rng(seed).integers(0, n, (n, min(_FAR, n)))
    links = _prune(away, np.hstack([pool, far]), degree, alpha)
    # every edge both ways; nodes with too many edges are pruned again
    a, b = np.nonzero(links >= 0)
    b = links[a, b]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    count = np.bincount(a, minlength=n)
    both = np.full((n, count.max()), -1, np.int64)
    both[a, np.arange(len(a)) - np.repeat(count.cumsum() - count, count)] = b
    if both.shape[1] <= 2 * degree:
        return both
    crowded = np.flatnonzero(count > 2 * degree)
    again = _prune(away, both[crowded], 2 * degree, alpha, crowded)
    both[crowded] = -1
    both[crowded, : again.shape[1]] = again
    return both[:, : 2 * degree]


def _prune(away: np.ndarray, pool: np.ndarray, degree: int, alpha: float, nodes: np.ndarray | None = None) -> np.ndarray:
    """Of each node's ``pool``: the nearest, less what it leads to, and so on."""
    nodes = np.arange(len(away)) if nodes is None else nodes
    out = np.full((len(nodes), degree), -1, np.int64)
    for at in range(0, len(nodes), _STRIP):
        own, some = nodes[at : at + _STRIP, None], pool[at : at + _STRIP]
        distance = np.where((some < 0) | (some == own), np.inf, away[own, some])
        order = np.argsort(distance, axis=1, kind="stable")
        some, left = np.take_along_axis(some, order, 1), np.take_along_axis(distance, order, 1)
        row = np.arange(len(some))
        distance = left.copy()
        for k in range(degree):
            pick = left.argmin(1)
            alive = np.isfinite(left[row, pick])
            if not alive.any():
                break
            chosen = some[row, pick]
            out[at : at + _STRIP][alive, k] = chosen[alive]
            led = alpha * away[chosen[:, None], some] <= distance
            left = np.where(led | (some == chosen[:, None]), np.inf, left)
    return out


def range_search(queries: np.ndarray, points: np.ndarray, links: np.ndarray, start: int, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) with an inner product of ``threshold`` or more
    that a walk from ``start`` over ``links`` finds."""
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(queries), _STRIP):
        q = queries[at : at + _STRIP]
        m, row = len(q), np.arange(len(q))
        seen, expanded = np.zeros((m, len(points)), bool), np.zeros((m, len(points)), bool)
        ids, sims, spent = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf), np.zeros((m, beam), bool)
        ids[:, 0], sims[:, 0], seen[:, start] = start, q @ points[start], True
        hits = [np.stack([row, np.full(m, start)])[:, sims[:, 0] >= threshold]]

        def look(of: np.ndarray, node: np.ndarray, m=m, q=q, seen=seen, expanded=expanded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Neighbours of ``node`` not seen by query ``of`` before."""
            expanded[of, node] = True
            to = links[node]
            r, c = np.nonzero((to >= 0) & ~seen[of[:, None], to])
            key = np.unique(of[r] * len(points) + to[r, c])
            who, new = key // len(points), key % len(points)
            seen[who, new] = True
            return who, new, np.einsum("ij,ij->i", q[who], points[new])

        while True:
            open_ = np.where(spent, -np.inf, sims)
            best = open_.argmax(1)
            active = np.flatnonzero(np.isfinite(open_[row, best]))
            if not len(active):
                break
            spent[active, best[active]] = True
            who, new, sim = look(active, ids[active, best[active]])
            hits.append(np.stack([who, new])[:, sim >= threshold])
            if not len(who):
                continue
            # the beam and what is new, the best of them stay
            count = np.bincount(who, minlength=m)
            place = np.arange(len(who)) - np.repeat(count.cumsum() - count, count)
            more = np.full((m, count.max()), -1, np.int64), np.full((m, count.max()), -np.inf)
            more[0][who, place], more[1][who, place] = new, sim
            ids, sims = np.hstack([ids, more[0]]), np.hstack([sims, more[1]])
            spent = np.hstack([spent, np.zeros_like(more[0], bool)])
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, spent = (np.take_along_axis(x, top, 1) for x in (ids, sims, spent))
        # range expansion
        edge = np.hstack(hits)
        while edge.shape[1]:
            edge = edge[:, ~expanded[edge[0], edge[1]]]
            if not edge.shape[1]:
                break
            who, new, sim = look(edge[0], edge[1])
            edge = np.stack([who, new])[:, sim >= threshold]
            hits.append(edge)
        pairs = np.hstack(hits)
        found.append(np.stack([pairs[0] + at, pairs[1]]))
    return tuple(np.hstack(found))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        next_ = root.copy()
        np.minimum.at(next_, a, low)
        np.minimum.at(next_, b, low)
        next_ = next_[next_]
        if (next_ == root).all():
            return root
        root = next_


# ------------------------------------------------------------ in Spark


def unit(vector: Column) -> Column:
    """The vector in doubles, scaled to length 1; null where it is null,
    empty or zero, or has a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    largest = F.array_max(F.transform(x, F.abs))

    def scaled(y: Column) -> Column:
        return bind(F.sqrt(F.aggregate(y, F.lit(0.0), lambda a, v: a + v * v)), lambda length: F.transform(y, lambda v: v / length))

    # divided by the largest component first: squares neither overflow nor vanish
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & whole & (largest > 0), bind(largest, lambda top: bind(F.transform(x, lambda v: v / top), scaled)))


def _centroids(nodes: DataFrame, shard_rows: int) -> dict[tuple, np.ndarray]:
    """Some vectors of every (label, dimension) that needs more than one
    shard, none of them alike: at most ``MAX_CENTROIDS`` in all."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = nodes.count()
    each = max(shard_rows, -(-total // MAX_CENTROIDS))
    wanted = sizes.where(F.col("n") > each).select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), F.expr(f"cast(n div {each} + 1 as int)").alias("k"))
    at = Window.partitionBy("label", "dim").orderBy(F.xxhash64("node"))
    ranked = nodes.select("label", "dim", "node", "u").withColumn("place", F.row_number().over(at)).where(F.col("place") <= MAX_CENTROIDS)
    drawn = ranked.join(wanted, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))).where(F.col("place") <= F.col("k"))
    groups: dict[tuple, list] = {}
    for r in drawn.select("label", "dim", "place", "u").collect():
        groups.setdefault((r.label, r.dim), []).append((r.place, r.u))
    out = {}
    for key, rows in groups.items():
        all_ = np.array([u for _, u in sorted(rows)])
        chosen: list[int] = []
        for i, u in enumerate(all_):
            if not chosen or (all_[chosen] @ u).max() < APART:
                chosen.append(i)
        if len(chosen) > 1:
            out[key] = all_[chosen]
    return out


def _with_shards(nodes: DataFrame, centroids: dict[tuple, np.ndarray], overlap: int) -> DataFrame:
    """``nodes`` with ``shards``: the nearest centroids' numbers, ascending."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("shards", T.ArrayType(T.IntegerType()))])
    at = nodes.columns.index("label"), nodes.columns.index("dim"), nodes.columns.index("u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True))
            shards: list = [[0]] * batch.num_rows
            for key in set(keys) & centroids.keys():
                rows = np.array([i for i, k in enumerate(keys) if k == key])
                near = matrix(batch.column(at[2]).take(pa.array(rows)), key[1]) @ centroids[key].T
                k = min(overlap, near.shape[1])
                own = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
                for i, s in zip(rows.tolist(), own.tolist(), strict=True):
                    shards[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int32()))], schema.names)

    return nodes.mapInArrow(run, schema)


def _found(nodes: DataFrame, threshold: float, overlap: int, beam: int, shard_rows: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``n``): weight of each node's links, in parts; and (``a``,
    ``b``): links that connect what is linked."""
    stored = checkpoint(_with_shards(nodes, _centroids(nodes, shard_rows), overlap), "vector-shards")
    cell = ["label", "dim", "shard"]
    dealt = stored.select("*", F.explode("shards").alias("shard"))
    sizes = checkpoint(dealt.groupBy(*cell).agg(F.expr(f"cast((count(*) + {cell_rows - 1}) div {cell_rows} as int)").alias("subs")), "shard-sizes")
    hashed = F.pmod(F.xxhash64("node"), F.col("subs")).cast("int")
    dealt = dealt.join(sizes, cell).withColumn("own", hashed)

    def build(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        links = pruned_graph(matrix(table.column("u"), table.column("dim")[0].as_py())[order])
        to = [node[order][x[x >= 0]] for x in links]
        return pa.Table.from_arrays([pa.array(node[order]), table.column("shard"), pa.array(to, pa.list_(pa.int64()))], ["node", "shard", "to"])

    built = dealt.groupBy(*cell, "own").applyInArrow(build, "node long, shard int, to array<long>")
    union = built.groupBy("node").agg(F.collect_list(F.struct("shard", "to")).alias("lists"))
    graph = checkpoint(stored.join(union, "node"), "vector-graph")

    # a division's index for every part of the queries, a part of the queries for every division
    each = F.sequence(F.lit(0), F.col("subs") - 1)
    roles = F.array_union(
        F.transform(each, lambda b: F.struct(F.col("own").alias("sub"), b.alias("block"))),
        F.transform(each, lambda s: F.struct(s.alias("sub"), F.col("own").alias("block"))),
    )
    spread = graph.select("*", F.explode("shards").alias("shard")).join(sizes, cell).withColumn("own", hashed)
    spread = spread.select("*", F.explode(roles).alias("role")).select(*cell, "role.*", "own", "node", "u", "weight", "shards", "lists")

    def search(table: pa.Table) -> pa.Table:
        shard, sub, block, dim = (table.column(c)[0].as_py() for c in ("shard", "sub", "block", "dim"))
        table = table.sort_by("node")
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        u, weight = matrix(table.column("u"), dim), table.column("weight").to_numpy()
        shards = table.column("shards").to_pylist()
        index, asked = np.flatnonzero(own == sub), np.flatnonzero(own == block)
        lists = table.column("lists").to_pylist()
        counted = np.zeros(len(node), np.int64)
        pairs, cross = np.zeros((2, 0), np.int64), []
        if len(index) and len(asked):
            here = node[index]
            inside, beyond = [], []  # places in the index; (shard, nodes) of lists that lead away
            for i in index:
                to = np.unique(np.concatenate([np.array(x["to"], np.int64) for x in lists[i]] or [here[:0]]))
                place = np.minimum(np.searchsorted(here, to), len(here) - 1)
                inside.append(place[here[place] == to])
                beyond.append([(x["shard"], x["to"]) for x in lists[i] if x["shard"] != shard and x["to"]])
            width = max(1, *(len(x) for x in inside))
            links = np.full((len(index), width), -1, np.int64)
            for i, x in enumerate(inside):
                links[i, : len(x)] = x
            medoid = int((u[index] @ u[index].mean(0)).argmax())
            of, to = range_search(u[asked], u[index], links, medoid, threshold, beam)
            of, to = asked[of], index[to]
            if sub == block:  # each end may have found the other
                both = np.unique(np.concatenate([of * len(node) + to, to * len(node) + of]))
                of, to = both // len(node), both % len(node)
            apart = of != to
            pairs = np.stack([of[apart], to[apart]])
            # the shards of most pairs are few different sets
            kinds: dict[tuple, int] = {}
            kind = np.array([kinds.setdefault(tuple(s), len(kinds)) for s in shards])
            sets = [set(k) for k in kinds]
            first = np.array([[min(a & b) == shard for b in sets] for a in sets])
            here_first = first[kind[pairs[0]], kind[pairs[1]]]
            np.add.at(counted, pairs[0][here_first], weight[pairs[1][here_first]])
            # lists of shards that the query isn't in: told for each kind of query, then for its pairs
            place = np.searchsorted(index, to)
            asks = kind[of] * len(index) + place
            leads = {a: away for a in np.unique(asks).tolist() if (away := [n for s, n in beyond[a % len(index)] if s not in sets[a // len(index)]])}
            onward = np.isin(asks, np.fromiter(leads, np.int64, len(leads)))
            hands: dict[int, set] = {}
            for q, a in zip(of[onward].tolist(), asks[onward].tolist(), strict=True):
                hands.setdefault(q, set()).update(*leads[a])
            cross = sorted(hands.items())
        root = _roots(len(node), *pairs)
        linked = np.flatnonzero(root != np.arange(len(node)))
        out = {
            "kind": np.repeat([0, 1], [len(asked), len(linked)]),
            "a": np.concatenate([node[asked], node[linked]]),
            "b": np.concatenate([counted[asked], node[root[linked]]]),
        }
        away = [(2, node[q], y) for q, ys in cross for y in sorted(ys)]
        arrays = [pa.array(np.concatenate([out[k], np.array([x[i] for x in away], np.int64)])) for i, k in enumerate(("kind", "a", "b"))]
        return pa.Table.from_arrays(arrays, ["kind", "a", "b"])

    results = checkpoint(spread.groupBy(*cell, "sub", "block").applyInArrow(search, "kind long, a long, b long"), "vector-links")
    counts = results.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("n"))
    forest = results.where("kind = 1").select("a", "b")

    # what was handed on: verified, then followed
    def side(name: str) -> DataFrame:
        return graph.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("u", "weight", "shards", "lists")))

    cosine = F.aggregate(F.zip_with("u_a", "u_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ask = results.where("kind = 2").select("a", "b").where("a != b").distinct()
    seen = links = None
    while True:
        asked = ask if seen is None else ask.join(seen, ["a", "b"], "left_anti")
        both = asked.join(side("b"), "b").join(side("a").drop("lists_a"), "a").where(~F.arrays_overlap("shards_a", "shards_b"))
        onward = F.filter("lists_b", lambda x: ~F.array_contains("shards_a", x["shard"]))
        looked = checkpoint(both.select("a", "b", "weight_a", "weight_b", (cosine >= threshold).alias("near"), onward.alias("lists")), "vector-handed-on")
        seen = looked.select("a", "b") if seen is None else seen.unionByName(looked.select("a", "b"))
        held = looked.where("near")
        if held.isEmpty():
            break
        found = held.select("a", "b", "weight_a", "weight_b").unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight_b").alias("weight_a"), F.col("weight_a").alias("weight_b")))
        links = found if links is None else links.unionByName(found)
        ask = held.select("a", F.explode("lists").alias("l")).select("a", F.explode("l.to").alias("b")).where("a != b").distinct()
    if links is not None:
        links = checkpoint(links.distinct(), "vector-crossing-links")
        counts = counts.unionByName(links.select(F.col("a").alias("node"), F.col("weight_b").alias("n")))
        forest = forest.unionByName(links.select("a", "b"))
    return checkpoint(counts.groupBy("node").agg(F.sum("n").alias("n")), "vector-counts"), forest


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, queries: int) -> float:
    """Share of the links of ``queries`` nodes (those whose hash is lowest)
    that was counted, against all rows; 1 where there are none."""
    asked = nodes.orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(queries).collect()
    by: dict[tuple, tuple[list, np.ndarray]] = {}
    for key in {(r.label, r.dim) for r in asked}:
        mine = [r for r in asked if (r.label, r.dim) == key]
        by[key] = [r.node for r in mine], np.array([r.u for r in mine])
    names = nodes.columns
    at = [names.index(c) for c in ("label", "dim", "u", "weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true: dict[int, int] = {}
        for batch in batches:
            label, dim, u, weight = (batch.column(i) for i in at)
            keys = list(zip(label.to_pylist(), dim.to_pylist(), strict=True))
            for key in set(keys) & by.keys():
                rows = pa.array([i for i, k in enumerate(keys) if k == key])
                near = by[key][1] @ matrix(u.take(rows), key[1]).T >= threshold
                for node, n in zip(by[key][0], near @ weight.take(rows).to_numpy(), strict=True):
                    true[node] = true.get(node, 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(true), pa.int64()), pa.array(list(true.values()), pa.int64())], ["node", "true"])

    true = nodes.mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    of = {r.node: r.weight for r in asked}
    found = {r.node: r.n for r in counts.where(F.col("node").isin(list(of))).collect()}
    there = sum(r.true - of[r.node] for r in true.collect())  # less the node itself
    return min(1.0, sum(found.get(k, 0) for k in of) / there) if there else 1.0


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    shard_rows: int = SHARD_ROWS,
    cell_rows: int = CELL_ROWS,
    overlap: int = OVERLAP,
    beam: int = BEAM,
    audited: int = AUDITED,
    recall_floor: float = RECALL_FLOOR,
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """(id column, ``n_links``, ``component_id``, ``kept``, ``audited_recall``)
    of every row: how many other rows it is linked with (equal labels, cosine
    of ``threshold`` or more), the smallest id that can be reached over links,
    and whether that is its own.

    Rows whose label is null, or whose vector is null, empty or zero or has a
    null or non-finite component, link with nothing; vectors of different
    lengths don't link. Equal vectors and repeated rows are searched once and
    count as often as they occur. Null ids take part and become a component's
    id only if all its ids are null. An empty table stays empty. Other columns
    are ignored. ``audited_recall`` is the share of links found, measured on
    ``audited`` queries against all rows; below ``recall_floor`` the search is
    done anew with more overlap and twice the beam, ``attempts`` times at most.
    """
    rows = checkpoint(
        vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), unit(F.col(f"`{vector_col}`")).alias("u")).withColumn("hash", F.xxhash64("label", "u")),
        "unit-vectors",
    )
    able = F.col("u").isNotNull() & F.col("label").isNotNull()
    same = ["hash", "label", "u"]
    grouped = rows.where(able).groupBy(*same).agg(F.count("*").alias("weight"), F.min("id").alias("first_id"))
    nodes = checkpoint(grouped.select("*", F.size("u").alias("dim"), F.monotonically_increasing_id().alias("node")), "vector-nodes")
    slim = nodes.select("node", "label", "dim", "u", "weight")
    for attempt in range(attempts):
        counts, forest = _found(slim, threshold, overlap + attempt, beam << attempt, shard_rows, cell_rows)
        recall = audit(slim, counts, threshold, audited)
        if recall >= recall_floor:
            break
    classes = connected_components(forest).withColumnRenamed("node", "_node")
    placed = checkpoint(nodes.join(classes, F.col("node") == F.col("_node"), "left").select("node", "first_id", F.coalesce("component", "node").alias("class")), "vector-classes")
    least = checkpoint(placed.groupBy("class").agg(F.min("first_id").alias("component_id")), "vector-class-ids")
    of_node = placed.join(least, "class").join(counts, "node", "left").select("node", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    known = checkpoint(nodes.join(of_node, "node").select(*same, (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-known")
    linked = rows.where(able).join(known, same).select("id", "n_links", "component_id")
    alone = rows.where(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("audited_recall"))
