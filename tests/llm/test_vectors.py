"""Vector codes, embedding near-duplicates and hard negatives against brute
force, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import hard_negatives, queries, vector_codes, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, u int, node int, shard string, a int, cell int, `x.y` int"
CLASH = ("i", 1, 2, 3, "s", 4, 5, 6)
NAN = float("nan")


def clustered(n=260, dim=16, seed=3):
    """(vec_id, vector, label): groups of near copies among scattered vectors."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(40, dim))
    out = []
    for i in range(n):
        at = int(rnd.integers(0, 6)) if rnd.random() < 0.5 else int(rnd.integers(6, 40))
        x = centres[at] + rnd.normal(size=dim) * (0.03 if at < 6 else 0.6)
        out.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), at % 3))
    return out


def awkward(n=260):
    """The above with copies, nulls, zeros and vectors that don't count."""
    good = clustered(n)
    dim = len(good[0][1])
    copies = [(1000 + i, good[5][1], good[5][2]) for i in range(9)]
    scaled = [(1100, [2 * x for x in good[6][1]], good[6][2]), (1101, good[7][1], None), (1102, [0.0] * dim, 1)]
    bad = [(1200, None, 1), (1201, [], 1), (1202, [None] + good[0][1][1:], 1), (1203, [NAN] + good[0][1][1:], 1), (1204, [math.inf] + good[0][1][1:], 1)]
    return good + copies + scaled + bad


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def valid(rows):
    return [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


# ------------------------------------------------------------ vector codes


def brute_codes(rows, parts, entries, rounds, scale):
    kept = sorted(valid(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(np.array([r[1] for r in kept], float) * scale).astype(int)
    d = v.shape[1] // parts
    codes, errors, books = [], 0, []
    for p in range(parts):
        x = v[:, p * d : (p + 1) * d]
        book = x[:entries].copy()
        nearest = lambda: ((x[:, None] - book[None]) ** 2).sum(2)  # noqa: B023, E731
        for _ in range(rounds):
            own = nearest().argmin(1)
            for e in range(len(book)):
                if (own == e).any():
                    book[e] = x[own == e].sum(0) // (own == e).sum()
        codes.append(nearest().argmin(1))
        errors = errors + nearest().min(1)
        books.append(book)
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    return sorted((r[0] if r[0] is not None else -1, tuple(c), int(e), by_label[r[2]]) for r, c, e in zip(kept, np.array(codes).T.tolist(), errors, strict=True)), books


@pytest.mark.parametrize(("entries", "shard_rows"), [(8, 50), (40, 8192), (400, 100)])
def test_codes_equal_brute_force(spark, entries, shard_rows):
    rows = awkward() + [(3, clustered()[9][1], 0), (3, clustered()[9][1], 0), (None, clustered()[11][1], None)]
    coded, books = vector_codes.compress(frame(spark, rows), parts=4, entries=entries, rounds=3, scale=64, shard_rows=shard_rows)
    want, want_books = brute_codes(rows, 4, entries, 3, 64)
    got = sorted((-1 if r.vec_id is None else r.vec_id, tuple(r.codes), r.error, r.label_error) for r in coded.collect())
    assert got == want
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))
    assert vector_codes.books_sha256(books) == hashlib.sha256(",".join(str(x) for b in want_books for x in b.reshape(-1)).encode()).hexdigest()


def test_balls_are_owned_whole():
    """Candidate lists shrink: in tight groups no point is compared by itself."""
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-500, 500, (20, 4))
    points = np.repeat(centres, 100, axis=0) + rnd.integers(-2, 3, (2000, 4))
    tree = vector_codes.build_tree(points)
    placed = points[tree["order"]]
    sizes = tree["high"] - tree["low"]
    inner = tree["left"] >= 0
    assert sorted(tree["order"].tolist()) == list(range(2000)) and sizes[-1] == 2000
    assert (sizes[inner] == sizes[tree["left"][inner]] + sizes[tree["right"][inner]]).all()
    for low, high, total, centre, radius in zip(*(tree[k] for k in ("low", "high", "total", "centre", "radius")), strict=True):
        assert (placed[low:high].sum(0) == total).all()
        assert np.sqrt(((placed[low:high] - centre) ** 2).sum(1)).max() <= radius + 1e-9
    code, total, number, loose = vector_codes.owners(tree, placed, centres)
    want = ((placed[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (code == want).all() and (number == np.bincount(want, minlength=20)).all() and loose < 400
    assert all((total[e] == placed[want == e].sum(0)).all() for e in range(20))
    # equal entries: the lower index; equal points: one ball
    same = vector_codes.owners(tree, placed, np.vstack([centres, centres]))
    assert (same[0] == want).all()
    one = vector_codes.build_tree(np.full((500, 3), 7))
    assert len(one["left"]) == 1 and one["radius"][0] == 0


def test_codes_of_nothing_and_unfit_vectors(spark):
    empty, books = vector_codes.compress(frame(spark, []))
    assert empty.columns == ["vec_id", "label", "codes", "error", "label_error"] and empty.count() == 0 and vector_codes.books_sha256(books) == hashlib.sha256(b"").hexdigest()
    for rows in ([(1, [1.0] * 8, 0), (2, [1.0] * 4, 0)], [(1, [1.0] * 6, 0)], [(1, [1e30] * 8, 0)]):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.compress(frame(spark, rows))


# ------------------------------------------------------------ near-duplicates


def brute_links(rows, threshold):
    """(n_links, component_id) of every row, in order."""
    n = len(rows)
    near = [[] for _ in rows]
    units = []
    for r in rows:
        able = valid([r]) and any(r[1]) and r[2] is not None
        x = np.array(r[1], float) if able else None
        units.append(x / np.linalg.norm(x) if able else None)
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(n):
        reached, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in reached:
                    reached.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in reached if rows[k][0] is not None]
        out.append((len(near[i]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 12, "cell_rows": 2048}, {"shard_rows": 500, "cell_rows": 30}, {"shard_rows": 12, "cell_rows": 16, "overlap": 1}])
def test_links_equal_brute_force(spark, limits):
    rows = awkward(220) + [(2, clustered()[8][1], 1), (2, clustered()[8][1], 1), (None, clustered()[8][1], clustered()[8][2]), (None, None, 0)]
    got = vector_dedup.near_duplicates(frame(spark, rows), threshold=0.98, recall_floor=0.999, **limits).collect()
    want = sorted(((r[0] if r[0] is not None else -1), n, -1 if c is None else c) for r, (n, c) in zip(rows, brute_links(rows, 0.98), strict=True))
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert got[0].audited_recall >= 0.999
    have = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got)
    assert have == want


def test_links_of_nothing(spark):
    assert vector_dedup.near_duplicates(frame(spark, [])).count() == 0
    bad = [r for r in awkward() if r[0] >= 1101]
    got = vector_dedup.near_duplicates(frame(spark, bad)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(r[0], 0, r[0], True) for r in bad}


def test_pruning_and_search():
    """A neighbour is left out only if a nearer one leads to it; the walk
    reaches far groups from one start, and looks at a part of the points."""
    rnd = np.random.default_rng(0)
    x = np.vstack([c + rnd.normal(size=(30, 24)) * 0.02 for c in rnd.normal(size=(20, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = vector_dedup.pruned_graph(x)
    away = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    assert links.shape[1] <= 2 * vector_dedup.DEGREE and all(i not in row for i, row in enumerate(links.tolist()))
    pool = np.argsort(away, axis=1)[:, 1:40]
    chosen = vector_dedup._prune(away, pool, 8, 1.2)
    for p, row in enumerate(chosen.tolist()):
        kept = [r for r in row if r >= 0]
        assert kept[0] == pool[p][0]
        for i, y in enumerate(kept):
            assert not any(1.2 * away[z, y] <= away[p, y] for z in kept[:i])
    of, to = vector_dedup.range_search(x, x, links, 0, 0.98)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.98), strict=True)}
    got = set(zip(of.tolist(), to.tolist(), strict=True))
    assert got <= want and len(got) >= 0.95 * len(want) and len(of) == len(got)


def test_audit_tells_what_is_missing(spark):
    rows = [(i, [1.0, 0.001 * i], 0) for i in range(10)]
    nodes = spark.createDataFrame([(r[0], r[2], 2, (np.array(r[1]) / np.linalg.norm(r[1])).tolist(), 1) for r in rows], "node long, label int, dim int, u array<double>, weight long")
    all_ = spark.createDataFrame([(i, 9) for i in range(10)], "node long, n long")
    assert vector_dedup.audit(nodes, all_, 0.98, 100) == 1
    assert vector_dedup.audit(nodes, all_.where("node < 5"), 0.98, 100) == 0.5


# ------------------------------------------------------------ hard negatives


def brute_negatives(rows, is_anchor, scale=256, positives=5, negatives=3):
    kept = [(r[0], np.floor(np.array(r[1], float) * scale).astype(int), r[2]) for r in valid(rows) if r[2] is not None]
    out = []
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for i, x, label in kept:
        if i is None or not is_anchor(i):
            continue
        scored = [(j, int(x @ y), other) for j, y, other in kept if j != i]
        for p, s, _ in sorted((z for z in scored if z[2] == label), key=order)[:positives]:
            window = sorted((z for z in scored if z[2] != label and 50 * s <= 100 * z[1] <= 95 * s), key=order)[:negatives]
            out += [(i, p, k + 1, z[0], s, z[1]) for k, z in enumerate(window)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "cell"), [(1024, 8192), (7, 40)])
def test_negatives_equal_brute_force(spark, block, cell):
    rows = awkward() + [(4, clustered()[8][1], 1), (5, clustered()[5][1], 2), (5, clustered()[5][1], 2), (None, clustered()[8][1], 0), (1300, [-x for x in clustered()[0][1]], 1)]
    rows = [r for r in rows if r[0] != 1100]  # its scores are fine, its length isn't one of interest
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, block_anchors=block, cell_rows=cell)
    have = sorted((tuple(r) for r in got.collect()), key=str)
    assert have == brute_negatives(rows, lambda i: i % 5 == 0) and len(have) > 100


def test_negatives_of_few_rows(spark):
    every = F.lit(True)
    assert hard_negatives.mine(frame(spark, []), every).count() == 0
    assert hard_negatives.mine(frame(spark, [(1, [1.0, 0.0], 0)]), every).count() == 0
    assert hard_negatives.mine(frame(spark, [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)]), F.lit(False)).count() == 0
    two = hard_negatives.mine(frame(spark, [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.75, 0.0], 1), (4, [0.97, 0.0], 1)]), F.col("vec_id") == 1)
    assert [tuple(r) for r in two.collect()] == [(1, 2, 1, 3, 65536, 49152)]
    zero = hard_negatives.mine(frame(spark, [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 0.5], 1), (4, [-1.0, 0.0], 0)]), F.col("vec_id") == 1)
    assert [tuple(r) for r in zero.collect()] == [(1, 2, 1, 3, 0, 0)]


# ------------------------------------------------------------ registered queries


@pytest.mark.parametrize("name", ["op11_vector_code_compression", "op12_embedding_near_dedup", "op13_hard_negative_mining"])
def test_queries_equal_their_sql(spark, tmp_path, name):
    rows = [(i, x, z) for i, x, z in awkward(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    have = sorted(map(tuple, got.select(*want.columns).collect()), key=key)
    assert have == sorted(want.fetchall(), key=key) and have
