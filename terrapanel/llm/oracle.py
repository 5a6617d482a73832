"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Vectors that take part: not null, with finite components only.
_WHOLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """op11: each round is a pair of steps, nearest entry and new entries."""
    width = f"(len(v) // {parts})"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings WHERE {_WHOLE})",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[{width} * p + 1 : {width} * (p + 1)] AS x FROM kept, range({parts}) AS t(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    nearest = (
        "SELECT a.vec_id, a.label, a.p, any_value(a.x) AS x, "
        "min({{'d': list_dot_product(a.x, a.x) - 2 * list_dot_product(a.x, b.x) + list_dot_product(b.x, b.x), 'e': b.e}}) AS near "
        "FROM parts a JOIN book{0} b ON a.p = b.p GROUP BY a.vec_id, a.label, a.p"
    )
    for k in range(rounds):
        steps += [
            f"near{k} AS MATERIALIZED ({nearest.format(k)})",
            f"mean{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, near.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{k}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i) GROUP BY p, near.e, i) GROUP BY p, e)",
            f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.x, book{k}.x) AS x FROM book{k} LEFT JOIN mean{k} USING (p, e))",
        ]
    steps += [
        f"last AS MATERIALIZED ({nearest.format(rounds)})",
        "coded AS (SELECT vec_id, label, string_agg(format('{:02x}', near.e), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error FROM last GROUP BY vec_id, label)",
        f"hashed AS (SELECT sha256(string_agg(x[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM book{rounds}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i))",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, hashed"


def vector_dedup(threshold: float = 0.98) -> str:
    """op12: all pairs of equal labels, then the reachable ids."""
    return f"""
WITH RECURSIVE able AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND {_WHOLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= {threshold}),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = vec_id"""


def hard_negatives() -> str:
    """op13: all scores of the anchors, ranked twice."""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER own)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN (SELECT * FROM scores WHERE NOT same) USING (anchor_id)
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW own AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY rank <= 3"""
