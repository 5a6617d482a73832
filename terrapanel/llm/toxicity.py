"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier is a linear model over the presence of words and of word
beginnings (three to eight letters: insults are inflected). It learns from
confirmed toxic texts and unlabelled ones, which hold toxic texts too, at
the class prior ``pi``. With ``l`` the logistic loss, the risk is

    pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)])

whose second term estimates the risk on clean texts: it can't be below zero,
and where a step makes it so the step is taken back (Kiryo et al., 2017).
The prior is the share of toxic labels among all training labels. The texts
to fit on are bounded samples (the rows whose ids hash lowest); every row is
scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import checkpoint
from terrapanel.llm.langid import held_out

#: Bounds of the samples to fit on and of the vocabulary.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 3000, 9000, 512
#: Least difference of a feature's two frequencies, in standard errors.
LEAST_Z = 4.5
_STEMS = range(3, 9)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """The distinct words of a text, lower-cased, and their beginnings (``*``
    stands for any rest, none included)."""
    found = set(_WORD.findall(text.lower()))
    out = set(found)
    for size in _STEMS:
        out.update([w[:size] + "*" for w in found if len(w) >= size])
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, l2: float = 1e-4, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk's minimum, by Adam over the
    full samples (rows: texts; columns: features, 0 or 1)."""
    width = positive.shape[1]
    w = np.zeros(width + 1, np.float64)
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    soft = lambda z: np.logaddexp(0, z)

    def mean_gradient(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(rows.T @ slope.astype(np.float32), slope.sum()) / len(rows)

    for step in range(1, steps + 1):
        fp, fu = positive @ w[:-1].astype(np.float32) + w[-1], unlabelled @ w[:-1].astype(np.float32) + w[-1]
        clean_risk = soft(fu).mean() - prior * soft(fp).mean()
        clean = mean_gradient(unlabelled, sigma(fu)) - prior * mean_gradient(positive, sigma(fp))
        if clean_risk >= -slack:
            gradient = prior * mean_gradient(positive, -sigma(-fp)) + clean
        else:
            gradient = -clean
        gradient[:-1] += l2 * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _sampled(rows: DataFrame, bound: int) -> DataFrame:
    """The rows with the ``bound`` lowest hashes of their ids (a few more if
    ids repeat)."""
    last = rows.select(F.xxhash64("_id").alias("h")).distinct().orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    return rows.where(F.xxhash64("_id") <= last) if last is not None else rows.limit(0)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(features(t or "")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "features"])


def learn(positive: DataFrame, unlabelled: DataFrame, prior: float) -> tuple[dict[str, float], float]:
    """Weight of every chosen feature, and the bias. ``positive`` and
    ``unlabelled`` have ``_id`` and ``text``.

    Features are those of at least 2 and 0.5 % of the sampled toxic texts
    whose frequencies in the two samples differ by ``LEAST_Z`` standard
    errors, ``MAX_FEATURES`` at most, the largest differences first.
    """
    both = _sampled(positive, MAX_POSITIVE).select(F.lit(1).alias("toxic"), "text").unionByName(_sampled(unlabelled, MAX_UNLABELLED).select(F.lit(0).alias("toxic"), "text"))
    rows = checkpoint(both.mapInArrow(_feature_rows, "toxic int, features array<string>"), "toxicity-sample")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}, -np.inf if not sizes.get(1) else 0.0
    n_pos, n_unl = sizes[1], sizes[0]
    seen = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u"))
    share = (F.col("p") + F.col("u")) / (n_pos + n_unl)
    z = (F.col("p") / n_pos - F.col("u") / n_unl) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_unl) + 1e-12)
    often = seen.where(F.col("p") >= max(2, 0.005 * n_pos)).withColumn("z", F.abs(z))
    chosen = often.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    vocabulary = sorted(r.feature for r in chosen.select("feature").collect())
    place = {f: i for i, f in enumerate(vocabulary)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [[place[f] for f in found if f in place] for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32()))], ["toxic", "at"])

    # sorted: the sums of the fit, and so its result, don't hang on the order
    # in which the rows arrive
    got = sorted((r.toxic, tuple(r.at)) for r in rows.mapInArrow(indexed, "toxic int, at array<int>").collect())
    matrix = np.zeros((len(got), len(vocabulary)), np.float32)
    for i, (_, at) in enumerate(got):
        matrix[i, list(at)] = 1
    marked = np.array([t == 1 for t, _ in got])
    weight, bias = fit(matrix[marked], matrix[~marked], prior)
    return dict(zip(vocabulary, weight.tolist(), strict=True)), bias


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """(id column, ``held_out``, ``score`` 0 to 1, ``predicted`` int) of every row.

    Labels are learnt from ids that aren't held out; an id with several
    labels is toxic if one of them is. Null and empty texts get the score of
    a text without a known feature. Without a toxic label every score is 0.
    Repeated rows stay repeated; null ids are never held out and not learnt from.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    known = rows.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), "text")
    marks = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull() & ~held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max(toxic_col).alias("_toxic"))
    n, n_toxic = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("_toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(max(n_toxic / n, 1e-4), 0.9) if n else 0.1
    toxic_ids = _sampled(marks.where(F.col("_toxic") == 1), MAX_POSITIVE).select("_id")
    # the ids number MAX_POSITIVE at most, so the join's other side isn't moved
    weights, bias = learn(known.join(F.broadcast(toxic_ids), "_id", "left_semi"), known, prior)
    vocabulary = frozenset(weights)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([sum(sorted(map(weights.__getitem__, features(t or "") & vocabulary))) for t in batch.column(2).to_pylist()], np.float64) + bias
            score = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    chosen = rows.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "text")
    return chosen.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")
