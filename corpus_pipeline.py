"""The training-data pipeline: five stages over ``documents``.

Every stage calls one operator of ``terrapanel.llm`` on all that its
predecessor kept, and its decisions take effect. All but the last return the
columns of ``documents``. ``run`` writes each stage to the shared folder and
reads it again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import credentials, decontamination, packing, quality, simhash
from terrapanel.llm.common import checkpoint, fresh, table
from terrapanel.llm.queries import tokenizer_path, trusted_ids


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio against
    the documents labelled good."""
    into = fresh(docs, "_quality")[0]
    judged = quality.with_quality(docs, trusted_ids(table(spark, sf_dir, "labels")), into=into)
    return judged.where(F.col(into)["kept"]).drop(into)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the
    smallest id."""
    return simhash.deduplicate(docs, shingle=3, max_bits=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    into = fresh(docs, "_contamination")[0]
    found = decontamination.with_contamination(docs, table(spark, sf_dir, "benchmark"), into=into)
    return found.where(F.col(into)["n_hit"] == 0).drop(into)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced; ``n_chars``, if there is
    one, is counted anew."""
    clean = credentials.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, tokens and packing are beyond SQL; tests compare the
#: pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return docs
