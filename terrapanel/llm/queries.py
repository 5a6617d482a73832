"""The named queries of this subpackage, one per operator, over the shared
tables, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import credentials, decontamination, hard_negatives, html_text, langid, oracle, packing, quality, simhash, token_counts, toxicity, vector_codes, vector_dedup, warc
from terrapanel.llm.common import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the package lies on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces placed in sequences of 2048 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that are labelled good: the target of the quality ratio."""
    return labels.where(F.col("quality") == 1).select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_quality(docs, trusted_ids(table(spark, sf_dir, "labels"))).select("doc_id", "quality.*")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, normalised and read back."""
    back = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    id_ = lambda c: F.col(c).cast("long").alias(c)
    return back.select(id_("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_("refers_to"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = credentials.credential_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(credentials.listed(F.col("base")), 256)
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), base.alias("base_sha256"), credentials.listed(F.col("spans")).alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded whole."""
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, by_line=True)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector in four codebooks of 256 entries."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.select("vec_id", vector_codes.hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98).select("vec_id", "n_links", "component_id", "kept")


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives; a seventh of the labels is
    changed to the next one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low_percent=50, high_percent=95, scale=256)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_secret_scans": op8_secret_scans,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_vector_code_compression": op11_vector_code_compression,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_hard_negative_mining": op13_hard_negative_mining,
}

ORACLE: dict[str, str] = {
    "op11_vector_code_compression": oracle.vector_codes(),
    "op12_embedding_near_dedup": oracle.vector_dedup(),
    "op13_hard_negative_mining": oracle.hard_negatives(),
}
