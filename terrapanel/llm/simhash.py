"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints at distance ``max_bits`` or less, cut into ``max_bits // 2 +
1`` segments, agree in one segment up to one bit. Every fingerprint is
indexed under each segment as it is and under each of its one-wildcard
variants (a bit deleted). Fingerprints that share a plain segment, or a
variant with opposite values of the deleted bit, are candidates, so a pair
is met once per segment at most; the bit count of the difference decides.

Work is done on distinct fingerprints, each with its smallest document id,
so copies meet in no join. A bucket of more than ``bucket_limit`` members is
divided further by the variants of the bits outside its segment, to which
the same argument applies with the distance that is left: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import checkpoint, fresh
from terrapanel.llm.components import connected_components

BITS = 64
SEED = 42
BUCKET_LIMIT = 1024
#: Index entries that one task makes.
EXPLODED_ROWS = 1_000_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text: A-Z lower-cased, words
    between ASCII white space, ``shingle`` words joined by spaces (a shorter
    text whole), XXH64; a bit is set if it is in over half the hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):  # bounds the unpacked bits of a very long text
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id column, ``text_hash``, ``fp`` long) of every row; a null text
    counts as empty (0)."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], schema.names)

    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(own, F.xxhash64(text), text.cast("binary").alias("_text")).mapInArrow(run, schema)


def _cut(width: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of ``parts`` segments of ``width`` bits."""
    at = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _variants(value: Column, segments: list[tuple[int, int]]) -> Column:
    """The index entries of ``value``: array of (segment, deleted bit or -1,
    what is left, the deleted bit's value or 0)."""

    def entries(i: int, low: int, width: int) -> Column:
        mask = F.lit((1 << width) - 1 if width < BITS else -1).cast("long")
        part = F.shiftrightunsigned(value, low).bitwiseAND(mask)
        one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p)
        return F.transform(
            F.sequence(F.lit(-1), F.lit(width - 1)),
            lambda p: F.struct(
                F.lit(i).alias("seg"),
                p.alias("pos"),
                F.when(p < 0, part).otherwise(part.bitwiseAND(F.bitwise_not(one(F.greatest(p, F.lit(0)))))).alias("left"),
                F.when(p < 0, F.lit(0)).otherwise(F.call_function("getbit", part, F.greatest(p, F.lit(0))).cast("int")).alias("bit"),
            ),
        )

    return F.flatten(F.array(*(entries(i, low, width) for i, (low, width) in enumerate(segments))))


_KEY = ["seg", "pos", "left"]


def _meet(rows: DataFrame, key: list[str], pos: str, bit: str) -> DataFrame:
    """Pairs of ``rows`` that share ``key``: any two of a plain segment, two
    with opposite deleted bits of a variant."""
    a = rows.select(*key, F.col("fp").alias("a"), F.col(bit).alias("_bit_a"))
    b = rows.select(*key, F.col("fp").alias("b"), F.col(bit).alias("_bit_b"))
    plain = (F.col(pos) < 0) & (F.col("a") < F.col("b"))
    variant = (F.col(pos) >= 0) & (F.col("_bit_a") < F.col("_bit_b"))
    pairs = a.join(b, key).where(plain | variant)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(distinct: DataFrame, max_bits: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs (``a`` < ``b``) of fingerprints that differ in at most
    ``max_bits`` bits, each once. ``distinct`` is a stored table with one row
    per fingerprint ``fp``."""
    segments = _cut(BITS, max_bits // 2 + 1)
    each = sum(width + 1 for _, width in segments)  # entries of a fingerprint
    tasks = max(1, -(-distinct.count() * each // EXPLODED_ROWS))
    # a small table has few files: it is dealt out by what the explosion makes of it
    entries = distinct.select("fp").repartition(tasks, "fp").select("fp", F.explode(_variants(F.col("fp"), segments)).alias("e")).select("fp", "e.*")
    sizes = entries.groupBy(*_KEY).agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))
    met = sizes.where(F.when(F.col("pos") < 0, F.col("n") > 1).otherwise((F.col("ones") > 0) & (F.col("ones") < F.col("n"))))
    # most entries are alone in their bucket; the few that aren't are stored
    # and the planner broadcasts or shuffles them by their size
    buckets = checkpoint(met.select(*_KEY, (F.col("n") > bucket_limit).alias("large")), "simhash-buckets")
    members = checkpoint(entries.join(buckets, _KEY), "simhash-members")
    pairs = _meet(members.where(~F.col("large")), _KEY, "pos", "bit")
    large = members.where(F.col("large"))
    # what lies outside the bucket's segment, turned to the low bits
    for i, (low, width) in enumerate(segments):
        rest = BITS - width
        if not rest:
            continue
        high = F.shiftleft(F.shiftrightunsigned("fp", low + width), low) if low + width < BITS else F.lit(0).cast("long")
        outside = high.bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << low) - 1).cast("long")))
        own = large.where(F.col("seg") == i).withColumn("_outside", outside)
        for kind, spare in ((F.col("pos") < 0, max_bits), (F.col("pos") >= 0, max_bits - 1)):
            sub = own.where(kind).select("fp", *_KEY, "bit", F.explode(_variants(F.col("_outside"), _cut(rest, spare // 2 + 1))).alias("s"))
            sub = sub.select("fp", *_KEY, "bit", F.col("s.seg").alias("s_seg"), F.col("s.pos").alias("s_pos"), F.col("s.left").alias("s_left"), F.col("s.bit").alias("s_bit"))
            pairs = pairs.unionByName(_meet_twice(sub))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return near.distinct()


def _meet_twice(sub: DataFrame) -> DataFrame:
    """Pairs within large buckets that share a variant of the outside bits."""
    key = [*_KEY, "s_seg", "s_pos", "s_left"]
    a = sub.select(*key, F.col("fp").alias("a"), F.col("bit").alias("_bit_a"), F.col("s_bit").alias("_sub_a"))
    b = sub.select(*key, F.col("fp").alias("b"), F.col("bit").alias("_bit_b"), F.col("s_bit").alias("_sub_b"))
    opposite = (F.col("pos") < 0) | (F.col("_bit_a") != F.col("_bit_b"))
    opposite &= (F.col("s_pos") < 0) | (F.col("_sub_a") != F.col("_sub_b"))
    return a.join(b, key).where((F.col("a") < F.col("b")) & opposite).select("a", "b")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """(id column, ``text_hash``, ``fp``, ``class``, ``component_id``) of
    every row: the component's smallest fingerprint, and the smallest id that
    can be reached over links, its own included.

    Null texts count as empty; empty texts have fingerprint 0 and link like
    any other. Null ids take part and never become a component's id unless
    all its ids are null. Repeated rows stay repeated.
    """
    stored = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = checkpoint(stored.groupBy("fp").agg(F.min(f"`{id_col}`").alias("first_id")), "distinct-fingerprints")
    classes = connected_components(links(distinct, max_bits, bucket_limit))
    # stored between the steps, so each join deals out both of its sides and
    # the planner can split a fingerprint that very many documents share
    grouped = checkpoint(distinct.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("class")), "fingerprint-classes")
    smallest = checkpoint(grouped.groupBy("class").agg(F.min("first_id").alias("component_id")), "class-ids")
    by_fp = checkpoint(grouped.join(smallest, "class").select("fp", "class", "component_id"), "fingerprint-ids")
    return stored.join(by_fp, "fp").select(F.col(f"`{id_col}`"), "text_hash", "fp", "class", "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each near-duplicate component, with all columns: the one
    with the smallest id (null ids last), of equal ids the one whose text
    hashes lowest, of rows with equal id and text any one.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, max_bits=max_bits)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    first = found.groupBy("class").agg(F.min(F.struct(own.isNull().alias("no_id"), own.alias("id"), "text_hash")).alias("kept"))
    key = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    names = fresh(docs, "_key", "_hash")
    kept = checkpoint(first.select(key(F.col("kept.id")).alias(names[0]), F.col("kept.text_hash").alias(names[1])), "kept-documents")
    keyed = docs.select("*", key(own).alias(names[0]), F.xxhash64(text).alias(names[1]))
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select(*(F.col(f"`{c}`") for c in docs.columns))
