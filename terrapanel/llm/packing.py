"""Sum-of-squares packing of tokenised documents into training sequences.

Documents become token ids plus one end token; longer ones are cut into
pieces of the sequence length. Pieces are placed by the sum-of-squares rule:
among the open sequences, take the residual gap for which the sum over gaps
of (number of open sequences with that gap) squared becomes smallest; open a
new sequence only if the piece fits in none. Pieces come in order of falling
length. The rule needs the count of open sequences per gap and nothing else,
so a group of pieces is placed with an array of ``capacity`` counts.

Spark deals the pieces into groups of about ``group_size`` rows; each group
is packed on its own and leaves only its last sequences partly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import checkpoint, fresh

CAPACITY = 2048
GROUP_SIZE = 32_768
_GROUP_SPAN = 1 << 40


def sum_of_squares(lengths: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length, in the order given.

    Each length is 1 to ``capacity``. Equal sums are settled for the smaller
    gap, equal gaps for the sequence that got it last.
    """
    lengths = np.asarray(lengths, np.int64)
    open_per_gap = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        # a gap g is taken off and g - size comes in its place; an exactly
        # filled gap leaves none behind
        here = open_per_gap[size:capacity]
        change = 2 * (open_per_gap[: capacity - size] - here) + 2
        if len(here):
            change[0] = 1 - 2 * here[0]
        change[here == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(here) else 0
        gap = size + best if len(here) and here[best] else 0
        if gap:
            bin_ = waiting[gap].pop()
            open_per_gap[gap] -= 1
        else:
            bin_, gap = used, capacity
            used += 1
        sequence[i], offset[i] = bin_, capacity - gap
        if left := gap - size:
            waiting[left].append(bin_)
            open_per_gap[left] += 1
    return sequence, offset


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: the id column, ``piece`` (from 0), ``start`` (ids of
    the document before it), ``length``, ``ids_crc32`` and, with ``keep_ids``,
    ``ids`` (little-endian uint32 bytes).

    A null or empty text is the end token alone. Rows are independent, so
    repeated rows and null ids give pieces of their own.
    """
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type)] + [T.StructField(n, T.LongType() if n != "piece" else T.IntegerType()) for n in ("piece", "start", "length", "ids_crc32")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)
    step = capacity * 4
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrapanel.llm.tokenizing import word_ids

        words = word_ids(tokenizer_path)
        for batch in batches:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = words.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out, names = [*out, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, *, length_col: str = "length", capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` must be stored (written and reread): its rows are numbered to
    deal them into groups, and a recomputed task has to number them alike.
    Lengths are 1 to ``capacity``; an empty table stays empty. Columns named
    like the new ones are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    group = fresh(pieces, "_group")[0]
    groups = max(1, -(-pieces.count() // group_size))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=group).sort_values(length_col, ascending=False, kind="stable")
        sequence, offset = sum_of_squares(rows[length_col].to_numpy(), capacity)
        return rows.assign(sequence_id=sequence + int(key[0]) * _GROUP_SPAN, offset=offset)

    dealt = pieces.withColumn(group, F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy(group).applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, keep_ids: bool = False, **columns) -> DataFrame:
    """Tokenise, cut and pack: the columns of ``token_pieces`` and ``pack``."""
    return pack(checkpoint(token_pieces(docs, tokenizer_path, capacity=capacity, keep_ids=keep_ids, **columns), "pieces"), capacity=capacity)
