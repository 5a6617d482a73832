"""Offset-mapped token counts of fields and sections.

A document is its fields, joined by a separator, and is encoded once, whole;
encoding the parts one by one would cut other tokens at the seams. Every
token's character span is interval-joined to the sections, which tile the
document: a field, or each line of it, with the line end or separator that
follows it. A token that crosses a boundary goes whole to the section that
holds most of its characters, to the earlier one if two hold equally many;
so the counts of a document's sections add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SpanEncoder:
    """Whole-text encoder of a byte-level rank file, with character spans."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("section-counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first character and the one after the last of each
        token. Tokens that share a character each have it in their span."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        if not len(ids):
            return ids, ids, ids
        end = np.cumsum(self.width[ids])
        start = end - self.width[ids]
        if text.isascii():
            return ids, start, end
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return ids, char[start], char[end - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary.

    ``bounds``: first characters of the sections, ascending, from 0.
    """
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    owner, crossing = first.copy(), first != last
    for i in np.flatnonzero(crossing):
        edges = np.concatenate(([start[i]], bounds[first[i] + 1 : last[i] + 1], [end[i]]))
        owner[i] = first[i] + int(np.diff(edges).argmax())  # argmax: the first of equals
    return owner, crossing


def section_token_counts(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", fields: Sequence[str] = ("text",), separator: str = "\n", by_line: bool = True
) -> DataFrame:
    """One row per section: id column, ``field`` (name), ``section`` (from 0
    within the document), ``start`` and ``end`` (characters of the document),
    ``n_tokens``, ``n_crossing`` (those of them that cross a boundary) and
    ``doc_tokens``.

    A null field counts as empty. An empty document has one section per field
    and no tokens. ``k`` line ends in a field make ``k + 1`` sections, the
    last possibly empty. Rows are independent: repeated rows and null ids
    give rows of their own.
    """
    fields = list(fields)
    counts = ["start", "end", "n_tokens", "n_crossing", "doc_tokens"]
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("field", T.StringType()), T.StructField("section", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in counts]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpanEncoder(ranks_path, pattern)
        for batch in batches:
            rows: list[int] = []
            names: list[str] = []
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                texts = [batch.column(1 + k)[i].as_py() or "" for k in range(len(fields))]
                starts, owners, at = [], [], 0
                for name, text in zip(fields, texts, strict=True):
                    starts.append(at)
                    owners.append(name)
                    if by_line:
                        here = text.find("\n")
                        while here >= 0:
                            starts.append(at + here + 1)
                            owners.append(name)
                            here = text.find("\n", here + 1)
                    at += len(text) + len(separator)
                whole = separator.join(texts)
                bounds = np.array(starts, np.int64)
                ids, start, end = encoder.spans(whole)
                owner, crossing = allocate(start, end, bounds)
                n = len(bounds)
                rows += [i] * n
                names += owners
                for part, values in zip(
                    parts,
                    (
                        np.arange(n),
                        bounds,
                        np.append(bounds[1:], len(whole)),
                        np.bincount(owner, minlength=n),
                        np.bincount(owner[crossing], minlength=n),
                        np.full(n, len(ids)),
                    ),
                    strict=True,
                ):
                    part.append(values)
            columns = [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                [id_col, "field", "section", *counts],
            )

    chosen = [F.col(id_col), *(F.col(c).cast("string").alias(f"_field_{i}") for i, c in enumerate(fields))]
    return docs.select(*chosen).mapInArrow(run, schema)
