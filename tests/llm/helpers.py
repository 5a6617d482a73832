"""Awkward documents that every operator has to cope with, and brute-force helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _hash string, _group string, _spans string, _found string, _key string, _quality string"


def rows(extra=(), seed=5, n=40):
    """(doc_id, text): prose, nulls, empties, ties, repeated rows, long texts."""
    rnd = random.Random(seed)
    vocabulary = [a + b for a in "th an er in on st".split() for b in "re ed ing ly at es".split()] + ["Été", "straße", "ñu", "don't", "42"]
    out = []
    for i in range(n):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120)))
        out.append((i, text.replace(" on", "\n on", rnd.randint(0, 4))))
    out += [(100, out[3][1]), (101, out[3][1]), (100, out[3][1])]  # copies, and a repeated row
    out += [(102, None), (103, ""), (104, " \n\t "), (None, out[5][1]), (None, None), (None, out[5][1])]
    out += [(105, "!?.. \x1c -- 😀 中文 Ⅷ ² ́"), (106, " ".join(rnd.choice(vocabulary) for _ in range(9000)))]
    return out + list(extra)


def documents(spark, extra=(), **kw):
    """The rows with the columns of documents and some that clash with the
    operators' own names."""
    full = [(i, t, "en", "s", len(t or ""), 7, "h", "g", "s", "f", "k", "q") for i, t in rows(extra, **kw)]
    return spark.createDataFrame(full, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def components(fps, max_bits=3):
    """Smallest reachable index of each of ``fps`` (a list of ints)."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= max_bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]
