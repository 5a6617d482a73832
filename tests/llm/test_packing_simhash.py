"""Packing and SimHash against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrapanel.llm import components, packing, simhash
from terrapanel.llm.common import checkpoint
from terrapanel.llm.tokenizing import WordIds

from .helpers import components as brute_components
from .helpers import documents, nothing, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizers():
    tokenizer = Tokenizer.from_file(PATH)
    odd = ["", "a\x1cb", "ΟΔΟΣ Σ", "é É", "x<|endoftext|>y", "a b\u0085c d", "\x00\x7f\x85", "İstanbul", "1²½Ⅷ", "it's'll", "😀 中文"]
    words = WordIds(PATH, max_runs=20, max_pieces=10)  # small: they overflow
    for text in [*odd, *(t or "" for _, t in rows())]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_new_latin_words_take_the_short_way():
    """Letters alone, and visible ASCII, go without the general pattern."""
    tokenizer, words = Tokenizer.from_file(PATH), WordIds(PATH)
    words.pieces = None
    for text in ["Heinea ier. it's'll a1b22,(c)%%%", "Éaiauxeux öpfbe ciónñezes", "E\u0301lan"]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_sum_of_squares_is_the_stated_rule():
    """Against a packer that tries every gap and adds up all squares."""
    rnd = random.Random(1)
    lengths = sorted((rnd.randint(1, 12) for _ in range(80)), reverse=True)
    got, _ = packing.sum_of_squares(lengths, 12)
    gaps = []  # per sequence
    for size, chosen in zip(lengths, got, strict=True):
        fitting = {g for g in gaps if g >= size}

        def total(g, size=size):
            after = sorted(gaps)
            after.remove(g)
            after += [g - size]
            return sum(after.count(x) ** 2 for x in set(after) if x)

        if not fitting:
            assert chosen == len(gaps)
            gaps.append(12 - size)
            continue
        best = min(total(g) for g in fitting)
        assert chosen < len(gaps) and total(gaps[chosen]) == best
        gaps[chosen] -= size


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_a_partition(spark, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack_documents(documents(spark), PATH, capacity=capacity, keep_ids=True).toPandas()
    want = []
    for i, text in rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want.append((-1 if i is None else i, k, at, len(part) // 4, zlib.crc32(part)))
    have = got.assign(doc_id=got.doc_id.fillna(-1).astype(int))
    assert sorted(map(tuple, have[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    assert all(zlib.crc32(i) == c for i, c in zip(got.ids, got.ids_crc32, strict=True))
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= capacity
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // capacity) + 1


def test_packing_nothing_and_groups(spark):
    assert packing.pack_documents(nothing(spark), PATH).count() == 0
    many = checkpoint(spark.range(500).select("id", (F.col("id") % 7 + 1).alias("length"), F.lit(0).alias("offset")))
    got = packing.pack(many, capacity=10, group_size=100).toPandas()
    assert len(got) == 500 and got.groupby("sequence_id").length.sum().max() <= 10


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_all_pairs(spark):
    base = rows()[20][1]
    near = [(200 + k, base.replace("thing", "thong", k)) for k in range(4)]
    every = rows(near)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(documents(spark, near)).collect())
    fps = [brute_fingerprint(t) for _, t in every]
    roots = brute_components(fps)
    least = {r: min((i for (i, _), q in zip(every, roots, strict=True) if q == r and i is not None), default=None) for r in set(roots)}
    assert got == sorted((i if i is not None else -1, f, least[r]) for (i, _), f, r in zip(every, fps, roots, strict=True))
    assert simhash.near_duplicates(nothing(spark)).count() == 0


@pytest.mark.parametrize("max_bits, limit", [(3, 1024), (3, 2), (4, 2), (1, 1024), (0, 2)])
def test_links_equal_all_pairs(spark, max_bits, limit):
    """Also where every bucket is divided (limit 2)."""
    rnd = random.Random(9)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = {s for s in seeds} | {0, 2**64 - 1, 1}
    for s in seeds[:6]:
        for _ in range(14):
            x = s
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    table = checkpoint(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = sorted((r.a, r.b) for r in simhash.links(table, max_bits, limit).collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits)
    assert got == want


def test_components_of_chains_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)] + [(60, 50), (50, 60), (50, 50), (70, 60), (90, 90)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 70: 50}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_row_of_each(spark):
    kept = simhash.deduplicate(documents(spark)).collect()
    fps = [brute_fingerprint(t) for _, t in rows()]
    assert len(kept) == len(set(brute_components(fps)))
    assert kept[0].__fields__ == documents(spark).columns
    assert {r.doc_id for r in kept}.isdisjoint({100, 101})
