"""Benchmark decontamination by a prefix-filtered set join.

An item is its windows of ``window`` successive words; a shorter one is one
window. A window is a set of word shingles, each at its offset. A text that
holds the window holds all of them, so of the shingles, ordered by how rare
they are in the corpus, the rarest alone is the necessary prefix. Texts and
windows are joined on it; the shingle's place in the text less its offset is
the only place where the window can begin (positional bound), it must begin
and end within the text (length bound), and its words are then compared one
by one with the text's.

All of it is SQL functions. The corpus is read twice: once for its shingles
that the benchmark has too, of all sizes in one pass over the words, once for
the comparison and the counts. Until then windows are carried by number; their
words come to a text once per place, the lists of their items once per window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import ascii_lower, bind, checkpoint, fresh

WINDOW = 10
SHINGLE = 5
#: Distinct shingles of a benchmark that are broadcast, at most (some 100 MB as a hash table).
WANTED_ROWS = 2_000_000
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(1))


def _shingles(hashes: Column, sizes: list[int]) -> Column:
    """(``at``, ``shingle``) for every ``size`` successive words, of every
    size, from the words' hashes; the size is part of the hash."""

    def of(size: int) -> Column:
        firsts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
        return F.transform(firsts, lambda h, i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), h, *(F.get(hashes, i + j) for j in range(1, size))).alias("shingle")))

    return F.concat(*map(of, sizes))


def _shingled(array: Column, sizes: list[int]) -> Column:
    return bind(F.transform(array, lambda w: F.xxhash64(w)), lambda hashes: _shingles(hashes, sizes))


def item_windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``words`` and the ids (strings) of their items.
    Items without a word have none; an item without an id is in no list."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.explode(F.array(words(F.col(f"`{text_col}`")))).alias("all"))
    rows = rows.where(F.size("all") > 0)
    cut = rows.select("item", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))).alias("at"))
    return cut.groupBy(F.slice("all", F.col("at") + 1, F.lit(window)).alias("words")).agg(F.collect_set("item").alias("items"))


def _candidates(docs: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """(``key``, ``places``, ``lists``) for texts with candidates: where a
    window may begin (start, window, words), and the items of every window."""
    numbered = checkpoint(windows.withColumn("window_id", F.monotonically_increasing_id()), "windows")
    size = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r.size for r in numbered.select(size.alias("size")).distinct().collect())  # five at most
    if not sizes:
        kinds = "array<struct<start:int,window_id:long,words:array<string>>>", "array<struct<window_id:long,items:array<string>>>"
        return docs.select(*key).limit(0).select(*key, F.lit(None).cast(kinds[0]).alias("places"), F.lit(None).cast(kinds[1]).alias("lists"))
    own = [numbered.where(size == k).select("window_id", F.explode(_shingled(F.col("words"), [k])).alias("s")) for k in sizes]
    shingles = checkpoint(reduce(DataFrame.unionByName, own).select("window_id", F.col("s.at").alias("offset"), "s.shingle"), "window-shingles")
    wanted = checkpoint(shingles.select("shingle").distinct(), "wanted-shingles")
    met = docs.select(*key, F.explode(_shingled(words(F.col("_body")), sizes)).alias("s")).select(*key, "s.at", "s.shingle")
    # a shingle is one long: what is broadcast is told by the number of rows
    wanted = F.broadcast(wanted) if wanted.count() <= WANTED_ROWS else wanted
    hits = checkpoint(met.join(wanted, "shingle", "left_semi"), "shingle-hits")
    rarity = hits.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = shingles.join(rarity, "shingle", "left").groupBy("window_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest"))
    # a window with a shingle that no text has is in no text
    prefix = checkpoint(ranked.where(F.col("rarest.n") > 0).select("window_id", "rarest.offset", "rarest.shingle"), "prefix-shingles")
    placed = hits.join(prefix, "shingle").where(F.col("at") >= F.col("offset")).select(*key, (F.col("at") - F.col("offset")).alias("start"), "window_id").distinct()
    placed = checkpoint(placed, "placed-windows")
    places = placed.join(numbered.select("window_id", "words"), "window_id").groupBy(*key).agg(F.collect_list(F.struct("start", "window_id", "words")).alias("places"))
    lists = placed.select(*key, "window_id").distinct().join(numbered.select("window_id", "items"), "window_id")
    lists = lists.groupBy(*key).agg(F.collect_list(F.struct("window_id", "items")).alias("lists"))
    second = [f"{k}_2" for k in key]
    same = [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(key, second, strict=True)]
    return places.join(lists.select(*(F.col(k).alias(t) for k, t in zip(key, second, strict=True)), "lists"), same).select(*key, "places", "lists")


def with_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    into: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words``, ``n_hit`` (words inside
    occurrences of windows), ``items`` (ids as strings, sorted), ``spans``
    (first word and the one after the last of every occurrence).

    Null texts have no words; an empty benchmark hits nothing. Rows are
    matched by id and text, so repeated rows, shared ids and null ids get
    their own text's result. Other columns stay; ``into`` must be new.
    """
    if into in docs.columns:
        raise ValueError(f"column {into} exists already")
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    slim = docs.select(id_.alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_body"))
    windows = item_windows(items, id_col=item_id_col, text_col=item_text_col, window=window)
    found = checkpoint(_candidates(slim, windows, ["_id", "_hash"]), "candidates")
    own_id, own_hash, own_places, own_lists = fresh(docs, "_found_id", "_found_hash", "_places", "_lists")
    found = found.toDF(own_id, own_hash, own_places, own_lists)
    joined = docs.join(found, id_.eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)), "left")

    def verified(text_words: Column) -> Column:
        fits = lambda c: F.slice(text_words, c["start"] + 1, F.size(c["words"])) == c["words"]
        return F.filter(F.coalesce(F.col(own_places), F.array()), fits)

    def result(text_words: Column) -> Column:
        def counted(occurring: Column) -> Column:
            spans = F.array_distinct(F.sort_array(F.transform(occurring, lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.size(c["words"])).alias("end")))))
            covered = F.aggregate(
                spans,
                F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
                lambda a: a["n"],
            )
            ids = F.array_distinct(F.transform(occurring, lambda c: c["window_id"]))
            of_windows = lambda w: F.filter(F.coalesce(F.col(own_lists), F.array()), lambda x: F.array_contains(w, x["window_id"]))
            listed = F.sort_array(F.array_distinct(F.flatten(F.transform(bind(ids, of_windows), lambda x: x["items"]))))
            return F.struct(F.size(text_words).cast("long").alias("n_words"), covered.alias("n_hit"), listed.alias("items"), spans.alias("spans"))

        return bind(verified(text_words), counted)

    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.transform(F.array(words(text)), result)).alias(into))
