"""Quality rules: base measures and an n-gram likelihood ratio.

Every text is scored by the mean log-likelihood ratio of its word n-grams
(words and pairs) between the trusted target documents and the raw corpus.
Grams are hashed into ``SLOTS`` slots and counted per slot over all documents;
each task sums its own grams first, so what is shuffled is bounded by the slots
and not by the occurrences. The raw count is scaled to the target's total
before one is added to both, so a gram without evidence has ratio 0 at every
size of the corpus. Every occurrence is taken out of the raw count that it is
held against and, in a trusted document, out of the target's too: a gram that
occurs nowhere else says nothing. A text is kept if its measures pass the base
rules and its mean ratio reaches a fixed threshold.

Everything is SQL functions. The counts, one row per slot whatever the input,
are broadcast to the pass that reads every text: a text's slots are joined in
the task that made them and summed there, so one row per text is shuffled and
no occurrence is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import bind, checkpoint, fresh, small_side

#: White space of the word rule.
SPACES = " \t\n\x0b\f\r"
#: Slots that grams are hashed into, a power of two: rows of the broadcast table of counts (24 bytes each).
SLOTS = 1 << 20
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Up to so many distinct repeated windows are looked up one by one; more are sorted.
_LOOKED_UP = 24


def _word_array(text: Column) -> Column:
    """The words of a text that isn't null. Texts whose only white space is
    blanks and line ends, nearly all, are split at a single character, which
    is much faster than by a pattern."""
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1)
    other = F.lit(False)
    for c in SPACES.replace(" ", "").replace("\n", ""):
        other = other | text.contains(c)
    return F.array_remove(F.when(other, F.split(text, r"[\x20\x09-\x0D]", -1)).otherwise(plain), "")


def _front(array: Column, drop: int) -> Column:
    """The array without its last ``drop`` elements."""
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - drop, F.lit(0)))


def _windows(words: Column) -> Column:
    """Hash of every three neighbouring words."""
    return F.transform(_front(words, 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _covered(positions: Column) -> Column:
    """Words in the three-word windows that start at the ascending positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def _repeat_words(windows_: Column) -> Column:
    """Words in windows whose hash is found twice or more."""

    def given(windows: Column, twice: Column) -> Column:
        """``twice``: the hashes found twice or more, each once."""
        looked_up = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(twice, F.get(windows, i)))
        numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def neighbours(by_hash: Column) -> Column:
            same = lambda z, other: F.coalesce(z["h"] == F.get(by_hash, other)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(by_hash, lambda z, j: same(z, j - 1) | same(z, j + 1)), lambda z: z["i"]))

        many = F.size(twice) > _LOOKED_UP
        return F.when(F.size(twice) == 0, F.lit(0).cast("long")).when(many, _covered(bind(numbered, neighbours))).otherwise(_covered(looked_up))

    twice = lambda in_order: F.array_distinct(F.filter(in_order, lambda h, i: F.coalesce(h == F.get(in_order, i - 1), F.lit(False))))
    return bind(windows_, lambda windows: bind(bind(F.sort_array(windows), twice), lambda t: given(windows, t)))


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str, name: str) -> DataFrame:
    """``docs`` and whether the id of the row is in ``trusted``, as ``name``."""
    ids = checkpoint(trusted.select(F.col(f"`{id_col}`").alias(name)).where(F.col(name).isNotNull()).distinct(), "trusted-ids")
    return docs.join(small_side(ids), docs[f"`{id_col}`"] == ids[name], "left").withColumn(name, F.col(name).isNotNull())


def _slot(hash_: Column, slots: int) -> Column:
    return hash_.bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")


def _grams(rows: DataFrame, words: Column, slots: int, *keep: str) -> DataFrame:
    """A row with its ``slot`` for every word and every pair of neighbouring
    words, beside the columns to ``keep``; a row without words has none.
    Neighbours are zipped and generated, so that all hashing is compiled."""
    zipped = F.arrays_zip(words.alias("word"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("next"))
    near = rows.select(*keep, F.explode(zipped).alias("z")).select(*keep, F.col("z.word").alias("_w"), F.col("z.next").alias("_n"))
    word = F.xxhash64("_w")
    pair = F.when(F.col("_n").isNotNull(), _slot(F.xxhash64(word, F.xxhash64("_n")), slots))
    return near.select(*keep, F.explode(F.array(_slot(word, slots), pair)).alias("slot")).where(F.col("slot").isNotNull())


def slot_counts(slim: DataFrame, slots: int) -> DataFrame:
    """(``slot``, ``raw``, ``target``): how often the grams of a slot occur in
    all rows of ``slim`` (``trusted``, ``text``) and in the trusted ones."""
    read = slim.select(F.col("trusted").cast("long").alias("trusted"), _word_array(F.col("text")).alias("words"))
    grams = _grams(read, F.col("words"), slots, "trusted")
    return checkpoint(grams.groupBy("slot").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")), "gram-counts")


def with_quality(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    into: str = "quality",
    slots: int = SLOTS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with a struct column ``into``: ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``ratio`` (mean log-likelihood ratio, 0 without a word) and ``kept``.

    Without a trusted document every ratio is 0: nothing tells the two apart.
    A null text has no words and fails the base rule like any short text.
    Rows are decided one by one: repeated rows and null ids are rows like any
    other (a copy's occurrences are not one's own). Other columns stay as they
    are; ``into`` must be a new name.
    """
    if into in docs.columns:
        raise ValueError(f"column {into} exists already")
    is_trusted, own_key, its_key, its_trusted, its = fresh(docs, "_trusted", "_key", "_its_key", "_its_trusted", "_its")
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = _marked(docs, trusted, id_col, is_trusted)
    slim = rows.select(F.col(is_trusted).alias("trusted"), body.alias("text"))
    counts = slot_counts(slim, slots)
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    share = target / raw if raw else 0.0
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _windows(words).alias("windows"),
            words.alias("words"),
        )

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # one element a row: generated, so that no later step computes it again
    read = slim.select(F.xxhash64("text").alias("key"), "trusted", F.explode(F.transform(F.array(_word_array(text)), measured)).alias("m")).select("key", "trusted", "m.*")
    # most texts repeat no window, which the distinct ones tell quickly
    repeated = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("windows")))
    read = read.withColumn("n_repeat_words", repeated).drop("windows")
    grams = _grams(read, F.col("words"), slots, "key", "trusted", *names)
    # at most ``slots`` rows, whatever the input: broadcast
    near = grams.join(F.broadcast(counts.select("slot", F.col("raw").cast("double").alias("raw"), F.col("target").cast("double").alias("target"))), "slot")
    own = F.when(F.col("trusted"), 1.0).otherwise(0.0)
    ratio = F.log((F.col("target") - own + 1.0) / ((F.col("raw") - 1.0) * F.lit(share) + 1.0)) if share else F.lit(0.0)
    # a text's grams lie in one task, which sums them; copies of a text share a row, and so do
    # texts without a word, whose lines and symbols may differ
    of_text = near.groupBy("key", "trusted", *names).agg(F.sum(ratio).alias("sum"), F.count("*").alias("n"))
    wordless = read.where(F.col("n_words") == 0).select("key", "trusted", *names, F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")).distinct()
    of_text = of_text.unionByName(wordless)
    ratio = F.when(F.col("n") > 0, F.col("sum") / F.col("n")).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = of_text.select("key", "trusted", F.struct(*names, failed.alias("base_failed"), ratio.alias("ratio"), (~failed & (ratio >= threshold)).alias("kept")).alias("q"))
    stored = checkpoint(judged, "text-measures").select(F.col("key").alias(its_key), F.col("trusted").alias(its_trusted), F.col("q").alias(its))
    keyed = rows.select("*", F.xxhash64(body).alias(own_key))
    joined = keyed.join(small_side(stored), (F.col(own_key) == F.col(its_key)) & (F.col(is_trusted) == F.col(its_trusted)), "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(its).alias(into))
