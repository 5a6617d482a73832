"""Language identification with interpolated Kneser-Ney character models.

A text becomes lower-case letters (with their combining marks); every run of
anything else is one space. Four successive symbols are a gram, packed
exactly into 64 bits (symbols beyond U+FFFF share one). Spark counts the
grams of every training text per language. Lower orders use continuation
counts, as Kneser and Ney define them, and every order is interpolated with
the one below by absolute discounting, down to a uniform choice of symbols.

The model holds, per order, a sorted array of gram hashes with one row of
log-probabilities (one column per language), fully interpolated. A text's
score per language is its cross-entropy per symbol; the lowest wins. A
temperature for the score and a limit of cross-entropy per language for
rejection are calibrated on a bounded sample of training texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import checkpoint

ORDER = 4
SYMBOL = 16  # bits of a symbol
SPACE, OTHER = 32, 0xFFFD
#: Characters handled at once; bounds the arrays of a task.
CHUNK = 1 << 20
#: Distinct grams a task holds before it hands them on.
FLUSH = 1 << 20
UNDETERMINED = "und"
#: Bits beyond a language's limit of cross-entropy that halve the score.
REJECT_BITS = 0.125


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For U+0000 to U+FFFF: is a letter; is a letter or combining mark."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(1 << SYMBOL)]
    letter = np.array([k == "L" for k in kinds])
    return letter, letter | np.array([k == "M" for k in kinds])


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' symbols one after the other, the number of each, and
    whether each has a letter."""
    letter, word = _classes()
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    if code.size and int(code.max()) >= 1 << SYMBOL:
        wide = code >= 1 << SYMBOL
        kinds = {c: unicodedata.category(chr(c))[0] for c in np.unique(code[wide]).tolist()}
        code = code.copy()
        code[wide] = [OTHER if kinds[c] in "LM" else SPACE for c in code[wide].tolist()]
        is_word, is_letter = word[code], letter[code]
        is_word[wide] |= code[wide] == OTHER
        is_letter[wide] |= code[wide] == OTHER
    else:
        is_word, is_letter = word[code], letter[code]
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    after = np.zeros(len(code), bool)  # the symbol before is part of a word
    after[1:] = is_word[:-1]
    after[starts[full]] = False
    keep = is_word | after
    counts, has = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    if full.any():
        counts[full] = np.add.reduceat(keep, starts[full], dtype=np.int64)
        has[full] = np.logical_or.reduceat(is_letter, starts[full])
    return np.where(is_word, code, SPACE)[keep].astype(np.uint64), counts, has


def grams(sequence: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The packed gram that ends at each symbol; a text begins after spaces."""
    starts = np.cumsum(counts) - counts
    packed = sequence.copy()
    for k in range(1, ORDER):
        before = np.full(len(sequence), SPACE, np.uint64)
        before[k:] = sequence[:-k]
        for j in range(k):
            before[starts[counts > j] + j] = SPACE
        packed |= before << np.uint64(SYMBOL * k)
    return packed


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of about CHUNK characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(``lang``, ``gram`` long, ``n``) over all rows of ``labelled`` (``lang``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            key, n = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for _, part in _chunks(texts):
                    sequence, counts, _ = symbols(part)
                    if len(sequence):
                        key, n = np.unique(grams(sequence, counts), return_counts=True)
                        old = held.get(lang)
                        held[lang] = _merged([old[0], key], [old[1], n]) if old else (key, n.astype(np.int64))
                if lang in held and len(held[lang][0]) > FLUSH:
                    yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    counted = labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashArray:
    """Sorted hashes of packed grams with one row of values each, found by
    the leading bits of the hash and a few steps from there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = self.mix(keys)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], values[order]
        self.bits = max(1, int(2 * len(keys)).bit_length())
        heads = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        per = np.bincount(heads, minlength=1 << self.bits)
        self.first = (np.cumsum(per) - per).astype(np.int32)
        self.steps = int(per.max()) if len(keys) else 0

    @staticmethod
    def mix(keys: np.ndarray) -> np.ndarray:
        """A one-to-one scramble of 64 bits, so no two grams share a hash."""
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        h = self.mix(keys)
        row = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        last = np.int32(len(self.hashes) - 1)
        for _ in range(self.steps):
            row = np.minimum(row, last)
            row = row + (self.hashes[row] < h)
        row = np.minimum(row, last)
        return row, self.hashes[row] == h


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


class KneserNey:
    """Interpolated models of several languages over one set of grams."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        low = lambda k, order: k & np.uint64((1 << SYMBOL * order) - 1)
        per_order: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            key, n = counts[lang]
            orders = [(key, n.astype(np.float64))]
            for order in range(ORDER - 1, 0, -1):
                key, n = np.unique(low(key, order), return_counts=True)
                orders.append((key, n.astype(np.float64)))
            per_order.append(orders[::-1])
        none = np.empty(0, np.uint64)
        seen = [np.unique(np.concatenate([none, *(o[k][0] for o in per_order)])) for k in range(ORDER)]
        self.uniform = 1.0 / (len(seen[0]) + 1)
        #: by order: probabilities; by the order they lead to: back-off weights
        self.prob: list[HashArray] = []
        self.back: list[HashArray | None] = []
        lower = None
        for k in range(ORDER):
            keys, width = seen[k], len(self.langs)
            context = keys >> np.uint64(SYMBOL)
            contexts, where = np.unique(context, return_inverse=True)
            p, gamma = np.zeros((len(keys), width)), np.ones((len(contexts), width))
            for j, orders in enumerate(per_order):
                own, n = orders[k]
                at = np.searchsorted(keys, own)
                d = _discount(n)
                total = np.bincount(where[at], weights=n, minlength=len(contexts))
                kinds = np.bincount(where[at], minlength=len(contexts))
                known = total > 0
                gamma[known, j] = d * kinds[known] / total[known]
                p[at, j] = np.maximum(n - d, 0) / total[where[at]]
            below = self.uniform if lower is None else lower.values[lower.find(low(keys, k))[0]]
            p += gamma[where] * below
            lower = HashArray(keys, p)
            self.prob.append(HashArray(keys, np.log2(p).astype(np.float32)))
            self.back.append(HashArray(contexts, np.log2(gamma).astype(np.float32)))

    def log2(self, packed: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each gram after the others,
        one column per language."""
        row, there = self.prob[-1].find(packed)
        out = self.prob[-1].values[row]
        miss = np.flatnonzero(~there)
        if len(miss):
            out[miss] = self._unseen(packed[miss], ORDER)
        return out

    def _unseen(self, packed: np.ndarray, order: int) -> np.ndarray:
        """The same where no language has the gram at ``order``."""
        back = self.back[order - 1]
        row, there = back.find((packed & np.uint64((1 << SYMBOL * order) - 1)) >> np.uint64(SYMBOL))
        weight = np.where(there[:, None], back.values[row], np.float32(0))
        if order == 1:
            return weight + np.float32(np.log2(self.uniform))
        key = packed & np.uint64((1 << SYMBOL * (order - 1)) - 1)
        row, there = self.prob[order - 2].find(key)
        out = self.prob[order - 2].values[row]
        miss = np.flatnonzero(~there)
        if len(miss):
            out[miss] = self._unseen(packed[miss], order - 1)
        return weight + out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of each text and language, and whether it has a letter."""
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        for at, part in _chunks(texts):
            sequence, counts, has = symbols(part)
            here = slice(at, at + len(part))
            letters[here] = has
            full = counts > 0
            if full.any() and self.langs:
                starts = (np.cumsum(counts) - counts)[full]
                sums = np.add.reduceat(self.log2(grams(sequence, counts)), starts, axis=0, dtype=np.float64)
                part_out = out[here]
                part_out[full] = -sums / counts[full][:, None]
        return out, letters


def held_out(id_: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame, *, model_bytes: int = 128 << 20) -> KneserNey:
    """Models of every non-null ``lang`` of ``labelled`` (``lang``, ``text``).

    All texts are counted. The model that tasks load is bounded by
    ``model_bytes``: if more distinct grams than fit were counted, a language
    keeps those with at least so many occurrences that its share fits (the
    smallest such number).
    """
    counts = checkpoint(gram_counts(labelled.where(F.col("lang").isNotNull())), "gram-counts")
    sizes: dict[str, list[tuple[int, int]]] = {}
    for lang, n, kinds in counts.groupBy("lang", F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("kinds")).orderBy("lang", F.desc("n")).collect():
        sizes.setdefault(lang, []).append((n, kinds))
    if not sizes:
        return KneserNey({})
    share = model_bytes // (2 * (8 + 4 * len(sizes)) * len(sizes))
    kept = F.lit(False)
    for lang, by_count in sizes.items():
        least, held = by_count[0][0], 0
        for n, kinds in by_count:
            held += kinds
            if held > share and n < by_count[0][0]:
                break
            least = n
        kept = kept | ((F.col("lang") == lang) & (F.col("n") >= least))
    table = counts.where(kept).toArrow()
    lang, gram, n = (table.column(c).to_numpy() for c in ("lang", "gram", "n"))
    out = {}
    for name in sizes:
        own = lang == name
        key, order = np.unique(gram[own].view(np.uint64), return_index=True)
        out[name] = (key, n[own][order])
    return KneserNey(out)


def _entropies(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """``columns`` of every row, ``bits`` (array per language) and ``letters``."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, letters = model.value.cross_entropy([t or "" for t in batch.column(len(columns)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(list(bits), pa.list_(pa.float64())), pa.array(letters)], [*columns, "bits", "letters"])

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, f"{fields}, bits array<double>, letters boolean")


def calibrate(labelled: DataFrame, model, *, sample: int = 2000, keep: float = 0.995) -> tuple[float, dict[str, float]]:
    """A temperature and one limit of cross-entropy per language, from the
    ``sample`` rows whose ids hash lowest (``labelled``: ``_id``, ``lang``,
    ``text``): the temperature that makes the score likeliest, and the
    ``keep`` quantile of each language's own cross-entropy."""
    langs = model.value.langs
    hashed = labelled.select(F.xxhash64("_id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if hashed is None or not langs:
        return 1.0, {}
    chosen = labelled.where((F.xxhash64("_id") <= hashed) & F.col("lang").isin(langs))
    rows = _entropies(chosen, model, ["lang"]).where("letters").limit(2 * sample).collect()
    if not rows:
        return 1.0, {}
    bits, right = np.array([r.bits for r in rows]), np.array([langs.index(r.lang) for r in rows])
    best, least = 1.0, np.inf
    for temperature in 2.0 ** np.arange(-2, 7, 0.5):
        z = -bits * temperature
        z -= z.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), right]))
        if loss < least:
            best, least = float(temperature), loss
    limits = {name: float(np.quantile(bits[right == j, j], keep)) for j, name in enumerate(langs) if (right == j).any()}
    return best, limits


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id column, ``held_out``, ``lang_pred``, ``score``, ``cross_entropy``,
    ``accepted``) of every row.

    Models learn from the rows that aren't held out and have a language and
    an id. ``und`` with score 0 for null texts and texts without a letter, and for
    every row if there is nothing to learn from. Equal cross-entropies go to
    the language first in order. The score is the calibrated share of the
    predicted language, halved for every ``REJECT_BITS`` beyond the
    language's limit of cross-entropy; ``accepted`` is the rejection: within
    the limit, and a score of at least 0.5.
    Repeated rows stay repeated; null ids are never held out.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = rows.where(~held_out(F.col(id_col)) & F.col("lang").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), "lang", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(labelled))
    temperature, limits = calibrate(labelled, model)
    langs = model.value.langs
    scored = _entropies(rows.withColumn("_held", held_out(F.col(id_col))), model, [id_col, "_held"])
    known = F.col("letters") & F.lit(bool(langs))
    least = F.array_min("bits")
    pick = F.array_position("bits", least).cast("int")
    names = F.array(*(F.lit(x) for x in langs)) if langs else F.array(F.lit(UNDETERMINED))
    total = F.aggregate("bits", F.lit(0.0), lambda a, b: a + F.exp((least - b) * temperature))
    lang = F.when(known, F.element_at(names, F.greatest(pick, F.lit(1)))).otherwise(UNDETERMINED)
    limit = F.coalesce(*(F.when(F.col("lang_pred") == k, F.lit(v)) for k, v in limits.items()), F.lit(float("inf")))
    out = scored.select(F.col(id_col), F.col("_held").alias("held_out"), lang.alias("lang_pred"), (1 / total).alias("_share"), F.when(known, least).alias("cross_entropy"))
    beyond = F.greatest(F.col("cross_entropy") - limit, F.lit(0.0))
    score = F.when(F.col("cross_entropy").isNull(), 0.0).otherwise(F.col("_share") * F.pow(F.lit(2.0), -beyond / REJECT_BITS))
    out = out.withColumn("score", score).withColumn("accepted", F.coalesce((beyond == 0) & (F.col("score") >= 0.5), F.lit(False)))
    return out.select(id_col, "held_out", "lang_pred", "score", "cross_entropy", "accepted")
