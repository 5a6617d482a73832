"""Secret scans with multipart credential linking.

Spans are found by patterns, in SQL functions over the whole text; places
are code points. Three kinds are strong and always reported: an assigned
secret, a cloud access identifier and a long hexadecimal string. Others are
weak: an account or client identifier, a short or unnamed secret, an
endpoint. Weak parts of a document are interval-joined: every part is dealt
to the scopes (stretches of ``SCOPE`` characters) that it can reach, parts in
one scope are compared by distance, and a weak part is reported only where
what completes it is near: a secret for an identifier, an identifier for a
secret, both for an endpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import checkpoint, fresh

SCOPE = 200
#: Kinds in the order of reports, with their pattern, the group
#: that holds the value, the value's least length and whether it is strong.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    "access": (r"AKIA[A-Z0-9]+", 0, 18, True),
    "hex": (r"[0-9a-f]+", 0, 16, True),
    "identifier": (r"""\b((?i:client_?id|access_?key_?id|account_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, False),
    "secret": (r"""\b((?i:password|passwd|pwd|passphrase|secret|token|api_?key|access_?key|auth_?key|client_?secret))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, False),
    "endpoint": (r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|mongodb|postgres(?:ql)?|mysql|redis|amqp)://[^\x00-\x20"'<>]+""", 0, 8, False),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _spans(text: Column, kind: str) -> Column:
    """The spans of a kind: matches, leftmost and non-overlapping, less those
    with too short a value. What lies between matches gives their places."""
    pattern, group, least, _ = KINDS[kind]
    # a run of at least 16 is within a run: the same matches without the
    # short ones, which are as many as the words
    look = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}.get(kind, pattern)
    found = F.regexp_extract_all(text, F.lit(look), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(look), F.lit(group)) if group else found
    between = F.split(text, look, -1)

    def placed(lengths: Column) -> Column:
        """lengths: (gap before, match, value) of every match."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + x["gap"]
            span = F.struct(begin.alias("start"), F.lit(ORDER[kind]).alias("kind_no"), (begin + x["size"]).alias("end"), F.lit(kind).alias("kind"))
            out = F.when(x["value"] >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"])
            return F.struct((begin + x["size"]).alias("at"), out.cast(_SPAN).alias("out"))

        return F.aggregate(lengths, start, step, lambda a: a["out"])

    lengths = F.transform(
        F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("size"), values.alias("value")),
        lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["size"]).alias("size"), F.length(z["value"]).alias("value")),
    )
    return F.when(text.rlike(look), placed(lengths)).otherwise(F.array().cast(_SPAN))


def _near(parts: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``parts`` with one of ``others`` within ``SCOPE``
    characters in the same document, by an interval join over scopes."""
    scope = lambda c: F.floor(F.col(c) / SCOPE).cast("int")
    left = parts.withColumn("_scope", F.explode(F.sequence(F.greatest(scope("start") - 1, F.lit(0)), scope("end") + 1)))
    right = others.select(*(F.col(k).alias(f"_o{k}") for k in key), F.col("start").alias("_from"), F.col("end").alias("_to")).withColumn("_o_scope", F.explode(F.sequence(scope("_from"), scope("_to"))))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in key))
    apart = (F.col("_from") - F.col("end") <= SCOPE) & (F.col("start") - F.col("_to") <= SCOPE)
    other = (F.col("_from") != F.col("start")) | (F.col("_to") != F.col("end"))
    return left.join(right, same & (F.col("_scope") == F.col("_o_scope")) & apart & other, "left_semi").drop("_scope").distinct()


def linked_parts(scanned: DataFrame, key: list[str]) -> DataFrame:
    """Weak parts that are completed by what is near: ``key`` and the span."""
    parts = scanned.where(F.size("weak") > 0).select(*key, F.inline(F.concat("base", "weak"))).distinct()
    parts = checkpoint(parts, "credential-parts")
    of = lambda *kinds: parts.where(F.col("kind").isin(*kinds))
    identifiers, secrets = of("access", "identifier"), of("assign", "hex", "secret")
    weak_ids = _near(of("identifier"), secrets, key)
    weak_secrets = _near(of("secret"), identifiers, key)
    endpoints = _near(_near(of("endpoint"), secrets, key), identifiers, key)
    return weak_ids.unionByName(weak_secrets).unionByName(endpoints)


def credential_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id column, ``text_hash``, ``base`` and
    ``spans`` (arrays of start, kind_no, end, kind; ends exclusive; ascending).

    ``base`` holds the strong spans, ``spans`` those and the linked weak
    ones. A weak secret that is a strong one too is reported as the strong
    one. Null texts are empty. Rows are matched by id and text, so repeated
    rows, shared ids and null ids get their own text's spans.
    """
    own, body = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    text = F.coalesce(body, F.lit(""))

    def every(strong: bool) -> Column:
        return F.concat(*(_spans(text, k) for k, (*_, s) in KINDS.items() if s is strong))

    def parted(base: Column) -> Column:
        known = lambda w: F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
        return F.struct(base.alias("base"), F.filter(every(False), lambda w: ~known(w)).alias("weak"))

    one = F.explode(F.transform(F.array(F.sort_array(every(True))), parted)).alias("_parts")
    scanned = docs.select(own.alias("_doc"), F.xxhash64(body).alias("text_hash"), one).select("_doc", "text_hash", "_parts.base", "_parts.weak")
    scanned = checkpoint(scanned, "credential-scan")
    key = ["_doc", "text_hash"]
    linked = linked_parts(scanned, key).groupBy(*key).agg(F.collect_list(F.struct("start", "kind_no", "end", "kind")).alias("_linked"))
    linked = checkpoint(linked, "linked-credentials").select(F.col("_doc").alias("_id"), F.col("text_hash").alias("_hash"), "_linked")
    out = scanned.join(linked, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(F.col("_doc").alias(id_col), "text_hash", "base", F.sort_array(F.concat("base", F.coalesce("_linked", F.array().cast(_SPAN)))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        added = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.concat(gap, F.lit(mark))))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), added.alias("out"))

    def finish(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))

    return F.aggregate(spans, start, step, finish)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the reported spans of ``text_col`` replaced; all columns
    stay. Texts without a span, nulls included, stay as they are."""
    own_id, own_hash, own_spans = fresh(docs, "_id", "_hash", "_spans")
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    found = credential_spans(docs, id_col=id_col, text_col=text_col).where(F.size("spans") > 0)
    found = checkpoint(found.select(id_.alias(own_id), F.col("text_hash").alias(own_hash), F.col("spans").alias(own_spans)).distinct(), "spans-to-redact")
    joined = docs.join(found, id_.eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)), "left")
    new = F.when(F.col(own_spans).isNull(), text).otherwise(redacted(text, F.col(own_spans)))
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
