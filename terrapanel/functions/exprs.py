"""Column expressions (all JVM-side built-ins; no Python UDFs).

Every helper takes and returns a ``Column`` so it composes inside
``select``/``withColumn`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import registry


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Null-safe arithmetic
# --------------------------------------------------------------------------


def safe_denominator(c) -> Column:
    """Value where strictly positive, else NULL (masks zero *and* negatives)."""
    c = col_of(c)
    return F.when(c > 0, c)


def nullif_zero(c) -> Column:
    """SQL ``NULLIF(c, 0)``: masks only zero."""
    c = col_of(c)
    return F.when(c != 0, c)


def as_double(c) -> Column:
    return col_of(c).cast("double")


def ratio(num, den, *, mask: str = "positive") -> Column:
    """``num / den`` in DOUBLE with the denominator masked first.

    ``mask='positive'`` drops zero and negative denominators (pandas path),
    ``mask='zero'`` drops only zero (SQL ``NULLIF``). Spark 4 runs with ANSI
    on, so an unmasked zero would raise instead of returning NULL.
    """
    d = as_double(den)
    d = safe_denominator(d) if mask == "positive" else nullif_zero(d)
    return as_double(num) / d


#: From here on a double has no fraction left to round.
_INTEGRAL = float(2**52)


def _scaled(x: Column, decimals: int) -> Column:
    """``x * 10^decimals`` rounded half away from zero, as a double."""
    units = F.abs(x) * F.lit(float(10**decimals))
    whole = F.floor(F.least(units, F.lit(_INTEGRAL)) + F.lit(0.5)).cast("double")
    return F.signum(x) * F.when(units < F.lit(_INTEGRAL), whole).otherwise(units)


def round_to(c, decimals: int) -> Column:
    """Half away from zero on the binary value scaled by ``10^decimals``.

    Unlike ``round`` (which rounds the shortest decimal rendering of a
    double), this is bit-for-bit reproducible by any engine that follows
    IEEE-754, so published numbers do not flip at exact halves between
    Spark and another engine. Values too large to have decimals stay as they
    are; NULL and NaN propagate; there is no negative zero.
    """
    return _scaled(col_of(c).cast("double"), decimals) / F.lit(float(10**decimals)) + F.lit(0.0)


def fixed_point(c, decimals: int) -> Column:
    """Integer ``round_to(c, n) * 10^n`` (exact sums, medians and averages)."""
    return _scaled(col_of(c).cast("double"), decimals).cast("long")


def from_fixed_point(c, decimals: int) -> Column:
    return col_of(c).cast("double") / F.lit(float(10**decimals))


def nan_to_null(c) -> Column:
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def sum_skipping_nulls(cols: Sequence) -> Column:
    """Row-wise sum that skips NULL parts; NULL only when every part is NULL."""
    cs = [col_of(c) for c in cols]
    any_present = F.lit(False)
    total = None
    for c in cs:
        any_present = any_present | c.isNotNull()
        total = F.coalesce(c, F.lit(0)) if total is None else total + F.coalesce(c, F.lit(0))
    return F.when(any_present, total)


# --------------------------------------------------------------------------
# Identifiers and text
# --------------------------------------------------------------------------


def pad_id(c, width: int = 7) -> Column:
    """Identifier as a zero-padded string of at least ``width`` characters.

    Codes are identifiers, never numbers. Longer codes are kept whole
    (``lpad`` alone would truncate them and make distinct ids collide).
    """
    s = F.trim(col_of(c).cast("string"))
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def label_city(name, uf) -> Column:
    """``name (UF)``."""
    return F.concat(col_of(name), F.lit(" ("), col_of(uf), F.lit(")"))


def fmt_number_br(c, decimals: int = 0) -> Column:
    """Brazilian number format: thousands ``.``, decimals ``,``; NULL → ``—``.

    ``format_number`` rounds half-even on a DECIMAL, so the value is cast to
    DECIMAL first to keep halves deterministic.
    """
    v = col_of(c).cast("decimal(38,10)")
    return F.coalesce(F.translate(F.format_number(v, decimals), ",.", ".,"), F.lit("—"))


def fmt_compact_br(c) -> Column:
    """``2,3 bi`` / ``2,3 mi`` / ``2,3 mil`` with one decimal; below 1000 as is."""
    x = col_of(c).cast("double")
    a = F.abs(x)

    def one(div: float, suffix: str) -> Column:
        return F.concat(fmt_number_br(x / F.lit(div), 1), F.lit(" " + suffix))

    return (
        F.when(x.isNull(), F.lit("—"))
        .when(a >= 1e9, one(1e9, "bi"))
        .when(a >= 1e6, one(1e6, "mi"))
        .when(a >= 1e3, one(1e3, "mil"))
        .otherwise(fmt_number_br(x, 0))
    )


# --------------------------------------------------------------------------
# Parsing
# --------------------------------------------------------------------------


def parse_feed_number(c, sentinels: Sequence[str] = registry.SENTINELS) -> Column:
    """Feed string → DOUBLE; sentinels, unparseable text and NaN → NULL."""
    s = F.trim(col_of(c).cast("string"))
    num = s.try_cast("double")
    finite = ~F.isnan(num) & (F.abs(num) != F.lit(float("inf")))
    return F.when(~s.isin(list(sentinels)) & finite, num)


# --------------------------------------------------------------------------
# Banding and ordering
# --------------------------------------------------------------------------


def bucketize(c, edges: Sequence[float], labels: Sequence[str], *, right: bool) -> Column:
    """Generic ``cut``: ``len(labels) == len(edges)`` buckets.

    ``right=True``: intervals ``(e[i-1], e[i]]`` with an open-ended first
    bucket ``(-inf, e[0]]`` and last ``(e[-1], +inf)`` — i.e. ``len(edges)+1``
    labels. ``right=False``: left-closed ``[e[i], e[i+1])`` with the last
    bucket ``[e[-1], +inf)``; values below ``e[0]`` get NULL. NULL → NULL.
    """
    x = col_of(c)
    if right:
        if len(labels) != len(edges) + 1:
            raise ValueError("right-closed bands need len(edges)+1 labels")
        expr = F.when(x.isNull(), F.lit(None).cast("string"))
        for e, lab in zip(edges, labels):
            expr = expr.when(x <= F.lit(e), F.lit(lab))
        return expr.otherwise(F.lit(labels[-1]))
    if len(labels) != len(edges):
        raise ValueError("left-closed bands need one label per lower edge")
    expr = F.when(x.isNull() | (x < F.lit(edges[0])), F.lit(None).cast("string"))
    for e, lab in zip(edges[1:], labels[:-1]):
        expr = expr.when(x < F.lit(e), F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def band_growth(c, edges: Sequence[float] = registry.GROWTH_EDGES) -> Column:
    return bucketize(c, edges, registry.GROWTH_LABELS, right=True)


def band_size(c, edges: Sequence[float] = registry.SIZE_EDGES) -> Column:
    return bucketize(c, edges, registry.SIZE_LABELS, right=False)


def band_density(c, edges: Sequence[float] = registry.DENSITY_EDGES) -> Column:
    return bucketize(c, edges, registry.DENSITY_LABELS, right=False)


def band_quotient(c, edges: Sequence[float] = registry.QUOTIENT_EDGES) -> Column:
    """Location-quotient reading: ``>= e0``, ``>= e1``, ``>= e2``, else."""
    x = col_of(c)
    labels = registry.QUOTIENT_LABELS
    expr = F.when(x >= F.lit(edges[0]), F.lit(labels[0]))
    for e, lab in zip(edges[1:], labels[1:-1]):
        expr = expr.when(x >= F.lit(e), F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def quality_status(ok: Column, failure: str = registry.STATUS_FAIL) -> Column:
    return F.when(ok, F.lit(registry.STATUS_OK)).otherwise(F.lit(failure))


def ordinal(c, order: Sequence[str]) -> Column:
    """1-based position in a literal list (0 when absent) for canonical sorts."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), col_of(c)).cast("int")


def abs_rel_mismatch(published, computed, rel: float = 0.01, absolute: float = 0.005) -> Column:
    """True only when the difference exceeds both tolerances."""
    d = F.abs(as_double(published) - as_double(computed))
    return (d > F.lit(rel) * as_double(published)) & (d > F.lit(absolute))
