from .exprs import (  # noqa: F401
    abs_rel_mismatch,
    as_double,
    band_density,
    band_growth,
    band_quotient,
    band_size,
    bucketize,
    col_of,
    fixed_point,
    fmt_compact_br,
    fmt_number_br,
    from_fixed_point,
    label_city,
    nan_to_null,
    nullif_zero,
    ordinal,
    pad_id,
    parse_feed_number,
    quality_status,
    ratio,
    round_to,
    safe_denominator,
    sum_skipping_nulls,
)
