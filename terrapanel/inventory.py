"""Where each operator of the inventory lives and which registered query
exercises it (``__spark_entry__.queries()`` key, checked against DuckDB)."""

from __future__ import annotations

# id → (implementation, registered query key)
INVENTORY: dict[str, tuple[str, str]] = {
    # scans and sources
    "src_series_flatten": ("sources.feeds.flatten_variables / flatten_payload_text / read_series", "src_series_flatten"),
    "src_sentinel_parse": ("functions.parse_feed_number", "src_sentinel_parse"),
    "src_published_years": ("sources.feeds.published_years", "src_published_years"),
    "src_dataset_catalog": ("sources.feeds.flatten_catalog", "src_dataset_catalog"),
    "src_series_dedupe": ("sources.feeds.dedupe_series", "src_series_dedupe"),
    "src_series_select": ("sources.feeds.select_series", "src_series_select"),
    "src_series_wide": ("sources.feeds.series_wide", "src_series_wide"),
    "src_windowed_extract": ("sources.feeds.window_years; plans.feed_etl", "src_windowed_extract"),
    "src_dim_uf": ("sources.feeds.flatten_ufs", "src_dim_uf"),
    "src_dim_region": ("sources.feeds.flatten_regions", "src_dim_region"),
    "src_dim_municipality": ("sources.feeds.flatten_municipalities(_text)", "src_dim_municipality"),
    "src_geo_features": ("operators.geo.read_large_features / read_features", "src_geo_features"),
    "src_parquet_table": ("sources.tables.read_table", "src_parquet_table"),
    "src_catalog_inventory": ("sources.tables.inventory", "src_catalog_inventory"),
    # sinks / load
    "sink_parquet": ("sinks.loads.write_parquet", "sink_parquet"),
    "sink_csv": ("sinks.loads.write_csv", "sink_csv"),
    "sink_geojson": ("sinks.loads.write_features", "sink_geojson"),
    "load_prepare": ("sinks.loads.prepare", "load_prepare"),
    "load_snapshot": ("sinks.snapshot.write_snapshot / read_snapshot / write_star / recover", "load_snapshot"),
    "load_append": ("sinks.snapshot.append_rows", "load_append"),
    "load_lineage": ("sinks.snapshot.load_log / latest_loads", "load_lineage"),
    "panel_refresh": ("plans.warehouse.refresh_panels", "panel_refresh"),
    # filters
    "filter_latest_year": ("plans.panels._latest_year (scalar subquery)", "filter_latest_year"),
    "filter_latest_nonnull_year": ("plans.panels._latest_year(where=…)", "filter_latest_nonnull_year"),
    "filter_members": ("operators.aggregates.filter_members / selection_share", "filter_members"),
    "filter_declining": ("operators.aggregates.declining", "filter_declining"),
    "filter_min_population": ("operators.aggregates.top_growth", "filter_min_population"),
    "filter_optional_param": ("plans.queries.serie_uf(uf=None)", "filter_optional_param"),
    "filter_id_or_name": ("plans.queries.perfil_municipio", "filter_id_or_name"),
    "filter_geo_codes": ("operators.geo.clip_to_codes", "filter_geo_codes"),
    "filter_xor": ("plans.queries.descolamento_pib_populacao", "filter_xor"),
    "project_existing": ("operators.aggregates.rank_ufs / operators.metrics.sector_structure", "project_existing"),
    "drop_nulls": ("operators.aggregates.topk", "drop_nulls"),
    # joins
    "join_enrich_municipality": ("operators.metrics.enrich_municipalities / unique_dimension / orphan_count",
                                 "join_enrich_municipality"),
    "join_enrich_uf": ("operators.metrics.enrich_ufs", "join_enrich_uf"),
    "join_growth_dim": ("plans.panels.growth_view", "join_growth_dim"),
    "join_hierarchy": ("plans.panels.hierarchy", "join_hierarchy"),
    "join_panel_municipality": ("plans.panels.municipality_panel", "join_panel_municipality"),
    "join_nearest_year": ("operators.nearest.nearest_year_per_key / nearest_year_global", "join_nearest_year"),
    "join_full_outer_series": ("plans.queries.serie_uf", "join_full_outer_series"),
    "join_self_endpoints": ("plans.queries.descolamento_pib_populacao", "join_self_endpoints"),
    "join_cross_thresholds": ("plans.queries.concentracao (crossing rows, no cross join)", "join_cross_thresholds"),
    "join_semi_in": ("plans.queries.perfil_municipio", "join_semi_in"),
    "join_using_rank": ("plans.queries.perfil_municipio", "join_using_rank"),
    "join_map_lookup": ("operators.growth.index_base100", "join_map_lookup"),
    "join_geo_data": ("operators.geo.attach_data", "join_geo_data"),
    # derived metrics
    "safe_denominator": ("functions.safe_denominator / ratio", "safe_denominator"),
    "nullif_ratio": ("functions.nullif_zero / ratio(mask='zero')", "nullif_ratio"),
    "density": ("operators.metrics.density", "density"),
    "gdp_per_capita": ("operators.metrics.gdp_per_capita; panels (nearest-year population)", "gdp_per_capita"),
    "sector_structure": ("operators.metrics.sector_structure / functions.sum_skipping_nulls", "sector_structure"),
    "growth_first_last": ("operators.growth.growth_first_last", "growth_first_last"),
    "growth_step": ("operators.growth.growth_step", "growth_step"),
    "pct_change": ("operators.growth.pct_change / national_series", "pct_change"),
    "index_base100": ("operators.growth.index_base100", "index_base100"),
    "share_of_total": ("plans.panels.uf_panel / region_panel (broadcast one-row totals)", "share_of_total"),
    "share_of_group": ("operators.aggregates.share_of_group", "share_of_group"),
    "gdp_pop_ratio": ("operators.aggregates.gdp_pop_ratio", "gdp_pop_ratio"),
    "location_quotient": ("plans.queries.quociente_locacional", "location_quotient"),
    "divergence_pp": ("plans.queries.descolamento_pib_populacao", "divergence_pp"),
    "common_window": ("plans.queries.descolamento_pib_populacao", "common_window"),
    "abs_rel_tolerance_check": ("functions.abs_rel_mismatch", "abs_rel_tolerance_check"),
    # bucketing
    "bucketize": ("functions.bucketize", "bucketize"),
    "band_growth": ("functions.band_growth", "band_growth"),
    "band_size": ("functions.band_size", "band_size"),
    "band_density": ("functions.band_density", "band_density"),
    "band_quotient": ("functions.band_quotient", "band_quotient"),
    "quality_status": ("functions.quality_status; plans.queries.qualidade", "quality_status"),
    # aggregations
    "agg_region_sum": ("operators.aggregates.region_sums", "agg_region_sum"),
    "agg_region_panel": ("plans.panels.region_panel", "agg_region_panel"),
    "agg_uf_panel": ("plans.panels.uf_panel", "agg_uf_panel"),
    "agg_national_series": ("operators.growth.national_series", "agg_national_series"),
    "agg_uf_series": ("plans.queries.serie_uf(uf=…)", "agg_uf_series"),
    "agg_region_year": ("operators.aggregates.region_year_share / region_year_sum", "agg_region_year"),
    "agg_growth_by_region": ("operators.aggregates.growth_by_region", "agg_growth_by_region"),
    "agg_decline_summary": ("operators.aggregates.decline_summary", "agg_decline_summary"),
    "agg_decline_by_uf": ("plans.queries.declinio_populacional", "agg_decline_by_uf"),
    "agg_growth_bands": ("operators.aggregates.growth_band_distribution", "agg_growth_bands"),
    "agg_size_bands": ("operators.aggregates.size_distribution; plans.queries.porte_populacional", "agg_size_bands"),
    "agg_density_bands": ("operators.aggregates.density_distribution", "agg_density_bands"),
    "agg_available_years": ("plans.panels.available_years", "agg_available_years"),
    "agg_distinct_years": ("countDistinct per fact; plans.queries.qualidade", "agg_distinct_years"),
    "agg_ordered_array": ("array_sort(collect_list(struct)) per entity; plans.queries.perfil_municipio",
                          "agg_ordered_array"),
    "agg_headline": ("operators.aggregates.headline", "agg_headline"),
    "agg_min_median_max": ("operators.aggregates.min_median_max", "agg_min_median_max"),
    "agg_quantile_breaks": ("operators.aggregates.quantile_breaks", "agg_quantile_breaks"),
    "agg_band_subset": ("operators.aggregates.band_subset_share", "agg_band_subset"),
    "agg_last_point": ("operators.aggregates.last_point", "agg_last_point"),
    "agg_histogram": ("operators.aggregates.histogram (linear and log10)", "agg_histogram"),
    # concentration
    "gini": ("operators.concentration.gini", "gini"),
    "top_share": ("operators.concentration.top_sums / concentration", "top_share"),
    "lorenz_curve": ("operators.concentration.lorenz_curve", "lorenz_curve"),
    "concentration_table": ("plans.panels.concentration_table", "concentration_table"),
    "concentration_cutoffs": ("plans.queries.concentracao", "concentration_cutoffs"),
    "half_of_total": ("operators.concentration.half_of_total", "half_of_total"),
    "territorial_half": ("operators.concentration.territorial_half", "territorial_half"),
    "population_concentration": ("operators.concentration.concentration (population / GDP)",
                                 "population_concentration"),
    # windows
    "win_lag": ("operators.growth.growth_step / pct_change", "win_lag"),
    "win_first_last": ("operators.growth.growth_first_last (min_by/max_by)", "win_first_last"),
    "win_rank": ("operators.prefix.with_rank / rank_table", "win_rank"),
    "win_percent_rank": ("operators.prefix.with_rank(percent_col=…)", "win_percent_rank"),
    "win_row_number": ("operators.prefix.running_totals(row_number=…)", "win_row_number"),
    "win_running_sum": ("operators.prefix.running_totals", "win_running_sum"),
    "win_running_sum_ties": ("operators.prefix.range_running_sum", "win_running_sum_ties"),
    "win_total": ("one-row aggregate + broadcast (panels, queries)", "win_total"),
    "win_transform_sum": ("operators.aggregates.share_of_group", "win_transform_sum"),
    "win_cumsum": ("operators.prefix.running_totals; concentration.lorenz_curve", "win_cumsum"),
    # sort / top-k / reshape
    "topk": ("operators.aggregates.topk", "topk"),
    "topk_metric_param": ("plans.queries.top_municipios(metrica=…)", "topk_metric_param"),
    "rank_ufs": ("operators.aggregates.rank_ufs", "rank_ufs"),
    "extremes": ("operators.aggregates.extremes", "extremes"),
    "extremes_union": ("plans.queries.densidade_extremos", "extremes_union"),
    "distinct_values": ("operators.aggregates.distinct_values", "distinct_values"),
    "full_growth_table": ("operators.aggregates.growth_table", "full_growth_table"),
    "canonical_sort": ("functions.ordinal; operators.aggregates.region_sums", "canonical_sort"),
    "distinct_on": ("min_by/max_by aggregates (growth, nearest year)", "distinct_on"),
    "unpivot_sectors": ("operators.aggregates.sector_structure_long", "unpivot_sectors"),
    "pivot_wide": ("sources.feeds.series_wide", "pivot_wide"),
    "union_all": ("unionByName (available years, quality, extremes)", "union_all"),
    "density_by_region": ("operators.aggregates.density_by_region", "density_by_region"),
    "regions_comparison": ("plans.queries.regioes", "regions_comparison"),
    "ranking_view": ("plans.panels.ranking_view", "ranking_view"),
    "profile": ("plans.queries.perfil_municipio", "profile"),
    # scalar functions
    "fmt_number_br": ("functions.fmt_number_br", "label_city"),
    "fmt_compact_br": ("functions.fmt_compact_br", "fmt_compact_br"),
    "label_city": ("functions.label_city", "label_city"),
    # geometry and quality
    "geo_signed_area": ("operators.geo.ring_signed_area", "geo_signed_area"),
    "geo_reorient": ("operators.geo.reorient / reorient_features", "geo_reorient"),
    "geo_choropleth_input": ("operators.aggregates.choropleth_input", "geo_choropleth_input"),
    "quality_checks": ("plans.queries.qualidade", "quality_checks"),
    "constraint_checks": ("operators.quality.constraint_checks / quarantine / enforce", "constraint_checks"),
    "panel_invariants": ("operators.quality.panel_invariants", "panel_invariants"),
    "coverage_gap_report": ("operators.quality.coverage_gap / all_null_columns", "coverage_gap_report"),
}

NAMED_QUERIES = [
    "top_municipios", "concentracao", "declinio_populacional", "porte_populacional", "quociente_locacional",
    "regioes", "serie_uf", "descolamento_pib_populacao", "densidade_extremos", "perfil_municipio", "qualidade",
]
