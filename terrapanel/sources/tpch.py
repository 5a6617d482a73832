"""Star schema derived from the TPC-H-shaped driver tables.

Mapping (see README): region → region dim, nation → state (UF) dim,
customer → municipality dim. Facts come from ``orders ⋈ lineitem ⋈ part``
aggregated per customer and order year:

* population = ``sum(l_quantity)`` of every order year;
* sector value added = ``sum(l_extendedprice)`` split by ``p_type`` (first
  word), net taxes = ``sum(l_extendedprice * l_tax)``, GDP = both, every year;
* census (the first order year): area = ``greatest(c_acctbal, 0)`` (zero areas on
  purpose), census population = that year's population, published density =
  population / area rounded to 2 decimals.

Plan shape: ``lineitem ⋈ part`` (part is broadcast when its file statistics
are small, shuffled on ``partkey`` otherwise) → one row per order with the
sector sums as conditional aggregates, hash-partitioned by ``orderkey`` so
the join with ``orders`` reuses that partitioning → one row per
customer-year. Money is summed as DECIMAL (exact); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pad_id, round_to
from .star import SECTOR_COLUMNS, Star
from .tables import read_table

# Sector of a part, by the first word of ``p_type`` (mapping of this dataset).
SECTOR_BY_TYPE = {
    "ECONOMY": "vab_agropecuaria",
    "MEDIUM": "vab_industria",
    "LARGE": "vab_industria",
    "PROMO": "vab_servicos",
    "SMALL": "vab_servicos",
    "STANDARD": "vab_administracao_publica",
}
MONEY = "decimal(38,4)"


#: Input tables that each table of the star is derived from.
_FACT_INPUTS = ("lineitem", "part", "orders", "customer")
INPUTS = {
    "dim_regiao": ("region",),
    "dim_uf": ("nation",),
    "dim_municipio": ("customer",),
    **{f"fato_{kind}": _FACT_INPUTS for kind in ("populacao_municipio", "populacao_uf", "censo_municipio", "censo_uf", "pib_municipio", "pib_uf")},
    "fato_populacao_regiao": (*_FACT_INPUTS, "nation"),
}


def origins(sf_dir: str) -> dict[str, list[str]]:
    """Paths of the inputs of every table, for the load log."""
    return {name: [f"{sf_dir}/{t}.parquet" for t in inputs] for name, inputs in INPUTS.items()}


def _sector(p_type) -> F.Column:
    first = F.substring_index(F.trim(p_type), " ", 1)
    expr = None
    for t, sector in SECTOR_BY_TYPE.items():
        expr = (F.when if expr is None else expr.when)(first == F.lit(t), F.lit(sector))
    return expr


def _cents(c) -> F.Column:
    """Exact integer hundredths of a 2-decimal amount stored as DOUBLE."""
    return F.round(F.col(c) * F.lit(100.0)).cast("long")


def money(units: F.Column, scale: int) -> F.Column:
    """Integer units of 10^-scale → DECIMAL(38,4), exactly."""
    return (units.cast("decimal(38,0)") / F.lit(10**scale)).cast(MONEY)


def customer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (customer, order year) with quantity and money sums.

    Money is carried as exact integers (cents; cents × tax-hundredths for
    taxes) through the aggregations — LONG sums are vectorised, DECIMAL
    sums above 18 digits are not — and converted to DECIMAL at the end.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_quantity",
        _cents("l_extendedprice").alias("price_c"),
        _cents("l_tax").alias("tax_c"),
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", _sector(F.col("p_type")).alias("sector"))
    li = li.join(part, li.l_partkey == part.p_partkey, "left")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.sum("price_c").alias("price_c"),
        F.sum(F.col("price_c") * F.col("tax_c")).alias("taxes_e4"),
        *[F.sum(F.when(F.col("sector") == F.lit(s), F.col("price_c"))).alias(s) for s in SECTOR_COLUMNS],
    )
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("ano")
    )
    joined = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
    cy = joined.groupBy("o_custkey", "ano").agg(
        F.sum("qty").alias("qty"),
        F.sum("price_c").alias("price_c"),
        F.sum("taxes_e4").alias("taxes_e4"),
        *[F.sum(s).alias(s) for s in SECTOR_COLUMNS],
    )
    return cy.select(
        "o_custkey", "ano", "qty",
        money(F.col("price_c"), 2).alias("price"),
        money(F.col("taxes_e4"), 4).alias("taxes"),
        *[money(F.col(s), 2).alias(s) for s in SECTOR_COLUMNS],
    )


def derive_star(spark: SparkSession, sf_dir: str, stage=None) -> Star:
    """Lazily defined star schema (materialise it with ``sinks.snapshot``).

    ``stage(df) -> df`` materialises the customer-year aggregate that every
    fact reads (e.g. a reliable checkpoint), so writing seven facts runs
    the big join once.
    """
    region = read_table(spark, sf_dir, "region")
    nation = read_table(spark, sf_dir, "nation")
    customer = read_table(spark, sf_dir, "customer")

    dim_regiao = region.select(
        F.col("r_regionkey").cast("int").alias("regiao_id"),
        F.upper(F.substring(F.col("r_name"), 1, 2)).alias("regiao_sigla"),
        F.col("r_name").alias("regiao_nome"),
    )
    dim_uf = nation.select(
        F.col("n_nationkey").cast("int").alias("uf_id"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("uf_sigla"),
        F.col("n_name").alias("uf_nome"),
        F.col("n_regionkey").cast("int").alias("regiao_id"),
    )
    dim_municipio = customer.select(
        pad_id("c_custkey").alias("municipio_id"),
        F.col("c_name").alias("municipio_nome"),
        F.lit(None).cast("int").alias("microrregiao_id"),
        F.lit(None).cast("string").alias("microrregiao_nome"),
        F.lit(None).cast("int").alias("mesorregiao_id"),
        F.col("c_mktsegment").alias("mesorregiao_nome"),
        F.col("c_nationkey").cast("int").alias("uf_id"),
    )

    cy = customer_years(spark, sf_dir)
    cy = cy.join(
        customer.select("c_custkey", F.col("c_nationkey").cast("int").alias("uf_id")),
        cy.o_custkey == customer.c_custkey,
    ).select(pad_id("o_custkey").alias("municipio_id"), "uf_id", "ano", *cy.columns[2:])
    if stage is not None:
        cy = stage(cy)

    pop_mun = cy.select(
        "municipio_id", "ano", F.col("qty").cast("long").alias("populacao")
    )
    pib_cols = [
        (F.col("price") + F.col("taxes")).cast(MONEY).alias("pib_mil_reais"),
        F.col("taxes").cast(MONEY).alias("impostos_liquidos"),
        *[F.col(s).cast(MONEY).alias(s) for s in SECTOR_COLUMNS],
    ]
    pib_mun = cy.select("municipio_id", "ano", *pib_cols)

    # one row: the first year of the series
    census_year = cy.agg(F.min("ano").alias("ano"))
    census_pop = pop_mun.join(F.broadcast(census_year), "ano").select(
        "municipio_id", F.col("populacao").alias("populacao_censo")
    )
    area = customer.select(
        pad_id("c_custkey").alias("municipio_id"),
        F.col("c_nationkey").cast("int").alias("uf_id"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(14,3)").alias("area_km2"),
    )
    censo_mun_uf = area.join(census_pop, "municipio_id", "left").crossJoin(F.broadcast(census_year))
    censo_mun = censo_mun_uf.select(
        "municipio_id",
        "ano",
        "populacao_censo",
        "area_km2",
        F.when(
            F.col("area_km2") > 0,
            round_to(F.col("populacao_censo").cast("double") / F.col("area_km2").cast("double"), 2),
        ).alias("densidade_hab_km2"),
    )

    # Upper levels are sums of the municipalities (they close by construction).
    pop_uf = (
        cy.groupBy("uf_id", "ano")
        .agg(F.sum(F.col("qty").cast("long")).alias("populacao"))
    )
    pop_reg = (
        pop_uf.join(dim_uf.select("uf_id", "regiao_id"), "uf_id")
        .groupBy("regiao_id", "ano")
        .agg(F.sum("populacao").alias("populacao"))
    )
    pib_uf = (
        cy.select("uf_id", "ano", *pib_cols)
        .groupBy("uf_id", "ano")
        .agg(*[F.sum(c).cast(MONEY).alias(c) for c in ["pib_mil_reais", "impostos_liquidos", *SECTOR_COLUMNS]])
    )
    censo_uf = (
        censo_mun_uf.groupBy("uf_id", "ano")
        .agg(
            F.sum("populacao_censo").alias("populacao_censo"),
            F.sum("area_km2").cast("decimal(38,3)").alias("area_km2"),
        )
        .withColumn(
            "densidade_hab_km2",
            F.when(
                F.col("area_km2") > 0,
                round_to(F.col("populacao_censo").cast("double") / F.col("area_km2").cast("double"), 2),
            ),
        )
    )
    return Star(
        dim_regiao=dim_regiao,
        dim_uf=dim_uf,
        dim_municipio=dim_municipio,
        fato_populacao_municipio=pop_mun,
        fato_populacao_uf=pop_uf,
        fato_populacao_regiao=pop_reg,
        fato_censo_municipio=censo_mun,
        fato_censo_uf=censo_uf,
        fato_pib_municipio=pib_mun,
        fato_pib_uf=pib_uf,
    )
