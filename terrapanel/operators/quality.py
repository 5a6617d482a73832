"""Declarative integrity rules: violating rows, their counts, enforcement.

The original enforces these with PRIMARY KEY / FOREIGN KEY / CHECK
constraints in its database. Here the rules are data (``row_rules``,
``PRIMARY_KEYS``, ``FOREIGN_KEYS``); one plan per table tags every row with
the rules that it breaks. The tagged rows are what a quarantine holds, the
report is counted from them, and a publication is rejected by them.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_double, nullif_zero
from ..session import checkpoint
from ..sinks.snapshot import PublicationRejected
from ..sources.star import DIM_TABLES, FACT_TABLES, FOREIGN_KEYS, PRIMARY_KEYS, Star

YEAR_RULE = "ano between 1990 and 2100"
PREFIX_RULE = "left(municipio_id, 2) = uf_id"
AREA_RULE = "area_km2 > 0"


def row_rules(table: str) -> dict[str, F.Column]:
    """CHECKs of a table: label → the condition that breaks it. As in a
    CHECK, a comparison with NULL breaks nothing."""
    rules = {}
    if table == "dim_municipio":
        rules["municipio_id ~ '^[0-9]{7}$'"] = ~F.col("municipio_id").rlike("^[0-9]{7}$")
        rules[PREFIX_RULE] = F.substring("municipio_id", 1, 2) != F.col("uf_id").cast("string")
    if table in FACT_TABLES:
        rules[YEAR_RULE] = ~F.col("ano").between(1990, 2100)
    if table.startswith("fato_populacao"):
        rules["populacao >= 0"] = F.col("populacao") < 0
    if table.startswith("fato_censo"):
        rules[AREA_RULE] = F.col("area_km2") <= 0
    return rules


def _labels(table: str) -> dict[str, str]:
    """Labels of the key rules of a table."""
    key = ",".join(PRIMARY_KEYS[table])
    out = {"pk": f"pk({key})", "null": f"not null({key})"}
    if table in FOREIGN_KEYS:
        col, parent, _ = FOREIGN_KEYS[table]
        out["fk"] = f"fk({col})->{parent}"
    return out


def violations(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """(``tabela``, ``regra``, ``chave``, ``linha``): every row of a table
    that breaks a rule, once per rule, with its key and itself as JSON.

    The keys that occur more than once are found first, from the key columns
    alone and summed in every task before they meet; they are few and joined
    back. References are looked up in the parent among ``tables``."""
    df, key, labels = tables[name], PRIMARY_KEYS[name], _labels(name)
    cols = df.columns
    twice = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(c).alias(f"_dup_{c}") for c in key), F.lit(True).alias("_twice"))
    same = [F.col(c).eqNullSafe(F.col(f"_dup_{c}")) for c in key]
    rows = df.join(twice, same, "left")
    tags = [F.when(cond, F.lit(label)) for label, cond in row_rules(name).items()]
    tags.append(F.when(F.col("_twice"), F.lit(labels["pk"])))
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    tags.append(F.when(missing, F.lit(labels["null"])))
    if name in FOREIGN_KEYS and FOREIGN_KEYS[name][1] in tables:
        col, parent, parent_col = FOREIGN_KEYS[name]
        there = tables[parent].select(F.col(parent_col).alias("_parent")).distinct()
        rows = rows.join(there, F.col(col) == F.col("_parent"), "left")
        tags.append(F.when(F.col(col).isNotNull() & F.col("_parent").isNull(), F.lit(labels["fk"])))
    found = rows.select("*", F.explode(F.array_compact(F.array(*tags))).alias("_regra"))
    return found.select(F.lit(name).alias("tabela"), F.col("_regra").alias("regra"), F.to_json(F.struct(*key)).alias("chave"), F.to_json(F.struct(*cols)).alias("linha"))


def quarantine(tables: dict[str, DataFrame]) -> DataFrame:
    """The violating rows of all ``tables``."""
    out = None
    for name in tables:
        found = violations(tables, name)
        out = found if out is None else out.unionByName(found)
    return out


def count_violations(tables: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """(``tabela``, ``regra``, ``violacoes``) of every rule, zeros included:
    violating rows, or repeated key values for a primary key."""
    spark = found.sparkSession
    rules = [(name, rule) for name in tables for rule in (*_labels(name).values(), *row_rules(name))]
    every = spark.createDataFrame(rules, "tabela string, regra string")
    is_key = F.col("regra").startswith("pk(")
    rows = found.where(~is_key).select("tabela", "regra")
    keys = found.where(is_key).select("tabela", "regra", "chave").distinct().select("tabela", "regra")
    counts = rows.unionByName(keys).groupBy("tabela", "regra").agg(F.count("*").alias("n"))
    return every.join(counts, ["tabela", "regra"], "left").select("tabela", "regra", F.coalesce("n", F.lit(0)).cast("long").alias("violacoes"))


def constraint_checks(star: Star) -> DataFrame:
    """PK uniqueness, keys that are NULL, FK presence and the row CHECKs of
    the schema, counted from the violating rows, which are written aside."""
    tables = star.tables()
    return count_violations(tables, checkpoint(quarantine(tables), "quarantine"))


def enforce(waived: Collection[str] = ()) -> Callable[[SparkSession, dict[str, DataFrame]], None]:
    """A validation for ``write_snapshot`` and ``append_rows``: raises
    ``PublicationRejected`` with the number of rows per broken rule. Rules
    whose label is ``waived`` may be broken. The counts come to the driver,
    one per rule; the rows don't."""

    def validate(_: SparkSession, tables: dict[str, DataFrame]) -> None:
        known = {n: df for n, df in tables.items() if n in (*DIM_TABLES, *FACT_TABLES)}
        if not known:
            return
        broken = quarantine(known).where(~F.col("regra").isin(list(waived)) if waived else F.lit(True)).groupBy("tabela", "regra").count().collect()
        if broken:
            raise PublicationRejected("; ".join(sorted(f"{r.tabela}: {r.regra}: {r['count']} rows" for r in broken)))

    return validate


def panel_invariants(star: Star, panel: DataFrame, uf_panel: DataFrame, region_panel: DataFrame) -> DataFrame:
    """Cross-level closure of the panels, as (invariante, valor) rows:
    sum of shares per level (should be 100), population at the three
    levels (should agree), GDP gap, municipalities whose area exceeds the
    state's, and recomputed density vs the stored one."""
    density = as_double("populacao_atual") / as_double(nullif_zero(F.col("area_km2")))
    off = F.col("densidade_atual").isNotNull() & (F.abs(F.col("densidade_atual") - density) > F.lit(0.005))
    # each panel is read once: municipalities per state, beside the state's own row
    of_state = panel.groupBy("uf_id").agg(
        F.sum("populacao_atual").alias("mun_pop"), F.sum("pib_mil_reais").alias("mun_pib"), F.sum("area_km2").alias("mun_area"), F.count_if(off).alias("off")
    )
    states = uf_panel.select("uf_id", "part_pop_brasil", "part_pib_brasil", "populacao_atual", "pib_mil_reais", "area_km2").join(of_state, "uf_id", "full")
    one = states.agg(
        F.sum("part_pop_brasil").alias("uf_share_pop"),
        F.sum("part_pib_brasil").alias("uf_share_pib"),
        F.sum("populacao_atual").alias("uf_pop"),
        F.sum("pib_mil_reais").alias("uf_pib"),
        F.sum("mun_pop").alias("mun_pop"),
        F.sum("mun_pib").alias("mun_pib"),
        F.count_if(F.col("mun_area") > F.col("area_km2") * F.lit(1.01)).alias("over"),
        F.coalesce(F.sum("off"), F.lit(0)).alias("off"),
    ).crossJoin(region_panel.agg(F.sum("part_pop_brasil").alias("reg_share_pop"), F.sum("populacao_atual").alias("reg_pop")))
    rows = {
        "soma part_pop_brasil (UF)": F.col("uf_share_pop"),
        "soma part_pib_brasil (UF)": F.col("uf_share_pib"),
        "soma part_pop_brasil (região)": F.col("reg_share_pop"),
        "população municípios - UFs": as_double("mun_pop") - as_double("uf_pop"),
        "população UFs - regiões": as_double("uf_pop") - as_double("reg_pop"),
        "PIB municípios - UFs": as_double("mun_pib") - as_double("uf_pib"),
        "UFs com área municipal > área da UF (1%)": F.col("over"),
        "densidade recalculada ≠ armazenada": F.col("off"),
    }
    found = [F.struct(F.lit(label).alias("invariante"), as_double(n).alias("valor")) for label, n in rows.items()]
    return one.select(F.explode(F.array(*found)).alias("r")).select("r.*")


def coverage_gap(panel: DataFrame, allowed: DataFrame | None = None, value: str = "pib_mil_reais") -> DataFrame:
    """Entities lacking ``value``; ``esperado`` tells whether they are on the
    allow-list (``allowed``: their ids), so that known gaps and new ones can
    be told apart."""
    gap = panel.filter(F.col(value).isNull()).select("municipio_id", "municipio_nome", "uf_sigla")
    if allowed is None:
        return gap.withColumn("esperado", F.lit(False))
    known = allowed.select(F.col("municipio_id").alias("_known")).distinct()
    return gap.join(known, F.col("municipio_id") == F.col("_known"), "left").withColumn("esperado", F.col("_known").isNotNull()).drop("_known")


def all_null_columns(df: DataFrame) -> DataFrame:
    """Columns that are 100% NULL: one pass of ``count(col)`` for every
    column, unpivoted, zeros kept."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = counts.unpivot([], list(df.columns), "coluna", "nao_nulos")
    return long.filter(F.col("nao_nulos") == 0).select("coluna")
