"""Shared fixtures: a local session and the miniature country.

The miniature country has deliberate properties: population skips
2022–2023, GDP ends two years before population, one municipality has no
GDP at all, one region has two states and one state two municipalities.
"""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from terrapanel.sources.star import Star  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="terrapanel-test-ckpt-")
    s = (
        SparkSession.builder.master("local[*]")
        .appName("terrapanel-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", ckpt)
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(ckpt)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="terrapanel-test-")


UFS = [
    (11, "RO", "Rondônia", 1, "N", "Norte"),
    (23, "CE", "Ceará", 2, "NE", "Nordeste"),
    (33, "RJ", "Rio de Janeiro", 3, "SE", "Sudeste"),
    (35, "SP", "São Paulo", 3, "SE", "Sudeste"),
    (43, "RS", "Rio Grande do Sul", 4, "S", "Sul"),
    (52, "GO", "Goiás", 5, "CO", "Centro-Oeste"),
]

# id, name, uf, pop 2020/2021/2024/2025, census pop, km², GDP 2021/2023, sector profile
MUNICIPALITIES = [
    ("1100015", "Alta Floresta D'Oeste", 11, (22000, 21500, 20000, 19500), 21000, 7067, (500000, 560000),
     (0.40, 0.10, 0.35, 0.15)),
    ("2304400", "Fortaleza", 23, (2600000, 2620000, 2700000, 2720000), 2428000, 312, (79000000, 92000000),
     (0.01, 0.19, 0.60, 0.20)),
    ("3304557", "Rio de Janeiro", 33, (6700000, 6710000, 6720000, 6730000), 6211000, 1200, (375000000, 430000000),
     (0.01, 0.25, 0.59, 0.15)),
    ("3509502", "Campinas", 35, (1200000, 1210000, 1240000, 1250000), 1139000, 795, None, None),
    ("3550308", "São Paulo", 35, (11800000, 11820000, 11880000, 11900000), 11451000, 1521, (828000000, 950000000),
     (0.00, 0.20, 0.70, 0.10)),
    ("4314902", "Porto Alegre", 43, (1490000, 1480000, 1460000, 1450000), 1332000, 495, (93000000, 105000000),
     (0.01, 0.15, 0.69, 0.15)),
    ("5208707", "Goiânia", 52, (1520000, 1540000, 1580000, 1600000), 1437000, 729, (68000000, 78000000),
     (0.02, 0.18, 0.62, 0.18)),
]
POP_YEARS = (2020, 2021, 2024, 2025)
GDP_YEARS = (2021, 2023)
SECTORS = ["vab_agropecuaria", "vab_industria", "vab_servicos", "vab_administracao_publica"]


def build_mini_star(spark) -> Star:
    from decimal import Decimal

    dim_regiao = spark.createDataFrame(
        sorted({(u[3], u[4], u[5]) for u in UFS}), "regiao_id int, regiao_sigla string, regiao_nome string"
    )
    dim_uf = spark.createDataFrame([(u[0], u[1], u[2], u[3]) for u in UFS],
                                   "uf_id int, uf_sigla string, uf_nome string, regiao_id int")
    dim_mun = spark.createDataFrame(
        [(m[0], m[1], None, None, None, f"Meso {m[2]}", m[2]) for m in MUNICIPALITIES],
        "municipio_id string, municipio_nome string, microrregiao_id int, microrregiao_nome string, "
        "mesorregiao_id int, mesorregiao_nome string, uf_id int",
    )
    pop = spark.createDataFrame(
        [(m[0], y, p) for m in MUNICIPALITIES for y, p in zip(POP_YEARS, m[3])],
        "municipio_id string, ano int, populacao long",
    )
    money = "decimal(38,4)"
    pib_rows = []
    for m in MUNICIPALITIES:
        if m[6] is None:
            continue
        for y, g in zip(GDP_YEARS, m[6]):
            vab = Decimal(g) * Decimal("0.85")
            parts = [vab * Decimal(str(s)) for s in m[7]]
            pib_rows.append((m[0], y, Decimal(g), Decimal(g) - vab, *parts))
    pib = spark.createDataFrame(
        pib_rows,
        f"municipio_id string, ano int, pib_mil_reais {money}, impostos_liquidos {money}, "
        + ", ".join(f"{s} {money}" for s in SECTORS),
    )
    censo = spark.createDataFrame(
        [(m[0], 2022, m[4], Decimal(m[5]), round(m[4] / m[5], 2)) for m in MUNICIPALITIES],
        "municipio_id string, ano int, populacao_censo long, area_km2 decimal(14,3), densidade_hab_km2 double",
    )
    uf_of = dim_mun.select("municipio_id", "uf_id")
    pop_uf = pop.join(uf_of, "municipio_id").groupBy("uf_id", "ano").agg(F.sum("populacao").alias("populacao"))
    pop_reg = pop_uf.join(dim_uf, "uf_id").groupBy("regiao_id", "ano").agg(F.sum("populacao").alias("populacao"))
    pib_uf = pib.join(uf_of, "municipio_id").groupBy("uf_id", "ano").agg(
        *[F.sum(c).cast(money).alias(c) for c in ["pib_mil_reais", "impostos_liquidos", *SECTORS]]
    )
    censo_uf = censo.join(uf_of, "municipio_id").groupBy("uf_id", "ano").agg(
        F.sum("populacao_censo").alias("populacao_censo"), F.sum("area_km2").cast("decimal(38,3)").alias("area_km2")
    ).withColumn("densidade_hab_km2", F.round(F.col("populacao_censo") / F.col("area_km2").cast("double"), 2))
    return Star(
        dim_regiao=dim_regiao, dim_uf=dim_uf, dim_municipio=dim_mun,
        fato_populacao_municipio=pop, fato_populacao_uf=pop_uf, fato_populacao_regiao=pop_reg,
        fato_censo_municipio=censo, fato_censo_uf=censo_uf, fato_pib_municipio=pib, fato_pib_uf=pib_uf,
    )


@pytest.fixture(scope="session")
def mini_star(spark):
    return build_mini_star(spark)
