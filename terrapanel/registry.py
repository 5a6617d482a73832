"""Fixed values and band definitions.

Everything in the block marked FIXED VALUES must equal what the original
application publishes (labels, cut points, sentinels, canonical orders) so
results read the same. Cut points are *defaults*: every banding operator
takes its edges as a parameter, because the magnitudes of other datasets
(the TPC-H-shaped test tables, for instance) differ from the real ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# FIXED VALUES (must equal the original application's values)
# --------------------------------------------------------------------------

# Canonical region order (north to south), used instead of alphabetical order.
REGION_ORDER = ["Norte", "Nordeste", "Sudeste", "Sul", "Centro-Oeste"]

# Growth bands: right-closed intervals on CAGR %/year.
GROWTH_LABELS = [
    "Perda acentuada",
    "Perda leve",
    "Crescimento lento",
    "Crescimento moderado",
    "Crescimento acelerado",
]
GROWTH_EDGES = [-0.5, 0.0, 0.5, 1.0]

# Size bands: left-closed intervals on population.
SIZE_LABELS = [
    "Até 5 mil",
    "5 a 10 mil",
    "10 a 20 mil",
    "20 a 50 mil",
    "50 a 100 mil",
    "100 a 500 mil",
    "Mais de 500 mil",
]
SIZE_EDGES = [0, 5_000, 10_000, 20_000, 50_000, 100_000, 500_000]

# Density bands: left-closed intervals on inhabitants per km².
DENSITY_LABELS = [
    "Muito baixa (<1)",
    "Baixa (1–5)",
    "Média-baixa (5–25)",
    "Média (25–100)",
    "Alta (100–500)",
    "Muito alta (>500)",
]
DENSITY_EDGES = [0, 1, 5, 25, 100, 500]

# Location-quotient reading, thresholds are ">=".
QUOTIENT_LABELS = ["Muito especializada", "Especializada", "Perfil nacional", "Sub-representada"]
QUOTIENT_EDGES = [1.5, 1.2, 0.8]

# Divergence pattern labels (GDP vs population moving in opposite directions).
PATTERN_RICHER_EMPTIER = "Enriquece esvaziando"
PATTERN_SWELLING_POORER = "Incha empobrecendo"

# Extremes labels for the density-extremes query.
EXTREME_DENSEST = "Mais densos"
EXTREME_EMPTIEST = "Mais vazios"

# Sector columns and their display names.
SECTORS = {
    "vab_agropecuaria": "Agropecuária",
    "vab_industria": "Indústria",
    "vab_servicos": "Serviços",
    "vab_administracao_publica": "Administração pública",
}

# Missing-value sentinels of the statistics feed: all parse to NULL
# ("-" is an absolute zero in the feed and is deliberately NULL as well).
SENTINELS = ["...", "..", "X", "-", ""]

# Concentration thresholds (percent of the national total).
CONCENTRATION_CUTS = [10, 25, 50, 75, 90]

# Data-quality statuses.
STATUS_OK, STATUS_WARN, STATUS_FAIL = "OK", "ATENÇÃO", "FALHA"

# Metrics accepted by the top-N query, and which of them are additive.
TOP_METRICS = {
    "populacao": "populacao_atual",
    "pib": "pib_mil_reais",
    "pib_per_capita": "pib_per_capita",
    "densidade": "densidade_atual",
    "crescimento": "cagr_pct",
}
ADDITIVE_METRICS = {"populacao", "pib"}

# Label of the whole country in the state series.
NATION = "BR"

# Quality report: limits, then name and expectation of every check, in order.
QUALITY_LIMITS = {
    "municipios": (5500, 5600), "ufs": 27, "regioes": 5, "anos": 20, "sem_pib": 5, "sem_area": 5, "cagr": 10.0,
    "cagr_fora": 20, "pib_negativo": 5,
}
QUALITY_CHECKS = {
    "municipios": ("municípios na dimensão", "5.571 (malha vigente)"),
    "ufs": ("UFs na dimensão", "27"),
    "regioes": ("regiões na dimensão", "5"),
    "anos": ("anos na série de população", "21 (2001-2025 sem 2007, 2010, 2022, 2023)"),
    "sem_pib": ("municípios sem PIB no último ano", "0 a 5 (instalados após o fim da série do PIB)"),
    "sem_area": ("municípios sem área (Censo 2022)", "0 a 5 (instalados após o Censo)"),
    "sem_populacao": ("municípios sem população no último ano", "0"),
    "soma_ufs": ("soma dos municípios vs. total das UFs (população)", "divergência < 0,01%"),
    "soma_regioes": ("soma das UFs vs. agregado regional (população)", "diferença de 0 habitantes"),
    "densidade": ("densidade publicada vs. recalculada (divergência real)", "0"),
    "cagr": ("municípios com CAGR fora de ±10% a.a.", "0 a 20 (municípios novos, com série curta)"),
    "pib_zero": ("PIB municipal zerado", "0"),
    "pib_negativo": ("PIB municipal negativo", "0 a 5 (VAB setorial negativo é possível)"),
    "colunas_nulas": ("colunas 100% nulas em mv_painel_municipio", "0 (coluna toda nula = buscada no ano errado)"),
    "carga": ("horas desde a última carga", "a carga já rodou ao menos uma vez"),
}

# Datasets of the feed: variables (id → column), territorial levels, names of
# the raw tables and facts, first year of the municipal level (None: all).
DATASETS = {
    "populacao_estimada": {
        "variables": {9324: "populacao"},
        "levels": ("N6", "N3", "N2", "N1"), "raw": "pop", "fact": "populacao", "first_municipal_year": None,
    },
    "censo_2022": {
        "variables": {93: "populacao_censo", 6318: "area_km2", 614: "densidade_hab_km2"},
        "levels": ("N6", "N3", "N2"), "raw": "censo", "fact": "censo", "first_municipal_year": None,
    },
    "pib": {
        "variables": {
            37: "pib_mil_reais", 513: "vab_agropecuaria", 517: "vab_industria", 6575: "vab_servicos",
            525: "vab_administracao_publica", 543: "impostos_liquidos",
        },
        "levels": ("N6", "N3", "N2", "N1"), "raw": "pib", "fact": "pib", "first_municipal_year": 2010,
    },
}

# Municipalities without GDP that are known (installed after the series ended).
KNOWN_WITHOUT_GDP = ["5101837"]

# Number of quantile classes of a choropleth.
QUANTILE_CLASSES = 7

# --------------------------------------------------------------------------
# Band parameter sets
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Bands:
    """Cut points for the three banding operators of one dataset."""

    growth: list = field(default_factory=lambda: list(GROWTH_EDGES))
    size: list = field(default_factory=lambda: list(SIZE_EDGES))
    density: list = field(default_factory=lambda: list(DENSITY_EDGES))


#: The moment at which the registered quality report measures freshness.
QUALITY_AS_OF = "2002-01-01 00:00:00"

#: Real-world magnitudes (the defaults).
REAL_BANDS = Bands()

#: Magnitudes of the TPC-H-shaped driver tables: entity "populations" are in
#: the hundreds and yearly changes are noisy, so the same labels get scaled
#: cut points. Same labels, same interval closure.
TPCH_BANDS = Bands(
    growth=[-10.0, 0.0, 10.0, 20.0],
    size=[0, 50, 100, 200, 500, 1_000, 5_000],
    density=[0, 0.01, 0.05, 0.25, 1.0, 5.0],
)
