"""Readers for the statistics feeds: nested series JSON, the territorial
hierarchy and the dataset catalogue.

The readers take either a path (``spark.read.json`` with an explicit
schema, ``multiLine``, PERMISSIVE) or a DataFrame holding raw JSON text in
a column (``from_json``) — the latter is how landed payload files or a
stream are parsed. Nothing is collected: every payload becomes rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_feed_number

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------

S = T.StringType()
LEVEL = T.StructType([T.StructField("id", S), T.StructField("nome", S)])
LOCALITY = T.StructType([T.StructField("id", S), T.StructField("nivel", LEVEL), T.StructField("nome", S)])
SERIES_ITEM = T.StructType([T.StructField("localidade", LOCALITY), T.StructField("serie", T.MapType(S, S))])
RESULT = T.StructType(
    [T.StructField("classificacoes", T.ArrayType(S)), T.StructField("series", T.ArrayType(SERIES_ITEM))]
)
#: One variable of a series payload (the payload file is an array of these).
VARIABLE = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("variavel", S),
        T.StructField("unidade", S),
        T.StructField("resultados", T.ArrayType(RESULT)),
    ]
)
PAYLOAD = T.ArrayType(VARIABLE)

REGION = T.StructType([T.StructField("id", T.LongType()), T.StructField("sigla", S), T.StructField("nome", S)])
UF = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("sigla", S), T.StructField("nome", S),
     T.StructField("regiao", REGION)]
)
MESO = T.StructType([T.StructField("id", T.LongType()), T.StructField("nome", S), T.StructField("UF", UF)])
MICRO = T.StructType([T.StructField("id", T.LongType()), T.StructField("nome", S), T.StructField("mesorregiao", MESO)])
INTERMEDIATE = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("nome", S), T.StructField("UF", UF)]
)
IMMEDIATE = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("nome", S),
     T.StructField("regiao-intermediaria", INTERMEDIATE)]
)
MUNICIPALITY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("nome", S),
        T.StructField("microrregiao", MICRO),
        T.StructField("regiao-imediata", IMMEDIATE),
    ]
)
CATALOG = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("nome", S),
        T.StructField("agregados", T.ArrayType(T.StructType([T.StructField("id", S), T.StructField("nome", S)]))),
    ]
)

SERIES_COLUMNS = ["localidade_id", "localidade_nome", "nivel", "ano", "variavel_id", "variavel_nome", "unidade", "valor"]


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Array-rooted or object-per-file JSON with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


# --------------------------------------------------------------------------
# Series
# --------------------------------------------------------------------------


def flatten_variables(variables: DataFrame, level: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Variables (rows of ``VARIABLE``) → tidy rows, one per observation.

    ``explode(resultados)`` → ``explode(series)`` → ``explode(serie)`` (a
    map year → text); the text is parsed with the feed's sentinels → NULL.
    ``level`` overrides the level id carried by the payload; columns to
    ``keep`` go along with every row.
    """
    keep = list(keep)
    r = variables.select("id", "variavel", "unidade", *keep, F.explode("resultados").alias("r"))
    s = r.select("id", "variavel", "unidade", *keep, F.explode("r.series").alias("s"))
    o = s.select(
        "id", "variavel", "unidade", *keep,
        F.col("s.localidade").alias("loc"),
        F.explode("s.serie").alias("ano_txt", "valor_txt"),
    )
    return o.select(
        F.col("loc.id").alias("localidade_id"),
        F.col("loc.nome").alias("localidade_nome"),
        (F.lit(level) if level is not None else F.col("loc.nivel.id")).alias("nivel"),
        F.col("ano_txt").try_cast("int").alias("ano"),
        F.col("id").try_cast("int").alias("variavel_id"),
        F.col("variavel").alias("variavel_nome"),
        F.col("unidade"),
        parse_feed_number(F.col("valor_txt")).alias("valor"),
        *keep,
    )


def flatten_payload_text(df: DataFrame, text_col: str = "payload", level: str | None = None) -> DataFrame:
    """Raw payload JSON text (one array of variables per row) → tidy rows."""
    v = df.select(F.explode(F.from_json(F.col(text_col), PAYLOAD)).alias("v")).select("v.*")
    return flatten_variables(v, level)


def read_series(spark: SparkSession, path: str, level: str | None = None) -> DataFrame:
    """Landed payload files (array-rooted JSON) → tidy rows."""
    return flatten_variables(read_json(spark, path, VARIABLE), level)


def dedupe_series(tidy: DataFrame, delivery: str | None = None) -> DataFrame:
    """Drop re-delivered observations: one row per (locality, year, variable).

    With ``delivery`` (a column that numbers the deliveries) the first one is
    kept; rows that tie, or all without it, are settled by their other
    columns in order, so every run keeps the same row."""
    key = ["localidade_id", "ano", "variavel_id"]
    rest = [c for c in tidy.columns if c not in key and c != delivery]
    lead = [delivery] if delivery else []
    kept = tidy.groupBy(*key).agg(F.min(F.struct(*lead, *rest)).alias("_row"))
    return kept.select(*key, "_row.*").select(*tidy.columns)


def select_series(
    tidy: DataFrame,
    variables: Sequence[int] | None = None,
    years: Sequence[int] | None = None,
    level: str | None = None,
    localities: Sequence[str] | None = None,
) -> DataFrame:
    """Filter of the landed long table (pushed down to the Parquet scan).
    ``None`` asks for all, an empty list for nothing."""
    out = tidy
    if variables is not None:
        out = out.filter(F.col("variavel_id").isin(list(variables)))
    if years is not None:
        out = out.filter(F.col("ano").isin(list(years)))
    if level is not None:
        out = out.filter(F.col("nivel") == F.lit(level))
    if localities is not None:
        out = out.filter(F.col("localidade_id").isin(list(localities)))
    return out


def series_wide(tidy: DataFrame, names: dict[int, str], keys: Sequence[str] = ("localidade_id", "localidade_nome",
                                                                                   "nivel", "ano"), delivery: str | None = None) -> DataFrame:
    """Long → wide: one column per declared variable (canonical names). Of
    several values of a cell the first delivered one stays (``delivery``
    numbers the deliveries), without it, or among equals, the smallest.

    NULL values are dropped first, so an entity-year whose every variable
    is NULL disappears (as a pandas pivot table does); every declared
    column is still emitted (explicit pivot values).
    """
    mapping = F.create_map(*[x for k, v in names.items() for x in (F.lit(int(k)), F.lit(v))])
    d = tidy.filter(F.col("valor").isNotNull()).withColumn("_var", mapping[F.col("variavel_id")])
    d = d.filter(F.col("_var").isNotNull())
    first = F.min_by("valor", F.struct(F.col(delivery), F.col("valor"))) if delivery else F.min("valor")
    return d.groupBy(*keys).pivot("_var", list(names.values())).agg(first)


def published_years(tidy: DataFrame, requested: Sequence[int] | None = None, year: str = "ano"):
    """(kept, ignored): the requested years the series publishes, and the
    requested years it does not (both as DataFrames of ``ano``)."""
    spark = tidy.sparkSession
    pub = tidy.select(F.col(year).alias("ano")).distinct()
    if requested is None:
        return pub.orderBy("ano"), spark.createDataFrame([], "ano int")
    req = spark.createDataFrame([(int(y),) for y in requested], "ano int")
    return req.join(pub, "ano", "left_semi"), req.join(pub, "ano", "left_anti")


def window_years(tidy: DataFrame, level_col: str = "nivel", municipal_level: str = "N6", first_year: int = 2010,
                 years: Sequence[int] | None = None) -> DataFrame:
    """Per-level year window: the municipal level from ``first_year`` on,
    aggregate levels whole; an explicit ``years`` list overrides both."""
    if years is not None:
        return tidy.filter(F.col("ano").isin(list(years)))
    return tidy.filter((F.col(level_col) != F.lit(municipal_level)) | (F.col("ano") >= F.lit(first_year)))


# --------------------------------------------------------------------------
# Hierarchy and catalogue
# --------------------------------------------------------------------------


def _uf_cols(uf: Column) -> list[Column]:
    return [
        uf["id"].cast("int").alias("uf_id"),
        uf["sigla"].alias("uf_sigla"),
        uf["nome"].alias("uf_nome"),
        uf["regiao"]["id"].cast("int").alias("regiao_id"),
        uf["regiao"]["sigla"].alias("regiao_sigla"),
        uf["regiao"]["nome"].alias("regiao_nome"),
    ]


def flatten_municipalities(m: DataFrame) -> DataFrame:
    """Hierarchy rows → flat municipality dimension.

    The state comes from ``microrregiao.mesorregiao.UF`` or, when the micro
    region is missing, from ``regiao-imediata.regiao-intermediaria.UF``
    (micro/meso then NULL). Rows with no state on either path are dropped.
    """
    micro = F.col("microrregiao")
    meso = micro["mesorregiao"]
    alt = F.col("`regiao-imediata`")["regiao-intermediaria"]["UF"]
    uf = F.coalesce(meso["UF"], alt)
    out = m.select(
        F.col("id").cast("string").alias("municipio_id"),
        F.col("nome").alias("municipio_nome"),
        micro["id"].cast("int").alias("microrregiao_id"),
        micro["nome"].alias("microrregiao_nome"),
        meso["id"].cast("int").alias("mesorregiao_id"),
        meso["nome"].alias("mesorregiao_nome"),
        *_uf_cols(uf),
    )
    return out.filter(F.col("uf_id").isNotNull())


def flatten_municipalities_text(df: DataFrame, text_col: str = "doc") -> DataFrame:
    m = df.select(F.from_json(F.col(text_col), MUNICIPALITY).alias("m")).select("m.*")
    return flatten_municipalities(m)


def flatten_ufs(u: DataFrame) -> DataFrame:
    return u.select(*_uf_cols(F.struct(*[F.col(c) for c in ("id", "sigla", "nome", "regiao")])))


def flatten_regions(r: DataFrame) -> DataFrame:
    return r.select(F.col("id").cast("int").alias("regiao_id"), F.col("sigla").alias("regiao_sigla"),
                    F.col("nome").alias("regiao_nome"))


def flatten_catalog(c: DataFrame) -> DataFrame:
    """Survey → datasets, one row per dataset; dataset ids are integers."""
    return c.select(F.col("id").alias("pesquisa_id"), F.col("nome").alias("pesquisa_nome"),
                    F.explode("agregados").alias("a")).select(
        "pesquisa_id", "pesquisa_nome", F.col("a.id").try_cast("int").alias("agregado_id"), F.col("a.nome").alias("agregado_nome")
    )
