"""Polygon meshes: reading FeatureCollections, ring orientation, clipping
to a set of codes, attaching data.

A feature is one row ``(codarea, geom_type, coordinates)`` where
``coordinates`` is always a MultiPolygon ``array<array<array<array<double>>>>``
(polygons are wrapped in one more array). All geometry work is
higher-order built-in functions over those arrays — no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fmt_number_br

POINT = T.ArrayType(T.DoubleType())
RING = T.ArrayType(POINT)
POLYGON = T.ArrayType(RING)
MULTIPOLYGON = T.ArrayType(POLYGON)

# ``coordinates`` differs in depth between Polygon and MultiPolygon, so it
# is read as raw JSON text and parsed per geometry type.
FEATURE_COLLECTION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("properties", T.StructType([T.StructField("codarea", T.StringType())])),
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)


FEATURE = FEATURE_COLLECTION["features"].dataType.elementType

#: What stands once in every feature and nowhere else in a collection.
_MARK = '"Feature"'


def _parsed(features: DataFrame) -> DataFrame:
    """Rows ``f`` of ``FEATURE`` → (codarea, geom_type, coordinates)."""
    gtype = F.col("f.geometry.type")
    text = F.col("f.geometry.coordinates")
    coords = F.when(gtype == F.lit("Polygon"), F.array(F.from_json(text, POLYGON))).when(
        gtype == F.lit("MultiPolygon"), F.from_json(text, MULTIPOLYGON)
    )
    return features.select(
        F.col("f.properties.codarea").alias("codarea"),
        gtype.alias("geom_type"),
        coords.alias("coordinates"),
    )


def features_from_collections(fc: DataFrame) -> DataFrame:
    """FeatureCollection rows → one row per feature (all collections of the
    input are concatenated, e.g. one file per state)."""
    return _parsed(fc.filter(F.col("type") == F.lit("FeatureCollection")).select(F.explode("features").alias("f")))


def read_features(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Read one or many GeoJSON FeatureCollection files (glob allowed);
    ``lines``: a collection on every line, which Spark splits. Otherwise a
    file is one task: see ``read_large_features``."""
    fc = spark.read.schema(FEATURE_COLLECTION).option("multiLine", not lines).json(path)
    return features_from_collections(fc)


def read_large_features(spark: SparkSession, path: str) -> DataFrame:
    """Read FeatureCollection files of any size by several tasks each.

    The text is cut at the mark that every feature has once (``"Feature"``),
    which is a record delimiter that files can be split at; what stands
    between two marks is a feature without its beginning, and a little of the
    next one's. So ``type`` must be the first member of every feature and the
    mark must not occur in the properties. White space and line ends don't
    matter. A feature that doesn't parse is an error, not a lost row."""
    cut = spark.read.option("lineSep", _MARK).text(path).select(F.ltrim("value").alias("t"))
    # the text before a file's first feature opens the collection; the others go on after a type
    rest = cut.where(F.col("t").startswith(","))
    whole = F.from_json(F.concat(F.lit('{"type":"Feature"'), F.col("t")), FEATURE, {"mode": "FAILFAST"})
    return _parsed(rest.select(whole.alias("f")))


def ring_signed_area(ring: Column) -> Column:
    """``Σ (x₂−x₁)(y₂+y₁)`` over consecutive points: > 0 means clockwise."""
    n = F.size(ring)
    return F.when(
        n >= 2,
        F.aggregate(
            F.sequence(F.lit(0), n - 2),
            F.lit(0.0),
            lambda acc, i: acc + (ring[i + 1][0] - ring[i][0]) * (ring[i + 1][1] + ring[i][1]),
        ),
    ).otherwise(F.lit(0.0))


def reorient(coordinates: Column) -> Column:
    """Outer rings clockwise, holes counter-clockwise; rings with fewer than
    four points untouched. Idempotent."""

    def fix_ring(ring: Column, i: Column) -> Column:
        clockwise = ring_signed_area(ring) > 0
        keep = (F.size(ring) < 4) | (clockwise == (i == 0))
        return F.when(keep, ring).otherwise(F.reverse(ring))

    return F.transform(coordinates, lambda poly: F.transform(poly, fix_ring))


def reorient_features(features: DataFrame) -> DataFrame:
    return features.withColumn("coordinates", reorient(F.col("coordinates")))


def clip_to_codes(features: DataFrame, codes: DataFrame, code_col: str = "codarea") -> DataFrame:
    """Keep the features whose code is in ``codes`` (semi join)."""
    return features.join(codes.select(F.col(code_col).cast("string").alias("codarea")), "codarea", "left_semi")


def attach_data(features: DataFrame, data: DataFrame, key: str, name: str, value: str, decimals: int = 0,
                how: str = "left") -> DataFrame:
    """Features with the entity name and the value formatted for display
    (``—`` when missing); join on ``codarea = string(key)``."""
    d = data.select(F.col(key).cast("string").alias("codarea"), F.col(name).alias("nome"), F.col(value).alias("valor"))
    j = features.join(d, "codarea", how)
    return j.withColumn("valor_fmt", fmt_number_br(F.col("valor"), decimals))


def square_meshes(entities: DataFrame, key: str, area: str, *, ccw: Column, hole: Column) -> DataFrame:
    """One square polygon per entity with side ``sqrt(area)`` (lower-left at
    ``(x0, y0)``), counter-clockwise when ``ccw``, with a same-orientation
    hole of half the side when ``hole``; an entity without area has an empty
    geometry. A mesh derived from a table, for exercising the geometry
    operators on data of any size."""
    base = entities.select(
        F.col(key).cast("string").alias("codarea"),
        (F.col(key).cast("long") % 100).cast("double").alias("_x0"),
        F.floor(F.col(key).cast("long") / 100).cast("double").alias("_y0"),
        ccw.alias("_ccw"), hole.alias("_hole"), F.when(F.col(area) > 0, F.sqrt(F.col(area).cast("double"))).alias("lado"),
    )
    x0, y0, side, counter_clockwise = F.col("_x0"), F.col("_y0"), F.col("lado"), F.col("_ccw")

    def square(x, y, d):
        pts = F.array(F.array(x, y), F.array(x + d, y), F.array(x + d, y + d), F.array(x, y + d), F.array(x, y))
        return F.when(counter_clockwise, pts).otherwise(F.reverse(pts))

    outer = square(x0, y0, side)
    inner = square(x0 + side / 4, y0 + side / 4, side / 2)
    poly = F.when(F.col("_hole"), F.array(outer, inner)).otherwise(F.array(outer))
    none = F.array().cast("array<array<array<array<double>>>>")
    return base.select("codarea", F.lit("MultiPolygon").alias("geom_type"), F.when(side.isNull(), none).otherwise(F.array(poly)).alias("coordinates"), "lado")
