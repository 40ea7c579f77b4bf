"""GeoJSON features: reading collections, writing one feature per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from patchloom.functions.geometry import GEOM_TYPE, bbox

POLYGON_TYPE = "array<array<array<double>>>"


def _feature_schema(properties: str, coordinates: str = "string") -> str:
    # coordinates are not parsed here: their depth depends on the geometry type
    return (
        f"struct<properties:struct<{_colons(properties)}>,geometry:struct<type:string,coordinates:{coordinates}>>"
    )


def _colons(ddl: str) -> str:
    fields = T.StructType.fromDDL(ddl)
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields)


def _geometry(features: DataFrame, keep: Sequence[str] = (), variant: bool = False) -> DataFrame:
    """Columns of parsed features ``f``: properties, type, geometry array and box."""
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    if variant:
        text = F.to_json(text)
    geom = F.when(kind == "Polygon", F.array(F.from_json(text, POLYGON_TYPE))).when(
        kind == "MultiPolygon", F.from_json(text, GEOM_TYPE)
    )
    shaped = features.select(*keep, "f.properties.*", kind.alias("geometry_type"), geom.alias("geom"))
    return bbox(shaped)


def parse_features(lines: DataFrame, properties: str, value: str = "value") -> DataFrame:
    """One feature per text row; ``properties`` is a DDL list of the wanted fields."""
    f = F.from_json(F.col(value), _feature_schema(properties))
    return _geometry(lines.select(f.alias("f")))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Read feature collections (one JSON document per file); Polygon and MultiPolygon.

    A document is read whole and once by one task, as its format asks; many files are
    read in parallel.  For large layers use feature-per-line files.  Coordinates are
    variants, which are parsed as they go by: for text the reader goes back to the file,
    some 12 kB for each feature.  Spark bounds a variant, so one geometry, at 128 MB.
    """
    schema = f"crs struct<properties:struct<name:string>>, features array<{_feature_schema(properties, 'variant')}>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    features = docs.select(
        F.col("crs.properties.name").alias("crs"), F.explode("features").alias("f")
    )
    return _geometry(features, ["crs"], variant=True)


def read_geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Read feature-per-line files, which split between tasks."""
    return parse_features(spark.read.text(path), properties)


def feature_text(properties: Sequence[str], geom: str = "geom") -> Column:
    """A feature as JSON text; a single polygon is written as Polygon."""
    single = F.size(geom) == 1
    coordinates = F.when(single, F.to_json(F.get(F.col(geom), F.lit(0)))).otherwise(F.to_json(geom))
    kind = F.when(single, "Polygon").otherwise("MultiPolygon")
    return F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}),
        F.lit(',"geometry":{"type":"'),
        kind,
        F.lit('","coordinates":'),
        coordinates,
        F.lit("}}"),
    )


def write_geojson(
    df: DataFrame, path: str, properties: Sequence[str], geom: str = "geom", mode: str = "error"
) -> None:
    """Write one feature per line, so that every task writes its own part."""
    df.select(feature_text(properties, geom).alias("value")).write.mode(mode).text(path)
