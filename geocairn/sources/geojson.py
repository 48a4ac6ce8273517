"""GeoJSON files and GeoJSON text columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import check_columns
from ..functions.geometry import GEOMETRY_TYPE, geometry_from_geojson
from .splits import feature_texts

_NO_PROPERTIES = T.StructType([])


def _property_schema(inferred: T.StructType) -> T.StructType:
    """The properties struct of a document of features, or of one feature per line."""
    node: T.DataType = inferred
    if "features" in inferred.names:
        node = inferred["features"].dataType
        node = node.elementType if isinstance(node, T.ArrayType) else _NO_PROPERTIES
    if isinstance(node, T.StructType) and "properties" in node.names:
        kind = node["properties"].dataType
        if isinstance(kind, T.StructType):
            return kind
    return _NO_PROPERTIES


def _in_lines(spark: SparkSession, path) -> bool:
    """Whether the first line with text is a JSON value of its own."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    try:
        return bool(first) and json.loads(first[0].value) is not None
    except ValueError:
        return False


def read_features(spark: SparkSession, path, *, lines: bool | None = None, split: bool = False,
                  properties: T.StructType | None = None, errors: str = "raise",
                  **options) -> DataFrame:
    """Property columns plus a ``geometry`` column, one row per feature.

    Geometry text is kept raw by the reader and parsed by type, so files may mix
    geometry types. ``properties`` (a schema) avoids the inference pass. With ``lines`` every line is
    a Feature or a collection, and files can be split between tasks; otherwise a file is one
    document, read by one task; with ``split`` files are FeatureCollections of any size and layout, each read by
    many tasks, and ``properties`` must be given. By default the first line decides. Text that is not JSON and
    geometries that are not understood raise; with
    ``errors="column"`` both are kept as rows whose ``_error`` holds the text.
    """
    if errors not in ("raise", "column"):
        raise ValueError(f"unknown errors: {errors!r}")
    if split and (properties is None or lines):
        raise ValueError("split=True needs properties= and reads whole documents")
    if lines is None:
        lines = not split and _in_lines(spark, path)
    reader = spark.read.options(**options).option("multiLine", not lines).option(
        "mode", "FAILFAST" if errors == "raise" else "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt")
    if properties is None:
        properties = _property_schema(reader.json(path).schema)
    elif isinstance(properties, str):
        properties = T._parse_datatype_string(properties)
    feature = T.StructType().add("type", "string").add("geometry", "string").add(
        "properties", properties)
    document = T.StructType(list(feature.fields)).add("features", T.ArrayType(feature)).add(
        "_corrupt", "string")
    if split:
        features = _split_features(spark, path, feature, errors, options)
    else:
        raw = reader.schema(document).json(path)
        features = raw.select("_corrupt", F.explode(
            F.when(F.col("features").isNotNull(), F.col("features"))
            .otherwise(F.array(F.struct("type", "geometry", "properties")))
            .cast(T.ArrayType(feature))).alias("f"))
    if "geometry" in {n.lower() for n in properties.names}:
        raise ValueError("a property named geometry would hide the geometry")
    columns = [F.col("f.properties").getField(n).alias(n) for n in properties.names]
    text = F.col("f.geometry")
    parsed = features.select("_corrupt", "f", geometry_from_geojson(text).alias("geometry"))
    odd = F.col("geometry").isNull() & text.isNotNull()
    if errors == "column":
        bad = F.coalesce("_corrupt", F.when(odd, text))
        return parsed.select(*columns, "geometry", bad.alias("_error"))
    refused = F.raise_error(F.concat(F.lit("geometry not understood: "), text))
    if split:  # the text of an object that is no feature is never NULL
        odd = odd | F.col("_corrupt").isNotNull()
    return parsed.select(*columns, F.when(odd, refused.cast(GEOMETRY_TYPE)).otherwise(
        F.col("geometry")).alias("geometry"))


def _split_features(spark: SparkSession, path, feature: T.StructType, errors: str, options: dict) -> DataFrame:
    """(_corrupt, f) of the features in documents read by many tasks; other objects among them are corrupt."""
    schema = T.StructType(list(feature.fields)).add("_corrupt", "string")
    texts = {**{n: str(v) for n, v in options.items()}, "columnNameOfCorruptRecord": "_corrupt",
             "mode": "FAILFAST" if errors == "raise" else "PERMISSIVE"}
    parsed = feature_texts(spark, path).select("value", F.from_json("value", schema, texts).alias("f"))
    odd = F.coalesce(F.col("f.type") != "Feature", F.lit(True))
    if errors == "raise":
        refused = F.raise_error(F.concat(F.lit("not a Feature: "), "value"))
        corrupt = F.when(odd, refused.cast("string"))
    else:
        corrupt = F.coalesce("f._corrupt", F.when(odd, F.col("value")))
    return parsed.select(corrupt.alias("_corrupt"), F.struct("f.type", "f.geometry", "f.properties").alias("f"))


def _geometry_texts(text: Column, collections: bool = True) -> Column:
    """JSON texts of the geometries in a Geometry, Feature or (if allowed) FeatureCollection text."""
    head = F.from_json(text, "type STRING, geometry STRING, "
                             "features ARRAY<STRUCT<type: STRING, geometry: STRING>>")
    return (
        F.when(head["type"] == "FeatureCollection",
               F.filter(head["features"]["geometry"], lambda g: g.isNotNull()) if collections
               else F.lit(None))
        .when(head["type"] == "Feature",
              F.filter(F.array(head["geometry"]), lambda g: g.isNotNull()))
        .when(head["type"].isNotNull(), F.array(text))
    )


def geometries_from_geojson(df: DataFrame, column: str) -> DataFrame:
    """Adds ``geometry`` from a Geometry or Feature text, and ``_error`` (NULL when sound)."""
    (column,) = check_columns(df, [column])
    texts = _geometry_texts(F.col(column), collections=False)
    staged = df.withColumn("_one", F.when(F.size(texts) == 1, F.get(texts, F.lit(0))))
    parsed = staged.withColumn("geometry", geometry_from_geojson(F.col("_one")))
    return parsed.withColumn("_error", F.when(
        F.col("geometry").isNull(), F.lit("expected one Geometry or Feature"))).drop("_one")


def _parsed(df: DataFrame, column: str) -> DataFrame:
    (column,) = check_columns(df, [column])
    staged = df.withColumn("_texts", _geometry_texts(F.col(column)))
    return staged.withColumn("_geoms", F.transform("_texts", geometry_from_geojson)).drop("_texts")


def polygons_from_geojson(df: DataFrame, column: str) -> DataFrame:
    """Adds ``polygons`` with the parts of every polygon in the text, and ``_error``.

    Anything but polygons in the text, or no polygon at all, is an error on that row;
    the job goes on.
    """
    geoms = F.col("_geoms")
    polygonal = F.forall(geoms, lambda g: F.coalesce(
        g["geom_type"].isin("Polygon", "MultiPolygon"), F.lit(False)))
    error = (
        F.when(geoms.isNull(), F.lit("not GeoJSON"))
        .when(~polygonal, F.lit("expected Polygon or MultiPolygon"))
        .when(F.size(geoms) == 0, F.lit("no polygons found")))
    parts = F.flatten(F.transform(geoms, lambda g: g["parts"]))
    return (_parsed(df, column).withColumn("_error", error)
            .withColumn("polygons", F.when(F.col("_error").isNull(), parts)).drop("_geoms"))


def points_from_geojson(df: DataFrame, column: str) -> DataFrame:
    """One row per point (multipoints flattened) with ``lon``, ``lat`` and ``_error``.

    Other geometry types are passed over. Text without points keeps one row whose
    coordinates are NULL and whose ``_error`` says why.
    """
    points = F.filter(F.col("_geoms"), lambda g: F.coalesce(
        g["geom_type"].isin("Point", "MultiPoint"), F.lit(False)))
    flat = F.flatten(F.flatten(F.flatten(F.transform(points, lambda g: g["parts"]))))
    out = _parsed(df, column).withColumn(
        "_error", F.when(F.col("_geoms").isNull(), F.lit("not GeoJSON"))
        .when(F.size(points) == 0, F.lit("no points found")))
    return (out.withColumn("_p", F.explode_outer(flat))
            .withColumn("lon", F.col("_p.lon")).withColumn("lat", F.col("_p.lat"))
            .drop("_geoms", "_p"))


__all__ = ["read_features", "geometries_from_geojson", "polygons_from_geojson",
           "points_from_geojson", "GEOMETRY_TYPE"]
