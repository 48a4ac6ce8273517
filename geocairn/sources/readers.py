"""Point table sources: CSV, Parquet, GeoJSON files and catalog tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import PointDataset
from ..functions.checks import check_identifier, detect_coordinates
from ..plans.session import join_side, materialize
from .geojson import read_features
from .splits import csv_records

# File extensions and the format each one means.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".geojson": "geojson", ".json": "geojson"}


def format_of(path: str, format: str | None = None) -> str:
    if format is not None:
        if format not in FORMATS.values():
            raise ValueError(f"unknown format: {format!r}")
        return format
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; pass format=")
    return FORMATS[extension]


def _widened(schema: T.StructType) -> T.StructType:
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return T.StructType([
        T.StructField(f.name, T.LongType() if isinstance(f.dataType, small) else f.dataType,
                      f.nullable) for f in schema.fields])


# RFC 4180: a quote inside quotes is doubled. Rows that do not fit fail the read.
CSV_READ = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path, schema=None, *, multi_line: bool = False, split: bool = False,
             **options) -> DataFrame:
    """CSV with a header. Without ``schema`` one extra pass infers it; integers become BIGINT.

    ``multi_line`` allows line ends inside quotes; a file is then read by one task, so keep files
    small. ``split`` allows them as well and reads one file by many tasks; it needs a ``schema`` and plain UTF-8
    files whose lines end in a line feed. Without either such rows raise, like any row that does not fit the header
    or the schema.
    """
    if split:
        return _split_csv(spark, path, schema, {**CSV_READ, **options})
    options = {**CSV_READ, "multiLine": multi_line, **options}
    if schema is None:
        schema = _widened(spark.read.options(**options).option("inferSchema", True).csv(path).schema)
    return spark.read.options(**options).schema(schema).csv(path)


def _split_csv(spark: SparkSession, path, schema, options: dict) -> DataFrame:
    if schema is None:
        raise ValueError("split=True needs a schema")
    fixed = {n for n in options if n.lower() in ("quote", "escape", "linesep", "encoding", "charset", "comment")}
    if any(options[n] != CSV_READ.get(n) for n in fixed):
        raise ValueError(f"split=True reads UTF-8 by RFC 4180, so these cannot be set: {sorted(fixed - set(CSV_READ))}")
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    texts = {str(n): str(v).lower() if isinstance(v, bool) else str(v) for n, v in options.items()}
    records = csv_records(spark, path).filter(F.trim("value", F.lit(" \t\r\n")) != "")
    if texts.pop("header").lower() == "true":
        records = records.filter(~F.col("_head"))
    row = F.from_csv("value", schema.toDDL(), {**texts, "multiLine": "true"})
    return records.select(row.alias("_row")).select("_row.*")


def _numbered(raw: DataFrame) -> DataFrame:
    """1-based contiguous row numbers for a Parquet scan, in file order.

    A row's place in its file comes with the scan, so the number does not depend on
    how the scan is split or on a task being run again. Only per-file counts are
    summed in one place; data rows never meet in one window.
    """
    from pyspark.sql import Window

    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    counts = raw.select(file.alias("_file")).groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    size = sum(len(f.encode()) + 64 for f in raw.inputFiles())
    placed = raw.select(file.alias("_file"), row.alias("_row"), "*")
    return placed.join(join_side(starts, size), "_file").select(
        (F.col("_start") + F.col("_row") + 1).alias("rowid"), *raw.columns)


def load_points(
    spark: SparkSession, path: str | None = None, *, table: str | None = None,
    format: str | None = None, schema=None, lat: str | None = None, lon: str | None = None,
    with_rowid: bool = False, lines: bool | None = None, **options,
) -> PointDataset:
    """Open a file, directory, glob or catalog table as a dataset of points.

    Coordinate columns are found by name unless given. Rows without coordinates are
    left out of queries but counted by ``profile``. ``with_rowid`` adds a contiguous
    ``rowid``: Parquet is numbered in place, other sources are first written to the
    shared scratch folder. ``lines`` is for GeoJSON, see :func:`read_features`.
    """
    if (path is None) == (table is None):
        raise ValueError("give either a path or table=")
    if table is not None:
        kind, source = "table", check_identifier(table)
        raw = spark.table(table)
    else:
        kind, source = format_of(path, format), path
        if kind == "csv":
            raw = read_csv(spark, path, schema, **options)
        elif kind == "parquet":
            reader = spark.read.options(**options)
            raw = (reader.schema(schema) if schema is not None else reader).parquet(path)
        else:
            raw = read_features(spark, path, lines=lines, properties=schema, **options)
    if with_rowid:
        if kind != "parquet":
            raw = materialize(raw, "rows")
        raw = _numbered(raw)
    if kind == "geojson":
        raw, lat, lon = _point_columns(raw, lat, lon)
    lat, lon = detect_coordinates(raw.columns, lat, lon)
    return PointDataset(raw, lat, lon, source)


def _point_columns(raw: DataFrame, lat, lon):
    """Take coordinates from point geometries when no property holds them."""
    try:
        return raw, *detect_coordinates(raw.columns, lat, lon)
    except ValueError:
        if lat or lon:
            raise
    point = F.when(F.col("geometry.geom_type") == "Point", F.col("geometry.parts")[0][0][0])
    taken = {c.lower() for c in raw.columns}
    if taken & {"latitude", "longitude"}:
        raise ValueError("only one coordinate property found; name both with lat= and lon=")
    return (raw.withColumn("latitude", point["lat"]).withColumn("longitude", point["lon"]),
            "latitude", "longitude")


def load_csv(spark, path, **kw) -> PointDataset:
    return load_points(spark, path, format="csv", **kw)


def load_parquet(spark, path, **kw) -> PointDataset:
    return load_points(spark, path, format="parquet", **kw)


def load_geojson(spark, path, **kw) -> PointDataset:
    return load_points(spark, path, format="geojson", **kw)
