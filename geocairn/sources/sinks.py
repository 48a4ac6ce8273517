"""JSON, CSV and GeoJSON output. Every writer is a plain distributed Spark write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import check_columns
from ..functions.geometry import geometry_to_geojson


# Moments are written whole; Spark's own default cuts them to milliseconds.
TIME_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CSV_WRITE = {
    "header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **TIME_FORMATS,
}


def output_value(field: T.StructField) -> Column:
    """A column as it leaves the engine: no NaN or infinity, ISO dates, wide integers as text."""
    c, kind = F.col(field.name), field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(field.name)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd").alias(field.name)
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision > 18:
        return c.cast("string").alias(field.name)
    return c


def output_rows(df: DataFrame) -> DataFrame:
    """Apply :func:`output_value` to every column."""
    return df.select(*[output_value(f) for f in df.schema.fields])


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line; NULL fields are kept."""
    output_rows(df).write.mode(mode).options(ignoreNullFields=False, **TIME_FORMATS).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV (RFC 4180) with a header, also for empty output; nested values are JSON.

    NULL and the empty text are both written as nothing, so they read back as NULL.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    rows = output_rows(df)
    rows = rows.select(*[
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in rows.schema.fields])
    # binary has no CSV form; text is its closest
    rows = rows.select(*[
        F.base64(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType)
        else F.col(f.name) for f in rows.schema.fields])
    (rows.write.mode(mode).options(**CSV_WRITE).csv(path))


def feature_lines(df: DataFrame, *, lat: str | None = None, lon: str | None = None,
                  geometry: str | None = None) -> DataFrame:
    """One GeoJSON Feature text per row in column ``value``.

    Point features from ``lat`` and ``lon``, or any geometry from a geometry column; all
    other columns become properties. Rows without a finite position are left out.
    """
    if geometry is not None:
        (geometry,) = check_columns(df, [geometry])
        shape, hidden = geometry_to_geojson(F.col(geometry)), {geometry}
        df = df.filter(F.col(geometry).isNotNull())
    else:
        if lat is None or lon is None:
            raise ValueError("give lat= and lon=, or geometry=")
        lat, lon = check_columns(df, [lat, lon])
        y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
        finite = F.abs(y).between(0.0, 1.7976931348623157e308) & F.abs(x).between(
            0.0, 1.7976931348623157e308)
        df = df.filter(finite)
        shape = F.to_json(F.struct(F.lit("Point").alias("type"),
                                   F.array(x, y).alias("coordinates")))
        hidden = {lat, lon}
    fields = [output_value(f) for f in df.schema.fields if f.name not in hidden]
    properties = (F.to_json(F.struct(*fields), {"ignoreNullFields": "false", **TIME_FORMATS})
                  if fields else F.lit("{}"))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape,
                              F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, path: str, *, lat: str | None = None, lon: str | None = None,
                  geometry: str | None = None, mode: str = "error") -> None:
    """GeoJSON text sequence, one Feature per line, so that tasks write side by side."""
    feature_lines(df, lat=lat, lon=lon, geometry=geometry).write.mode(mode).text(path)



def write_rows(df: DataFrame, path: str, *, format: str = "json", lat: str | None = None,
               lon: str | None = None, mode: str = "error") -> None:
    """Write rows as ``"json"``, ``"csv"`` or ``"geojson"``; any other name raises."""
    if format == "json":
        write_json(df, path, mode)
    elif format == "csv":
        write_csv(df, path, mode)
    elif format == "geojson":
        write_geojson(df, path, lat=lat, lon=lon, mode=mode)
    else:
        raise ValueError(f"unknown output format: {format!r}")
