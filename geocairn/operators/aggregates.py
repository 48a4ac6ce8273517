"""Grouped aggregates and one-pass dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_columns

_FUNCTIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def parse_agg(df: DataFrame, spec: str) -> Column:
    """``"count"``, ``"sum:col"``, ``"avg:col"``, ``"min:col"`` or ``"max:col"``."""
    name, _, column = spec.partition(":")
    name, column = name.strip().lower(), column.strip()
    if name == "count" and not column:
        return F.count("*").alias("count")
    if name not in _FUNCTIONS or not column:
        raise ValueError(f"unknown aggregate: {spec!r}")
    (column,) = check_columns(df, [column])
    return _FUNCTIONS[name](column).alias(f"{name}_{column}")


def aggregate(df: DataFrame, *, by: str | list[str], aggs: str | list[str]) -> DataFrame:
    """Group by one or more keys; NULL keys form a group."""
    keys = check_columns(df, [by] if isinstance(by, str) else by)
    specs = [aggs] if isinstance(aggs, str) else aggs
    return df.groupBy(*keys).agg(*[parse_agg(df, a) for a in specs])


def profile(df: DataFrame, *, lat: str, lon: str) -> DataFrame:
    """One row: counts, extent, box centre and mean position, in a single pass.

    ``spatial_points`` counts rows with both coordinates; ``out_of_range`` those of
    them outside the valid degrees (NaN included).
    """
    y, x = F.col(lat), F.col(lon)
    valid = y.isNotNull() & x.isNotNull()

    def over(fn, c):
        return fn(F.when(valid, c))

    sane = y.between(-90.0, 90.0) & x.between(-180.0, 180.0)
    stats = df.agg(
        F.count("*").alias("row_count"),
        F.count_if(valid).alias("spatial_points"),
        F.count_if(valid & ~sane).alias("out_of_range"),
        over(F.min, y).alias("min_lat"), over(F.min, x).alias("min_lon"),
        over(F.max, y).alias("max_lat"), over(F.max, x).alias("max_lon"),
        over(F.avg, y).alias("mean_lat"), over(F.avg, x).alias("mean_lon"),
    )
    return stats.withColumn(
        "center_lat", (F.col("min_lat") + F.col("max_lat")) / 2.0
    ).withColumn("center_lon", (F.col("min_lon") + F.col("max_lon")) / 2.0)


def schema_report(df: DataFrame, *, source: str, lat: str, lon: str) -> DataFrame:
    """One row per column: name, type, its coordinate role, with source and row count."""
    fields = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                       F.lit(f.dataType.simpleString()).alias("column_type"),
                       F.lit({lat: "lat", lon: "lon"}.get(f.name)).alias("role"))
              for i, f in enumerate(df.schema.fields, 1)]
    return (df.agg(F.count("*").alias("row_count"))
            .select(F.lit(source).alias("source"), "row_count", F.inline(F.array(*fields))))
