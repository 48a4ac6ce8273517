"""Point and zone tables derived from the shared tables, for Spark and for SQL alike.

The tables carry no coordinates, so positions are computed from keys by the same
arithmetic on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocairn.functions.geometry import PARTS_TYPE, geometry

# Offsets (lon, lat) in degrees of each zone's rings from the zone's corner, by part.
ZONE_SHAPE = (
    (
        ((0.0, 0.0), (0.7, 0.05), (0.6, 0.5), (0.35, 0.25), (0.1, 0.45)),
        ((0.2, 0.1), (0.4, 0.1), (0.4, 0.2), (0.2, 0.2)),
    ),
    (((0.5, 0.3), (0.9, 0.35), (0.7, 0.6)),),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def located(df: DataFrame, key: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    k = F.col(key).cast("bigint")
    return df.withColumn(lat, (F.lit(345000) + (k * 7919) % 25001).cast("double") / 10000.0
                         ).withColumn(lon, (F.lit(-845000) + (k * 104729) % 35001).cast("double")
                                      / 10000.0)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(read(spark, sf_dir, "events"), "event_id")


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(read(spark, sf_dir, "customer"), "c_custkey")


def supplier_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = located(read(spark, sf_dir, "supplier"), "s_suppkey", "centre_lat", "centre_lon")
    return df.select(F.col("s_suppkey").alias("centre_id"), "centre_lat", "centre_lon",
                     (F.lit(1000.0) + (F.col("s_suppkey") % 40) * 250.0).alias("radius_m"),
                     F.col("s_nationkey").alias("nation"))


def nation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``zone_id``, ``n_name``, ``polygons`` and ``geometry``."""
    n = F.col("n_nationkey")
    lat0 = F.lit(34.5) + F.lit(0.5) * F.floor(n / 5).cast("double")
    lon0 = F.lit(-84.5) + F.lit(0.7) * (n % 5).cast("double")
    parts = F.array(*[
        F.array(*[
            F.array(*[F.struct((lon0 + dx).alias("lon"), (lat0 + dy).alias("lat"))
                      for dx, dy in ring])
            for ring in part])
        for part in ZONE_SHAPE]).cast(PARTS_TYPE)
    zones = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("zone_id"), "n_name", "n_regionkey", parts.alias("polygons"))
    return zones.withColumn("geometry", geometry("MultiPolygon", F.col("polygons")))


def mixed_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square zones of suppliers, of sides from 0.0005 to 2.048 degrees."""
    centres = supplier_centres(spark, sf_dir)
    x, y = F.col("centre_lon"), F.col("centre_lat")
    side = F.lit(0.0005) * F.pow(F.lit(4.0), (F.col("centre_id") % 7).cast("double"))
    ring = F.array(*[F.struct(a.alias("lon"), b.alias("lat"))
                     for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side))])
    return centres.select(F.col("centre_id").alias("zone_id"), F.array(F.array(ring)).cast(PARTS_TYPE).alias("polygons"))


# -- the same tables in SQL ------------------------------------------------------------


def sql_located(table: str, key: str, lat: str = "latitude", lon: str = "longitude") -> str:
    return (f"SELECT *, CAST(345000 + (CAST({key} AS BIGINT) * 7919) % 25001 AS DOUBLE) / 10000 "
            f"AS {lat}, CAST(-845000 + (CAST({key} AS BIGINT) * 104729) % 35001 AS DOUBLE) / 10000 "
            f"AS {lon} FROM {table}")


EVENT_POINTS = sql_located("events", "event_id")
CUSTOMER_POINTS = sql_located("customer", "c_custkey")
SUPPLIER_CENTRES = (
    "SELECT s_suppkey AS centre_id, centre_lat, centre_lon, "
    "CAST(1000 + (s_suppkey % 40) * 250 AS DOUBLE) AS radius_m, s_nationkey AS nation "
    f"FROM ({sql_located('supplier', 's_suppkey', 'centre_lat', 'centre_lon')})")


def _zone_edge_values() -> str:
    rows = []
    for p, part in enumerate(ZONE_SHAPE):
        for r, ring in enumerate(part):
            for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1])):
                rows.append(f"({p}, {r}, {i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})")
    return ", ".join(rows)


# one row per zone edge: zone_id, part, ring, i, x1, y1, x2, y2
ZONE_EDGES = (
    "SELECT n_nationkey AS zone_id, n_name, part, ring, i, "
    "lon0 + CAST(dx1 AS DOUBLE) AS x1, lat0 + CAST(dy1 AS DOUBLE) AS y1, "
    "lon0 + CAST(dx2 AS DOUBLE) AS x2, lat0 + CAST(dy2 AS DOUBLE) AS y2 "
    "FROM (SELECT *, CAST(34.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(n_nationkey // 5 AS DOUBLE)"
    " AS lat0, CAST(-84.5 AS DOUBLE) + CAST(0.7 AS DOUBLE) * CAST(n_nationkey % 5 AS DOUBLE) AS "
    f"lon0 FROM nation), (VALUES {_zone_edge_values()}) "
    "AS s(part, ring, i, dx1, dy1, dx2, dy2)")

# strictly-inside test as aggregates over the edges of one part
SIDE = "((x2 - x1) * (latitude - y1) - (longitude - x1) * (y2 - y1))"
ON_EDGE = (f"({SIDE} = 0 AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2) "
           "AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2))")
CROSSES = f"((y1 > latitude) <> (y2 > latitude) AND ({SIDE} > 0) = (y2 > y1))"
INSIDE = (f"sum(CASE WHEN {ON_EDGE} THEN 1 ELSE 0 END) = 0 AND "
          f"sum(CASE WHEN {CROSSES} THEN 1 ELSE 0 END) % 2 = 1")

# (event_id, zone_id) pairs, one per point and zone
EVENT_ZONES = (
    "SELECT DISTINCT event_id, zone_id FROM (SELECT event_id, zone_id, part "
    f"FROM ({EVENT_POINTS}) e JOIN ({ZONE_EDGES}) z ON true "
    f"GROUP BY event_id, zone_id, part HAVING {INSIDE})")


# (event_id, zone_id) pairs of the square zones
_SIDE = "0.0005::DOUBLE * pow(4.0::DOUBLE, (centre_id % 7)::DOUBLE)"
MIXED_ZONES = (
    f"SELECT event_id, centre_id AS zone_id FROM ({EVENT_POINTS}) JOIN (SELECT *, {_SIDE} AS side FROM ({SUPPLIER_CENTRES})) "
    "ON latitude > centre_lat AND latitude < centre_lat + side AND longitude > centre_lon AND longitude < centre_lon + side")


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Spherical distance in metres."""
    return (f"(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) "
            f"+ cos(radians({lat1})) * cos(radians({lat2})) * "
            f"pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")
