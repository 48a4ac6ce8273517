"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import geocairn as gc
from geocairn.functions.checks import radius_metres
from geocairn.functions.geometry import geometry, geometry_from_geojson, geometry_to_geojson, point_geometry
from geocairn.operators.aggregates import profile
from geocairn.plans.session import scratch_path
from geocairn.sources.readers import read_csv
from geocairn.sources.sinks import output_rows

from .tables import customer_points, event_points, mixed_zones, nation_zones, read, supplier_centres

LATLON = {"lat": "latitude", "lon": "longitude"}
CENTRE = {"centre_lat": "centre_lat", "centre_lon": "centre_lon"}
POLYGON = [[[(-84, 35), (-82, 35.2), (-81.5, 36.6), (-83, 35.9), (-84, 36.5)]]]
# A long zigzag boundary, past the size that is compiled into one expression.
COMB = [[[(-84.4 + 0.05 * i, 36.8 if i % 2 else 36.1) for i in range(60)]
         + [(-81.4, 34.7), (-84.4, 34.7)]]]


def _data(spark: SparkSession, sf_dir: str) -> gc.PointDataset:
    return gc.PointDataset(event_points(spark, sf_dir), "latitude", "longitude", "events")


def _km(df: DataFrame) -> DataFrame:
    return df.withColumn("distance_km", F.round("_distance_km", 6))


# -- filters, projection, top-k ----------------------------------------------------------


def bbox(spark, sf_dir):
    return _data(spark, sf_dir).bbox(35.0, -84.0, 36.0, -82.5).select(
        "event_id", "latitude", "longitude", "event_type")


def bbox_across_180(spark, sf_dir):
    moved = event_points(spark, sf_dir).withColumn(
        "longitude", F.when(F.col("longitude") < -82.75, F.col("longitude") + 263.0)
        .otherwise(F.col("longitude") - 97.0))
    return gc.PointDataset(moved, "latitude", "longitude").bbox(
        35.0, 179.5, 36.5, -179.25, wrap=True).select("event_id", "longitude")


def radius(spark, sf_dir):
    near = _data(spark, sf_dir).radius(lat=35.6, lon=-83.5, radius="20km")
    return _km(near.by_distance("event_id")).select("event_id", "distance_km")


def nearest(spark, sf_dir):
    top = _data(spark, sf_dir).nearest(lat=35.6, lon=-83.5, k=100, tie="event_id")
    return _km(top).select("event_id", "event_type", "distance_km")


def within(spark, sf_dir):
    return _data(spark, sf_dir).within(POLYGON).select("event_id", "user_id")


def within_long_boundary(spark, sf_dir):
    return _data(spark, sf_dir).within(COMB).select("event_id")


def where(spark, sf_dir):
    data = _data(spark, sf_dir).where({"event_type": "click", "user_id": "7"})
    return data.select("event_id", "event_type", "user_id", "value")


def bbox_and_where(spark, sf_dir):
    return gc.run_query(_data(spark, sf_dir), bbox="34.8,-84.2,36.2,-82.0",
                        where="event_type:purchase", select="event_id, value")


def limit_report(spark, sf_dir):
    return gc.run_query(_data(spark, sf_dir), bbox=(35.0, -84.0, 36.0, -82.5), limit=50,
                        tie="event_id", select="event_id,latitude,longitude")


# -- aggregation and metadata ------------------------------------------------------------


def grouped_aggregates(spark, sf_dir):
    out = _data(spark, sf_dir).within(POLYGON).aggregate(
        by="event_type", aggs=["count", "sum:value", "avg:value", "min:value", "max:value"])
    return out.select("event_type", "count", F.round("sum_value", 4).alias("sum_value"),
                      F.round("avg_value", 6).alias("avg_value"), "min_value", "max_value")


def radius_group_count(spark, sf_dir):
    return gc.run_query(_data(spark, sf_dir), lat=36.0, lon=-82.0, radius="60km",
                        group_by="user_id", agg="count")


def _with_gaps(spark, sf_dir):
    gap = F.col("event_type") == "error"
    return event_points(spark, sf_dir).withColumn(
        "latitude", F.when(~gap, F.col("latitude")))


def located_rows(spark, sf_dir):
    return gc.PointDataset(_with_gaps(spark, sf_dir), "latitude", "longitude").select("event_id")


def dataset_profile(spark, sf_dir):
    out = profile(_with_gaps(spark, sf_dir), **LATLON)
    return out.select("row_count", "spatial_points", "out_of_range", "min_lat", "min_lon",
                      "max_lat", "max_lon", F.round("mean_lat", 8).alias("mean_lat"),
                      F.round("mean_lon", 8).alias("mean_lon"),
                      F.round("center_lat", 8).alias("center_lat"),
                      F.round("center_lon", 8).alias("center_lon"))


def schema_report(spark, sf_dir):
    data = gc.PointDataset(event_points(spark, sf_dir).drop("ts"), "latitude", "longitude",
                           "events")
    return data.schema_df().select("source", "row_count", "position", "column_name",
                                   "column_type", F.coalesce("role", F.lit("")).alias("role"))


# -- joins -------------------------------------------------------------------------------


def within_join(spark, sf_dir):
    return gc.within_join(event_points(spark, sf_dir), nation_zones(spark, sf_dir), **LATLON,
                          keep=["n_name"]).select("event_id", "zone_id", "n_name")


def within_join_left(spark, sf_dir):
    return gc.within_join(event_points(spark, sf_dir), nation_zones(spark, sf_dir), **LATLON,
                          how="left").select("event_id", "zone_id")


def within_join_semi(spark, sf_dir):
    return gc.within_join(event_points(spark, sf_dir), nation_zones(spark, sf_dir), **LATLON,
                          how="left_semi").select("event_id", "event_type")


def within_join_anti(spark, sf_dir):
    return gc.within_join(event_points(spark, sf_dir), nation_zones(spark, sf_dir), **LATLON,
                          how="left_anti").select("event_id", "event_type")


def within_join_mixed_sizes(spark, sf_dir):
    """Zones from fifty metres to two degrees across, so of many grid levels."""
    return gc.within_join(event_points(spark, sf_dir), mixed_zones(spark, sf_dir), **LATLON).select("event_id", "zone_id")


def within_join_mixed_left(spark, sf_dir):
    return gc.within_join(event_points(spark, sf_dir), mixed_zones(spark, sf_dir), **LATLON,
                          how="left").select("event_id", "zone_id")


def within_join_mixed_semi(spark, sf_dir):
    return gc.within_join(event_points(spark, sf_dir), mixed_zones(spark, sf_dir), **LATLON,
                          how="left_semi").select("event_id", "event_type")


def within_join_mixed_anti(spark, sf_dir):
    return gc.within_join(event_points(spark, sf_dir), mixed_zones(spark, sf_dir), **LATLON,
                          how="left_anti").select("event_id", "event_type")


def within_join_mixed_shuffled(spark, sf_dir):
    """The same where the cover is too large to broadcast."""
    points, zones = event_points(spark, sf_dir), mixed_zones(spark, sf_dir)
    kinds = [gc.within_join(points, zones, **LATLON, how=how, broadcast_limit=-1).select("event_id", F.lit(how).alias("kind"))
             for how in ("left", "left_semi", "left_anti")]
    return reduce(DataFrame.unionByName, kinds)


def within_join_shuffled(spark, sf_dir):
    return gc.within_join(event_points(spark, sf_dir), nation_zones(spark, sf_dir), **LATLON,
                          broadcast_limit=-1).select("event_id", "zone_id")


def zonal_stats(spark, sf_dir):
    out = gc.zonal_stats(event_points(spark, sf_dir), nation_zones(spark, sf_dir), **LATLON,
                         aggs=["count", "sum:value", "min:value", "max:value"])
    return out.withColumn("sum_value", F.round("sum_value", 4))


def radius_join(spark, sf_dir):
    out = gc.radius_join(event_points(spark, sf_dir), supplier_centres(spark, sf_dir), **LATLON,
                         **CENTRE, radius_m="radius_m", keep=["nation"])
    return _km(out).select("event_id", "centre_id", "nation", "distance_km")


def radius_text_join(spark, sf_dir):
    """Radii given as text with units, as a column."""
    n = F.col("centre_id")
    unit = F.element_at(F.array(*map(F.lit, ("km", "mi", "ft", "m"))), (n % 4 + 1).cast("int"))
    amount = F.when(n % 4 < 2, n % 6 + 1).otherwise((n % 6 + 1) * 3000)
    centres = supplier_centres(spark, sf_dir).drop("radius_m").withColumn(
        "reach", F.concat(amount.cast("string"), F.lit(" "), unit))
    out = gc.radius_join(event_points(spark, sf_dir), centres, **LATLON, **CENTRE,
                         radius_m=radius_metres(F.col("reach")), keep=["reach"])
    return out.groupBy("centre_id", "reach").agg(F.count("*").alias("count"))


def radius_join_shuffled(spark, sf_dir):
    out = gc.radius_join(event_points(spark, sf_dir), supplier_centres(spark, sf_dir), **LATLON,
                         **CENTRE, radius_m="radius_m", broadcast_limit=-1)
    return out.groupBy("centre_id").agg(F.count("*").alias("count"))


def knn_join(spark, sf_dir):
    queries = customer_points(spark, sf_dir).select(
        F.col("c_custkey").alias("query_id"), F.col("latitude").alias("q_lat"),
        F.col("longitude").alias("q_lon"))
    out = gc.knn_join(event_points(spark, sf_dir), queries, k=3, **LATLON, query_lat="q_lat",
                      query_lon="q_lon", tie="event_id")
    return _km(out).select("query_id", "rank", "event_id", "distance_km")


def buffer_join(spark, sf_dir):
    return gc.buffer_join(event_points(spark, sf_dir), supplier_centres(spark, sf_dir), **LATLON,
                          **CENTRE, distance_m="radius_m", segments=24).select(
        "event_id", "centre_id")


# -- geodesic and planar geometry ----------------------------------------------------------


def geodesic_distance(spark, sf_dir):
    """Every event to the centre its number points at; all centres take part."""
    centres = supplier_centres(spark, sf_dir)
    count = centres.select(F.count("*")).scalar()
    pairs = event_points(spark, sf_dir).join(centres, F.col("centre_id") == F.col("event_id") % count + 1)
    out = gc.geodesic_distance(pairs, from_lat="latitude", from_lon="longitude",
                               to_lat="centre_lat", to_lon="centre_lon")
    return out.select("event_id", "centre_id", F.round("distance_m", 2).alias("distance_m"),
                      F.round("distance_km", 5).alias("distance_km"),
                      F.round("distance_mi", 5).alias("distance_mi"),
                      F.round("bearing_deg", 5).alias("bearing_deg"))


def track_lengths(spark, sf_dir):
    out = gc.track_lengths(event_points(spark, sf_dir), **LATLON, track="user_id",
                           order=["ts", "event_id"])
    return out.select("user_id", "point_count", F.round("length_m", 2).alias("length_m"))


def polygon_metrics(spark, sf_dir):
    out = gc.polygon_metrics(nation_zones(spark, sf_dir))
    return out.select("zone_id", F.round("area_km2", 4).alias("area_km2"),
                      F.round("area_ha", 2).alias("area_ha"),
                      F.round("area_acres", 2).alias("area_acres"),
                      F.round("perimeter_m", 2).alias("perimeter_m"),
                      F.round("shell_perimeter_m", 2).alias("shell_perimeter_m"))


def _customer_boxes(spark, sf_dir):
    """One quadrilateral per customer, its corners set by the key."""
    from geocairn.functions.geometry import PARTS_TYPE

    c = customer_points(spark, sf_dir)
    k = F.col("c_custkey")
    w, h = (k % 7 + 1) * F.lit(0.01), (k % 5 + 1) * F.lit(0.02)
    lon, lat = F.col("longitude"), F.col("latitude")
    corners = [(lon, lat), (lon + w, lat), (lon + w * 2.0, lat + h), (lon, lat + h)]
    ring = F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners])
    return c.withColumn("polygons", F.array(F.array(ring)).cast(PARTS_TYPE)).withColumn(
        "geometry", geometry("Polygon", F.col("polygons")))


def customer_areas(spark, sf_dir):
    out = gc.polygon_metrics(_customer_boxes(spark, sf_dir))
    return out.select("c_custkey", F.round("area_km2", 5).alias("area_km2"),
                      F.round("perimeter_m", 2).alias("perimeter_m"))


def centroids(spark, sf_dir):
    zones = nation_zones(spark, sf_dir).select(F.col("zone_id").cast("bigint").alias("id"),
                                               F.lit("zone").alias("kind"), "geometry")
    boxes = _customer_boxes(spark, sf_dir).select(F.col("c_custkey").alias("id"),
                                                  F.lit("box").alias("kind"), "geometry")
    out = gc.centroids(zones.unionByName(boxes))
    return out.select("kind", "id", F.round("centroid.lon", 8).alias("lon"),
                      F.round("centroid.lat", 8).alias("lat"))


def bounds(spark, sf_dir):
    out = gc.bounds(_customer_boxes(spark, sf_dir).select("c_custkey", "geometry"))
    return out.select("c_custkey", "min_lat", "min_lon", "max_lat", "max_lon",
                      F.round("width_km", 6).alias("width_km"),
                      F.round("height_km", 6).alias("height_km"),
                      F.round("area_km2", 5).alias("area_km2"))


def geometry_collections(spark, sf_dir):
    """A collection a customer, read from text: a box inside a second level, a line, or two points count."""
    k, lon, lat = F.col("c_custkey"), F.col("longitude"), F.col("latitude")
    far = F.struct((lon + (k % 7 + 1) * F.lit(0.01)).alias("lon"), (lat + (k % 5 + 1) * F.lit(0.02)).alias("lat"))
    path = F.array(F.struct(lon.alias("lon"), lat.alias("lat")), far)
    point, line, both = (geometry_to_geojson(g) for g in (
        point_geometry(lon=lon, lat=lat), geometry("LineString", F.array(F.array(path))),
        geometry("MultiPoint", F.array(F.array(path)))))

    def gathered(*texts):
        return F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.concat_ws(",", *texts), F.lit("]}"))

    text = F.when(k % 3 == 0, gathered(point, gathered(line, geometry_to_geojson(F.col("geometry"))))).when(
        k % 3 == 1, gathered(point, line)).otherwise(gathered(gathered(both)))
    rows = _customer_boxes(spark, sf_dir).select("c_custkey", text.alias("text"))
    out = gc.bounds(gc.centroids(gc.geometries_from_geojson(rows, "text")))
    return out.select(
        "c_custkey", F.round("centroid.lon", 8).alias("lon"), F.round("centroid.lat", 8).alias("lat"),
        *(F.round(c, 8).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")),
        F.size("geometry.members").alias("members"), (geometry_to_geojson(F.col("geometry")) == F.col("text")).alias("same"))


def total_bounds(spark, sf_dir):
    out = _data(spark, sf_dir).bounds()
    return out.select("min_lat", "min_lon", "max_lat", "max_lon",
                      F.round("width_km", 6).alias("width_km"),
                      F.round("height_km", 6).alias("height_km"))


def buffer_points(spark, sf_dir):
    out = gc.buffer_points(supplier_centres(spark, sf_dir), lat="centre_lat", lon="centre_lon",
                           distance="radius_m", segments=16)
    ring = F.col("geometry.parts")[0][0]
    return out.select("centre_id", "segments", F.posexplode(ring).alias("i", "v")).select(
        "centre_id", "segments", "i", F.round("v.lon", 7).alias("lon"),
        F.round("v.lat", 7).alias("lat"))


def buffer_units(spark, sf_dir):
    """Area of each buffer, its distance in kilometres, miles and feet in turn."""
    centres = supplier_centres(spark, sf_dir)
    out = None
    for unit, amount in (("km", 5.0), ("mi", 3.0), ("ft", 9000.0)):
        part = gc.buffer_points(centres, lat="centre_lat", lon="centre_lon", distance=amount,
                                unit=unit, segments=64)
        part = part.select("centre_id", F.lit(unit).alias("unit"), "distance_m",
                           F.round("area_km2", 4).alias("area_km2"))
        out = part if out is None else out.unionByName(part)
    return out


def _customer_lines(spark, sf_dir):
    """One jagged line of forty vertices per customer."""
    k, lon, lat = F.col("c_custkey").cast("bigint"), F.col("longitude"), F.col("latitude")
    line = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint")), lambda i: F.struct(
        (lon + F.lit(0.01) * i).alias("lon"),
        (lat + ((k + 1) * (i + 3) * (i + 11) * (i + 17) % 99991).cast("double") / 1000000.0).alias("lat")))
    return customer_points(spark, sf_dir).select(
        "c_custkey", geometry("LineString", F.array(F.array(line))).alias("geometry"))


def _line_report(df):
    line = F.col("geometry.parts")[0][0]
    return df.select("c_custkey", F.size(line).alias("vertices"),
                     F.round(F.aggregate(line, F.lit(0.0), lambda a, v: a + v["lon"] + v["lat"]),
                             6).alias("checksum"))


def simplify_by_distance(spark, sf_dir):
    return _line_report(gc.simplify(_customer_lines(spark, sf_dir), tolerance=0.02, method="dp"))


def simplify_by_area(spark, sf_dir):
    return _line_report(gc.simplify(_customer_lines(spark, sf_dir), tolerance=0.0003,
                                    method="vw"))


def simplify_zones(spark, sf_dir):
    """Vertices left in each ring; removable corners lie close to their neighbours."""
    out = gc.simplify(_customer_boxes(spark, sf_dir), tolerance=0.0006, method="vw")
    return out.select("c_custkey", F.size(F.col("geometry.parts")[0][0]).alias("vertices"))


def dissolve(spark, sf_dir):
    """Hull corners of the customers of each nation, on exact integer coordinates."""
    grid = customer_points(spark, sf_dir).select(
        "c_nationkey", F.round(F.col("latitude") * 10000.0).alias("lat"),
        F.round(F.col("longitude") * 10000.0).alias("lon"))
    out = gc.dissolve(grid, by="c_nationkey", lat="lat", lon="lon", include_area=False)
    corners = F.array_distinct(F.col("geometry.parts")[0][0])
    return out.select("c_nationkey", "count", F.explode(corners).alias("v")).select(
        "c_nationkey", "count", F.col("v.lon").cast("bigint").alias("x"),
        F.col("v.lat").cast("bigint").alias("y"))


def dissolve_extent(spark, sf_dir):
    """The box of every group's hull is the box of the group."""
    out = gc.dissolve(event_points(spark, sf_dir), by=["event_type"], **LATLON)
    v = F.col("geometry.parts")[0][0]
    return out.select("event_type", "count", F.array_min(v["lat"]).alias("min_lat"),
                      F.array_max(v["lat"]).alias("max_lat"), F.array_min(v["lon"]).alias("min_lon"),
                      F.array_max(v["lon"]).alias("max_lon"))


BOX = (35.5, -83.5, 35.75, -83.15)


def _snapped(rows: DataFrame) -> gc.PointDataset:
    """Points on a grid of 1/1024 degree, whose hulls are exact in both engines."""
    snapped = {c: F.round(F.col(c) * 1024.0) / 1024.0 for c in LATLON.values()}
    return gc.PointDataset(rows.withColumns(snapped), "latitude", "longitude")


def _hull_size(hull: DataFrame) -> DataFrame:
    return hull.select("point_count", F.round("area_km2", 5).alias("area_km2"), F.round("perimeter_m", 2).alias("perimeter_m"))


def hull_in_box(spark, sf_dir):
    """Size of the hull of the events in a box."""
    return _hull_size(_snapped(_data(spark, sf_dir).bbox(*BOX).df).convex_hull())


def hull_metrics(spark, sf_dir):
    """Size of the hull of all events."""
    return _hull_size(_snapped(event_points(spark, sf_dir)).convex_hull())


def dissolve_metrics(spark, sf_dir):
    """Hull sizes of all events by type."""
    out = _snapped(event_points(spark, sf_dir)).dissolve("event_type")
    return out.select("event_type", "count", F.round("area_km2", 5).alias("area_km2"),
                      F.round("perimeter_m", 2).alias("perimeter_m"))


def where_typed(spark, sf_dir):
    """Equality on a moment, a day, a decimal and a truth value, each given as text."""
    rows = event_points(spark, sf_dir).select(
        "event_id", F.date_trunc("hour", "ts").alias("hour"), F.to_date("ts").alias("day"),
        F.round("value").cast("decimal(12,2)").alias("amount"), (F.col("user_id") % 2 == 0).alias("even"),
        "latitude", "longitude")
    data = gc.PointDataset(rows, "latitude", "longitude")
    tests = {"hour": "2024-01-03 15:00:00", "day": "2024-01-03", "amount": "22.0", "even": "TRUE"}
    found = [data.where({k: v}).df.select("event_id", F.lit(k).alias("test")) for k, v in tests.items()]
    found.append(data.where({"amount": "nan"}).df.select("event_id", F.lit("nan").alias("test")))
    return reduce(DataFrame.union, found)


def nearest_grouped(spark, sf_dir):
    """Types among the 500 nearest events."""
    return gc.run_query(_data(spark, sf_dir), lat=35.6, lon=-83.5, nearest=500, tie="event_id",
                        group_by="event_type", agg="count")


def convex_hull(spark, sf_dir):
    """Corners of the hull of all suppliers."""
    points = supplier_centres(spark, sf_dir).select(
        F.round(F.col("centre_lat") * 10000.0).alias("lat"),
        F.round(F.col("centre_lon") * 10000.0).alias("lon"))
    out = gc.convex_hull(points, lat="lat", lon="lon")
    corners = F.array_distinct(F.col("geometry.parts")[0][0])
    return out.select("point_count", F.explode(corners).alias("v")).select(
        "point_count", F.col("v.lon").cast("bigint").alias("x"),
        F.col("v.lat").cast("bigint").alias("y"))


# -- sources and sinks ---------------------------------------------------------------------

def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = event_points(spark, sf_dir)
    gc.write_csv(rows, path)
    return gc.load_points(spark, path, format="csv", schema=rows.schema).df


def csv_text(spark, sf_dir):
    """Whole texts with quotes, commas and line ends, out and back."""
    path = scratch_path(spark, "csv-text")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(
        F.lit(' "a", b\n'), "text").alias("text"))
    gc.write_csv(rows, path)
    return read_csv(spark, path, rows.schema, multi_line=True)


def csv_text_split(spark, sf_dir):
    """The same texts, each file read by as many tasks as it has splits."""
    path = scratch_path(spark, "csv-split")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(
        F.lit(' "a", b\n'), "text").alias("text"))
    gc.write_csv(rows, path)
    return read_csv(spark, path, rows.schema, split=True)


def json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "json")
    rows = event_points(spark, sf_dir)
    gc.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


def geojson_round_trip(spark, sf_dir):
    path = scratch_path(spark, "geojson")
    rows = event_points(spark, sf_dir)
    gc.write_geojson(rows, path, **LATLON)
    back = gc.load_points(spark, path, format="geojson", lines=True,
                          schema=rows.drop(*LATLON.values()).schema)
    return back.df.select(*rows.columns)


def geojson_document(spark, sf_dir):
    """All zones in one document over many lines, and that it is told from one Feature per line."""
    path = scratch_path(spark, "document")
    zones = nation_zones(spark, sf_dir).select("zone_id", "n_name", "geometry")
    features = gc.feature_lines(zones, geometry="geometry").agg(F.collect_list("value").alias("f"))
    features.select(F.concat(F.lit('{"type":"FeatureCollection","features":[\n'), F.array_join("f", ",\n"),
                             F.lit("\n]}")).alias("value")).write.text(path)
    back = gc.read_features(spark, path)
    return back.select("zone_id", "n_name", F.col("geometry.geom_type").alias("geom_type"),
                       F.size("geometry.parts").alias("parts"))


def geojson_split(spark, sf_dir):
    """Customers as FeatureCollections of a thousand, a file each, read by as many tasks as they have splits."""
    path = scratch_path(spark, "collections") + ".geojson"
    rows = customer_points(spark, sf_dir).select("c_custkey", "c_name", "latitude", "longitude")
    lines = gc.feature_lines(rows, **LATLON)
    thousand = F.floor(F.get_json_object("value", "$.properties.c_custkey").cast("bigint") / 1000)
    documents = lines.groupBy(thousand.alias("part")).agg(F.array_join(F.collect_list("value"), ",\n").alias("features"))
    documents.select(F.concat(F.lit('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "}{"}},'
                                    '\n"features": [\n'), "features", F.lit("\n]}")).alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    back = gc.load_points(spark, path, split=True, schema="c_custkey bigint, c_name string")
    return back.df.select("c_custkey", "c_name", "latitude", "longitude")


def geojson_errors(spark, sf_dir):
    """Customers as Features; every fifth line is cut off and every seventh geometry is of no known type."""
    path = scratch_path(spark, "broken")
    lines = gc.feature_lines(customer_points(spark, sf_dir).select("c_custkey", "latitude", "longitude"), **LATLON)
    key = F.get_json_object("value", "$.properties.c_custkey").cast("bigint")
    text = F.when(key % 5 == 0, F.substring("value", 1, 30)).when(
        key % 7 == 0, F.replace("value", F.lit('"Point"'), F.lit('"Blob"'))).otherwise(F.col("value"))
    lines.select(text.alias("value")).write.text(path)
    back = gc.read_features(spark, path, lines=True, properties="c_custkey bigint", errors="column")
    return back.select("c_custkey", F.col("_error").isNull().alias("sound"), F.col("geometry").isNull().alias("empty"))


def catalog_table(spark, sf_dir):
    event_points(spark, sf_dir).createOrReplaceTempView("geocairn_event_points")
    return gc.load_points(spark, table="geocairn_event_points").bbox(
        35.0, -83.5, 36.0, -83.0).select("event_id", "event_type")


def row_numbers(spark, sf_dir):
    """Numbers run on over the files of a folder; the format is told by its name."""
    path = scratch_path(spark, "rows") + ".parquet"
    read(spark, sf_dir, "events").repartitionByRange(5, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    data = gc.load_points(spark, path, lat="value", lon="event_id", with_rowid=True)
    return data.raw.select("rowid", "event_id")


def clustered_layout(spark, sf_dir):
    path = scratch_path(spark, "layout")
    gc.write_layout(event_points(spark, sf_dir), path, **LATLON, partitions=8)
    whole = gc.load_points(spark, path, format="parquet")
    near = whole.radius(lat=35.2, lon=-82.2, radius="9mi").df.select("event_id", "_distance_km")
    return _km(whole.df.join(near, "event_id", "left")).drop("_distance_km")


def polygon_text(spark, sf_dir):
    """Zones as GeoJSON texts of every accepted kind, and two kinds that are refused."""
    zone = geometry_to_geojson(F.col("geometry"))
    point = F.lit('{"type":"Point","coordinates":[1.5,2.5]}')

    def feature(g):
        return F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), g, F.lit("}"))

    r = F.col("n_regionkey")
    text = (
        F.when(r == 0, zone).when(r == 1, feature(zone))
        .when(r == 2, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature(zone),
                               F.lit(","), feature(zone), F.lit("]}")))
        .when(r == 3, feature(point)).otherwise(F.lit("not json")))
    rows = nation_zones(spark, sf_dir).select("zone_id", "n_regionkey", text.alias("text"))
    out = gc.polygons_from_geojson(rows, "text")
    return out.select(
        "zone_id", F.coalesce("_error", F.lit("")).alias("error"),
        F.coalesce(F.size("polygons"), F.lit(0)).alias("parts"),
        F.round(F.coalesce(F.aggregate(
            F.flatten(F.flatten("polygons")), F.lit(0.0), lambda a, v: a + v["lon"] + v["lat"]),
            F.lit(0.0)), 6).alias("checksum"))


def point_text(spark, sf_dir):
    """Customer positions as points and multipoints in GeoJSON text."""
    c = customer_points(spark, sf_dir)
    pos = F.to_json(F.array("longitude", "latitude"))
    single = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":'), pos,
                      F.lit('},"properties":{}}'))
    multi = F.concat(F.lit('{"type":"MultiPoint","coordinates":['), pos, F.lit(","), pos,
                     F.lit("]}"))
    text = F.when(F.col("c_nationkey") % 2 == 0, single).otherwise(multi)
    out = gc.points_from_geojson(c.select("c_custkey", text.alias("text")), "text")
    return out.groupBy("c_custkey", "lon", "lat").agg(F.count("*").alias("copies"))


def geometry_text_round_trip(spark, sf_dir):
    boxes = _customer_boxes(spark, sf_dir)
    back = boxes.withColumn("g", geometry_from_geojson(geometry_to_geojson(F.col("geometry"))))
    return back.select("c_custkey", F.col("g.geom_type").alias("geom_type"),
                       F.posexplode(F.col("g.parts")[0][0]).alias("i", "v")).select(
        "c_custkey", "geom_type", "i", F.col("v.lon").alias("lon"), F.col("v.lat").alias("lat"))


def polygon_features(spark, sf_dir):
    """Zones written as GeoJSON features with their area, read back."""
    path = scratch_path(spark, "zones")
    zones = gc.polygon_metrics(nation_zones(spark, sf_dir)).select(
        "zone_id", "n_name", F.round("area_km2", 4).alias("area_km2"), "geometry")
    gc.write_geojson(zones, path, geometry="geometry")
    back = gc.read_features(spark, path, lines=True)
    return back.select("zone_id", "n_name", "area_km2",
                       F.col("geometry.geom_type").alias("geom_type"),
                       F.size("geometry.parts").alias("parts"))


def output_values(spark, sf_dir):
    """Values as sinks write them: no NaN, ISO dates, wide integers as text."""
    o = read(spark, sf_dir, "orders")
    wide = F.col("o_orderkey").cast(T.DecimalType(20, 0)) + F.lit(9007199254740993)
    rows = o.select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderstatus") == "F", F.lit(float("nan")))
        .when(F.col("o_orderstatus") == "P", F.lit(float("inf")))
        .otherwise(F.col("o_totalprice")).alias("price"),
        wide.cast(T.DecimalType(20, 0)).alias("wide"))
    return output_rows(rows)


# -- refresh and streaming -------------------------------------------------------------------


def refreshed_view(spark, sf_dir):
    """A good refresh, then a bad one that must leave the first in place."""
    base = scratch_path(spark, "refresh-source")
    rows = event_points(spark, sf_dir).withColumnsRenamed({"latitude": "north", "longitude": "east"})
    north = F.when(F.col("event_type") != "error", F.col("north"))
    rows.withColumn("north", north).write.parquet(base + "/good")
    read(spark, sf_dir, "nation").write.parquet(base + "/bad")
    options = {"format": "parquet", "versions_dir": scratch_path(spark, "versions")}
    gc.refresh(spark, "geocairn_live", base + "/good", lat="north", lon="east", **options)
    try:
        gc.refresh(spark, "geocairn_live", base + "/bad", **options)
    except gc.RefreshFailed:
        pass
    live = gc.published(spark, "geocairn_live")
    count = live.profile().select("row_count").scalar()
    near = live.radius(lat=35.6, lon=-83.5, radius="20000km").df
    return _km(near).drop("_distance_km").withColumn("all_rows", count)


def streamed_zone_points(spark, sf_dir):
    """Files arriving as a stream, joined with static zones."""
    source, sink, log = (scratch_path(spark, n) for n in ("arrivals", "zoned", "progress"))
    rows = event_points(spark, sf_dir)
    rows.write.parquet(source)
    stream = gc.stream_points(spark, source, schema=rows.schema, max_files_per_trigger=4)
    zoned = gc.within_join(stream.df, nation_zones(spark, sf_dir), **LATLON)
    query = (zoned.select("event_id", "ts", "props", "zone_id").writeStream.format("parquet")
             .option("checkpointLocation", log).trigger(availableNow=True).start(sink))
    query.awaitTermination()
    kept = zoned.select("event_id", "ts", "props", "zone_id").schema
    return spark.read.schema(kept).parquet(sink)


def streamed_zone_counts(spark, sf_dir):
    """Daily counts by zone of a stream that stops and starts twice; a tenth of the first days arrives too late."""
    source, sink, log = (scratch_path(spark, n) for n in ("arrivals", "counts", "progress"))
    rows = event_points(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    first, second = F.col("ts") < "2024-01-11", F.col("ts") < "2024-01-21"
    held = first & (F.col("event_id") % 10 == 0)
    for part in (first & ~held, second & ~first, ~second | held):
        rows.where(part).write.mode("append").parquet(source)
        stream = gc.stream_points(spark, source, schema=rows.schema)
        counts = gc.zone_counts(stream, nation_zones(spark, sf_dir), time="ts", window="1 day", delay="6 hours")
        query = (counts.writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", log).trigger(availableNow=True).start(sink))
        query.awaitTermination()
    out = spark.read.schema(counts.schema).parquet(sink)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "zone_id", "count")


def refreshed_elsewhere(spark, sf_dir):
    """Three refreshes and a bad one, read by a session that made none of them."""
    base = scratch_path(spark, "refresh-source")
    rows = event_points(spark, sf_dir)
    for name, kind in (("first", "click"), ("second", "error"), ("third", "purchase")):
        rows.where(F.col("event_type") != kind).write.parquet(f"{base}/{name}")
    read(spark, sf_dir, "nation").write.parquet(base + "/bad")
    versions = scratch_path(spark, "versions")
    for name in ("first", "second", "bad", "third"):
        try:
            gc.refresh(spark, "geocairn_shared", f"{base}/{name}", format="parquet", versions_dir=versions, keep=2)
        except gc.RefreshFailed:
            pass
    return gc.published(spark.newSession(), "geocairn_shared", versions_dir=versions).df.select("event_id", "event_type")


def published_stream(spark, sf_dir):
    """A stream that publishes, stops, and goes on with more files from its checkpoint; read by another session."""
    source, log, versions = (scratch_path(spark, n) for n in ("arrivals", "progress", "versions"))
    rows = event_points(spark, sf_dir)
    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).repartition(2).write.mode("append").parquet(source)
        stream = gc.stream_points(spark, source, schema=rows.schema, max_files_per_trigger=1)
        gc.publish_stream(stream, "geocairn_stream", versions_dir=versions, checkpoint=log,
                          availableNow=True).awaitTermination()
    live = gc.published(spark.newSession(), "geocairn_stream", versions_dir=versions)
    return live.df.select("event_id", "event_type", "value", "latitude", "longitude")


QUERIES = {f.__name__: f for f in (
    bbox, bbox_across_180, radius, nearest, within, within_long_boundary, where, bbox_and_where,
    limit_report, grouped_aggregates, radius_group_count, located_rows, dataset_profile,
    schema_report, within_join, within_join_left, within_join_semi, within_join_anti,
    within_join_shuffled, zonal_stats, radius_join, radius_text_join, radius_join_shuffled,
    knn_join, buffer_join, geodesic_distance, track_lengths, polygon_metrics, customer_areas,
    centroids, bounds, total_bounds, buffer_points, buffer_units, simplify_by_distance,
    simplify_by_area, simplify_zones, dissolve, dissolve_extent, convex_hull, csv_round_trip,
    json_round_trip, geojson_round_trip, catalog_table, row_numbers, clustered_layout,
    polygon_text, point_text, geometry_text_round_trip, polygon_features, output_values,
    refreshed_view, streamed_zone_points, csv_text, geojson_document, geojson_errors, hull_in_box,
    dissolve_metrics, where_typed, nearest_grouped, within_join_mixed_sizes, within_join_mixed_left,
    within_join_mixed_semi, within_join_mixed_anti, within_join_mixed_shuffled, refreshed_elsewhere, published_stream,
    geometry_collections, streamed_zone_counts, hull_metrics, csv_text_split, geojson_split,
)}
