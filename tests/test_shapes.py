"""Geometry operators over tables of shapes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from conftest import plan_of

import geocairn as gc
from geocairn.functions.geometry import geometry, geometry_to_geojson, parts_literal, point_geometry


def shape(spark, kind, parts):
    return spark.range(1).select(geometry(kind, parts_literal(parts)).alias("geometry"))


SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]


@pytest.mark.parametrize("kind, parts, expected", [
    ("Polygon", [[SQUARE]], (1, 1)),
    ("Polygon", [[SQUARE[::-1]]], (1, 1)),
    ("Polygon", [[SQUARE, [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]], (7 / 6, 7 / 6)),
    ("MultiPolygon", [[SQUARE], [[(10, 0), (11, 0), (11, 1), (10, 1), (10, 0)]]], (2.9, 0.9)),
    ("Polygon", [[[(0, 0), (4, 0), (0, 0)]]], (2, 0)),  # no area: the outline counts
    ("Polygon", [[[(3, 3), (3, 3), (3, 3)]]], (3, 3)),
    ("LineString", [[[(0, 0), (2, 0), (2, 2)]]], (1.5, 0.5)),
    ("MultiLineString", [[[(0, 0), (2, 0)]], [[(0, 4), (6, 4)]]], (2.5, 3)),
    ("MultiPoint", [[[(0, 0), (3, 6), (3, 0)]]], (2, 2)),
    ("Point", [[[(5, 6)]]], (5, 6)),
])
def test_centroid(spark, kind, parts, expected):
    c = gc.centroids(shape(spark, kind, parts)).collect()[0].centroid
    assert (c.lon, c.lat) == pytest.approx(expected)


def test_empty_shapes(spark):
    empty = shape(spark, "Polygon", [])
    assert gc.centroids(empty).collect()[0].centroid is None
    row = gc.bounds(empty).collect()[0]
    assert row.min_lat is None and row.envelope is None and row.area_km2 is None


def test_bounds(spark):
    row = gc.bounds(shape(spark, "Polygon", [[[(0, 0), (1, 0), (1, 1), (0, 1)]]])).collect()[0]
    assert (row.min_lat, row.min_lon, row.max_lat, row.max_lon) == (0, 0, 1, 1)
    assert row.width_km == pytest.approx(111.319491, abs=1e-6)
    assert row.height_km == pytest.approx(110.574389, abs=1e-6)
    assert row.area_km2 == pytest.approx(12308.778, abs=1e-3)
    ring = [(v.lon, v.lat) for v in row.envelope.parts[0][0]]
    assert ring == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]


def test_polygon_metrics(spark):
    hole = [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5)]
    unit = [(0, 0), (1, 0), (1, 1), (0, 1)]
    df = spark.range(1).select(parts_literal([[unit]]).alias("a"), parts_literal([[hole]]).alias("b"),
                               parts_literal([[unit, hole]]).alias("c"),
                               parts_literal([[unit], [hole]]).alias("d"),
                               F.lit(None).cast("array<array<array<struct<lon:double,lat:double>>>>")
                               .alias("e"))
    m = {c: gc.polygon_metrics(df, polygons=c).collect()[0] for c in "abcde"}
    assert m["c"].area_m2 == pytest.approx(m["a"].area_m2 - m["b"].area_m2)
    assert m["d"].area_m2 == pytest.approx(m["a"].area_m2 + m["b"].area_m2)
    assert m["c"].perimeter_m == pytest.approx(m["a"].perimeter_m + m["b"].perimeter_m)
    assert m["c"].shell_perimeter_m == pytest.approx(m["a"].perimeter_m)
    # between two parallels of the ellipsoid, by its closed form; the upper side is a geodesic, hence the tolerance
    e, phi = math.sqrt(0.00669437999014), math.radians(1.0)
    strip = math.sin(phi) / (1 - (e * math.sin(phi)) ** 2) + math.atanh(e * math.sin(phi)) / e
    assert m["a"].area_m2 == pytest.approx(6356752.314245 ** 2 / 2 * phi * strip, rel=1e-4)
    assert m["a"].area_ha == pytest.approx(m["a"].area_km2 * 100)
    assert m["a"].area_acres == pytest.approx(m["a"].area_m2 / 4046.8564224)
    assert m["e"].area_m2 is None and m["e"].perimeter_m is None


def test_buffer(spark):
    df = spark.createDataFrame([(-12.25, 130.75)], "lat double, lon double")
    row = gc.buffer_points(df, lat="lat", lon="lon", distance=7500, unit="m", segments=32).collect()[0]
    ring = row.geometry.parts[0][0]
    assert len(ring) == 33 and ring[0] == ring[-1] and row.distance_m == 7500 and row.segments == 32
    assert row.area_km2 == pytest.approx(16 * 7.5 ** 2 * math.sin(math.pi / 16), rel=1e-4)  # a regular polygon
    turn = sum(a.lon * b.lat - b.lon * a.lat for a, b in zip(ring, ring[1:]))
    assert turn > 0  # counter-clockwise
    north = max(ring, key=lambda v: v.lat)
    assert north.lon == pytest.approx(130.75)
    for bad in ({"unit": "furlong"}, {"segments": 2}):
        with pytest.raises(ValueError):
            gc.buffer_points(df, lat="lat", lon="lon", distance=5, **bad)


def test_distance_table(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (36.5, -82.5, 36.0, -82.0),
                                (1.0, 1.0, None, 1.0), (5.0, 5.0, 5.0, 5.0)],
                               "a double, b double, c double, d double")
    out = gc.geodesic_distance(df, from_lat="a", from_lon="b", to_lat="c", to_lon="d").collect()
    assert out[0].distance_m == pytest.approx(111319.490793) and out[0].bearing_deg == 90.0
    assert out[0].distance_mi == pytest.approx(69.1707, abs=1e-3)
    assert out[1].distance_m == pytest.approx(71398.317, abs=1e-3)
    assert out[1].bearing_deg == pytest.approx(140.84515, abs=1e-5)
    assert out[2].distance_m is None and out[3].distance_m == 0.0


def test_track_lengths(spark):
    df = spark.createDataFrame([("a", 2, 0.0, 2.0), ("a", 1, 0.0, 1.0), ("a", 0, 0.0, 0.0),
                                ("b", 0, 5.0, 5.0)], "k string, t int, lat double, lon double")
    out = {r.k: r for r in gc.track_lengths(df, lat="lat", lon="lon", track="k",
                                            order="t").collect()}
    assert out["a"].length_m == pytest.approx(2 * 111319.490793)
    assert (out["b"].point_count, out["b"].length_m) == (1, 0.0)


def test_long_tracks_are_cut_without_changing_the_result(spark, events):
    one = events.withColumn("k", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(
        F.when(F.col("event_id") % 50 == 1, F.lit(None)).otherwise(F.col("event_type"))))
    args = {"lat": "latitude", "lon": "longitude", "track": "k"}
    for order in (["ts", "event_id"], ["user_id", "ts", "event_id"]):
        whole = gc.track_steps(one, order=order, **args)
        cut = gc.track_steps(one, order=order, long_track=60, **args)
        a, b = ({r.event_id: r.distance_m for r in d.collect()} for d in (whole, cut))
        assert len(a) == events.count() and a == b
    (a, b) = ({r.k: (r.point_count, round(r.length_m, 3)) for r in gc.track_lengths(
        one, order=["ts", "event_id"], long_track=n, **args).collect()} for n in (10**9, 25))
    assert a == b


def test_simplify(spark):
    line = shape(spark, "LineString", [[[(0, 0), (0.5, 0.01), (1, 0)]]])
    out = gc.simplify(line, tolerance=0.1, method="dp").collect()[0].geometry
    assert len(out.parts[0][0]) == 2 and out.geom_type == "LineString"
    poly = shape(spark, "Polygon", [[[(0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2), (0, 0)]]])
    for method in ("dp", "vw"):
        ring = gc.simplify(poly, tolerance=0.01, method=method).collect()[0].geometry.parts[0][0]
        assert [(v.lon, v.lat) for v in ring] == [(float(x), float(y)) for x, y in SQUARE]
    points = spark.range(1).select(point_geometry(lon=F.lit(1.0), lat=F.lit(2.0)).alias("geometry"))
    same = gc.simplify(points, tolerance=9.0).collect()[0].geometry
    assert same.parts[0][0][0].lon == 1.0
    with pytest.raises(ValueError):
        gc.simplify(line, method="fast")


@pytest.mark.parametrize("text", [
    '{"type":"Point","coordinates":[1.5,-2.0]}',
    '{"type":"MultiPoint","coordinates":[[1.0,2.0],[3.0,4.0]]}',
    '{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}',
    '{"type":"MultiLineString","coordinates":[[[1.0,2.0],[3.0,4.0]],[[5.0,6.0],[7.0,8.0]]]}',
    '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]}',
    '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]]}',
])
def test_geojson_round_trip(spark, text):
    df = gc.geometries_from_geojson(spark.createDataFrame([(text,)], "t string"), "t")
    line = gc.feature_lines(df.select("geometry"), geometry="geometry").collect()[0][0]
    assert json.loads(line)["geometry"] == json.loads(text)


def test_total_bounds(obs):
    row = obs.bounds().collect()[0]
    assert (row.min_lat, row.max_lon) == (36.51, -82.51)
    assert math.isclose(row.height_km, 0.06 * 110.97, rel_tol=1e-3)


def test_long_tracks_are_cut_at_any_order_columns(spark):
    """One value in the first order column, and text as the order."""
    from geocairn.operators.shapes import _slices

    rows = spark.range(30_000).selectExpr(
        "id % 2 AS t", "DATE '2024-05-01' AS day", "id AS seq", "lpad(CAST(id AS STRING), 9, '0') AS name",
        "CAST(id % 97 AS DOUBLE) AS lat", "CAST(id % 89 AS DOUBLE) AS lon")
    for order in (["day", "seq"], ["name"]):
        cut, many = _slices(rows, ["t"], order, 500)
        sizes = [r["count"] for r in cut.groupBy("t", "_slice").count().collect()]
        assert many and sum(sizes) == 30_000 and max(sizes) < 6_000 and len(sizes) > 30
        options = {"lat": "lat", "lon": "lon", "track": "t", "order": order}
        short = gc.track_steps(rows, **options, long_track=500).select("seq", "distance_m")
        whole = gc.track_steps(rows, **options).select("seq", "distance_m")
        assert short.exceptAll(whole).count() == 0 and whole.exceptAll(short).count() == 0


def test_the_merge_of_one_hull_stays_parallel(events):
    plan = plan_of(gc.convex_hull(events, lat="latitude", lon="longitude"))
    assert "Coalesce" not in plan and "SinglePartition" in plan


LINE = {"type": "LineString", "coordinates": [[0, 0], [2, 0], [2, 2]]}
FAR = {"type": "MultiPoint", "coordinates": [[50.0, 60.0], [70.0, 80.0]]}
BOX = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
TWO = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]], [[[10, 0], [11, 0], [11, 1], [10, 1], [10, 0]]]]}


def gathered(*members):
    return {"type": "GeometryCollection", "geometries": list(members)}


@pytest.mark.parametrize("value, expected, box", [
    (gathered(), None, None),
    (gathered(gathered(), gathered(gathered())), None, None),
    (gathered(FAR), (60, 70), (60, 50, 80, 70)),
    (gathered(FAR, LINE), (1.5, 0.5), (0, 0, 80, 70)),
    (gathered(FAR, gathered(LINE, gathered(BOX)), FAR), (1, 1), (0, 0, 80, 70)),
    (gathered(gathered(TWO, FAR), {"type": "Point", "coordinates": [9.0, 9.0]}, gathered()), (2.9, 0.9), (0, 0, 80, 70)),
    (gathered({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [0, 0]]]}, FAR), (2, 0), (0, 0, 80, 70)),
])
def test_collections(spark, value, expected, box):
    df = gc.geometries_from_geojson(spark.createDataFrame([(json.dumps(value),)], "t string"), "t")
    row = gc.bounds(gc.centroids(df)).withColumn("back", geometry_to_geojson(F.col("geometry"))).first()
    assert row._error is None and json.loads(row.back) == value
    assert (row.centroid and tuple(row.centroid)) == (expected and pytest.approx(expected))
    assert (row.min_lat, row.min_lon, row.max_lat, row.max_lon) == (box or (None,) * 4)


def test_collections_that_are_not_understood(spark):
    deep = BOX
    for _ in range(9):
        deep = gathered(deep)
    odd = [gathered(BOX, {"type": "Circle"}), gathered(None), gathered(gathered(None)), gathered(5), deep,
           {"type": "GeometryCollection"}, gathered({"type": "GeometryCollection"}),
           gathered({"type": "Point", "coordinates": ["x", 1]})]
    df = gc.geometries_from_geojson(spark.createDataFrame([(json.dumps(v),) for v in odd], "t string"), "t")
    assert [(r.geometry, r._error) for r in df.collect()] == [(None, "expected one Geometry or Feature")] * len(odd)
    mixed = gc.centroids(df.unionByName(gc.geometries_from_geojson(
        spark.createDataFrame([(json.dumps(gathered(FAR, BOX)),), (json.dumps(LINE),)], "t string"), "t")))
    found = [r.centroid for r in mixed.collect()]
    assert found[:-2] == [None] * len(odd) and [tuple(c) for c in found[-2:]] == [(1, 1), (1.5, 0.5)]
