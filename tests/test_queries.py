"""Single-table queries on the 20-row fixture and on small brute-force cases."""

import math
import os

import numpy as np
import pytest
from conftest import BIG_PARK, SMALL_PARK, plan_of
from pyspark.sql import functions as F

import geocairn as gc
from geocairn.functions import planar


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def km(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = (np.sin((p2 - p1) / 2) ** 2
         + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2)
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, a)))


def test_loaded_types(obs):
    assert (obs.lat_col, obs.lon_col) == ("latitude", "longitude")
    types = dict(obs.raw.dtypes)
    assert types["id"] == types["count"] == "bigint" and types["latitude"] == "double"
    assert obs.df.count() == 20


def test_bbox(obs):
    assert obs.bbox(35, -84, 37, -81).df.count() == 20
    assert ids(obs.bbox(36.545, -82.54, 36.55, -82.53).df) == [2, 3, 15]  # closed on every side
    with pytest.raises(ValueError):
        obs.bbox(37, -84, 35, -81)


@pytest.mark.parametrize("text, rows", [("1km", 6), ("2km", 11), ("5000", 19), ("500km", 20)])
def test_radius(obs, text, rows):
    near = obs.radius(lat=36.54, lon=-82.54, radius=text).by_distance("id")
    got = [r["_distance_km"] for r in near.collect()]
    assert len(got) == rows and got == sorted(got)


def test_nearest(obs):
    expected = [(19, 5.852873), (9, 5.940302), (11, 5.991388), (12, 6.021060), (15, 6.139468)]
    for start in (None, 100.0):
        top = obs.nearest(lat=36.5, lon=-82.5, k=5, tie="id", start_radius_m=start).collect()
        assert [r["id"] for r in top] == [i for i, _ in expected]
        assert [r["_distance_km"] for r in top] == pytest.approx([d for _, d in expected], abs=1e-6)
    assert "TakeOrderedAndProject" in plan_of(obs.nearest(lat=36.5, lon=-82.5, k=5, tie="id"))
    assert obs.nearest(lat=0, lon=0, k=50, tie="id").count() == 20


def test_within_excludes_boundary(obs):
    assert obs.within([BIG_PARK]).df.count() == 20
    assert ids(obs.within([SMALL_PARK]).df) == [1, 4, 5, 9, 11, 12, 19]
    assert obs.within([BIG_PARK, SMALL_PARK]).df.count() == 20  # any part, even overlapping
    ring = [[(-82.57 + 0.03 * i / 30, 36.52) for i in range(30)]
            + [(-82.54, 36.52), (-82.54, 36.55), (-82.57, 36.55)] + [(-82.57, 36.55 - 0.03 * i / 30)
                                                    for i in range(1, 30)]]
    assert ids(obs.within([ring]).df) == [1, 4, 5, 9, 11, 12, 19]  # too long to unroll


def test_where_compares_typed_values(obs):
    assert ids(obs.where({"quality_grade": "needs_id"}).df) == [8, 16]
    assert ids(obs.where({"count": "5"}).df) == [2] == ids(obs.where({"count": 5}).df)
    assert ids(obs.where([("count", "1"), ("quality_grade", "casual")]).df) == [20]
    assert ids(obs.where({"latitude": "36.54"}).df) == [1]
    for nothing in ("x", "1.5", "99999999999999999999999"):
        assert ids(obs.where({"count": nothing}).df) == []
    assert "EqualTo(count,5)" in plan_of(obs.where({"count": "5"}).df)
    with pytest.raises(gc.ColumnNotFound):
        obs.where({"nope": "1"})


def test_where_other_types(spark):
    df = spark.sql("SELECT 1 id, 0D lat, 0D lon, DATE'2024-03-15' d, true b, "
                   "TIMESTAMP'2024-03-15 10:00:00' t, 1.50BD p")
    data = gc.PointDataset(df, "lat", "lon")
    for name, good, bad in (("d", "2024-03-15", "2024-03-16"), ("b", "TRUE", "false"),
                            ("t", "2024-03-15T10:00:00", "soon"), ("p", "1.5", "1.51")):
        assert data.where({name: good}).df.count() == 1
        assert data.where({name: bad}).df.count() == 0


def test_aggregate(obs):
    rows = obs.aggregate(by="quality_grade", aggs=["count", "sum:count", "avg:count", "min:count",
                                                   "max:count"]).collect()
    assert {tuple(r) for r in rows} == {
        ("casual", 5, 16, 3.2, 1, 6), ("needs_id", 2, 2, 1.0, 1, 1),
        ("research", 13, 39, 3.0, 1, 8)}
    with pytest.raises(ValueError):
        obs.aggregate(by="quality_grade", aggs="median:count")


def test_null_group_and_missing_coordinates(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0, 1.0), (2, "a", 2.0, 2.0), (3, "a", None, 2.0),
         (4, None, 3.0, float("nan"))], "id int, k string, lat double, lon double")
    data = gc.PointDataset(df, "lat", "lon")
    assert {tuple(r) for r in data.aggregate(by="k", aggs="count").collect()} == {
        (None, 2), ("a", 1)}
    p = data.profile().collect()[0]
    assert (p.row_count, p.spatial_points, p.out_of_range) == (4, 3, 1)
    empty = gc.PointDataset(df.filter("id > 9"), "lat", "lon").profile().collect()[0]
    assert empty.row_count == 0 and empty.min_lat is None and empty.center_lon is None


def test_profile_and_schema(obs):
    p = obs.profile().collect()[0]
    assert (p.min_lat, p.min_lon, p.max_lat, p.max_lon) == (36.51, -82.59, 36.57, -82.51)
    assert p.center_lat == pytest.approx(36.54) and p.center_lon == pytest.approx(-82.55)
    rows = obs.schema_df().collect()
    assert [(r.column_name, r.role) for r in rows][2:4] == [("latitude", "lat"),
                                                            ("longitude", "lon")]
    assert rows[0].row_count == 20


def test_run_query(obs):
    out = gc.run_query(obs, lat=36.54, lon=-82.54, radius="2km", select="id, quality_grade",
                       where="quality_grade:research", tie="id")
    assert out.columns == ["id", "quality_grade", "_distance_km"]
    assert gc.run_query(obs, bbox="35,-84,37,-81", lat=0, lon=0, radius=1).count() == 20
    assert [r.id for r in gc.run_query(obs, limit=3, tie="id").collect()] == [1, 2, 3]
    assert gc.run_query(obs, within=[SMALL_PARK], group_by="quality_grade", agg="count").count() == 1
    for bad in ({"lat": 1}, {"radius": "1km"}, {"group_by": "id"}, {"nearest": 3, "lat": 0, "lon": 0},
                {"limit": 3}):
        with pytest.raises(ValueError):
            gc.run_query(obs, **bad)
    with pytest.raises(gc.ColumnNotFound):
        gc.run_query(obs, select="nope")


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(-90, 90, 1500), rng.uniform(80, 90, 300), [90, -90, 0, 0]])
    lon = np.concatenate([rng.uniform(-180, 180, 1500), rng.uniform(-180, 180, 300),
                          [0, 10, 180, -180]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    return spark.createDataFrame(rows, "id int, lat double, lon double"), lat, lon


@pytest.mark.parametrize("lat, lon, metres", [
    (0, 179.9, 900e3), (0, -179.5, 700e3), (88, 10, 500e3), (89.99, -120, 30e3), (70, 5, 1500e3),
    (-85, 179, 2000e3), (45, -90, 9000e3), (60, 0, 20020e3), (0, 180, 0.0), (90, 0, 1e5),
])
def test_radius_box_never_drops_a_match(world, lat, lon, metres):
    df, ys, xs = world
    got = set(ids(gc.PointDataset(df, "lat", "lon").radius(lat=lat, lon=lon, radius=metres).df))
    assert got == set(np.flatnonzero(km(lat, lon, ys, xs) * 1000 <= metres).tolist())


def test_radius_sees_longitudes_past_180(spark):
    df = spark.createDataFrame([(1, 36.0, 277.0), (2, 36.0, -83.0)], "id int, lat double, lon double")
    assert ids(gc.PointDataset(df, "lat", "lon").radius(lat=36, lon=-83, radius=10).df) == [1, 2]


def test_bbox_wrap(world):
    df, ys, xs = world
    got = gc.PointDataset(df, "lat", "lon").bbox(-50, 170, 50, -170, wrap=True).df
    assert ids(got) == np.flatnonzero((np.abs(ys) <= 50) & ((xs >= 170) | (xs <= -170))).tolist()


def test_filters_reach_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "points")
    gc.write_layout(events, path, lat="latitude", lon="longitude", partitions=4)
    data = gc.load_parquet(spark, path)
    plan = plan_of(data.radius(lat=35.6, lon=-83.5, radius="5km").select("event_id"))
    assert "GreaterThanOrEqual(latitude" in plan and "GreaterThanOrEqual(longitude" in plan
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert math.isclose(data.df.count(), events.count())


def test_hull_and_dissolve(spark):
    pts = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.5)]
    df = spark.createDataFrame([("a", y, x) for x, y in pts] + [("b", 0.0, 0.0), ("b", 1.0, 1.0)]
                               + [(None, 0.0, 0.0), (None, 1.0, 0.0), (None, 0.0, 2.0)],
                               "k string, lat double, lon double")
    data = gc.PointDataset(df, "lat", "lon")
    rows = {r.k: r for r in data.dissolve("k").collect()}
    assert set(rows) == {"a", None}  # fewer than three points are left out
    ring = [(v.lon, v.lat) for v in rows["a"].geometry.parts[0][0]]
    assert ring[0] == ring[-1] and set(ring) == set(pts[:4]) and rows["a"]["count"] == 5
    assert rows["a"].area_km2 == pytest.approx(12308.778, abs=1e-2)
    one = gc.PointDataset(df.filter("k = 'a'"), "lat", "lon").convex_hull().collect()
    assert one[0].point_count == 5 and one[0].area_ha == pytest.approx(one[0].area_km2 * 100)
    assert gc.PointDataset(df.filter("k = 'b'"), "lat", "lon").convex_hull().count() == 0
    with pytest.raises(gc.ColumnNotFound):
        data.dissolve("nope")


def test_hull_does_not_depend_on_partitioning(events):
    def ring(n):
        data = gc.PointDataset(events.repartition(n), "latitude", "longitude")
        return sorted((v.lon, v.lat) for v in data.convex_hull().collect()[0].geometry.parts[0][0][1:])

    assert ring(1) == ring(7) == ring(23)
    groups = events.withColumn("g", F.col("event_id") % 300)  # many small groups

    def all_rings(df):
        out = gc.dissolve(df, by="g", lat="latitude", lon="longitude").collect()
        return {r.g: (r["count"], sorted((v.lon, v.lat) for v in r.geometry.parts[0][0][1:]))
                for r in out}

    assert all_rings(groups.repartition(2)) == all_rings(groups.repartition(9))


def test_equality_on_moments_uses_the_session_zone(spark):
    import datetime as dt
    import time

    df = spark.sql("SELECT 1 AS id, 1D AS lat, 2D AS lon, TIMESTAMP '2024-05-06 07:08:09.123456' AS t, "
                   "TIMESTAMP_NTZ '2024-05-06 07:08:09' AS n, CAST(1.50 AS DECIMAL(9,2)) AS d")
    data = gc.PointDataset(df, "lat", "lon")
    before = os.environ.get("TZ")
    os.environ["TZ"] = "America/New_York"
    time.tzset()
    try:
        assert data.where({"t": "2024-05-06 07:08:09.123456"}).df.count() == 1
        assert data.where({"t": dt.datetime(2024, 5, 6, 7, 8, 9, 123456)}).df.count() == 1
        assert data.where({"n": "2024-05-06T07:08:09"}).df.count() == 1
        assert data.where({"t": "2024-05-06 07:08:09"}).df.count() == 0
    finally:
        os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
        time.tzset()
    assert data.where({"d": "1.5"}).df.count() == 1
    for odd in ("nan", "Infinity", "x"):
        assert data.where({"d": odd}).df.count() == 0


def test_requests_group_the_nearest_and_refuse_what_cannot_end(spark, obs):
    got = gc.run_query(obs, lat=36.5, lon=-82.5, nearest=3, tie="id", group_by="quality_grade", agg="count")
    assert sum(r["count"] for r in got.collect()) == 3
    with pytest.raises(ValueError):
        gc.run_query(obs, lat=36.5, lon=-82.5, nearest=3, group_by="quality_grade", agg="count")
    with pytest.raises(ValueError):
        obs.nearest(lat=36.5, lon=-82.5, k=3, tie="id", start_radius_m=0)
    km = [r._distance_km for r in gc.run_query(obs, lat=36.5, lon=-82.5, radius="50km").collect()]
    assert km == sorted(km) and len(km) == 20


def test_a_collection_is_no_single_geometry(spark):
    feature = '{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}'
    texts = [feature, '{"type":"FeatureCollection","features":[%s]}' % feature,
             '{"type":"FeatureCollection","features":[%s,%s]}' % (feature, feature)]
    df = spark.createDataFrame([(t,) for t in texts], "g string")
    assert [r._error is None for r in gc.geometries_from_geojson(df, "g").collect()] == [True, False, False]


def test_hulls_of_many_groups_and_a_hot_one(spark):
    rows = spark.range(240_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 ELSE id % 20000 END AS g",
        "CAST(id * 7919 % 1009 AS DOUBLE) AS lat", "CAST(id * 104729 % 1013 AS DOUBLE) AS lon")
    hulls = gc.dissolve(rows.repartition(24), by="g", lat="lat", lon="lon", include_area=False)
    assert "collect_list" not in hulls._jdf.queryExecution().toString()
    got = {r.g: (r["count"], sorted((v.lon, v.lat) for v in r.geometry.parts[0][0][1:])) for r in hulls.collect()}
    local = rows.toPandas().groupby("g")
    assert len(got) == local.ngroups
    for g in [-1, *range(1, 20000, 3001)]:
        part = local.get_group(g)
        want = planar.hull(part["lon"].to_numpy(), part["lat"].to_numpy())
        assert got[g] == (len(part), sorted(want))


def test_rows_outside_the_valid_latitudes(spark):
    df = spark.createDataFrame([(1, 95.0, 0.0), (2, 89.0, 0.0), (3, 10.0, 2.0e6), (4, 10.0, float("nan"))],
                               "id long, latitude double, longitude double")
    one = [r.id for r in gc.PointDataset(df, "latitude", "longitude").nearest(lat=80, lon=0, k=5, tie="id").collect()]
    queries = spark.createDataFrame([(9, 80.0, 0.0)], "query_id long, qlat double, qlon double")
    joined = gc.knn_join(df, queries, k=5, lat="latitude", lon="longitude", query_lat="qlat", query_lon="qlon", tie="id")
    assert one == [r.id for r in joined.orderBy("_distance_km").collect()] == [2, 3]
