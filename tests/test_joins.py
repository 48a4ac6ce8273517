"""Joins against brute force, on both the broadcast and the shuffled plan."""

import math

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

import geocairn as gc
from geocairn.functions.geometry import PARTS_TYPE

LATLON = {"lat": "lat", "lon": "lon"}
HOWS = ("inner", "left", "left_semi", "left_anti")


def inside(part, x, y):
    """Strictly inside one polygon; None when exactly on its boundary."""
    odd = False
    for ring in part:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if (side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)):
                return False
            if (y1 > y) != (y2 > y) and (side > 0) == (y2 > y1):
                odd = not odd
    return odd


def star(rng, cx, cy, size, n):
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    reach = rng.uniform(0.2, 1.0, n) * size
    return [(float(cx + r * np.cos(t)), float(cy + r * np.sin(t))) for t, r in zip(turn, reach)]


def zone_rows():
    rng = np.random.default_rng(11)
    zones = []
    for i, size in enumerate([30, 12, 5, 3, 1.5, 1, 0.3, 0.3, 0.05, 0.002]):
        cx, cy = rng.uniform(-30, 30), rng.uniform(-20, 20)
        zones.append((i, [[star(rng, cx, cy, size, int(rng.integers(5, 90)))]]))
    # on the integer lattice: touching cells, holes, overlapping parts, a spike, a closed ring
    zones.append((10, [[[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 2), (6, 2), (6, 6), (2, 6)]]]))
    zones.append((11, [[[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(2, 2), (6, 2), (6, 6), (2, 6)]]]))
    zones.append((12, [[[(-16, -16), (16, -16), (16, 16), (0, 0), (-16, 16)]]]))
    zones.append((13, [[[(1, 1), (3, 1), (3, 3), (2, 1), (1, 3)]]]))
    return [(i, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts])
            for i, parts in zones]


@pytest.fixture(scope="module")
def zones(spark):
    rows = [(i, [[[{"lon": x, "lat": y} for x, y in ring] for ring in part] for part in parts])
            for i, parts in zone_rows()]
    return spark.createDataFrame(rows, f"zone_id int, polygons {PARTS_TYPE}")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(12)
    spots = [(float(x), float(y)) for x, y in rng.uniform(-32, 32, (500, 2))]
    spots += [(float(x), float(y)) for x in range(-2, 18) for y in range(-2, 18)]
    for _, parts in zone_rows()[:10]:  # near the small zones, and exactly on their corners
        ring = parts[0][0]
        cx, cy = np.mean(ring, axis=0)
        spread = max(abs(x - cx) for x, _ in ring)
        spots += [(float(cx + a), float(cy + b)) for a, b in rng.uniform(-1, 1, (40, 2)) * spread]
        spots += ring[:3]
    rows = [(i, y, x) for i, (x, y) in enumerate(spots)]
    return spark.createDataFrame(rows, "id int, lat double, lon double").repartition(5), rows


@pytest.fixture(scope="module")
def expected(points):
    return {(i, z) for i, y, x in points[1] for z, parts in zone_rows()
            if any(inside(p, x, y) for p in parts)}


@pytest.mark.parametrize("limit", [1 << 26, -1])
@pytest.mark.parametrize("how", HOWS)
def test_within_join(points, zones, expected, how, limit):
    df, rows = points
    out = gc.within_join(df, zones, **LATLON, how=how, broadcast_limit=limit)
    plan = plan_of(out)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ("SortMergeJoin" in plan) == (limit < 0)
    matched = {i for i, _ in expected}
    got = [tuple(r) for r in out.select("id", *(["zone_id"] if how in HOWS[:2] else [])).collect()]
    want = {
        "inner": expected,
        "left": expected | {(r[0], None) for r in rows if r[0] not in matched},
        "left_semi": {(i,) for i in matched},
        "left_anti": {(r[0],) for r in rows if r[0] not in matched},
    }[how]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("how", HOWS[1:])
def test_existence_over_many_levels_takes_one_pass(points, zones, how):
    df, _ = points
    near = plan_of(gc.within_join(df, zones, **LATLON, how=how)).split("\n\n\n")[0]
    wide = plan_of(gc.within_join(df, zones, **LATLON, how=how, broadcast_limit=-1)).split("\n\n\n")[0]
    # broadcast: the points stream past the cover in one stage, in two for left joins
    assert near.count("Union") == (how == "left") and "SortMergeJoin" not in near
    # shuffled: one join with the cover (two for left joins), one with the positions that match
    joins = wide.count("SortMergeJoin")
    assert joins == (3 if how == "left" else 2) and wide.count("LeftAnti") == (how != "left_semi")


def test_existence_counts_rows_of_one_place_and_keeps_odd_ones(spark, zones):
    rows = [(1, 0.5, 0.5), (1, 0.5, 0.5), (2, None, 0.5), (3, 0.5, None), (4, float("nan"), 0.5), (5, 400.0, -400.0), (6, -0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double").withColumn("_mlat", F.lit("clash"))
    for limit in (1 << 26, -1):
        semi, anti = (gc.within_join(df, zones, **LATLON, how=how, broadcast_limit=limit) for how in HOWS[2:])
        assert semi.columns == anti.columns == df.columns
        assert sorted(r.id for r in semi.union(anti).collect()) == [1, 1, 2, 3, 4, 5, 6]
        assert {2, 3, 4, 5} <= {r.id for r in anti.collect()}


def test_within_join_one_level_and_none(points, zones, expected):
    df, rows = points
    for how in HOWS:
        one = gc.within_join(df, zones.filter("zone_id = 10"), **LATLON, how=how).count()
        none = gc.within_join(df, zones.filter("zone_id > 99"), **LATLON, how=how).count()
        hits = sum(z == 10 for _, z in expected)
        assert one == {"left": len(rows), "left_anti": len(rows) - hits}.get(how, hits)
        assert none == (len(rows) if how in ("left", "left_anti") else 0)


def test_single_zone_equals_filter(points, expected):
    df, _ = points
    for z, parts in zone_rows():
        got = {r[0] for r in gc.PointDataset(df, "lat", "lon").within(parts).select("id").collect()}
        assert got == {i for i, zone in expected if zone == z}


def test_column_clash_is_refused(points, zones):
    with pytest.raises(ValueError, match="both sides"):
        gc.within_join(points[0].withColumn("zone_id", F.lit(1)), zones, **LATLON)


def test_zonal_stats(points, zones, expected):
    out = gc.zonal_stats(points[0], zones, **LATLON, aggs=["count", "max:id"]).collect()
    assert {(r.zone_id, r["count"]) for r in out} == {
        (z, sum(k == z for _, k in expected)) for z in {z for _, z in expected}}


# -- circles -------------------------------------------------------------------------------


def metres(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = (math.sin((p2 - p1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1, a)))


def spread_out(rng, n):
    lat = np.concatenate([rng.uniform(-90, 90, n), rng.uniform(86, 90, n // 4), [90, -90, 0, 0, 1]])
    lon = np.concatenate([rng.uniform(-180, 180, n + n // 4), [0, 77, 180, -180, 190]])
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]


@pytest.fixture(scope="module")
def globe(spark):
    rows = spread_out(np.random.default_rng(13), 700)
    return spark.createDataFrame(rows, "id int, lat double, lon double"), rows


@pytest.fixture(scope="module")
def centres(spark):
    rng = np.random.default_rng(14)
    reach = [0.0, 1e3, 5e4, 3e5, 1e6, 4e6, 9e6, 1.5e7, 2.1e7]
    rows = [(i, a, b, reach[i % len(reach)]) for i, a, b in spread_out(rng, 60)]
    return spark.createDataFrame(rows, "centre_id int, clat double, clon double, r double"), rows


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_radius_join(globe, centres, limit):
    out = gc.radius_join(globe[0], centres[0], **LATLON, centre_lat="clat", centre_lon="clon",
                         radius_m="r", broadcast_limit=limit)
    assert "NestedLoop" not in plan_of(out)
    got = [(r.id, r.centre_id) for r in out.collect()]
    want = {(i, c) for i, y, x in globe[1] for c, cy, cx, r in centres[1]
            if metres(y, x, cy, cx) <= r}
    assert len(got) == len(set(got)) and set(got) == want


def test_radius_join_equals_single_queries(globe, centres):
    data = gc.PointDataset(globe[0], "lat", "lon")
    out = gc.radius_join(globe[0], centres[0], **LATLON, centre_lat="clat", centre_lon="clon",
                         radius_m=2.5e6)
    got = {(r.id, r.centre_id) for r in out.collect()}
    for c, y, x, _ in centres[1][::9]:
        single = data.radius(lat=y, lon=min(x, 180.0) if x <= 180 else x - 360, radius=2.5e6)
        assert {r[0] for r in single.select("id").collect()} == {i for i, k in got if k == c}


def test_buffer_join_matches_buffer_polygons(spark, globe):
    rows = [(0, 0.0, 179.8, 3e5), (1, 10.0, -179.9, 2e5), (2, 45.0, 10.0, 8e5), (3, 85.0, 0.0, 1e5)]
    df = spark.createDataFrame(rows, "centre_id int, clat double, clon double, r double")
    rng = np.random.default_rng(15)
    pts = [(i * 1000 + j, float(y + dy), float((x + dx + 180) % 360 - 180))
           for i, y, x, _ in rows for j, (dy, dx) in enumerate(rng.uniform(-4, 4, (300, 2)))]
    near = spark.createDataFrame(pts, "id int, lat double, lon double")
    out = gc.buffer_join(near, df, **LATLON, centre_lat="clat", centre_lon="clon", distance_m="r",
                         segments=180)
    got = {(r.id, r.centre_id) for r in out.collect()}
    from geocairn.functions import geodesy

    for c, cy, cx, r in rows:
        ids, lat, lon = (np.array(v, float) for v in zip(*pts))
        d = geodesy.inverse(np.full(len(ids), cx), np.full(len(ids), cy), lon, lat)[0]
        mine = {i for i, k in got if k == c}
        assert {int(i) for i in ids[d < r * 0.995]} <= mine <= {int(i) for i in ids[d < r]}


# -- nearest neighbours ----------------------------------------------------------------------


def knn_brute(points, queries, k):
    return {(q, n + 1, i) for q, qy, qx in queries for n, (_, i) in enumerate(
        sorted((metres(y, x, qy, qx), i) for i, y, x in points)[:k])}


def knn(points, queries, k, **kw):
    out = gc.knn_join(points, queries, k=k, **LATLON, query_lat="qlat", query_lon="qlon",
                      tie="id", **kw)
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    return [(r.query_id, r["rank"], r.id) for r in out.collect()]


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, a, b) for i, a, b in spread_out(np.random.default_rng(16), 60)]
    return spark.createDataFrame(rows, "query_id int, qlat double, qlon double"), rows


@pytest.mark.parametrize("k, limit", [(1, -1), (7, 1 << 26)])
def test_knn_over_the_globe(globe, questions, k, limit):
    got = knn(globe[0], questions[0], k, broadcast_limit=limit)
    assert len(got) == k * len(questions[1])
    # compare by distance: rounding may order exact ties differently
    place = {i: (y, x) for i, y, x in globe[1]}
    for q, qy, qx in questions[1]:
        best = sorted(metres(y, x, qy, qx) for _, y, x in globe[1])[:k]
        mine = [metres(*place[i], qy, qx) for _, _, i in sorted(r for r in got if r[0] == q)]
        assert mine == pytest.approx(best, abs=1e-3)


def test_knn_far_from_clustered_data(spark, questions):
    rng = np.random.default_rng(17)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(
        np.array([36.0, -83.0]) + rng.normal(0, 0.2, (600, 2)))]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    assert set(knn(df, questions[0], 4)) == knn_brute(rows, questions[1], 4)


def test_knn_with_a_third_of_all_rows_in_one_spot(spark):
    rng = np.random.default_rng(18)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 1, (800, 2)))]
    rows += [(800 + i, 0.5, 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double").repartition(4)
    asks = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0.3, 0.7, (30, 2)))]
    asks.append((30, 0.5, 0.5))
    queries = spark.createDataFrame(asks, "query_id int, qlat double, qlon double")
    got = knn(df, queries, 6, crowd=50)
    assert len(got) == len(set(got)) and set(got) == knn_brute(rows, asks, 6)


@pytest.mark.parametrize("busy", [1, 100])
def test_knn_beside_a_crowd(spark, busy):
    """Queries next to, inside and far from a dense spot; the bounds must stay exact."""
    rng = np.random.default_rng(20)
    crowd = np.array([40.0, 5.0]) + rng.normal(0, 0.01, (1500, 2))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(
        np.vstack([crowd, rng.uniform(-60, 60, (300, 2)), [[89.9, 10.0], [0.0, 179.99]]]))]
    df = spark.createDataFrame(rows, "id int, lat double, lon double").repartition(4)
    asks = [(40.0, 5.0), (40.05, 5.05), (40.4, 5.0), (42.0, 8.0), (-80.0, -170.0), (0.0, -179.99),
            (90.0, 0.0), (39.97, 4.97), (65.0, 5.0), (10.0, 190.0)]
    asks += [(float(a), float(b)) for a, b in rng.uniform(-50, 50, (15, 2))]
    asks = [(i, a, b) for i, (a, b) in enumerate(asks)]
    queries = spark.createDataFrame(asks, "query_id int, qlat double, qlon double")
    got = knn(df, queries, 5, busy=busy)
    assert len(got) == len(set(got)) and set(got) == knn_brute(rows, asks, 5)


def test_descent_keeps_circles_small(spark):
    from geocairn.operators import knn as module

    rng = np.random.default_rng(21)
    spots = np.array([40.0, 5.0]) + rng.uniform(-0.02, 0.02, (20000, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in spots], "lat double, lon double")
    tree = module._cell_tree(df, "lat", "lon", 16, 1 << 26)
    asks = [(0, 40.03, 5.0), (1, 40.5, 5.5), (2, 10.0, -60.0), (3, 40.0, 5.0)]
    queries = spark.createDataFrame(asks, "_qid int, _qlat double, _qlon double").withColumn(
        "_near_m", F.lit(None).cast("double"))
    bound = {r[0]: r[1] for r in module._descend(queries, tree, 3, 60).collect()}
    for q, y, x in asks:
        d = np.sort([metres(a, b, y, x) for a, b in spots])
        assert d[2] <= bound[q]
        assert np.searchsorted(d, bound[q]) <= 200  # of 20,000 crowded points


def test_cell_tree_has_few_rows_on_even_data(spark):
    from geocairn.operators import knn as module

    rng = np.random.default_rng(22)
    n = 200_000
    rows = zip((np.degrees(np.arcsin(rng.uniform(-1, 1, n)))).tolist(), rng.uniform(-180, 180, n).tolist())
    df = spark.createDataFrame(list(rows), "lat double, lon double").repartition(8)
    for box in ("true", "lat BETWEEN 30 AND 60 AND lon BETWEEN 0 AND 80", "lat BETWEEN 30 AND 50"):
        some = df.filter(box)
        leaves = module._cell_tree(some, "lat", "lon", 128, 1 << 26).leaves.toPandas()
        assert leaves["n"].sum() == some.count() and leaves["n"].max() <= 128
        assert len(leaves) < 0.05 * leaves["n"].sum()


@pytest.mark.parametrize("limit", [-1, 1 << 26])
def test_cell_tree_counts_every_point_once(spark, limit):
    """Hot spots, both poles, the 180 degree meridian, rows without a place; leaves never overlap."""
    from geocairn.operators import knn as module

    rng = np.random.default_rng(23)
    rows = [(12.25, -71.5)] * 900 + [(12.2501, -71.5)] * 300 + [(90.0, 180.0), (-90.0, -180.0), (0.0, 540.0), (None, 1.0), (95.0, 3.0)]
    rows += [(float(a), float(b)) for a, b in np.array([48.0, 11.0]) + rng.normal(0, 0.3, (1500, 2))]
    df = spark.createDataFrame(rows, "lat double, lon double").repartition(5)
    tree = module._cell_tree(df, "lat", "lon", 20, limit)
    got = [tuple(r) for r in tree.leaves.select("depth", "cx", "cy", "n").collect()]
    assert sum(n for *_, n in got) == len(rows) - 2
    assert all(n <= 20 or depth == module._DEPTH for depth, _, _, n in got)
    cells = {(d, x, y) for d, x, y, _ in got}
    assert len(cells) == len(got) == tree.n_leaves and max(cells)[0] == tree.deepest
    assert not any((d - i, x >> i, y >> i) in cells for d, x, y in cells for i in range(1, d + 1))
    counts = {r["key"]: r["n"] for r in module._all_depths(tree).collect()}
    assert sum(n for key, n in counts.items() if key >> 48 == 0) == len(rows) - 2
    empty = module._cell_tree(df.filter("lat > 1000"), "lat", "lon", 20, limit)
    assert empty.leaves.count() == empty.n_leaves == 0


@pytest.mark.parametrize("leaf, busy, limit", [(1, 1, 1 << 26), (3, 40, -1), (700, 1, 1 << 26)])
def test_knn_with_cells_of_any_size(spark, questions, leaf, busy, limit):
    """Small and large leaves, circles from both ways of bounding them."""
    rng = np.random.default_rng(24)
    places = np.vstack([np.array([20.0, 30.0]) + rng.normal(0, 0.05, (500, 2)), rng.uniform(-70, 70, (200, 2))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(places)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double").repartition(4)
    asks = questions[1][:20] + [(100 + i, float(a), float(b)) for i, (a, b) in enumerate(places[::60] + 0.001)]
    queries = spark.createDataFrame(asks, "query_id int, qlat double, qlon double")
    got = knn(df, queries, 4, leaf=leaf, busy=busy, broadcast_limit=limit)
    assert len(got) == len(set(got)) and set(got) == knn_brute(rows, asks, 4)


def test_knn_with_fewer_points_than_k(spark, questions):
    rows = [(0, 10.0, 10.0), (1, -60.0, 170.0), (2, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    got = knn(df, questions[0], 5)
    assert set(got) == knn_brute(rows, questions[1], 5)


def test_hot_cell_is_split_in_the_shuffled_plan(spark, zones):
    rng = np.random.default_rng(19)
    spread = [(i, float(y), float(x)) for i, (x, y) in enumerate(rng.uniform(-20, 20, (3000, 2)))]
    copies = spark.range(40000).select((F.col("id") + 3000).cast("int").alias("id"),
                                       F.lit(0.5).alias("lat"), F.lit(0.25).alias("lon"))
    df = spark.createDataFrame(spread, "id int, lat double, lon double").repartition(6).unionByName(
        copies.repartition(6))
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = gc.within_join(df, zones.filter("zone_id >= 10"), **LATLON, broadcast_limit=-1)
        rows = out.collect()
        assert "skew" in plan_of(out).lower()
        hot = [r for r in rows if r.id >= 3000]
        inside_zones = {z for z, parts in zone_rows() if z >= 10
                        and any(inside(p, 0.25, 0.5) for p in parts)}
        assert len(hot) == 40000 * len(inside_zones) and inside_zones
    finally:
        for k in settings:
            spark.conf.unset(k)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_buffers_around_a_pole(spark, limit):
    rng = np.random.default_rng(12)
    rows = [(int(i), float(y), float(x)) for i, (y, x) in enumerate(zip(
        rng.uniform(88.0, 90.0, 3000) * rng.choice([-1, 1], 3000), rng.uniform(-180, 180, 3000)))]
    rows += [(5000, 90.0, 12.0), (5001, -90.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    centres = spark.createDataFrame([(1, 89.9, 0.0, 50e3), (2, 89.5, 170.0, 90e3), (3, -89.7, -100.0, 80e3), (4, 88.9, 20.0, 40e3)],
                                    "centre_id long, clat double, clon double, reach double")
    names = {"lat": "lat", "lon": "lon", "centre_lat": "clat", "centre_lon": "clon"}
    got = {(r.id, r.centre_id) for r in gc.buffer_join(points, centres, **names, distance_m="reach", segments=128,
                                                       broadcast_limit=limit).select("id", "centre_id").collect()}
    # the polygon of geodesic vertices in the plane lies near the circle
    sure, out = ({(r.id, r.centre_id) for r in gc.radius_join(points, centres, **names, radius_m=F.col("reach") * part)
                  .select("id", "centre_id").collect()} for part in (0.97, 1.03))
    assert sure <= got <= out and {c for _, c in got} == {1, 2, 3, 4}
    assert {(5000, 1), (5000, 2), (5001, 3)} <= got


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_joins_with_zones_of_many_edges_are_compiled(spark, points, zones, limit):
    joined = gc.within_join(points[0], zones, **LATLON, broadcast_limit=limit).select("id", "zone_id")
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "MergeJoin" in line or "HashJoin" in line]
    assert joins and all("*(" in line for line in joins), joins


@pytest.mark.parametrize("how", HOWS)
def test_cells_full_of_zones_are_dealt_to_shares(spark, points, zones, expected, how, monkeypatch):
    from geocairn.plans import cells

    monkeypatch.setattr(cells, "FULL_CELL", 0.25)
    assert cells.polygon_cover(zones, parts="polygons", keep=["zone_id"], limit=-1).full.count() > 0
    got = gc.within_join(points[0], zones, **LATLON, how=how, broadcast_limit=-1)
    if how in ("left_semi", "left_anti"):
        hit = {i for i, _ in expected}
        ids = [r.id for r in got.select("id").collect()]
        every = {r[0] for r in points[1]}
        assert len(ids) == len(set(ids)) and set(ids) == (hit if how == "left_semi" else every - hit)
    else:
        pairs = [(r.id, r.zone_id) for r in got.select("id", "zone_id").collect()]
        assert len(pairs) == len(set(pairs)) and {p for p in pairs if p[1] is not None} == set(expected)
    left = cells.polygon_cover(zones, parts="polygons", keep=["zone_id"], limit=64 << 20)
    assert left.full is None


def test_buffers_of_a_file_of_one_split_are_computed_by_many_tasks(spark, points):
    centres = spark.range(400).selectExpr("id AS centre_id", "id % 20 - 10.0D AS clat", "id % 30 - 15.0D AS clon").coalesce(1)
    joined = gc.buffer_join(points[0], centres, **LATLON, centre_lat="clat", centre_lon="clon", distance_m=20_000.0, segments=8)
    assert "REPARTITION_BY_NUM" in joined._jdf.queryExecution().executedPlan().toString()
    joined.collect()


@pytest.mark.parametrize("how", HOWS[:2])
def test_points_meet_crowded_cells_by_blocks(spark, points, zones, expected, how, monkeypatch):
    """Blocks of a few points, cells dealt to shares, rows that come twice, columns of other types."""
    from geocairn.operators import joins
    from geocairn.plans import cells

    for module, name, value in ((cells, "BLOCK_CELL", 0.0), (cells, "FULL_CELL", 0.25), (joins, "BLOCK_POINTS", 3), (joins, "_SHARE_POINTS", 40), (joins, "_MOST_TASKS", 8)):
        monkeypatch.setattr(module, name, value)
    cover = cells.polygon_cover(zones, parts="polygons", keep=["zone_id"], limit=-1)
    assert cover.crowded.levels == cover.levels and not cover.calm.levels
    odd = spark.createDataFrame([(9001, None, 1.0), (9002, 1.0, None), (9003, float("nan"), 1.0), (9004, -0.0, 1.5)], points[0].schema)
    df = points[0].union(points[0]).union(odd).selectExpr("*", "IF(id % 3 = 0, NULL, array(id, lat)) AS listed", "map('k', lon) AS m")
    got = gc.within_join(df, zones, **LATLON, how=how, broadcast_limit=-1)
    assert got.columns == [*df.columns, "zone_id"]
    near = gc.within_join(df, zones, **LATLON, how=how).collect()
    rows = got.collect()
    assert sorted(map(str, rows)) == sorted(map(str, near))
    mine = [(r.id, r.zone_id) for r in rows if r.id < 9000 and r.zone_id is not None]
    assert sorted(mine) == sorted([*expected, *expected])


def test_rows_of_a_region_come_in_runs(spark):
    """Files of the result are small because a region's points follow each other, and so does the next region's same list."""
    spots = spark.range(20000).selectExpr("id", "10 + id % 141 / 150.0D AS lat", "20 + id % 137 / 150.0D AS lon").repartition(4)
    squares = spark.range(100).selectExpr("id AS zone_id", "9.9D + id / 1000 AS y", "19.9D + id / 1000 AS x").selectExpr(
        "zone_id", "array(array(array(named_struct('lon', x, 'lat', y), named_struct('lon', x + 1.3D, 'lat', y), "
        "named_struct('lon', x + 1.3D, 'lat', y + 1.3D), named_struct('lon', x, 'lat', y + 1.3D)))) AS polygons")
    squares = squares.withColumn("polygons", F.col("polygons").cast(PARTS_TYPE))
    pairs = gc.within_join(spots, squares, **LATLON, broadcast_limit=-1).select("id", "zone_id")

    def runs(batches):
        import pyarrow as pa

        for batch in batches:
            zone = batch.column("zone_id").to_numpy()
            yield pa.RecordBatch.from_pydict({"n": [len(zone)], "k": [1 + int((zone[1:] != zone[:-1]).sum())]})

    total, changes = pairs.mapInArrow(runs, "n long, k long").agg(F.sum("n"), F.sum("k")).first()
    assert total == gc.within_join(spots, squares, **LATLON).count() > 1_000_000
    assert changes < total / 50


def test_streams_meet_crowded_cells_without_blocks(spark, zones, points, tmp_path, monkeypatch):
    from geocairn.plans import cells

    monkeypatch.setattr(cells, "BLOCK_CELL", 0.0)
    points[0].write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points[0].schema).parquet(str(tmp_path / "in"))
    joined = gc.within_join(stream, zones, **LATLON, broadcast_limit=-1).select("id", "zone_id")
    query = joined.writeStream.format("memory").queryName("crowded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("crowded").count() == gc.within_join(points[0], zones, **LATLON).count()
