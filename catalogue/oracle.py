"""SQL for another engine that must give the same rows as the registered queries."""

from __future__ import annotations

from .geodesic_sql import direct, inverse
from .spark_queries import BOX, COMB, POLYGON
from .tables import (
    CUSTOMER_POINTS, EVENT_POINTS, EVENT_ZONES, INSIDE, MIXED_ZONES, SUPPLIER_CENTRES, ZONE_EDGES,
    haversine_sql,
)


def _edges(polygons) -> str:
    rows = []
    for p, rings in enumerate(polygons):
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                rows.append(f"({p}, {x1!r}::DOUBLE, {y1!r}::DOUBLE, {x2!r}::DOUBLE, {y2!r}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) AS s(part, x1, y1, x2, y2)"


def _inside(polygons, columns: str) -> str:
    """Events strictly inside literal polygons."""
    return (f"SELECT {columns} FROM ({EVENT_POINTS}) WHERE event_id IN (SELECT event_id FROM ("
            f"SELECT event_id, part FROM ({EVENT_POINTS}), {_edges(polygons)} "
            f"GROUP BY event_id, part HAVING {INSIDE}))")


_KM = haversine_sql("latitude", "longitude", "{lat}", "{lon}")


def _km(lat, lon) -> str:
    return _KM.format(lat=lat, lon=lon) + " / 1000.0"


_EVENTS_CENTRES = (
    f"(SELECT e.*, c.*, {_km('centre_lat', 'centre_lon')} AS d FROM ({EVENT_POINTS}) e "
    f"JOIN ({SUPPLIER_CENTRES}) c ON abs(latitude - centre_lat) < 0.2)")

_GAPS = (f"(SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN latitude END AS latitude) "
         f"FROM ({EVENT_POINTS}))")

_ZONE_MEASURES = inverse(
    f"SELECT *, x1 AS lon1, y1 AS lat1, x2 AS lon2, y2 AS lat2 FROM ({ZONE_EDGES})",
    "zone_id, part, ring", with_area=True)
_ZONE_AREAS = (
    "SELECT zone_id, sum(CASE WHEN ring = 0 THEN a ELSE -a END) AS area, sum(l) AS len, "
    "sum(CASE WHEN ring = 0 THEN l ELSE 0 END) AS shell FROM (SELECT zone_id, part, ring, "
    f"abs(sum(edge_area)) AS a, sum(distance_m) AS l FROM ({_ZONE_MEASURES}) "
    "GROUP BY zone_id, part, ring) GROUP BY zone_id")

# corners and edges of each customer's quadrilateral
_BOX_SIZES = (
    "SELECT *, CAST((c_custkey % 7 + 1) AS DOUBLE) * 0.01::DOUBLE AS w, "
    f"CAST((c_custkey % 5 + 1) AS DOUBLE) * 0.02::DOUBLE AS h FROM ({CUSTOMER_POINTS})")
_BOX_EDGES = (
    "SELECT c_custkey, i, longitude + dx1 * w AS x1, latitude + dy1 * h AS y1, "
    f"longitude + dx2 * w AS x2, latitude + dy2 * h AS y2 FROM ({_BOX_SIZES}), "
    "(VALUES (0, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE), (1, 1, 0, 2, 1), (2, 2, 1, 0, 1), "
    "(3, 0, 1, 0, 0)) AS s(i, dx1, dy1, dx2, dy2)")
_BOX_CORNERS = f"SELECT c_custkey, i, x1 AS x, y1 AS y FROM ({_BOX_EDGES})"
_BOX_MEASURES = inverse(
    f"SELECT *, x1 AS lon1, y1 AS lat1, x2 AS lon2, y2 AS lat2 FROM ({_BOX_EDGES})",
    "c_custkey", with_area=True)

_EXTENTS = (f"SELECT c_custkey, min(y) AS min_lat, min(x) AS min_lon, max(y) AS max_lat, "
            f"max(x) AS max_lon FROM ({_BOX_CORNERS}) GROUP BY c_custkey")
_SIDES = (
    f"(SELECT *, 0 AS side, min_lon AS lon1, min_lat AS lat1, max_lon AS lon2, min_lat AS lat2 "
    f"FROM {{e}} UNION ALL SELECT *, 1, max_lon, min_lat, max_lon, max_lat FROM {{e}} UNION ALL "
    f"SELECT *, 2, max_lon, max_lat, min_lon, max_lat FROM {{e}} UNION ALL "
    f"SELECT *, 3, min_lon, max_lat, min_lon, min_lat FROM {{e}})")


def _bounds(extents: str, keys: str) -> str:
    sides = inverse(f"SELECT * FROM {_SIDES.format(e=f'({extents})')}",
                    f"{keys}min_lat, min_lon, max_lat, max_lon, side", with_area=True)
    return (f"SELECT {keys}min_lat, min_lon, max_lat, max_lon, "
            "round(sum(CASE WHEN side = 0 THEN distance_m END) / 1000, 6) AS width_km, "
            "round(sum(CASE WHEN side = 3 THEN distance_m END) / 1000, 6) AS height_km{area} "
            f"FROM ({sides}) GROUP BY {keys}min_lat, min_lon, max_lat, max_lon")


# planar centroid of rings given as edges, relative to the first vertex of each ring
def _centroid(edges: str, keys: str, kind: str, hole: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, {keys} AS id, round(sum(s * mx) / sum(s * a), 8) AS lon, "
        f"round(sum(s * my) / sum(s * a), 8) AS lat FROM (SELECT {keys}, {hole} AS s, "
        "abs(sum(cr) / 2) AS a, "
        "sign(sum(cr)) * (sum(cr * (px + qx)) / 6 + sum(cr) / 2 * min(ox)) AS mx, "
        "sign(sum(cr)) * (sum(cr * (py + qy)) / 6 + sum(cr) / 2 * min(oy)) AS my FROM ("
        "SELECT *, x1 - ox AS px, y1 - oy AS py, x2 - ox AS qx, y2 - oy AS qy, "
        f"px * qy - qx * py AS cr FROM ({edges})) GROUP BY {keys}, part, ring) GROUP BY {keys}")


_ZONE_CENTROIDS = _centroid(
    f"SELECT *, first_value(x1) OVER r AS ox, first_value(y1) OVER r AS oy FROM ({ZONE_EDGES}) "
    "WINDOW r AS (PARTITION BY zone_id, part, ring ORDER BY i)",
    "zone_id", "zone", "CASE WHEN ring = 0 THEN 1 ELSE -1 END")
_BOX_CENTROIDS = _centroid(
    f"SELECT *, 0 AS part, 0 AS ring, first_value(x1) OVER r AS ox, first_value(y1) OVER r AS oy "
    f"FROM ({_BOX_EDGES}) WINDOW r AS (PARTITION BY c_custkey ORDER BY i)",
    "c_custkey", "box", "1")


def _hull(points: str, key: str) -> str:
    """Strict hull corners of integer points: ends of edges with nothing to their right."""
    return (
        f"WITH p AS (SELECT DISTINCT {key} AS k, x, y FROM ({points})), e AS (SELECT a.k, "
        "a.x AS ax, a.y AS ay, b.x AS zx, b.y AS zy FROM p a JOIN p b ON a.k = b.k "
        "AND (a.x <> b.x OR a.y <> b.y)), hull AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 "
        "FROM p c WHERE c.k = e.k AND ((zx - ax) * (c.y - ay) - (zy - ay) * (c.x - ax) < 0 OR "
        "((zx - ax) * (c.y - ay) - (zy - ay) * (c.x - ax) = 0 AND ((c.x - ax) * (zx - ax) + "
        "(c.y - ay) * (zy - ay) < 0 OR (c.x - zx) * (ax - zx) + (c.y - zy) * (ay - zy) < 0)))))")


_CUSTOMER_GRID = (f"SELECT c_nationkey, CAST(round(longitude * 10000) AS BIGINT) AS x, "
                  f"CAST(round(latitude * 10000) AS BIGINT) AS y FROM ({CUSTOMER_POINTS})")
_SUPPLIER_GRID = (f"SELECT 0 AS g, CAST(round(centre_lon * 10000) AS BIGINT) AS x, "
                  f"CAST(round(centre_lat * 10000) AS BIGINT) AS y FROM ({SUPPLIER_CENTRES})")

_BEARINGS = (
    f"SELECT *, centre_lon AS lon1, centre_lat AS lat1, "
    f"((({{n}} - 1 - i) % {{n}} + {{n}}) % {{n}}) * 360.0::DOUBLE / {{n}} AS bearing "
    f"FROM ({{source}}), range({{n}} + 1) AS r(i)")


def _buffer(n: int, source: str = SUPPLIER_CENTRES, keys: str = "centre_id, i") -> str:
    src = _BEARINGS.format(n=n, source=f"SELECT *, radius_m AS distance_m FROM ({source})")
    return direct(src, keys)


_BUFFER_EDGES = (
    "SELECT a.centre_id, a.far_lon AS x1, a.far_lat AS y1, b.far_lon AS x2, b.far_lat AS y2 "
    "FROM {ring} a JOIN {ring} b ON a.centre_id = b.centre_id AND b.i = a.i + 1")

_UNIT_CENTRES = (
    f"SELECT centre_id, centre_lat, centre_lon, unit, d AS radius_m FROM ({SUPPLIER_CENTRES}), "
    "(VALUES ('km', 5.0::DOUBLE * 1000), ('mi', 3.0::DOUBLE * 1609.344::DOUBLE), "
    "('ft', 9000.0::DOUBLE * 0.3048::DOUBLE)) AS u(unit, d)")
_UNIT_RING = _buffer(64, _UNIT_CENTRES, "centre_id, unit, radius_m, i")
_UNIT_EDGES = (
    "SELECT * FROM (SELECT *, far_lon AS lon1, far_lat AS lat1, lead(far_lon) OVER r AS lon2, "
    f"lead(far_lat) OVER r AS lat2 FROM ({_UNIT_RING}) WINDOW r AS (PARTITION BY centre_id, unit "
    "ORDER BY i)) WHERE lon2 IS NOT NULL")

_KEPT = f"SELECT * FROM ({EVENT_POINTS})"
_IN_BOX = f" WHERE latitude BETWEEN {BOX[0]} AND {BOX[2]} AND longitude BETWEEN {BOX[1]} AND {BOX[3]}"


def _grid(key: str, where: str) -> str:
    return (f"SELECT {key} AS k, CAST(round(longitude * 1024) AS BIGINT) AS x, CAST(round(latitude * 1024) "
            f"AS BIGINT) AS y FROM ({EVENT_POINTS}){where}")


def _outer(points: str) -> str:
    """Points that aren't strictly inside the quadrilateral of the four that lie farthest on the diagonals."""
    corners = ", ".join(f"{f}(struct_pack(x := x, y := y), {d}) AS {n}" for n, f, d in (
        ("a", "arg_min", "x + y"), ("b", "arg_max", "x - y"), ("c", "arg_max", "x + y"), ("d", "arg_min", "x - y")))
    inside = " AND ".join(f"({n}.x - {m}.x) * (p.y - {m}.y) - ({n}.y - {m}.y) * (p.x - {m}.x) > 0" for m, n in (
        ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")))
    return (f"SELECT p.k, p.x, p.y FROM ({points}) p JOIN (SELECT k, {corners} FROM ({points}) GROUP BY k) q "
            f"ON p.k = q.k WHERE NOT ({inside})")


def _hull_sizes(key: str, where: str = "") -> str:
    """``k``, number of points, area and length of the hull of the events."""
    edges = _hull(_outer(_grid(key, where)), "k") + (
        " SELECT k, ax / 1024.0::DOUBLE AS lon1, ay / 1024.0::DOUBLE AS lat1, "
        "zx / 1024.0::DOUBLE AS lon2, zy / 1024.0::DOUBLE AS lat2 FROM hull")
    return (f"SELECT k, n, round(abs(sum(edge_area)) / 1e6, 5) AS area_km2, "
            f"round(sum(distance_m), 2) AS perimeter_m FROM ({inverse(edges, 'k', with_area=True)}) "
            f"JOIN (SELECT k, count(*) AS n FROM ({_grid(key, where)}) GROUP BY k) USING (k) "
            "GROUP BY k, n")


_MOVED = (f"SELECT event_id, latitude, CASE WHEN longitude < -82.75 THEN longitude + 263.0::DOUBLE "
          f"ELSE longitude - 97.0::DOUBLE END AS longitude FROM ({EVENT_POINTS})")

_TRACK_PAIRS = (
    "SELECT * FROM (SELECT user_id, longitude AS lon2, latitude AS lat2, lag(longitude) OVER t AS "
    f"lon1, lag(latitude) OVER t AS lat1 FROM ({EVENT_POINTS}) "
    "WINDOW t AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE lon1 IS NOT NULL")

_PAIRS = (
    f"SELECT event_id, centre_id, longitude AS lon1, latitude AS lat1, centre_lon AS lon2, "
    f"centre_lat AS lat2 FROM ({EVENT_POINTS}) JOIN ({SUPPLIER_CENTRES}) "
    "ON centre_id = event_id % (SELECT count(*) FROM supplier) + 1")

_REACH = (
    "SELECT centre_id, centre_lat, centre_lon, CASE WHEN centre_id % 4 < 2 THEN centre_id % 6 + 1 "
    "ELSE (centre_id % 6 + 1) * 3000 END AS amount, "
    "['km', 'mi', 'ft', 'm'][centre_id % 4 + 1] AS unit, amount || ' ' || unit AS reach, "
    "amount * [1000.0, 1609.344, 0.3048, 1.0][centre_id % 4 + 1]::DOUBLE AS r "
    f"FROM ({SUPPLIER_CENTRES})")

_ZONE_VERTEX_SUMS = (f"SELECT n_nationkey AS zone_id, n_regionkey, s FROM nation JOIN (SELECT "
                     f"zone_id, sum(x1 + y1) AS s FROM ({ZONE_EDGES}) GROUP BY zone_id) "
                     "ON zone_id = n_nationkey")

_LINES = (
    "SELECT c_custkey AS k, CAST(i AS INTEGER) AS i, longitude + 0.01::DOUBLE * i AS x, latitude + "
    "CAST((CAST(c_custkey AS BIGINT) + 1) * (i + 3) * (i + 11) * (i + 17) % 99991 AS DOUBLE) / 1000000 AS y "
    f"FROM ({CUSTOMER_POINTS}), range(40) AS r(i)")

# split runs at their farthest vertex while it lies beyond the tolerance; run ends are kept
_BY_DISTANCE = (
    f"WITH RECURSIVE p AS MATERIALIZED ({_LINES}), run AS (SELECT DISTINCT k, 0 AS a, 39 AS b "
    "FROM p UNION ALL SELECT k, unnest([a, m]) AS a, unnest([m, b]) AS b FROM (SELECT k, a, b, "
    "arg_max(i, gap) AS m FROM (SELECT k, a, b, i, sqrt(pow(x - (ax + t * dx), 2) + "
    "pow(y - (ay + t * dy), 2)) AS gap FROM (SELECT run.k, run.a, run.b, p.i, p.x, p.y, "
    "s.x AS ax, s.y AS ay, e.x - s.x AS dx, e.y - s.y AS dy, least(1, greatest(0, "
    "((p.x - s.x) * (e.x - s.x) + (p.y - s.y) * (e.y - s.y)) / (pow(e.x - s.x, 2) + "
    "pow(e.y - s.y, 2)))) AS t FROM run JOIN p ON p.k = run.k AND p.i > run.a AND p.i < run.b "
    "JOIN p s ON s.k = run.k AND s.i = run.a JOIN p e ON e.k = run.k AND e.i = run.b)) "
    "GROUP BY k, a, b HAVING max(gap) > 0.02)) "
    "SELECT k AS c_custkey, CAST(count(*) AS INTEGER) AS vertices, round(sum(x + y), 6) AS checksum "
    "FROM p JOIN (SELECT k, a AS i FROM run UNION SELECT k, b FROM run) USING (k, i) GROUP BY k")

# drop the vertex with the smallest triangle while that is at most the threshold
_TRIANGLES = (
    "[abs((xs[t + 1] - xs[t]) * (ys[t + 2] - ys[t]) - (xs[t + 2] - xs[t]) * (ys[t + 1] - ys[t])) "
    "/ 2 FOR t IN range(1, len(xs) - 1)]")
_BY_AREA = (
    f"WITH RECURSIVE st AS (SELECT k, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys FROM "
    f"({_LINES}) GROUP BY k UNION ALL SELECT k, xs[:m] || xs[m + 2:], ys[:m] || ys[m + 2:] FROM ("
    "SELECT *, list_position(areas, list_min(areas)) AS m FROM (SELECT *, "
    f"{_TRIANGLES} AS areas FROM st WHERE len(xs) > 2)) WHERE list_min(areas) <= 0.0003) "
    "SELECT k AS c_custkey, CAST(len(xs) AS INTEGER) AS vertices, "
    "round(list_sum(xs) + list_sum(ys), 6) AS checksum FROM st "
    "QUALIFY len(xs) = min(len(xs)) OVER (PARTITION BY k)")

ORACLE = {
    "simplify_by_distance": _BY_DISTANCE,
    "simplify_by_area": _BY_AREA,
    "bbox": f"SELECT event_id, latitude, longitude, event_type FROM ({EVENT_POINTS}) "
            "WHERE latitude BETWEEN 35 AND 36 AND longitude BETWEEN -84 AND -82.5",
    "bbox_across_180": f"SELECT event_id, longitude FROM ({_MOVED}) WHERE latitude BETWEEN 35 AND "
                       "36.5 AND (longitude >= 179.5 OR longitude <= -179.25)",
    "radius": f"SELECT event_id, round(d, 6) AS distance_km FROM (SELECT *, {_km(35.6, -83.5)} "
              f"AS d FROM ({EVENT_POINTS})) WHERE d <= 20",
    "nearest": f"SELECT event_id, event_type, round(d, 6) AS distance_km FROM (SELECT *, "
               f"{_km(35.6, -83.5)} AS d FROM ({EVENT_POINTS})) ORDER BY d, event_id LIMIT 100",
    "within": _inside(POLYGON, "event_id, user_id"),
    "within_long_boundary": _inside(COMB, "event_id"),
    "where": "SELECT event_id, event_type, user_id, value FROM events "
             "WHERE event_type = 'click' AND user_id = 7",
    "bbox_and_where": f"SELECT event_id, value FROM ({EVENT_POINTS}) WHERE latitude BETWEEN 34.8 "
                      "AND 36.2 AND longitude BETWEEN -84.2 AND -82 AND event_type = 'purchase'",
    "limit_report": f"SELECT event_id, latitude, longitude FROM ({EVENT_POINTS}) WHERE latitude "
                    "BETWEEN 35 AND 36 AND longitude BETWEEN -84 AND -82.5 "
                    "ORDER BY event_id LIMIT 50",
    "grouped_aggregates":
        "SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum_value, "
        "round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value "
        f"FROM ({_inside(POLYGON, '*')}) GROUP BY event_type",
    "radius_group_count": f"SELECT user_id, count(*) AS count FROM ({EVENT_POINTS}) "
                          f"WHERE {_km(36.0, -82.0)} <= 60 GROUP BY user_id",
    "located_rows": f"SELECT event_id FROM {_GAPS} WHERE latitude IS NOT NULL",
    "dataset_profile":
        "SELECT count(*) AS row_count, count(latitude) AS spatial_points, "
        "CAST(0 AS BIGINT) AS out_of_range, min(latitude) AS min_lat, min(lon) AS min_lon, "
        "max(latitude) AS max_lat, max(lon) AS max_lon, round(avg(latitude), 8) AS mean_lat, "
        "round(avg(lon), 8) AS mean_lon, round((min(latitude) + max(latitude)) / 2, 8) "
        "AS center_lat, round((min(lon) + max(lon)) / 2, 8) AS center_lon FROM (SELECT *, "
        f"CASE WHEN latitude IS NOT NULL THEN longitude END AS lon FROM {_GAPS})",
    "schema_report":
        "SELECT 'events' AS source, (SELECT count(*) FROM events) AS row_count, * FROM (VALUES "
        "(1, 'event_id', 'bigint', ''), (2, 'user_id', 'bigint', ''), "
        "(3, 'event_type', 'string', ''), (4, 'value', 'double', ''), (5, 'props', 'string', ''), "
        "(6, 'latitude', 'double', 'lat'), (7, 'longitude', 'double', 'lon')) "
        "AS s(position, column_name, column_type, role)",
    "within_join": f"SELECT event_id, zone_id, n_name FROM ({EVENT_ZONES}) "
                   "JOIN nation ON n_nationkey = zone_id",
    "within_join_left": f"SELECT e.event_id, zone_id FROM events e LEFT JOIN ({EVENT_ZONES}) z "
                        "ON z.event_id = e.event_id",
    "within_join_semi": "SELECT event_id, event_type FROM events WHERE event_id IN "
                        f"(SELECT event_id FROM ({EVENT_ZONES}))",
    "within_join_anti": "SELECT event_id, event_type FROM events WHERE event_id NOT IN "
                        f"(SELECT event_id FROM ({EVENT_ZONES}))",
    "within_join_shuffled": EVENT_ZONES,
    "zonal_stats": "SELECT zone_id, count(*) AS count, round(sum(value), 4) AS sum_value, "
                   "min(value) AS min_value, max(value) AS max_value "
                   f"FROM ({EVENT_ZONES}) JOIN events USING (event_id) GROUP BY zone_id",
    "radius_join": "SELECT event_id, centre_id, nation, round(d, 6) AS distance_km "
                   f"FROM {_EVENTS_CENTRES} WHERE d * 1000 <= radius_m",
    "radius_text_join":
        f"SELECT centre_id, reach, count(*) AS count FROM ({EVENT_POINTS}) JOIN ({_REACH}) "
        f"ON {_KM.format(lat='centre_lat', lon='centre_lon')} <= r GROUP BY centre_id, reach",
    "radius_join_shuffled": "SELECT centre_id, count(*) AS count "
                            f"FROM {_EVENTS_CENTRES} WHERE d * 1000 <= radius_m GROUP BY centre_id",
    "knn_join":
        "SELECT query_id, rank, event_id, round(d, 6) AS distance_km FROM (SELECT *, "
        "CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, event_id) AS INTEGER) AS rank "
        f"FROM (SELECT event_id, c_custkey AS query_id, {_km('q_lat', 'q_lon')} AS d FROM "
        f"({EVENT_POINTS}) JOIN (SELECT c_custkey, latitude AS q_lat, longitude AS q_lon FROM "
        f"({CUSTOMER_POINTS})) ON true)) WHERE rank <= 3",
    "buffer_join":
        f"WITH ring AS ({_buffer(24)}), s AS ({_BUFFER_EDGES.format(ring='ring')}), b AS (SELECT "
        "centre_id, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM s GROUP BY ALL), "
        f"p AS (SELECT * FROM ({EVENT_POINTS}) JOIN b ON longitude BETWEEN w AND e AND "
        "latitude BETWEEN b.s AND n) SELECT event_id, centre_id FROM p JOIN s USING (centre_id) "
        f"GROUP BY event_id, centre_id HAVING {INSIDE}",
    "geodesic_distance":
        "SELECT event_id, centre_id, round(distance_m, 2) AS distance_m, "
        "round(distance_m / 1000, 5) AS distance_km, round(distance_m / 1609.344, 5) AS "
        f"distance_mi, round(bearing_deg, 5) AS bearing_deg "
        f"FROM ({inverse(_PAIRS, 'event_id, centre_id')})",
    "track_lengths":
        "SELECT user_id, n AS point_count, round(coalesce(l, 0), 2) AS length_m FROM (SELECT "
        "user_id, count(*) AS n FROM events GROUP BY user_id) LEFT JOIN (SELECT user_id, "
        f"sum(distance_m) AS l FROM ({inverse(_TRACK_PAIRS, 'user_id')}) GROUP BY user_id) "
        "USING (user_id)",
    "polygon_metrics":
        "SELECT zone_id, round(area / 1e6, 4) AS area_km2, round(area / 1e4, 2) AS area_ha, "
        "round(area / 4046.8564224, 2) AS area_acres, round(len, 2) AS perimeter_m, "
        f"round(shell, 2) AS shell_perimeter_m FROM ({_ZONE_AREAS})",
    "customer_areas": "SELECT c_custkey, round(abs(sum(edge_area)) / 1e6, 5) AS area_km2, "
                      "round(sum(distance_m), 2) AS perimeter_m "
                      f"FROM ({_BOX_MEASURES}) GROUP BY c_custkey",
    "centroids": f"{_ZONE_CENTROIDS} UNION ALL {_BOX_CENTROIDS}",
    "bounds": _bounds(_EXTENTS, "c_custkey, ").replace(
        "{area}", ", round(abs(sum(edge_area)) / 1e6, 5) AS area_km2"),
    "geometry_collections":
        "WITH c AS (SELECT c_custkey, c_custkey % 3 AS k, longitude AS x, latitude AS y, (c_custkey % 7 + 1) * 0.01::DOUBLE AS w, "
        f"(c_custkey % 5 + 1) * 0.02::DOUBLE AS h FROM ({CUSTOMER_POINTS})) SELECT c_custkey, "
        "CASE WHEN k = 0 THEN b.lon ELSE round(x + w / 2, 8) END AS lon, CASE WHEN k = 0 THEN b.lat ELSE round(y + h / 2, 8) END AS lat, "
        "round(y, 8) AS min_lat, round(x, 8) AS min_lon, round(y + h, 8) AS max_lat, "
        "round(x + CASE WHEN k = 0 THEN 2 * w ELSE w END, 8) AS max_lon, "
        "CAST(CASE WHEN k = 0 THEN 4 ELSE 2 END AS INTEGER) AS members, true AS same "
        f"FROM c JOIN ({_BOX_CENTROIDS}) b ON b.id = c_custkey",
    "total_bounds": _bounds(
        "SELECT min(latitude) AS min_lat, min(longitude) AS min_lon, max(latitude) AS max_lat, "
        f"max(longitude) AS max_lon FROM ({EVENT_POINTS})", "").replace("{area}", ""),
    "buffer_points": "SELECT centre_id, 16 AS segments, CAST(i AS INTEGER) AS i, "
                     "round(far_lon, 7) AS lon, round(far_lat, 7) AS lat "
                     f"FROM ({_buffer(16)})",
    "buffer_units":
        "SELECT centre_id, unit, radius_m AS distance_m, "
        "round(abs(sum(edge_area)) / 1e6, 4) AS area_km2 FROM ("
        f"{inverse(_UNIT_EDGES, 'centre_id, unit, radius_m', with_area=True)}) "
        "GROUP BY centre_id, unit, radius_m",
    "simplify_zones":
        # the two inner corners go in order of triangle area while that is at most 0.0006
        "SELECT c_custkey, CASE WHEN least(t1, t2) > 0.0006 THEN 4 WHEN (CASE WHEN t1 <= t2 THEN "
        "t02 ELSE t01 END) > 0.0006 THEN 3 ELSE 2 END AS vertices FROM (SELECT c_custkey, "
        "abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 AS t1, "
        "abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2 AS t2, "
        "abs((x2 - x0) * (y3 - y0) - (x3 - x0) * (y2 - y0)) / 2 AS t02, "
        "abs((x1 - x0) * (y3 - y0) - (x3 - x0) * (y1 - y0)) / 2 AS t01 FROM (SELECT c_custkey, "
        + ", ".join(f"max(CASE WHEN i = {i} THEN {c} END) AS {c}{i}" for i in range(4)
                    for c in "xy")
        + f" FROM ({_BOX_CORNERS}) GROUP BY c_custkey))",
    "dissolve":
        _hull(_CUSTOMER_GRID, "c_nationkey") + " SELECT h.k AS c_nationkey, n AS count, x, y FROM "
        "(SELECT DISTINCT k, ax AS x, ay AS y FROM hull) h JOIN (SELECT c_nationkey AS k, "
        "count(*) AS n FROM customer GROUP BY c_nationkey) c ON c.k = h.k",
    "dissolve_extent":
        "SELECT event_type, count(*) AS count, min(latitude) AS min_lat, max(latitude) AS max_lat,"
        " min(longitude) AS min_lon, max(longitude) AS max_lon "
        f"FROM ({EVENT_POINTS}) GROUP BY event_type",
    "convex_hull": _hull(_SUPPLIER_GRID, "g") + " SELECT DISTINCT (SELECT count(*) FROM supplier) "
                   "AS point_count, ax AS x, ay AS y FROM hull",
    "csv_round_trip": _KEPT,
    "json_round_trip": _KEPT,
    "geojson_round_trip": _KEPT,
    "catalog_table": f"SELECT event_id, event_type FROM ({EVENT_POINTS}) WHERE latitude BETWEEN 35 "
                     "AND 36 AND longitude BETWEEN -83.5 AND -83",
    "row_numbers": "SELECT row_number() OVER (ORDER BY event_id) AS rowid, event_id FROM events",
    "clustered_layout": "SELECT * EXCLUDE (d), CASE WHEN d <= 9 * 1.609344 THEN round(d, 6) END AS "
                        f"distance_km FROM (SELECT *, {_km(35.2, -82.2)} AS d FROM ({EVENT_POINTS}))",
    "csv_text": "SELECT doc_id, lang, ' \"a\", b' || chr(10) || text AS text FROM documents",
    "csv_text_split": "SELECT doc_id, lang, ' \"a\", b' || chr(10) || text AS text FROM documents",
    "geojson_split": f"SELECT c_custkey, c_name, latitude, longitude FROM ({CUSTOMER_POINTS})",
    "geojson_document": "SELECT n_nationkey::BIGINT AS zone_id, n_name, 'MultiPolygon' AS geom_type, "
                        "2 AS parts FROM nation",
    "geojson_errors": "SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS c_custkey, c_custkey % 5 "
                      "<> 0 AND c_custkey % 7 <> 0 AS sound, NOT sound AS empty FROM customer",
    "hull_in_box": f"SELECT n AS point_count, area_km2, perimeter_m FROM ({_hull_sizes('0', _IN_BOX)})",
    "hull_metrics": f"SELECT n AS point_count, area_km2, perimeter_m FROM ({_hull_sizes('0')})",
    "dissolve_metrics": "SELECT k AS event_type, n AS count, area_km2, perimeter_m "
                        f"FROM ({_hull_sizes('event_type')}) WHERE n >= 3",
    "where_typed":
        "SELECT event_id, 'hour' AS test FROM events WHERE date_trunc('hour', ts) = '2024-01-03 15:00:00' "
        "UNION ALL SELECT event_id, 'day' FROM events WHERE CAST(ts AS DATE) = '2024-01-03' "
        "UNION ALL SELECT event_id, 'amount' FROM events WHERE round(value) = 22 "
        "UNION ALL SELECT event_id, 'even' FROM events WHERE user_id % 2 = 0",
    "nearest_grouped": "SELECT event_type, count(*) AS count FROM (SELECT event_type FROM "
                       f"({EVENT_POINTS}) ORDER BY {_km(35.6, -83.5)}, event_id LIMIT 500) GROUP BY event_type",
    "polygon_text":
        "SELECT zone_id, CASE n_regionkey WHEN 3 THEN 'expected Polygon or MultiPolygon' WHEN 4 "
        "THEN 'not GeoJSON' ELSE '' END AS error, CASE n_regionkey WHEN 2 THEN 4 WHEN 3 THEN 0 "
        "WHEN 4 THEN 0 ELSE 2 END AS parts, round(CASE n_regionkey WHEN 2 THEN 2 * s WHEN 3 THEN 0 "
        f"WHEN 4 THEN 0 ELSE s END, 6) AS checksum FROM ({_ZONE_VERTEX_SUMS})",
    "point_text": "SELECT c_custkey, longitude AS lon, latitude AS lat, CAST(CASE WHEN "
                  f"c_nationkey % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS copies "
                  f"FROM ({CUSTOMER_POINTS})",
    "geometry_text_round_trip": "SELECT c_custkey, 'Polygon' AS geom_type, i, x AS lon, y AS lat "
                                f"FROM ({_BOX_CORNERS})",
    "polygon_features": "SELECT CAST(zone_id AS BIGINT) AS zone_id, n_name, "
                        "round(area / 1e6, 4) AS area_km2, 'MultiPolygon' AS geom_type, 2 AS parts "
                        f"FROM ({_ZONE_AREAS}) JOIN nation ON n_nationkey = zone_id",
    "output_values":
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus "
        "NOT IN ('F', 'P') THEN o_totalprice END AS price, "
        "CAST(o_orderkey + 9007199254740993 AS VARCHAR) AS wide FROM orders",
    "refreshed_view": f"SELECT * RENAME (latitude AS north, longitude AS east), round({_km(35.6, -83.5)}, 6) "
                      "AS distance_km, (SELECT count(*) FROM events) AS all_rows "
                      f"FROM ({EVENT_POINTS}) WHERE event_type <> 'error'",
    "within_join_mixed_sizes": MIXED_ZONES,
    "within_join_mixed_left": f"SELECT e.event_id, zone_id FROM events e LEFT JOIN ({MIXED_ZONES}) z ON z.event_id = e.event_id",
    "within_join_mixed_semi": f"SELECT event_id, event_type FROM events WHERE event_id IN (SELECT event_id FROM ({MIXED_ZONES}))",
    "within_join_mixed_anti": f"SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM ({MIXED_ZONES}))",
    "within_join_mixed_shuffled":
        f"SELECT e.event_id, 'left' AS kind FROM events e LEFT JOIN ({MIXED_ZONES}) z ON z.event_id = e.event_id UNION ALL "
        f"SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM ({MIXED_ZONES})) THEN 'left_semi' ELSE 'left_anti' END FROM events",
    "refreshed_elsewhere": "SELECT event_id, event_type FROM events WHERE event_type <> 'purchase'",
    "published_stream": f"SELECT event_id, event_type, value, latitude, longitude FROM ({EVENT_POINTS})",
    "streamed_zone_points":
        f"SELECT event_id, ts, props, zone_id FROM ({EVENT_ZONES}) JOIN ({EVENT_POINTS}) USING (event_id)",
    "streamed_zone_counts":
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, zone_id, count(*) AS count "
        f"FROM ({EVENT_ZONES}) JOIN events USING (event_id) "
        "WHERE NOT (event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-11') AND date_trunc('day', ts) + INTERVAL 1 DAY <= "
        "(SELECT max(ts) - INTERVAL 6 HOUR FROM events) GROUP BY ALL",
}
