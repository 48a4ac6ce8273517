"""Ellipsoidal measurements and simplification as vectorised Arrow column functions.

Each function maps a column to a column of the same rows, a batch of rows at a
time: no shuffle is involved and Catalyst can prune around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow, geodesy, planar
from .checks import METRES_PER_UNIT
from .geometry import PARTS_TYPE, RING_TYPE, VERTEX_TYPE, geometry, part_kinds

# Fixed value: square metres per acre.
M2_PER_ACRE = 4046.8564224


def _nulls(*columns: pa.Array) -> np.ndarray:
    mask = np.zeros(len(columns[0]), bool)
    for c in columns:
        mask |= c.is_null().to_numpy(zero_copy_only=False)
    return mask


def _struct(mask: np.ndarray, **fields) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(v, pa.float64(), mask=mask) for v in fields.values()], list(fields))


def geodesic_inverse(*, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """``STRUCT<distance_m, bearing_deg>``; NULL fields when any input is NULL."""

    @F.arrow_udf("struct<distance_m: double, bearing_deg: double>")
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        dist, azi, _ = geodesy.inverse(*(arrow.as_doubles(v) for v in (a, b, c, d)))
        bearing = np.remainder(np.degrees(azi), 360.0)
        bearing = np.where(dist == 0.0, 0.0, bearing)
        return _struct(_nulls(a, b, c, d), distance_m=dist, bearing_deg=bearing)

    return run(*(c.cast("double") for c in (lon1, lat1, lon2, lat2)))


def distance_fields(inverse: Column) -> list[Column]:
    """Distance and bearing columns in the usual units from :func:`geodesic_inverse`."""
    d = inverse["distance_m"]
    return [
        d.alias("distance_m"),
        (d / METRES_PER_UNIT["km"]).alias("distance_km"),
        (d / METRES_PER_UNIT["mi"]).alias("distance_mi"),
        inverse["bearing_deg"].alias("bearing_deg"),
    ]


def polygon_measures(parts: Column) -> Column:
    """``STRUCT<area_m2, perimeter_m, shell_perimeter_m>`` summed over all polygons.

    Areas are shell minus holes; ``perimeter_m`` is the length of all rings.
    """

    @F.arrow_udf("struct<area_m2: double, perimeter_m: double, shell_perimeter_m: double>")
    def run(column: pa.Array) -> pa.Array:
        rows, polys, rings, lon, lat = arrow.open_parts(column)
        area, length = geodesy.ring_measures(lon, lat, rings)
        shell = np.zeros(area.size, bool)
        shell[polys[:-1][np.diff(polys) > 0]] = True
        ring_row = polys[rows]  # ring offsets per row
        return _struct(
            _nulls(column),
            area_m2=arrow.segment_sum(np.where(shell, area, -area), ring_row),
            perimeter_m=arrow.segment_sum(length, ring_row),
            shell_perimeter_m=arrow.segment_sum(np.where(shell, length, 0.0), ring_row),
        )

    return run(parts)


def area_fields(measures: Column) -> list[Column]:
    """Area in the usual units from :func:`polygon_measures`."""
    m2 = measures["area_m2"]
    return [
        m2.alias("area_m2"),
        (m2 / 1_000_000.0).alias("area_km2"),
        (m2 / 10_000.0).alias("area_ha"),
        (m2 / M2_PER_ACRE).alias("area_acres"),
        measures["perimeter_m"].alias("perimeter_m"),
    ]


def _pick(weight, x, y):
    """Weighted means where there is weight, NaN elsewhere."""
    with np.errstate(invalid="ignore", divide="ignore"):
        some = weight > 0
        return np.where(some, x / weight, np.nan), np.where(some, y / weight, np.nan)


def centroid(geom: Column) -> Column:
    """Planar centroid ``STRUCT<lon, lat>``: area, else length, else vertex mean.

    Holes count negative; NULL for an empty geometry. Of a collection the polygons count, or the lines
    if no member has an area, or the vertices if none has a length.
    """

    @F.arrow_udf(VERTEX_TYPE)
    def run(column: pa.Array, kinds: pa.Array) -> pa.Array:
        rows, parts, paths, lon, lat = arrow.open_parts(column)
        path_row = parts[rows]  # path offsets per row
        vertex_row = paths[path_row]  # vertex offsets per row
        kind = np.repeat(np.array(kinds.flatten().to_pylist(), dtype=object), np.diff(parts))
        areal_path = np.isin(kind, ["Polygon", "MultiPolygon"])
        lined_path = areal_path | np.isin(kind, ["LineString", "MultiLineString"])
        sizes = np.diff(paths)
        # next vertex in the path; rings close, the last vertex of a line pairs with itself
        nxt = np.arange(1, lon.size + 1)
        filled = sizes > 0
        last = paths[1:][filled] - 1
        nxt[last] = np.where(areal_path[filled], paths[:-1][filled], last)
        start = np.repeat(paths[:-1], sizes)
        ax, ay = lon - lon[start], lat - lat[start]
        bx, by = lon[nxt] - lon[start], lat[nxt] - lat[start]

        cross = ax * by - bx * ay
        w = arrow.segment_sum(cross / 2.0, paths)
        first = np.minimum(paths[:-1], max(lon.size - 1, 0))
        ox, oy = (c[first] if c.size else np.zeros(w.size) for c in (lon, lat))
        mx = arrow.segment_sum(cross * (ax + bx) / 6.0, paths) + w * ox
        my = arrow.segment_sum(cross * (ay + by) / 6.0, paths) + w * oy
        shell = np.zeros(w.size, bool)
        shell[parts[:-1][np.diff(parts) > 0]] = True
        role = np.where(areal_path, np.where(shell, 1.0, -1.0) * np.sign(w), 0.0)
        by_area = _pick(*(arrow.segment_sum(role * v, path_row) for v in (w, mx, my)))

        d = np.where(np.repeat(lined_path, sizes), np.hypot(bx - ax, by - ay), 0.0)
        by_length = _pick(*(arrow.segment_sum(v, vertex_row) for v in (
            d, d * (lon + lon[nxt]) / 2.0, d * (lat + lat[nxt]) / 2.0)))
        by_count = _pick(*(arrow.segment_sum(v, vertex_row) for v in (np.ones(lon.size), lon, lat)))
        x, y = by_count
        for cx, cy in (by_length, by_area):
            better = ~np.isnan(cx)
            x, y = np.where(better, cx, x), np.where(better, cy, y)
        missing = _nulls(column) | (np.diff(vertex_row) == 0)
        return pa.StructArray.from_arrays(
            [pa.array(x), pa.array(y)], ["lon", "lat"], mask=pa.array(missing))

    return run(geom["parts"], part_kinds(geom))


def buffer_ring(*, lon: Column, lat: Column, distance_m: Column, segments: int,
                continuous: bool = False) -> Column:
    """Closed counter-clockwise ring of geodesic destinations around each point.

    ``continuous=True`` keeps longitudes on one side of the 180 degree meridian
    (values may pass 180); otherwise they are folded into [-180, 180].
    """
    if segments < 3:
        raise ValueError("segments must be at least 3")

    @F.arrow_udf(RING_TYPE)
    def run(x: pa.Array, y: pa.Array, d: pa.Array) -> pa.Array:
        n = len(x)
        mask = _nulls(x, y, d)
        bearings = -np.arange(1, segments + 2) * 360.0 / segments  # anticlockwise, closed
        bearings = np.remainder(bearings, 360.0)
        far_lon, far_lat = geodesy.direct(
            *(np.repeat(arrow.as_doubles(c), segments + 1) for c in (x, y)),
            np.tile(bearings, n),
            np.repeat(arrow.as_doubles(d), segments + 1),
        )
        if not continuous:
            far_lon = geodesy.wrap_degrees(far_lon)
        offsets = np.arange(n + 1) * (segments + 1)
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), arrow.vertex_array(far_lon, far_lat),
            mask=pa.array(mask))

    return run(*(c.cast("double") for c in (lon, lat, distance_m)))


def simplify_geometry(geom: Column, *, tolerance: float, method: str) -> Column:
    """Simplify polygons and lines; other geometry types pass through unchanged."""
    if method not in ("dp", "vw"):
        raise ValueError(f"unknown simplification method: {method!r}")
    if not tolerance >= 0:
        raise ValueError("tolerance must not be negative")

    @F.arrow_udf(PARTS_TYPE)
    def run(column: pa.Array, kinds: pa.Array) -> pa.Array:
        rows, parts, paths, lon, lat = arrow.open_parts(column)
        is_line = np.array([k == "LineString" for k in kinds.to_pylist()], bool)
        line_of_path = np.repeat(is_line, np.diff(parts[rows]))
        if method == "vw":
            keep = planar.visvalingam_all(lon, lat, paths, tolerance)
        else:
            keep = planar.douglas_peucker_all(lon, lat, paths, tolerance, np.where(line_of_path, 2, 4))
        index = np.flatnonzero(keep)
        fresh = np.searchsorted(index, paths)
        return arrow.close_parts(rows, parts, fresh, lon[index], lat[index], _nulls(column))

    kind = geom["geom_type"]
    handled = kind.isin("Polygon", "MultiPolygon", "LineString")
    return F.when(geom.isNotNull(), geometry(
        kind, F.when(handled, run(geom["parts"], kind)).otherwise(geom["parts"]), geom["members"]))


def hull_ring(points: Column) -> Column:
    """Hull corners (counter-clockwise, not closed) of an array of vertices."""

    @F.arrow_udf(RING_TYPE)
    def run(column: pa.Array) -> pa.Array:
        offsets = arrow.list_offsets(column)
        lon, lat = arrow.vertices(column.flatten())
        corners = [planar.hull(lon[a:b], lat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        sizes = np.concatenate([[0], np.cumsum([len(c) for c in corners], dtype=np.int64)])
        flat = np.array([p for ring in corners for p in ring], dtype=float).reshape(-1, 2)
        return pa.ListArray.from_arrays(
            pa.array(sizes, pa.int32()), arrow.vertex_array(flat[:, 0], flat[:, 1]),
            mask=pa.array(_nulls(column)))

    return run(points)
