"""Operators over tables of geometries, and hulls of grouped points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import measures, planar
from ..functions.arrow import vertex_array
from ..functions.checks import METRES_PER_UNIT, check_columns
from ..functions.geometry import RING_TYPE, bounds_of, box_parts, geometry
from ..plans.session import join_side, materialize, row_width


def polygon_metrics(df: DataFrame, *, polygons: str = "polygons") -> DataFrame:
    """Adds geodesic area (m2, km2, ha, acres) and perimeter of each row's polygons."""
    (polygons,) = check_columns(df, [polygons])
    measured = df.withColumn("_m", measures.polygon_measures(F.col(polygons)))
    return measured.select(*df.columns, *measures.area_fields(F.col("_m")),
                           F.col("_m.shell_perimeter_m"))


def centroids(df: DataFrame, *, geom: str = "geometry") -> DataFrame:
    """Adds the planar ``centroid`` (lon, lat) of each geometry."""
    (geom,) = check_columns(df, [geom])
    return df.withColumn("centroid", measures.centroid(F.col(geom)))


def bounds(df: DataFrame, *, geom: str = "geometry") -> DataFrame:
    """Adds the box of each geometry, its envelope polygon and geodesic size.

    Width is measured along the southern edge and height along the western edge.
    """
    (geom,) = check_columns(df, [geom])
    boxed = df.withColumn("_b", bounds_of(F.col(geom)["parts"]))
    return _sized(boxed).drop("_b")


def _sized(boxed: DataFrame) -> DataFrame:
    b = F.col("_b")
    south, west, north, east = (b[n] for n in ("min_lat", "min_lon", "max_lat", "max_lon"))
    parts = box_parts(min_lat=south, min_lon=west, max_lat=north, max_lon=east)
    return (
        boxed.withColumn("envelope", F.when(south.isNotNull(), geometry("Polygon", parts)))
        .withColumn("_w", measures.geodesic_inverse(lon1=west, lat1=south, lon2=east, lat2=south))
        .withColumn("_h", measures.geodesic_inverse(lon1=west, lat1=south, lon2=west, lat2=north))
        .withColumn("_a", measures.polygon_measures(F.col("envelope.parts")))
        .withColumns({
            "min_lat": south, "min_lon": west, "max_lat": north, "max_lon": east,
            "width_km": F.col("_w.distance_m") / 1000.0,
            "height_km": F.col("_h.distance_m") / 1000.0,
            "area_km2": F.col("_a.area_m2") / 1_000_000.0,
        })
        .drop("_w", "_h", "_a")
    )


def total_bounds(points: DataFrame, *, lat: str, lon: str) -> DataFrame:
    """One row: the box of all points with its geodesic size."""
    lat, lon = check_columns(points, [lat, lon])
    box = points.agg(F.struct(
        F.min(lat).alias("min_lat"), F.min(lon).alias("min_lon"),
        F.max(lat).alias("max_lat"), F.max(lon).alias("max_lon")).alias("_b"))
    return _sized(box).drop("_b")


def simplify(df: DataFrame, *, geom: str = "geometry", tolerance: float = 0.001,
             method: str = "vw") -> DataFrame:
    """Simplify each geometry: ``"dp"`` by distance in degrees, ``"vw"`` by triangle area.

    Lines, polygons and multipolygons only; no promise about topology.
    """
    (geom,) = check_columns(df, [geom])
    return df.withColumn(geom, measures.simplify_geometry(F.col(geom), tolerance=tolerance,
                                                          method=method))


def buffer_points(df: DataFrame, *, lat: str, lon: str, distance: float | str, unit: str = "m",
                  segments: int = 64) -> DataFrame:
    """Adds the geodesic buffer polygon of each point with its area.

    ``distance`` is a number or the name of a column, in ``unit``.
    """
    if unit not in METRES_PER_UNIT:
        raise ValueError(f"unknown unit: {unit!r}")
    lat, lon = check_columns(df, [lat, lon])
    amount = F.col(check_columns(df, [distance])[0]) if isinstance(distance, str) else F.lit(
        float(distance))
    ring = measures.buffer_ring(lon=F.col(lon), lat=F.col(lat), segments=segments,
                                distance_m=F.col("distance_m"))
    out = (
        df.withColumn("distance_m", amount * METRES_PER_UNIT[unit])
        .withColumn("segments", F.lit(segments))
        .withColumn("_ring", ring)
        .withColumn("geometry", F.when(F.col("_ring").isNotNull(),
                                       geometry("Polygon", F.array(F.array("_ring")))))
        .withColumn("_m", measures.polygon_measures(F.col("geometry.parts")))
    )
    return (out.withColumn("area_m2", F.col("_m.area_m2"))
            .withColumn("area_km2", F.col("_m.area_m2") / 1_000_000.0).drop("_ring", "_m"))


def geodesic_distance(df: DataFrame, *, from_lat: str, from_lon: str, to_lat: str,
                      to_lon: str) -> DataFrame:
    """Adds ellipsoidal distance (m, km, mi) and forward bearing for each pair of points."""
    a, b, c, d = check_columns(df, [from_lon, from_lat, to_lon, to_lat])
    pair = measures.geodesic_inverse(lon1=F.col(a), lat1=F.col(b), lon2=F.col(c), lat2=F.col(d))
    return df.withColumn("_g", pair).select(*df.columns, *measures.distance_fields(F.col("_g")))


_BLOCK = 256


def _same_keys(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]


def _slices(points: DataFrame, keys: list[str], by: list[str], long_track: int):
    """Points with ``_slice``, and whether any track has more than one.

    A long track is cut where the hash of a row's order columns is divisible by ``long_track``, so into
    stretches of about that many rows, whatever the types of the columns and however often the first
    one repeats. The slice depends on values only, never on task placement.
    """
    whole = points.withColumn("_slice", F.lit(0))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = [f"_k{i}" for i in range(len(keys))]
    long = points.groupBy(*named).agg(F.count("*").alias("_rows")).filter(
        F.col("_rows") > long_track)
    tracks, width = long.agg(F.count("*"), F.sum(row_width(long, own))).first()
    if not tracks:
        return whole, False
    place = F.struct(*[F.col(c) for c in by])
    cuts = (
        points.filter(F.pmod(F.xxhash64(F.lit("cut"), *by), F.lit(long_track)) == 0)
        .join(join_side(long, width), _same_keys(keys))
        .groupBy(*own).agg(F.array_sort(F.collect_set(place)).alias("_cuts")))
    cuts = materialize(cuts, "cuts")
    size = cuts.agg(F.sum(row_width(cuts, cuts.columns))).first()[0] or 0
    # two short searches instead of one along all cuts
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % _BLOCK == 0))
    block = F.size(F.filter("_coarse", lambda c: c <= place))
    within = F.size(F.filter(F.slice("_cuts", (F.col("_block") - 1) * _BLOCK + 1, F.lit(_BLOCK)),
                             lambda c: c <= place))
    placed = (
        points.join(join_side(cuts, 2 * size), _same_keys(keys), "left")
        .withColumn("_block", F.when(F.col("_cuts").isNull(), 0).otherwise(block))
        .withColumn("_slice", F.when(F.col("_block") == 0, 0).otherwise(
            (F.col("_block") - 1) * _BLOCK + within)))
    return placed.select(*points.columns, "_slice"), True


def track_steps(points: DataFrame, *, lat: str, lon: str, track: str | list[str],
                order: str | list[str], long_track: int = 5_000_000) -> DataFrame:
    """Adds the distance and bearing from the previous point of each track (NULL for the first).

    Tracks over ``long_track`` rows are sorted in slices of their ``order`` columns, each slice
    continuing from the last point of the one before.
    """
    lat, lon = check_columns(points, [lat, lon])
    keys = check_columns(points, [track] if isinstance(track, str) else track)
    by = check_columns(points, [order] if isinstance(order, str) else order)
    rows, cut = _slices(points, keys, by, long_track)
    here = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    w = Window.partitionBy(*keys, "_slice").orderBy(*by)
    back = rows.withColumn("_back", F.lag(here).over(w))
    if cut:
        # the last point of each slice carries over to the first row of the next
        before = Window.partitionBy(*keys).orderBy("_slice")
        carry = (
            rows.groupBy(*keys, "_slice").agg(F.max_by(here, F.struct(*by)).alias("_last"))
            .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                    F.col("_slice").alias("_s"), F.lag("_last").over(before).alias("_carry"))
            .filter(F.col("_carry").isNotNull())
        )
        first = F.row_number().over(w) == 1
        back = (
            back.withColumn("_first", first)
            .join(carry, [*_same_keys(keys), F.col("_slice") == F.col("_s"), F.col("_first")],
                  "left")
            .withColumn("_back", F.coalesce("_back", "_carry"))
        )
    pair = measures.geodesic_inverse(lon1=F.col("_back.lon"), lat1=F.col("_back.lat"),
                                     lon2=F.col(lon), lat2=F.col(lat))
    return back.withColumn("_g", pair).select(*points.columns,
                                              *measures.distance_fields(F.col("_g")))


def track_lengths(points: DataFrame, *, lat: str, lon: str, track: str | list[str],
                  order: str | list[str], long_track: int = 5_000_000) -> DataFrame:
    """Geodesic length and number of points of each track."""
    keys = [track] if isinstance(track, str) else track
    steps = track_steps(points, lat=lat, lon=lon, track=track, order=order,
                        long_track=long_track)
    return steps.groupBy(*check_columns(points, keys)).agg(
        F.count("*").alias("point_count"),
        F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("length_m"))


# -- hulls -----------------------------------------------------------------------------


def _group_codes(columns: list[pa.Array], size: int) -> np.ndarray:
    codes = np.zeros(size, np.int64)
    for column in columns:
        own = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        _, codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
    return codes


def _reduced(columns: list[pa.Array], n_keys: int, codes: np.ndarray) -> list[pa.Array]:
    """Hull corners per key of rows (keys, lon, lat, n); the first corner carries the sum of n."""
    lon, lat, n = (c.to_numpy(zero_copy_only=False) for c in columns[n_keys:])
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.diff(codes[order])) + 1
    first, lons, lats, counts = [], [], [], []
    for rows in np.split(order, edges):
        corners = planar.hull(lon[rows], lat[rows]) or [(np.nan, np.nan)]
        first += [rows[0]] * len(corners)
        lons += [c[0] for c in corners]
        lats += [c[1] for c in corners]
        counts += [int(n[rows].sum())] + [0] * (len(corners) - 1)
    take = pa.array(first, pa.int64())
    return [*(c.take(take) for c in columns[:n_keys]), pa.array(lons, pa.float64()),
            pa.array(lats, pa.float64()), pa.array(counts, pa.int64())]


def _appended(held: list[pa.Array] | None, batch: pa.RecordBatch) -> list[pa.Array]:
    return batch.columns if held is None else [pa.concat_arrays([a, b])
                                               for a, b in zip(held, batch.columns)]


def _partial_hulls(n_keys: int):
    """Reduce a partition to hull corners per key; rows carry (keys, lon, lat, n).

    Corners so far are re-merged as batches arrive while that shrinks them; keys too
    numerous to shrink are passed on instead of being held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.schema.names
            held = _appended(held, batch)
            if len(held[-1]) < 100_000:
                continue
            held = _reduced(held, n_keys, _group_codes(held[:n_keys], len(held[-1])))
            if len(held[-1]) > 50_000:
                yield pa.RecordBatch.from_arrays(held, names)
                held = None
        if held is not None:
            codes = _group_codes(held[:n_keys], len(held[-1]))
            yield pa.RecordBatch.from_arrays(_reduced(held, n_keys, codes), names)

    return run


def _running_hulls(n_keys: int):
    """Merge rows sorted by key; all that is held is a batch and the hull of the key it ends with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.schema.names
            rows = _appended(held, batch)
            codes = _group_codes(rows[:n_keys], len(rows[-1]))
            last = codes == codes[-1]
            if not last.all():
                done = pa.array(~last)
                yield pa.RecordBatch.from_arrays(
                    _reduced([c.filter(done) for c in rows], n_keys, codes[~last]), names)
            held = _reduced([c.filter(pa.array(last)) for c in rows], n_keys, codes[last])
        if held is not None:
            yield pa.RecordBatch.from_arrays(held, names)

    return run


def _as_rings(n_keys: int):
    """One row (keys, corners, point_count) per key from the whole hulls of ``_running_hulls``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _running_hulls(n_keys)(batches):
            lon, lat, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys:])
            start = np.flatnonzero(n > 0)
            real = np.isfinite(lon)
            ends = np.concatenate([np.cumsum(real)[start] - real[start], [real.sum()]])
            rings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                             vertex_array(lon[real], lat[real]))
            keys = [c.take(pa.array(start)) for c in batch.columns[:n_keys]]
            yield pa.RecordBatch.from_arrays(
                [*keys, rings, pa.array(n[start])],
                [*batch.schema.names[:n_keys], "corners", "point_count"])

    return run


def _hulls(points: DataFrame, lat: str, lon: str, keys: list[str]) -> DataFrame:
    """(keys, corners, point_count). Each task reduces what it reads, then rows sorted by key are merged
    as they stream by: first per key and reading task, so a group of most rows is merged by many
    tasks, then per key. No group is ever an array of its points."""
    schema = T.StructType([points.schema[k] for k in keys])
    schema = schema.add("_lon", "double").add("_lat", "double").add("_n", "long")
    rows = points.select(*keys, F.col(lon).cast("double").alias("_lon"),
                         F.col(lat).cast("double").alias("_lat"),
                         F.lit(1).cast("bigint").alias("_n"))
    # a task id is the same when a lost task is run again, unlike a random salt
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.spark_partition_id(), F.lit(parts)).alias("_salt")
    partial = rows.mapInArrow(_partial_hulls(len(keys)), schema).select(*keys, salt, "_lon", "_lat", "_n")
    by = [*keys, "_salt"]
    merged = (partial.repartition(*by).sortWithinPartitions(*by)
              .mapInArrow(_running_hulls(len(by)), partial.schema).drop("_salt"))
    together = merged.repartition(*keys).sortWithinPartitions(*keys) if keys else merged.repartition(1)  # an exchange, so that the merge before it stays parallel
    vertex = T.StructType().add("lon", "double").add("lat", "double")
    rings = T.StructType(schema.fields[:len(keys)]).add("corners", T.ArrayType(vertex))
    rings = rings.add("point_count", "long")
    return together.mapInArrow(_as_rings(len(keys)), rings)


def _hull_features(hulls: DataFrame, keys: list[str]) -> DataFrame:
    ring = F.col("corners")
    closed = F.concat(ring, F.slice(ring, 1, 1)).cast(RING_TYPE)
    shaped = hulls.withColumn("geometry", geometry("Polygon", F.array(F.array(closed)))).withColumn(
        "_m", measures.polygon_measures(F.col("geometry.parts")))
    area = {c: f for c, f in zip(("area_m2", "area_km2", "area_ha", "area_acres", "perimeter_m"),
                                 measures.area_fields(F.col("_m")))}
    return shaped.select(*keys, "geometry", area["area_m2"], area["area_km2"], area["area_ha"],
                         area["perimeter_m"], "point_count")


def convex_hull(points: DataFrame, *, lat: str, lon: str) -> DataFrame:
    """One row: convex hull of all points with area, perimeter and input count.

    No row when there are fewer than three points.
    """
    lat, lon = check_columns(points, [lat, lon])
    points = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return _hull_features(_hulls(points, lat, lon, []), []).filter(F.col("point_count") >= 3)


def dissolve(points: DataFrame, *, by: str | list[str], lat: str, lon: str,
             include_area: bool = True, include_count: bool = True) -> DataFrame:
    """Convex hull of each group; groups under three points are left out, NULL is a group."""
    lat, lon = check_columns(points, [lat, lon])
    keys = check_columns(points, [by] if isinstance(by, str) else by)
    points = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    out = _hull_features(_hulls(points, lat, lon, keys), keys).filter(F.col("point_count") >= 3)
    columns: list[str | Column] = [*keys, "geometry"]
    if include_area:
        columns += ["area_m2", "area_km2", "area_ha", "perimeter_m"]
    if include_count:
        columns.append(F.col("point_count").alias("count"))
    return out.select(*columns)
