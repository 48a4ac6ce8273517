"""Joins of a points table with zones, circles and buffers.

Every join is an equi-join on one BIGINT cell key followed by an exact test. The
region side is broadcast when its computed size bound is small; otherwise both sides
shuffle on the cell and adaptive execution splits the cells that are hot. Building a join runs
small jobs over the regions, which give that bound and the overall box pushed to the scan of the
points for inner and semi joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import ColumnNotFound, check_columns
from ..functions.geometry import PARTS_TYPE
from ..functions.measures import buffer_ring
from ..functions.sphere import fold_longitude, fold_longitude_sql, haversine_m
from ..plans import cells as grid
from ..plans.session import BROADCAST_LIMIT_BYTES, join_side

DISTANCE_KM = "_distance_km"
_HOWS = ("inner", "left", "left_semi", "left_anti")


def _carried(points: DataFrame, regions: DataFrame, names: list[str]) -> list[str]:
    names = check_columns(regions, dict.fromkeys(names))
    clash = {c.lower() for c in points.columns} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}; rename one side")
    return names


def _spread(points: DataFrame, levels: tuple[int, ...], lat: str, lon: str) -> DataFrame:
    """A row for each level in use; one formula for all keeps the compiled method small."""
    each = points.withColumn("_plevel", F.explode(F.array(*map(F.lit, levels))))
    return each.withColumn("_pcell", grid.point_cell_at(lat=lat, lon=lon, level="_plevel"))


def _shared_points(points: DataFrame, full: DataFrame | None, *by: str) -> DataFrame:
    """Points with the key of their cell, or of one of its shares; dealt by the SQL expressions ``by``."""
    if full is None:
        return points
    share = f"pmod(xxhash64({', '.join(by)}), {grid.SHARES})"
    return (points.join(F.broadcast(full), F.col("_pcell") == F.col("_full"), "left")
            .withColumn("_pcell", grid.share_key("_pcell", f"coalesce({share}, 0L)")).drop("_full", grid.SHARES))


def _shared_cells(cells: DataFrame, full: DataFrame | None) -> DataFrame:
    """Rows of a cover, those of full cells once for each share."""
    if full is None:
        return cells
    return (cells.join(F.broadcast(full.withColumnRenamed("_full", grid.CELL)), grid.CELL, "left")
            .withColumn("_share", F.explode(F.expr(f"sequence(0L, coalesce({grid.SHARES}, 1L) - 1L)")))
            .withColumn(grid.CELL, grid.share_key(grid.CELL, "_share")).drop(grid.SHARES, "_share"))


BLOCK_POINTS = 256
_SHARE_POINTS = 65536
_MOST_TASKS = 4096


def _block_join(points: DataFrame, cover: grid.Cover, *, lat: str, lon: str, after) -> DataFrame:
    """Inner join to cells with many regions each, by blocks of nearby points of a cell.

    A block is one row that holds its points as arrays, one for each column so that unused columns are not read. Most
    blocks lie wholly inside or outside a region, so few points are tested. A region comes with the points of a block one after
    another, and the next with the same points again: files of such rows are small. The work goes with the rows that
    come out and not with the bytes that come in, so the number of tasks is set here, and cells of more than
    ``_SHARE_POINTS`` points are dealt to shares too.
    """
    lat_sql, lon_sql = grid.quoted(lat), grid.quoted(lon)
    tasks = min(_MOST_TASKS, max(4 * points.sparkSession.sparkContext.defaultParallelism, 2 * cover.cells // grid.FULL_CELL))
    placed = _spread(points, cover.levels, lat_sql, lon_sql)
    full = (placed.groupBy("_pcell").count().where(f"count > {_SHARE_POINTS}")
            .select(F.col("_pcell").alias("_full"), F.expr(f"ceil(count / {_SHARE_POINTS}D)").alias(grid.SHARES)))
    if cover.full is not None:
        full = full.unionByName(cover.full).groupBy("_full").agg(F.max(grid.SHARES).alias(grid.SHARES))
    full = full.withColumn(grid.SHARES, F.least(grid.SHARES, F.lit(grid.MOST_SHARES)))
    placed = placed.withColumn("_ppart", grid.point_cell_at(lat=lat_sql, lon=lon_sql, level="(_plevel + 2)")).drop("_plevel")
    placed = _shared_points(placed, full, lat_sql, lon_sql, "monotonically_increasing_id()").repartition(tasks, "_pcell")
    number = F.row_number().over(Window.partitionBy("_pcell").orderBy("_ppart"))
    low_lat, low_lon, high_lat, high_lon = grid.BLOCK_BOX
    held = {c: f"_held_{i}" for i, c in enumerate(points.columns)}
    at_lat, at_lon = F.col(lat).cast("double"), F.col(lon).cast("double")
    blocks = placed.withColumn("_pblock", F.floor((number - 1) / BLOCK_POINTS)).groupBy("_pcell", "_pblock").agg(
        F.min(at_lat).alias(low_lat), F.max(at_lat).alias(high_lat), F.min(at_lon).alias(low_lon), F.max(at_lon).alias(high_lon),
        F.expr("sequence(1, CAST(count(*) AS INT))").alias("_at"),
        *[F.collect_list(F.struct(F.col(grid.quoted(c)).alias("v"))).alias(a) for c, a in held.items()])
    side = _shared_cells(cover.df, full).repartition(tasks, grid.CELL).hint("merge")
    # a compiled join would hold all points of all regions that meet a block before it hands on the first; one with a
    # function of an array in its condition is not compiled and hands on row by row
    gaps = F.array(F.col(grid.BOX[3]) - F.col(low_lon), F.col(high_lon) - F.col(grid.BOX[1]))
    meets = ((F.col(low_lat) <= F.col(grid.BOX[2])) & (F.col(high_lat) >= F.col(grid.BOX[0]))
             & F.forall(gaps, lambda gap: gap >= 0.0))
    met = blocks.join(side, (F.col("_pcell") == F.col(grid.CELL)) & meets, "inner")

    def opened(rows):
        kept = [c for c in cover.df.columns if c != grid.CELL]
        return rows.withColumn("_i", F.explode("_at")).select(*kept, *[F.expr(f"element_at({a}, _i).v").alias(c) for c, a in held.items()])

    sure, each = grid.block_tests()
    return opened(met.where(sure)).unionByName(after(opened(met.where(each))), allowMissingColumns=True)


def _cell_join(points: DataFrame, cover: grid.Cover, *, lat: str, lon: str, how: str,
               exact: Column, limit: int, fold: bool = False, after=None) -> DataFrame:
    """Join points to a cover; the result keeps the cover's columns for inner and left.

    ``fold`` compares longitudes modulo 360 degrees. ``after`` filters joined rows; inner joins use it
    in place of ``exact``, for tests that are too long for the condition of a join.
    """
    raw_lon = F.col(lon)
    folded = fold_longitude(raw_lon) if fold else raw_lon
    lat_sql, lon_sql = grid.quoted(lat), grid.quoted(lon)
    if fold:
        lon_sql = fold_longitude_sql(lon_sql)
    if how == "inner" and cover.crowded is not None and not points.isStreaming:
        low_lat, low_lon, high_lat, high_lon = cover.box
        near = points.filter(F.col(lat).between(low_lat, high_lat) & raw_lon.between(low_lon, high_lon))
        out = _block_join(near, cover.crowded, lat=lat, lon=lon, after=after)
        if not cover.calm.levels:
            return out
        return out.unionByName(_cell_join(points, cover.calm, lat=lat, lon=lon, how=how, exact=exact, limit=limit, after=after),
                               allowMissingColumns=True)
    cells, full = cover.df, cover.full
    side = join_side(_shared_cells(cells, full), cover.bytes_bound, limit)
    box_test = (F.col(lat).between(F.col(grid.BOX[0]), F.col(grid.BOX[2]))
                & folded.between(F.col(grid.BOX[1]), F.col(grid.BOX[3])))
    match = box_test & exact

    def shared(df):
        return _shared_points(df, full, lat_sql, lon_sql)

    def inner(df):
        test = match if after is None else box_test
        out = df.join(side, (F.col("_pcell") == F.col(grid.CELL)) & test, "inner").drop("_pcell")
        return out if after is None else after(out)

    def keys(levels):
        return [grid.point_cell(lat=lat_sql, lon=lon_sql, level=n) for n in levels]

    def keyed(df, level):
        return df.withColumn("_pcell", keys([level])[0])

    def spread(df):
        return _spread(df, cover.levels, lat_sql, lon_sql).drop("_plevel")

    def step(df, level, kind):
        if kind == "inner":
            return inner(shared(keyed(df, level)))
        return (shared(keyed(df, level))
                .join(side, (F.col("_pcell") == F.col(grid.CELL)) & match, kind).drop("_pcell"))

    if not cover.levels:  # no regions at all
        if how in ("left", "left_anti"):
            return points if how == "left_anti" else step(points, 0, "left")
        return step(points, 0, how)
    if how in ("inner", "left_semi"):
        low_lat, low_lon, high_lat, high_lon = cover.box
        lon_box = raw_lon.between(low_lon, high_lon)
        if fold:  # longitudes in another turn cannot be bounded before folding
            lon_box = lon_box | (raw_lon < -180.0) | (raw_lon > 180.0)
        points = points.filter(F.col(lat).between(low_lat, high_lat) & lon_box)
    if len(cover.levels) == 1:
        return step(points, cover.levels[0], how)
    if how == "inner":
        return inner(shared(spread(points)))
    if cover.bytes_bound <= limit:
        # one scan: an existence test a level against the same broadcast cover, in any order
        tests = [cover.df.hint("broadcast").where((F.col(grid.CELL) == key.outer()) & match).exists()
                 for key in (F.col(f"_pcell{n}") for n in cover.levels)]
        any_level = reduce(lambda a, b: a | b, tests)
        flagged = points.withColumns({f"_pcell{n}": k for n, k in zip(cover.levels, keys(cover.levels))})

        def kept(wanted):
            return flagged.where(any_level if wanted else ~any_level).select(*points.columns)
    else:
        # whether a point matches depends on its position alone: positions with a match meet the points again
        spare = "_" * (1 + max(map(len, points.columns)))  # longer than any name of the points
        at_lat, at_lon = f"{spare}lat", f"{spare}lon"
        places = points.select(F.col(lat).alias(at_lat), F.col(lon).alias(at_lon), lat, lon).where(
            F.col(lat).isNotNull() & F.col(lon).isNotNull())
        hits = shared(spread(places)).join(side, (F.col("_pcell") == F.col(grid.CELL)) & match, "left_semi").select(at_lat, at_lon).distinct()

        def kept(wanted):
            return points.join(hits.hint("merge"), (F.col(lat) == F.col(at_lat)) & (F.col(lon) == F.col(at_lon)),
                               "left_semi" if wanted else "left_anti")
    if how != "left":
        return kept(how == "left_semi")
    matched = _cell_join(points, cover, lat=lat, lon=lon, how="inner", exact=exact, limit=limit,
                         fold=fold, after=after)
    return matched.unionByName(kept(False), allowMissingColumns=True)


def within_join(
    points: DataFrame, zones: DataFrame, *, lat: str, lon: str, polygons: str = "polygons",
    zone_id: str = "zone_id", keep: list[str] | None = None, how: str = "inner",
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Points strictly inside zones: one row per (point, zone), boundary excluded.

    ``polygons`` holds polygon parts; a point matches a zone if it is inside any part.
    ``keep`` names further zone columns to carry for inner and left joins.
    """
    if how not in _HOWS:
        raise ValueError(f"how must be one of {_HOWS}")
    lat, lon = check_columns(points, [lat, lon])
    (polygons,) = check_columns(zones, [polygons])
    outer = how in ("inner", "left")
    names = _carried(points, zones, [zone_id, *(keep or [])]) if outer else []
    cover = grid.polygon_cover(zones, parts=polygons, keep=names, limit=broadcast_limit)
    at = {"lat": grid.quoted(lat), "lon": grid.quoted(lon)}
    out = _cell_join(points, cover, lat=lat, lon=lon, how=how, exact=grid.inside_test(**at), limit=broadcast_limit,
                     after=lambda pairs: grid.keep_inside(pairs, **at, many=cover.many))
    return out.select(*points.columns, *names)


def radius_join(
    points: DataFrame, centres: DataFrame, *, lat: str, lon: str, centre_lat: str,
    centre_lon: str, radius_m: Column | str | float, centre_id: str = "centre_id",
    keep: list[str] | None = None, broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Points within each centre's own radius (inclusive), with ``_distance_km``.

    ``radius_m`` is a column of ``centres`` or one number for all. Points with a
    latitude outside [-90, 90] never match.
    """
    lat, lon = check_columns(points, [lat, lon])
    centre_lat, centre_lon = check_columns(centres, [centre_lat, centre_lon])
    names = _carried(points, centres, [centre_id, *(keep or [])])
    if isinstance(radius_m, str):
        radius_m = F.col(check_columns(centres, [radius_m])[0])
    elif not isinstance(radius_m, Column):
        radius_m = F.lit(float(radius_m))
    centres = centres.withColumn("_clat", F.col(centre_lat).cast("double")).withColumn(
        "_clon", F.col(centre_lon).cast("double"))
    cover = grid.circle_cover(centres, lat="_clat", lon="_clon", radius_m=radius_m,
                              keep=[*names, "_clat", "_clon"])
    distance = haversine_m(lat1=F.col(lat), lon1=F.col(lon), lat2=F.col("_clat"),
                           lon2=F.col("_clon"))
    out = _cell_join(points, cover, lat=lat, lon=lon, how="inner", fold=True,
                     exact=distance <= F.col("_radius_m"), limit=broadcast_limit)
    return out.select(*points.columns, *names, (distance / 1000.0).alias(DISTANCE_KM))


def buffer_join(
    points: DataFrame, centres: DataFrame, *, lat: str, lon: str, centre_lat: str,
    centre_lon: str, distance_m: Column | str | float, centre_id: str = "centre_id",
    segments: int = 64, keep: list[str] | None = None, how: str = "inner",
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Points strictly inside the geodesic buffer polygon of each centre.

    Buffers over the 180 degree meridian are tested on both sides of it. A buffer around a pole is
    closed by the pole's cap (buffers around both poles are not supported).
    """
    if isinstance(distance_m, str):
        distance_m = F.col(check_columns(centres, [distance_m])[0])
    elif not isinstance(distance_m, Column):
        distance_m = F.lit(float(distance_m))
    if "_ring" in centres.columns:
        raise ColumnNotFound("column name _ring is reserved")
    # rings cost far more than the centres, which are often one split
    centres = centres.repartition(4 * centres.sparkSession.sparkContext.defaultParallelism,
                                  *dict.fromkeys([centre_id, centre_lat, centre_lon]))
    ring = F.col("_ring")
    lons = ring["lon"]

    def shifted(by):
        return F.array(F.transform(ring, lambda v: F.struct(
            (v["lon"] + by).alias("lon"), v["lat"].alias("lat"))))

    # around a pole the ring goes once round the earth: its vertices by longitude, then the cap
    count = F.size(ring) - 1
    around = F.exists(F.zip_with(F.slice(ring, 1, count), F.slice(ring, 2, count),
                                 lambda a, b: F.abs(a["lon"] - b["lon"]) > 180.0), lambda x: x)
    turn = F.array_sort(F.transform(F.slice(ring, 1, count), lambda v: F.struct(
        fold_longitude(v["lon"]).alias("lon"), v["lat"].alias("lat"))))
    west, east = F.element_at(turn, -1), F.element_at(turn, 1)
    pole = F.when(F.col(centre_lat) > 0, 90.0 + 1e-9).otherwise(-90.0 - 1e-9)

    def vertex(x, y):
        return F.array(F.struct(x.alias("lon"), y.alias("lat")))

    cap = F.concat(vertex(west["lon"] - 360.0, west["lat"]), turn, vertex(east["lon"] + 360.0, east["lat"]),
                   vertex(east["lon"] + 360.0, pole), vertex(west["lon"] - 360.0, pole),
                   vertex(west["lon"] - 360.0, west["lat"]))

    zones = centres.withColumn(
        "_ring", buffer_ring(lon=F.col(centre_lon), lat=F.col(centre_lat), distance_m=distance_m,
                             segments=segments, continuous=True),
    ).withColumn("_polygons", F.when(around, F.array(F.array(cap)))
                 .when(F.array_max(lons) > 180.0,
                                     F.array(F.array(ring), shifted(-360.0)))
                 .when(F.array_min(lons) < -180.0, F.array(F.array(ring), shifted(360.0)))
                 .otherwise(F.array(F.array(ring))).cast(PARTS_TYPE))
    return within_join(points, zones, lat=lat, lon=lon, polygons="_polygons", zone_id=centre_id,
                       keep=keep, how=how, broadcast_limit=broadcast_limit)


def zonal_stats(
    points: DataFrame, zones: DataFrame, *, lat: str, lon: str, aggs: list[str],
    polygons: str = "polygons", zone_id: str = "zone_id",
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Aggregates (``"count"``, ``"sum:col"``, ...) of the points inside each zone.

    Zones without points are absent. Partial sums are taken before the shuffle, so a
    zone holding most of the points sends one row per task.
    """
    from .aggregates import parse_agg

    exprs = [parse_agg(points, a) for a in aggs]
    inside = within_join(points, zones, lat=lat, lon=lon, polygons=polygons, zone_id=zone_id,
                         broadcast_limit=broadcast_limit)
    return inside.groupBy(zone_id).agg(*exprs)


def point_in_parts(polygons, *, lat: str, lon: str) -> Column:
    """Strictly-inside test against literal polygons, unrolled into one expression.

    ``lat`` and ``lon`` are SQL expressions.
    """

    def lit(value):
        return f"{float(value)!r}D"

    def between(what, a, b):
        return f"{what} BETWEEN {lit(min(a, b))} AND {lit(max(a, b))}"

    tests = []
    for rings in polygons:
        hits, crossings = [], []
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (x1, y1) == (x2, y2):
                    continue
                side = (f"({lit(x2 - x1)} * ({lat} - {lit(y1)}) - "
                        f"({lon} - {lit(x1)}) * {lit(y2 - y1)})")
                hits.append(f"({side} = 0D AND {between(lon, x1, x2)} AND {between(lat, y1, y2)})")
                if y1 != y2:
                    crossings.append(
                        f"({lat} >= {lit(min(y1, y2))} AND {lat} < {lit(max(y1, y2))} AND "
                        f"{side} {'>' if y2 > y1 else '<'} 0D)")
        if not crossings:
            continue
        xs, ys = zip(*[p for ring in rings for p in ring])
        odd = " != ".join(["false", *crossings])
        tests.append(f"({between(lat, min(ys), max(ys))} AND {between(lon, min(xs), max(xs))} "
                     f"AND NOT ({' OR '.join(hits)}) AND ({odd}))")
    return F.expr(" OR ".join(tests) or "false")
