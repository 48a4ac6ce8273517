"""Exact k nearest points for a table of query points.

1. Count points in a tree of cells: a cell is split only where it holds more than a bound,
   straight to the depth at which its points would meet the bound if they lay evenly. The
   table of leaves has a row per so many points, whatever their spread.
2. For each query find the smallest cell, or 2 x 2 block of cells, around it that holds k
   points; the farthest corner bounds its k-th distance.
3. Where such a circle could hold many points (queries far from all data, or beside a
   crowded spot), descend the tree: keep only occupied cells that may hold one of the
   k nearest, tighten the bound from their counts, and go to finer cells.
4. Join smaller circles first, in which the counts let expect a few times k points. Where one
   holds k points, their k-th distance is the bound; elsewhere the proven bound stays.
5. One circle join with the bounds, then the k best rows per query.

Finest cells holding far more than k points are thinned first: of the points sharing one
coordinate only the k with the smallest tie key can be among anyone's k nearest.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import check_columns
from ..functions.sphere import EARTH_RADIUS_M, fold_longitude
from ..plans.session import BROADCAST_LIMIT_BYTES, join_side, materialize
from .joins import DISTANCE_KM, radius_join

_TOP_DEG = 8.0  # divides 360, so columns wrap at the 180 degree meridian
_DEPTH = 16  # finest cells: 8 / 2**16 degrees, about 14 m
_EXPECTED = 4  # times k points in a circle that is tried first
_LEAF = 128  # points from which a cell is split
_HALF_TURN_M = 3.1415926535897936 * EARTH_RADIUS_M + 1.0


def _far_bound(lat: Column, reach_lat: Column, reach_lon: Column, low: Column) -> Column:
    """Upper bound in metres of the distance to anything within the given degrees.

    ``low`` is the smallest absolute latitude there, where a degree of longitude is widest.
    """
    dy, dx = F.radians(F.least(reach_lat, F.lit(180.0))), F.radians(F.least(reach_lon, F.lit(180.0)))
    widest = F.cos(F.radians(F.greatest(low, F.lit(0.0))))
    sin_y, sin_x = F.sin(dy / 2.0), F.sin(dx / 2.0)
    a = sin_y * sin_y + F.cos(F.radians(lat)) * widest * sin_x * sin_x
    arc = 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    return arc * (1.0 + 1e-9) + 0.001


def _grid(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    columns = int(360.0 / size)
    return (F.pmod(F.floor((fold_longitude(lon) + 180.0) / size), F.lit(columns)),
            F.floor((lat + 90.0) / size))


def _key(depth: Column, cx: Column, cy: Column) -> Column:
    return F.shiftleft(depth.cast("bigint"), 48) + F.shiftleft(cy.cast("bigint"), 24) + cx


def _usable(lat: str, lon: str) -> Column:
    return F.col(lat).between(-90.0, 90.0) & F.abs(F.col(lon)).between(0.0, 1.7976931348623157e308)


def _above(value: str, depth: Column) -> Column:
    """Row or column at ``depth`` of the cell that holds a finest one."""
    return F.call_function("shiftright", value, F.lit(_DEPTH) - depth)


@dataclass(frozen=True)
class _Tree:
    """Leaves (depth, cx, cy, n) that hold all points once, with the facts needed to plan joins on them."""

    leaves: DataFrame
    n_leaves: int
    deepest: int


def _cell_tree(points: DataFrame, lat: str, lon: str, bound: int, limit: int) -> _Tree:
    """A tree whose cells hold at most ``bound`` points, finest cells apart.

    A round reads the points of the cells still above the bound and splits each of those at once by as many
    depths as its count asks for, so it adds at most four leaves per ``bound`` points; a hot spot falls
    to the finest cells in one or two rounds.
    """
    cx, cy = _grid(F.col(lat), F.col(lon), _TOP_DEG / 2**_DEPTH)
    places = points.filter(_usable(lat, lon)).select(
        cx.cast("int").alias("_x"), cy.cast("int").alias("_y"))

    def counted(cells: DataFrame, depth: Column) -> DataFrame:
        rows = cells.select(depth.cast("int").alias("depth"), _above("_x", depth).alias("cx"),
                            _above("_y", depth).alias("cy"))
        return materialize(rows.groupBy("depth", "cx", "cy").agg(F.count("*").alias("n")), "knn-cells")

    over = (F.col("n") > bound) & (F.col("depth") < _DEPTH)
    level, leaves, n_leaves, deepest = counted(places, F.lit(0)), [], 0, 0
    while True:
        leaves.append(level.filter(~over))
        sizes = {}
        for r in level.groupBy("depth", over.alias("over")).count().collect():  # two rows a depth
            if r["over"]:
                sizes[r["depth"]] = r["count"]
            else:
                n_leaves, deepest = n_leaves + r["count"], max(deepest, r["depth"])
        if not sizes:
            return _Tree(reduce(DataFrame.unionByName, leaves), n_leaves, deepest)
        down = F.floor(F.log2(F.col("n") / bound) / 2.0).cast("int") + 1
        split = level.filter(over).select(
            _key(F.col("depth"), F.col("cx"), F.col("cy")).alias("_parent"),
            F.least(F.lit(_DEPTH), F.col("depth") + down).alias("_deeper"))
        # the cells to split do not overlap, so a point meets one of them at most
        keys = [_key(F.lit(d), _above("_x", F.lit(d)), _above("_y", F.lit(d))) for d in sorted(sizes)]
        inner = places.withColumn("_parent", F.explode(F.array(*keys)) if len(keys) > 1 else keys[0])
        inner = inner.join(join_side(split, 64 * sum(sizes.values()), limit), "_parent")
        level = counted(inner, F.col("_deeper"))


def _all_depths(tree: _Tree, wanted: DataFrame | None = None) -> DataFrame:
    """Counts of the leaves and of every cell above them, keyed by one BIGINT; only ``wanted`` keys if given."""
    up = F.col("depth") - F.col("_d")
    cells = tree.leaves.withColumn("_d", F.explode(F.sequence(F.lit(0), "depth"))).select(
        _key(F.col("_d"), F.call_function("shiftright", "cx", up), F.call_function("shiftright", "cy", up)).alias("key"),
        "n", F.col("_d").alias("depth"), (up == 0).alias("leaf"))
    if wanted is not None:
        cells = cells.join(wanted, "key", "left_semi")
    return cells.groupBy("key").agg(F.sum("n").alias("n"), F.first("depth").alias("depth"), F.first("leaf").alias("leaf"))


def _blocks(queries: DataFrame, deepest: int) -> DataFrame:
    """For each query and depth: keys of its own and the three next cells."""
    # whole numbers of half a finest cell: higher bits give the cell of a depth, the next bit the nearer side
    gx, gy = _grid(F.col("_qlat"), F.col("_qlon"), _TOP_DEG / 2 ** (_DEPTH + 1))
    spread = queries.select("_qid", "_qlat", "_qlon", gx.alias("_gx"), gy.alias("_gy")).withColumn(
        "depth", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    down = F.lit(_DEPTH + 1) - F.col("depth")

    def cell(value):
        return F.call_function("shiftright", value, down)

    def other(value):
        return cell(value) + F.call_function("shiftright", value, down - 1).bitwiseAND(F.lit(1)) * 2 - 1

    columns = F.call_function("shiftleft", F.lit(int(360 / _TOP_DEG)), F.col("depth"))
    sides = spread.select("_qid", "_qlat", "_qlon", "depth", cell("_gx").alias("_x"), cell("_gy").alias("_y"),
                          F.pmod(other("_gx"), columns).alias("_ox"), F.greatest(other("_gy"), F.lit(-1)).alias("_oy"))
    cells = [F.struct(_key(F.col("depth"), F.col(x), F.col(y)).alias("key"), F.lit(own).alias("own"))
             for x, y, own in (("_x", "_y", True), ("_x", "_oy", False), ("_ox", "_y", False), ("_ox", "_oy", False))]
    return sides.select("_qid", "_qlat", "_qlon", "depth", F.inline(F.array(*cells)))


def _reaches(block_depth: Column, own_depth: Column) -> tuple[Column, Column]:
    """Bounds of the distance from a query to anything in its block, and in its own cell, of the depths given."""
    def block(f):
        return F.when(f < 0.5, 1.0 + f).otherwise(2.0 - f)

    def own(f):
        return F.greatest(f, 1.0 - f)

    def bound(depth, share):
        size = F.lit(_TOP_DEG) / F.pow(F.lit(2.0), depth)
        gx, gy = (fold_longitude(F.col("_qlon")) + 180.0) / size, (F.col("_qlat") + 90.0) / size
        x, y = (size * share(g - F.floor(g)) + 1e-9 for g in (gx, gy))
        return F.when(depth.isNotNull(), _far_bound(F.col("_qlat"), y, x, F.abs("_qlat") - y))

    return bound(block_depth, block), bound(own_depth, own)


def _cell_distances() -> tuple[Column, Column]:
    """Bounds in metres of the distance from the query to anything in a cell (depth, cx, cy)."""
    cx, cy = F.col("cx"), F.col("cy")
    size = F.lit(_TOP_DEG) / F.pow(F.lit(2.0), F.col("depth"))
    half, lat = size / 2.0, F.col("_qlat")
    mid_lon, mid_lat = cx * size - 180.0 + half, cy * size - 90.0 + half
    turn = F.abs(fold_longitude(fold_longitude(F.col("_qlon")) - mid_lon))
    up, edge = F.abs(lat - mid_lat), half + 1e-9
    far = _far_bound(lat, up + edge, turn + edge, F.abs(mid_lat) - edge)
    dy = F.radians(F.greatest(up - edge, F.lit(0.0)))
    dx = F.radians(F.greatest(turn - edge, F.lit(0.0)))
    narrow = F.least(F.cos(F.radians(F.greatest(mid_lat - edge, F.lit(-90.0)))),
                     F.cos(F.radians(F.least(mid_lat + edge, F.lit(90.0)))))
    sin_y, sin_x = F.sin(dy / 2.0), F.sin(dx / 2.0)
    a = sin_y * sin_y + F.cos(F.radians(lat)) * narrow * sin_x * sin_x
    near = 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (1.0 - 1e-9) - 0.001
    return near, far


def _tightened(cells: DataFrame, k: int) -> DataFrame:
    """Shrink each query's bound to the nearest cells that hold k points; drop cells beyond it.

    Rows of a query are only occupied cells near its bound. ``_load`` counts their points, ``_last`` says that
    none of them can be split.
    """
    mine = Window.partitionBy("_qid")
    so_far = mine.orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cells.filter(F.col("_near") <= F.col("_near_m"))
        .withColumn("_sum", F.sum("n").over(so_far))
        .withColumn("_reach", F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(mine))
        .withColumn("_near_m", F.least("_near_m", "_reach"))
        .filter(F.col("_near") <= F.col("_near_m"))
        .withColumn("_load", F.sum("n").over(mine))
        .withColumn("_last", F.every("leaf").over(mine))
        .select("_qid", "_qlat", "_qlon", "_near_m", "_load", "_last", "depth", "cx", "cy", "n", "leaf")
    )


def _descend(queries: DataFrame, tree: _Tree, k: int, enough: int) -> DataFrame:
    """(_qid, _near_m) with circles holding few points, or as tight as the leaves allow."""
    up = F.col("depth")
    coarse = (tree.leaves.groupBy(F.call_function("shiftright", "cx", up).alias("x"),
                           F.call_function("shiftright", "cy", up).alias("y"))
              .agg(F.sum("n").alias("n"), F.every(up == 0).alias("leaf")).collect())  # at most 45 x 23 cells
    top = F.from_json(F.lit(json.dumps([r.asDict() for r in coarse])),
                      "array<struct<x: bigint, y: bigint, n: bigint, leaf: boolean>>")
    # two depths a step, so the cells between count only where they are leaves
    counts = materialize(
        _all_depths(tree).filter(F.col("leaf") | (F.col("depth") % 2 == 0)), "knn-counts")
    near, far = _cell_distances()
    names = ["_qid", "_qlat", "_qlon", "_near_m", "depth", "cx", "cy", "n", "leaf"]
    cells = (
        queries.withColumn("_c", F.explode(top))
        .select("_qid", "_qlat", "_qlon", F.coalesce("_near_m", F.lit(_HALF_TURN_M)).alias("_near_m"),
                F.lit(0).alias("depth"), F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"),
                F.col("_c.n").alias("n"), F.col("_c.leaf").alias("leaf"))
    )
    below = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i % 2**d).alias("x"), F.lit(i // 2**d).alias("y"))
                      for d in (1, 2) for i in range(4**d)])
    finished = []
    while True:
        step = materialize(_tightened(cells.withColumn("_near", near).withColumn("_far", far), k), "knn-step")
        ready = (F.col("_load") <= enough) | F.col("_last")
        finished.append(step.filter(ready).groupBy("_qid").agg(F.min("_near_m").alias("_near_m")))
        still = step.filter(~ready)
        if still.isEmpty():
            return reduce(DataFrame.unionByName, finished)
        children = (
            still.filter(~F.col("leaf")).drop("n", "leaf").withColumn("_i", F.explode(below))
            .withColumn("depth", F.col("depth") + F.col("_i.d"))
            .withColumn("cx", F.call_function("shiftleft", "cx", F.col("_i.d")) + F.col("_i.x"))
            .withColumn("cy", F.call_function("shiftleft", "cy", F.col("_i.d")) + F.col("_i.y"))
            .withColumn("key", _key(F.col("depth"), F.col("cx"), F.col("cy")))
            .join(counts.select("key", "n", "leaf"), "key")
        )
        cells = still.filter("leaf").select(*names).unionByName(children.select(*names))


def _thin(points: DataFrame, tree: _Tree, *, lat: str, lon: str, tie: list[str], k: int,
          crowd: int, limit: int) -> DataFrame:
    """In crowded finest cells keep only the k smallest tie keys of each exact coordinate."""
    crowded = tree.leaves.filter((F.col("depth") == _DEPTH) & (F.col("n") > crowd)).select(
        F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
    cells = crowded.count()
    if not cells:
        return points
    crowded = join_side(crowded, 64 * cells, limit)
    cx, cy = _grid(F.col(lat), F.col(lon), _TOP_DEG / 2**_DEPTH)
    keyed = points.filter(_usable(lat, lon)).withColumn("_kx", cx).withColumn("_ky", cy)
    same = (F.col("_kx") == F.col("_cx")) & (F.col("_ky") == F.col("_cy"))
    # the rank filter is applied within each task before the shuffle as well
    by_tie = Window.partitionBy(lat, lon).orderBy(*tie)
    thin = (keyed.join(crowded, same, "left_semi")
            .withColumn("_n", F.row_number().over(by_tie)).filter(F.col("_n") <= k))
    rest = keyed.join(crowded, same, "left_anti")
    return rest.select(*points.columns).unionByName(thin.select(*points.columns))


def _tried(points: DataFrame, bounded: DataFrame, k: int, *, lat: str, lon: str, limit: int) -> DataFrame:
    """(_qid, _qlat, _qlon, _near_m) with the k-th distance as bound where a smaller circle holds k points.

    Points spread evenly over the block of a query would put ``_EXPECTED`` times k of them in that circle.
    """
    metres = F.radians(F.lit(_TOP_DEG) / F.pow(F.lit(2.0), F.col("_depth"))) * EARTH_RADIUS_M
    area = 4.0 * metres * metres * F.cos(F.radians("_qlat"))
    guess = F.sqrt(_EXPECTED * k * area / (F.pi() * F.col("_n")))
    trial = bounded.select("_qid", "_qlat", "_qlon", F.least("_near_m", guess).alias("_try_m"))
    near = radius_join(points.select(lat, lon), trial, lat=lat, lon=lon, centre_lat="_qlat", centre_lon="_qlon",
                       radius_m="_try_m", centre_id="_qid", broadcast_limit=limit).select("_qid", DISTANCE_KM)
    place = F.row_number().over(Window.partitionBy("_qid").orderBy(DISTANCE_KM))
    kth = (near.withColumn("_n", place).filter(F.col("_n") <= k).groupBy("_qid")
           .agg(F.count("*").alias("_found"), F.max(DISTANCE_KM).alias("_kth_km")).filter(F.col("_found") == k)
           .select("_qid", (F.col("_kth_km") * (1000.0 * (1.0 + 1e-9)) + 0.001).alias("_kth_m")))
    return materialize(
        bounded.join(kth, "_qid", "left")
        .select("_qid", "_qlat", "_qlon", F.least("_near_m", "_kth_m").alias("_near_m")), "knn-tried")


def knn_join(
    points: DataFrame, queries: DataFrame, *, k: int, lat: str, lon: str, query_lat: str,
    query_lon: str, query_id: str = "query_id", tie: str | list[str],
    keep: list[str] | None = None, broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    crowd: int | None = None, busy: int | None = None, leaf: int | None = None,
) -> DataFrame:
    """The ``k`` nearest points of every query, with ``_distance_km`` and ``rank``.

    Exact. ``query_id`` must be unique; equal distances are ordered by ``tie``, which
    should identify a point. ``leaf``, ``crowd`` and ``busy`` are the counts from which cells are
    split, thinned and circles tightened; they change the work, never the result. Points and queries with a latitude
    outside [-90, 90] take no part.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    lat, lon = check_columns(points, [lat, lon])
    tie = check_columns(points, [tie] if isinstance(tie, str) else tie)
    query_lat, query_lon, query_id = check_columns(queries, [query_lat, query_lon, query_id])
    places = queries.filter(_usable(query_lat, query_lon)).select(
        F.col(query_id).alias("_qid"), F.col(query_lat).cast("double").alias("_qlat"),
        F.col(query_lon).cast("double").alias("_qlon"))

    # each query becomes many rows next, so spread the narrow rows before that
    places = places.repartition("_qid")

    leaf = max(_LEAF, 8 * k) if leaf is None else leaf
    tree = _cell_tree(points, lat, lon, leaf, broadcast_limit)
    blocks = _blocks(places, tree.deepest)
    rows = tree.n_leaves * (tree.deepest + 1)  # at most, with the cells above the leaves
    asked = None
    if 48 * rows > broadcast_limit:
        # drop the cells no query looks at; before they are shuffled if the list of the others is small
        keys = places.count() * 4 * (tree.deepest + 1)
        asked = join_side(blocks.select("key").distinct(), 48 * keys, broadcast_limit)
    counts = join_side(_all_depths(tree, asked).select("key", "n"), 48 * rows, broadcast_limit)
    own = F.max(F.when(F.col("own"), F.col("n")))
    levels = (
        blocks.join(counts, "key").groupBy("_qid", "depth").agg(F.sum("n").alias("n"), own.alias("own"))
        # what is reached shrinks with the depth, so the deepest block and the deepest cell with k points bound best
        .groupBy("_qid").agg(F.map_from_entries(F.collect_list(F.struct("depth", "n"))).alias("_all"),
                             F.max(F.when(F.col("n") >= k, F.col("depth"))).alias("_block"),
                             F.max(F.when(F.col("own") >= k, F.col("depth"))).alias("_own"))
    )
    block, cell = _reaches(F.col("_block"), F.col("_own"))
    depth = F.when(F.col("_cell_m") < F.col("_block_m"), F.col("_own")).otherwise(F.col("_block"))
    # the circle of a cell or block lies inside the block three depths up, short of the poles
    bounded = materialize(
        places.join(levels, "_qid", "left").select("*", block.alias("_block_m"), cell.alias("_cell_m"))
        .withColumn("_depth", depth)
        .select("_qid", "_qlat", "_qlon", F.least("_block_m", "_cell_m").alias("_near_m"),
                F.try_element_at("_all", F.col("_depth") - 3).alias("_around"), "_depth",
                F.try_element_at("_all", F.col("_depth")).alias("_n")), "knn-bounds")
    # evenly spread points put up to 256 leaves in that block, of which the circle covers a few
    busy = 256 * leaf if busy is None else busy
    easy = F.coalesce((F.col("_around") <= busy) & (F.abs("_qlat") < 60.0), F.lit(False))
    hard = bounded.filter(~easy)
    names = ["_qid", "_qlat", "_qlon", "_near_m"]
    crowd = max(1000, 64 * k) if crowd is None else crowd
    thin = _thin(points, tree, lat=lat, lon=lon, tie=tie, k=k, crowd=crowd, limit=broadcast_limit)
    tight = _tried(thin, bounded.filter(easy), k, lat=lat, lon=lon, limit=broadcast_limit)
    if not hard.isEmpty():
        proven = _descend(hard.select(*names), tree, k, max(1, busy // 16))
        tight = tight.unionByName(hard.select("_qid", "_qlat", "_qlon").join(proven, "_qid"))
    circles = tight
    if keep:
        extra = check_columns(queries, keep)
        circles = circles.join(
            queries.select(F.col(query_id).alias("_qid"), *extra), "_qid")
    near = radius_join(
        thin, circles, lat=lat, lon=lon, centre_lat="_qlat", centre_lon="_qlon",
        radius_m="_near_m", centre_id="_qid", keep=keep, broadcast_limit=broadcast_limit,
    )
    best = Window.partitionBy("_qid").orderBy(DISTANCE_KM, *tie)
    return (near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .withColumnRenamed("_qid", query_id))
