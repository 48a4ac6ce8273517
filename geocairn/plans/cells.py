"""Grid cells that turn spatial joins into equi-joins.

Level ``n`` has square cells of ``64 / 4**n`` degrees. A region picks the level at
which it spans a handful of cells; a point has exactly one cell per level. Cell
edges are multiples of a power of two, so ``floor(x / size)`` is exact and a
point's cell never depends on rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow
from ..functions.geometry import bounds_of
from ..functions.sphere import circle_span_columns, fold_longitude
from .session import BROADCAST_LIMIT_BYTES, row_width

COARSEST_DEG = 64.0
FINEST_LEVEL = 9
_BITS = 22
_HALF = 1 << (_BITS - 1)
_LIMIT = 500.0  # degrees; coordinates beyond share the outermost cells

CELL, LEVEL = "_cell", "_level"
BOX = ("_min_lat", "_min_lon", "_max_lat", "_max_lon")
BLOCK_BOX = ("_low_lat", "_low_lon", "_high_lat", "_high_lon")

# A cell's polygon test: INSIDE needs none, FEW has its edges in flat columns that
# compile to straight code, MANY keeps them in arrays.
INSIDE, FEW, MANY = 0, 1, 2
FLAT_EDGES = 8
_FLAT = [f"_{axis}_{i}" for i in range(FLAT_EDGES) for axis in ("x1", "y1", "x2", "y2")]
_EDGE = "struct<x1: double, y1: double, x2: double, y2: double>"
_PIECES = f"array<struct<odd: boolean, edges: array<{_EDGE}>>>"
_ON_EDGE = 1 << 32


def cell_size(level: int) -> float:
    return COARSEST_DEG / 4.0**level


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _index(value: str, size: str) -> str:
    return f"CAST(floor(greatest(least({value}, {_LIMIT}D), -{_LIMIT}D) / {size}) AS BIGINT)"


def _key(level: str, cx: str, cy: str) -> str:
    """One BIGINT per cell, so joins hash a single long."""
    return (f"shiftleft(CAST({level} AS BIGINT), {2 * _BITS}) + "
            f"shiftleft({cy} + {_HALF}L, {_BITS}) + {cx} + {_HALF}L")


def point_cell(*, lat: str, lon: str, level: int) -> Column:
    """Cell key of a point; ``lat`` and ``lon`` are SQL expressions."""
    size = f"{cell_size(level)!r}D"
    return F.expr(_key(str(level), _index(lon, size), _index(lat, size)))


def point_cell_at(*, lat: str, lon: str, level: str) -> Column:
    """The same for a level given as an SQL expression."""
    size = f"({COARSEST_DEG}D / shiftleft(1L, 2 * {level}))"
    return F.expr(_key(level, _index(lon, size), _index(lat, size)))


@dataclass(frozen=True)
class Cover:
    """Cells of a table of regions, with the facts needed to plan a join on them."""

    df: DataFrame
    levels: tuple[int, ...]
    bytes_bound: int
    box: tuple[float, float, float, float] | None
    full: DataFrame | None = None  # cells of more than FULL_CELL rows, with the number of their shares
    many: bool = False  # cells of kind MANY may occur
    cells: int = 0  # bound on the rows of df
    crowded: Cover | None = None  # the levels whose average cell has more than BLOCK_CELL rows, if both sides are shuffled
    calm: Cover | None = None  # the other levels, where there is crowded


# Where points and cover are both shuffled, the points of a cell with more rows of the cover than this are dealt to
# several shares, and each share gets all these rows: work by task then goes by its bytes.
FULL_CELL = 512
MOST_SHARES = (1 << 15) - 1
SHARES = "_shares"
# There, inner joins meet the cells of a level by blocks of nearby points if its average cell has more rows than this.
BLOCK_CELL = 32


def share_key(key: str, share: str) -> Column:
    """Key of a share of a cell; share 0 has the key of the cell."""
    return F.expr(f"{key} + shiftleft(CAST({share} AS BIGINT), {2 * _BITS + 4})")


def _full_cells(ranged: DataFrame) -> DataFrame:
    """Cells that the boxes of more than ``FULL_CELL`` regions touch; at most a row per ``FULL_CELL`` rows of the cover."""
    return (
        ranged.select(LEVEL, F.explode(F.sequence("_x0", "_x1")).alias("_cx"), "_y0", "_y1")
        .select(LEVEL, "_cx", F.explode(F.sequence("_y0", "_y1")).alias("_cy"))
        .groupBy(F.expr(_key(LEVEL, "_cx", "_cy")).alias("_full")).agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > FULL_CELL)
        .select("_full", F.expr(f"least(ceil(_rows / {FULL_CELL}D), {MOST_SHARES})").alias(SHARES))
    )


def _with_ranges(df: DataFrame, cells_across: Column) -> DataFrame:
    """Adds the finest level with at most ``cells_across`` cells per side, and cell ranges."""
    extent = "greatest(_max_lat - _min_lat, _max_lon - _min_lon, 1e-12D)"
    level = (f"CAST(greatest(0L, least({FINEST_LEVEL}L, "
             f"floor(log2({COARSEST_DEG}D * _across / {extent}) / 2D))) AS INT)")
    df = df.withColumn("_across", cells_across)
    size = f"({COARSEST_DEG}D / pow(4D, CAST({LEVEL} AS DOUBLE)))"
    return (
        df.withColumn(LEVEL, F.expr(level)).withColumn("_size", F.expr(size))
        .withColumns({name: F.expr(_index(side, "_size")) for name, side in (
            ("_x0", "_min_lon"), ("_x1", "_max_lon"), ("_y0", "_min_lat"), ("_y1", "_max_lat"))})
    )


# Most cells per side of a region: circles, and zones where few or many.
_CIRCLE, _FINE, _COARSE = 4, 32, 8
_CELLS = "((_x1 - _x0 + 1) * (_y1 - _y0 + 1))"


@dataclass(frozen=True)
class _Summary:
    levels: tuple[int, ...] = ()
    bytes_bound: int = 0
    cells: int = 0
    box: tuple[float, float, float, float] | None = None
    edges: int = 0
    level_cells: dict[int, int] = field(default_factory=dict)
    rows_a_cell: dict[int, float] = field(default_factory=dict)  # on average over the box of a level


def _summaries(ranged: DataFrame, row_bytes: str, edges: str = "0") -> dict[int, _Summary]:
    """Per number of cells across: levels in use, bound on the cover's bytes, overall box, and most edges.

    One aggregation over the regions (not the points), at most a row per level and choice.
    """
    rows = ranged.groupBy("_across", LEVEL).agg(
        F.expr(f"sum({_CELLS} * ({row_bytes}))").alias("bytes"),
        F.expr(f"sum({_CELLS})").alias("cells"), F.expr(f"max({edges})").alias("edges"),
        *[F.expr(f"{fn}({c})").alias(c) for fn, c in zip(("min", "min", "max", "max"), BOX)],
    ).collect()
    out = {}
    for across in {r["_across"] for r in rows}:
        mine = [r for r in rows if r["_across"] == across]
        out[across] = _Summary(
            tuple(sorted(r[LEVEL] for r in mine)), int(sum(r["bytes"] for r in mine)),
            int(sum(r["cells"] for r in mine)),
            (min(r[BOX[0]] for r in mine), min(r[BOX[1]] for r in mine),
             max(r[BOX[2]] for r in mine), max(r[BOX[3]] for r in mine)),
            max(int(r["edges"] or 0) for r in mine),
            {r[LEVEL]: int(r["cells"]) for r in mine},
            {r[LEVEL]: r["cells"] / math.prod((min(r[BOX[i + 2]], _LIMIT) - max(r[BOX[i]], -_LIMIT)) / cell_size(r[LEVEL]) + 1.0
                                              for i in (0, 1)) for r in mine})
    return out


# -- circles ---------------------------------------------------------------------------


def circle_cover(df: DataFrame, *, lat: str, lon: str, radius_m: Column, keep: list[str]) -> Cover:
    """Cells touched by each circle, as expressions only.

    A circle across the 180 degree meridian becomes two boxes; boxes of one circle
    never overlap, so a point meets a circle at most once.
    """
    lo, hi, half = circle_span_columns(lat=F.col(lat), radius_m=F.col("_radius_m"))
    spans = F.expr(
        "CASE WHEN _half >= 180 THEN array(struct(-180D AS a, 180D AS b)) "
        "WHEN _lon - _half < -180 THEN array(struct(_lon - _half + 360D AS a, 180D AS b), "
        "struct(-180D AS a, _lon + _half AS b)) "
        "WHEN _lon + _half > 180 THEN array(struct(_lon - _half AS a, 180D AS b), "
        "struct(-180D AS a, _lon + _half - 360D AS b)) "
        "ELSE array(struct(_lon - _half AS a, _lon + _half AS b)) END")
    boxes = (
        df.withColumn("_radius_m", radius_m.cast("double"))
        .filter(F.col(lat).between(-90.0, 90.0) & (F.col("_radius_m") >= 0)
                & F.abs(F.col(lon)).between(0.0, 1.7976931348623157e308))
        .withColumn("_bytes", row_width(df, keep) + 96)
        .withColumn("_lon", fold_longitude(F.col(lon)))
        .withColumn("_half", half)
        .withColumn(BOX[0], lo).withColumn(BOX[2], hi)
        .withColumn("_span", F.explode(spans))
        .withColumn(BOX[1], F.col("_span.a")).withColumn(BOX[3], F.col("_span.b"))
    )
    names = [*keep, "_radius_m"]
    ranged = _with_ranges(boxes, F.lit(_CIRCLE))
    facts = _summaries(ranged, "_bytes").get(_CIRCLE, _Summary())
    cells = (
        ranged.withColumn("_cx", F.explode(F.sequence("_x0", "_x1")))
        .withColumn("_cy", F.explode(F.sequence("_y0", "_y1")))
        .select(*names, *BOX, F.expr(_key(LEVEL, "_cx", "_cy")).alias(CELL))
    )
    return Cover(cells, facts.levels, facts.bytes_bound, facts.box)


# -- polygons --------------------------------------------------------------------------


def polygon_cover(df: DataFrame, *, parts: str, keep: list[str],
                  limit: int = BROADCAST_LIMIT_BYTES) -> Cover:
    """Cells touched by each polygon, each with only the edges that matter there.

    Small tables of zones get fine cells, most of which lie wholly inside a zone and
    need no edge test; large tables get about a sixteenth as many.
    """
    boxed = (
        df.select(*keep, F.col(parts).alias("_parts"), bounds_of(F.col(parts)).alias("_b"),
                  row_width(df, keep).alias("_wide"))
        .filter(F.col("_b.min_lat").isNotNull())
        .select(*keep, "_parts", "_wide", *[F.col(f"_b.{c[1:]}").alias(c) for c in BOX])
    )
    choices = _with_ranges(boxed, F.explode(F.array(F.lit(_FINE), F.lit(_COARSE))))
    facts = _summaries(choices, f"_wide + 448 + {_EDGE_BYTES}", _MOST_EDGES)
    across = _FINE if _FINE in facts and facts[_FINE].bytes_bound <= limit // 4 else _COARSE
    chosen = facts.get(across, _Summary())
    ranged = _with_ranges(boxed, F.lit(across))
    schema = T.StructType([df.schema[c] for c in keep])
    for name in (*BOX, *_FLAT):  # never NULL, so that the test compiles to a method that the JVM still optimises
        schema = schema.add(name, "double", False)
    schema = (schema.add(CELL, "long", False).add("_kind", "integer", False).add("_odd", "boolean", False)
              .add("_pieces", T._parse_datatype_string(_PIECES), False))
    inputs = ranged.select(*keep, *BOX, LEVEL, "_x0", "_x1", "_y0", "_y1", "_parts")

    def cut(rows: DataFrame, count: int) -> DataFrame:
        tasks = math.ceil(count / 2000)
        if tasks > 1:  # a zone file is often one split; cutting polygons is worth spreading
            tasks = min(tasks, 4 * df.sparkSession.sparkContext.defaultParallelism)
            rows = rows.repartition(tasks, *BOX)
        return rows.mapInArrow(_cover_batches(len(keep)), schema)

    shuffled, most = chosen.bytes_bound > limit, max(chosen.rows_a_cell.values(), default=0.0)
    # finding them computes the regions again, so only where the average cell is full
    full = _full_cells(ranged) if shuffled and most > FULL_CELL else None
    cover = Cover(cut(inputs, chosen.cells), chosen.levels, chosen.bytes_bound, chosen.box, full, chosen.edges > FLAT_EDGES, chosen.cells)
    if not shuffled or most <= BLOCK_CELL:
        return cover

    def only(levels: list[int]) -> Cover:
        count = sum(chosen.level_cells[n] for n in levels)
        return replace(cover, df=cut(inputs.where(F.col(LEVEL).isin(levels)), count), levels=tuple(levels), cells=count)

    crowded = [n for n in cover.levels if chosen.rows_a_cell[n] > BLOCK_CELL]
    return replace(cover, crowded=only(crowded), calm=only([n for n in cover.levels if n not in crowded]))


def _edge_bytes() -> str:
    """Bound on edge bytes per cell, averaged over a zone's cells.

    An edge is kept in the cells its own box meets, and brings at most two pieces of
    far-edge parity with it.
    """
    side = "(abs({a} - {b}) + 1)"
    lon, lat = (side.format(a=_index(f"b.{c}", "_size"), b=_index(f"a.{c}", "_size"))
                for c in ("lon", "lat"))
    ring = ("aggregate(zip_with(r, concat(slice(r, 2, greatest(size(r), 1)), slice(r, 1, 1)), "
            f"(a, b) -> {lon} * {lat}), 0L, (n, e) -> n + e)")
    total = f"aggregate(flatten(_parts), 0L, (n, r) -> n + {ring})"
    return f"({total} * 168 / {_CELLS} + 48 * size(flatten(_parts)))"


_EDGE_BYTES = _edge_bytes()
# A cell has at most as many edges of a part as the part, upright ones included; several parts can share a cell.
_CLOSED = "get(r, 0) = get(r, size(r) - 1) AND NOT isnan(get(r, 0).lon + get(r, 0).lat)"
_MOST_EDGES = (f"if(size(_parts) > 1, {FLAT_EDGES + 1}, aggregate(flatten(_parts), 0, "
               f"(n, r) -> n + coalesce(size(r), 0) - if({_CLOSED}, 1, 0)))")
_FLUSH_CELLS = 20_000


def _cover_batches(n_keep: int):
    """Arrow batches of zones in; (zone columns, box, flat edges, cell, test) rows out."""
    edge = pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")])
    pieces_type = pa.list_(pa.struct([("odd", pa.bool_()), ("edges", pa.list_(edge))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            names = [*batch.schema.names[:n_keep + 4], *_FLAT, CELL, "_kind", "_odd", "_pieces"]
            level, *window = (columns[n_keep + 4 + i].to_numpy(zero_copy_only=False)
                              for i in range(5))
            rows, polys, rings, lon, lat = arrow.open_parts(columns[n_keep + 9])

            def flush(source, keys, tests):
                take = pa.array(source, pa.int32())
                kinds = [t[0] for t in tests]
                flat = np.full((len(tests), 4 * FLAT_EDGES), np.nan)
                many = []
                for i, (kind, pieces) in enumerate(tests):
                    if kind == FEW:
                        cut = pieces[0][1].ravel()
                        flat[i, :cut.size] = cut
                    many.append([] if kind != MANY else [
                        {"odd": odd, "edges": [dict(zip(("x1", "y1", "x2", "y2"), e))
                                               for e in edges.tolist()]} for odd, edges in pieces])
                return pa.RecordBatch.from_arrays(
                    [*(c.take(take) for c in columns[:n_keep + 4]),
                     *(pa.array(flat[:, j]) for j in range(flat.shape[1])),
                     pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()),
                     pa.array([t[0] == FEW and t[1][0][0] for t in tests], pa.bool_()),
                     pa.array(many, pieces_type)], names)

            source, keys, tests = [], [], []
            for r in range(batch.num_rows):
                size, span = cell_size(int(level[r])), tuple(int(w[r]) for w in window)
                cells: dict[tuple[int, int], list] = {}
                for p in range(rows[r], rows[r + 1]):
                    edges = _edges(lon, lat, rings[polys[p]:polys[p + 1] + 1])
                    for cell, piece in _clip(edges, size, span):
                        cells.setdefault(cell, []).append(piece)
                for (cx, cy), pieces in cells.items():
                    source.append(r)
                    keys.append((int(level[r]) << 2 * _BITS) + ((cy + _HALF) << _BITS) + cx + _HALF)
                    if any(len(edges) == 0 for _, edges in pieces):
                        tests.append((INSIDE, pieces))
                    elif len(pieces) == 1 and len(pieces[0][1]) <= FLAT_EDGES:
                        tests.append((FEW, pieces))
                    else:
                        tests.append((MANY, pieces))
                if len(keys) >= _FLUSH_CELLS:
                    yield flush(source, keys, tests)
                    source, keys, tests = [], [], []
            yield flush(source, keys, tests)

    return run


def _edges(lon, lat, bounds):
    """Edge end points of all rings of one polygon, closing open rings."""
    start = np.concatenate([np.arange(a, b) for a, b in zip(bounds[:-1], bounds[1:])] or [[]])
    stop = np.concatenate([np.append(np.arange(a + 1, b), a)[:b - a]
                           for a, b in zip(bounds[:-1], bounds[1:])] or [[]])
    start, stop = start.astype(np.int64), stop.astype(np.int64)
    edges = np.column_stack([lon[start], lat[start], lon[stop], lat[stop]])
    # a repeated vertex can still be hit, but only together with its neighbours
    return edges[(edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])]


def _clip(edges, size, window):
    """Yield ``((cx, cy), (odd, edges))`` for each cell a polygon touches.

    Points of a cell are tested by counting the edges that a ray towards greater
    longitude crosses. Edges passing left of the whole cell never count. Edges passing
    right of it count by latitude only, so together they reduce to a starting parity
    and the latitudes where it flips, kept as upright segments on the cell's right side.
    """
    if len(edges) == 0:
        return
    west, east = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    south, north = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    x0, x1, y0, y1 = window
    cols = range(max(x0, math.floor(west.min() / size)),
                 min(x1, math.floor(east.max() / size)) + 1)
    for cy in range(max(y0, math.floor(south.min() / size)),
                    min(y1, math.floor(north.max() / size)) + 1):
        low, high = cy * size, (cy + 1) * size
        band = edges[(north >= low) & (south < high)]
        bw, be = np.minimum(band[:, 0], band[:, 2]), np.maximum(band[:, 0], band[:, 2])
        for cx in cols:
            left, right = cx * size, (cx + 1) * size
            far = bw >= right
            near = np.flatnonzero(~far & (be >= left))
            if near.size:
                passes = _side_of_cell(band[near], left, low, right, high)
                far[near[passes > 0]] = True
                near = near[passes == 0]
            near, away = band[near], band[far]
            odd = bool(np.count_nonzero((away[:, 1] > low) != (away[:, 3] > low)) & 1)
            ends = away[:, [1, 3]].ravel()
            ends, times = np.unique(ends[(ends > low) & (ends < high)], return_counts=True)
            flips = ends[times % 2 == 1].tolist()
            if len(flips) % 2:
                flips.append(high)
            if flips:
                upright = [(right, a, right, b) for a, b in zip(flips[::2], flips[1::2])]
                near = np.vstack([near, np.array(upright)])
            if len(near) or odd:
                yield (cx, cy), (odd, near)


def _side_of_cell(edges, left, low, right, high):
    """1 for edges whose line passes right of the whole cell, -1 left of it, else 0.

    The margin leaves edges that come within rounding of the cell as touching it.
    """
    x, y = np.array([left, right, left, right]), np.array([low, low, high, high])
    dx, dy = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    a, b = dx[:, None] * (y - edges[:, 1:2]), dy[:, None] * (x - edges[:, 0:1])
    side, margin = a - b, 1e-12 * (np.abs(a) + np.abs(b)).max(axis=1)
    one_way = np.where(side.min(axis=1) > margin, 1, np.where(side.max(axis=1) < -margin, -1, 0))
    # an edge along a latitude is never crossed, whichever side it passes
    return np.where(dy == 0, np.where(one_way != 0, -1, 0), one_way * np.sign(dy)).astype(int)


def _edge_tests(lat: str, lon: str, x1: str, y1: str, x2: str, y2: str) -> tuple[str, str]:
    """Whether a point lies on an edge, and whether its ray crosses it."""
    side = f"(({x2} - {x1}) * ({lat} - {y1}) - ({lon} - {x1}) * ({y2} - {y1}))"
    hit = (f"({side} = 0D AND {lon} BETWEEN least({x1}, {x2}) AND greatest({x1}, {x2}) "
           f"AND {lat} BETWEEN least({y1}, {y2}) AND greatest({y1}, {y2}))")
    crossed = f"((({y1} > {lat}) != ({y2} > {lat})) AND (({side} > 0D) = ({y2} > {y1})))"
    return hit, crossed


def _many_test(lat: str, lon: str) -> str:
    hit, crossed = _edge_tests(lat, lon, "e.x1", "e.y1", "e.x2", "e.y2")
    code = (f"aggregate(p.edges, CAST(p.odd AS BIGINT), (n, e) -> n + CASE WHEN {hit} THEN "
            f"{_ON_EDGE}L WHEN {crossed} THEN 1L ELSE 0L END)")
    # the running count is odd inside, and no hit has been added
    return f"exists(transform(_pieces, p -> {code}), n -> n < {_ON_EDGE}L AND n % 2 = 1)"


def inside_test(*, lat: str, lon: str) -> Column:
    """True when the point is strictly inside, from a polygon cover's columns.

    ``lat`` and ``lon`` are SQL expressions. An edge is hit when the point lies on it;
    unused flat edges are NaN and neither hit nor crossed.
    """
    flat = [_edge_tests(lat, lon, *_FLAT[4 * i:4 * i + 4]) for i in range(FLAT_EDGES)]
    few = (f"NOT ({' OR '.join(h for h, _ in flat)}) AND "
           f"({' != '.join(['_odd', *(c for _, c in flat)])})")
    return F.expr(f"CASE WHEN _kind = {INSIDE} THEN true WHEN _kind = {FEW} THEN {few} "
                  f"ELSE {_many_test(lat, lon)} END")


def keep_inside(pairs: DataFrame, *, lat: str, lon: str, many: bool) -> DataFrame:
    """The joined rows that :func:`inside_test` is true for, tested after the join.

    Tests over arrays are not compiled, and a join with one in its condition is not either. Here the flat edges are
    a column, each edge used twice so that it is compiled to a method of its own (the JVM does not optimise methods over 8,000
    bytes); arrays are tested last and only if there are any. The task's number keeps Spark from moving the tests into the join.
    """
    codes = []
    for i in range(FLAT_EDGES):
        hit, crossed = _edge_tests(lat, lon, *_FLAT[4 * i:4 * i + 4])
        codes.append(f"CASE WHEN {hit} THEN 2 WHEN {crossed} THEN 1 ELSE 0 END")
    few = f"greatest({', '.join(codes)}) < 2 AND ({' + '.join([*codes, 'CAST(_odd AS INT)'])}) % 2 = 1"
    flat = pairs.withColumn("_in", F.expr(f"(_kind != {FEW} OR ({few})) AND spark_partition_id() >= 0")).where("_in")
    return flat.where(f"_kind != {MANY} OR {_many_test(lat, lon)}") if many else flat


def block_tests() -> tuple[Column, Column]:
    """For a block of points and a cell: whether all its points match without a test, and whether each needs the test.

    Taken from the cover's columns and the block's box. Where no edge comes near the box, all its points lie on the side of its
    corner; the margin is far above the rounding of the edge tests.
    """
    low_lat, low_lon, high_lat, high_lon = BLOCK_BOX
    edges = [_FLAT[4 * i:4 * i + 4] for i in range(FLAT_EDGES)]
    near = " OR ".join(  # unused edges are NaN, which is greater than any number
        f"(({x1} <= {high_lon} + 1e-9D OR {x2} <= {high_lon} + 1e-9D) AND ({x1} >= {low_lon} - 1e-9D OR {x2} >= {low_lon} - 1e-9D) AND "
        f"({y1} <= {high_lat} + 1e-9D OR {y2} <= {high_lat} + 1e-9D) AND ({y1} >= {low_lat} - 1e-9D OR {y2} >= {low_lat} - 1e-9D))"
        for x1, y1, x2, y2 in edges)
    odd = " != ".join(["_odd", *(_edge_tests(low_lat, low_lon, *edge)[1] for edge in edges)])
    return (F.expr(f"CASE WHEN _kind = {FEW} THEN NOT ({near}) AND ({odd}) ELSE _kind = {INSIDE} END"),
            F.expr(f"CASE WHEN _kind = {FEW} THEN {near} ELSE _kind = {MANY} END"))
