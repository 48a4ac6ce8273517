"""Geometry columns: encoding, GeoJSON parsing and planar expressions.

A geometry is ``STRUCT<geom_type, parts, members>`` where ``parts`` nests part > path >
vertex for every type, so one expression serves them all:

* Point: one part, one path, one vertex; MultiPoint: one path of vertices
* LineString: one part, one path; MultiLineString: one part per line
* Polygon: one part, shell first then holes; MultiPolygon: one part per polygon

* GeometryCollection: the parts of all members in their order; ``members`` says for each its type, how
  many of the parts are its own, and how deep it lies. A collection inside has no parts of its own and the
  members that follow it one level deeper. ``members`` is NULL for all other types

Zones carry only the ``parts`` array of their polygons.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX_TYPE = "STRUCT<lon: DOUBLE, lat: DOUBLE>"
RING_TYPE = f"ARRAY<{VERTEX_TYPE}>"
PARTS_TYPE = f"ARRAY<ARRAY<{RING_TYPE}>>"
MEMBERS_TYPE = "ARRAY<STRUCT<geom_type: STRING, parts: INT, depth: INT>>"
GEOMETRY_TYPE = f"STRUCT<geom_type: STRING, parts: {PARTS_TYPE}, members: {MEMBERS_TYPE}>"

COLLECTION = "GeometryCollection"
# Levels of collections inside collections that are read; what lies deeper is not understood.
NESTING = 6

_DEPTH = {  # nesting of a GeoJSON coordinates array above one position
    "Point": 0, "MultiPoint": 1, "LineString": 1,
    "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3,
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vertex(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def geometry(geom_type: str | Column, parts: Column, members: Column | None = None) -> Column:
    kind = geom_type if isinstance(geom_type, Column) else F.lit(geom_type)
    members = F.lit(None) if members is None else members
    return F.struct(kind.alias("geom_type"), parts.alias("parts"), members.cast(MEMBERS_TYPE).alias("members"))


def part_kinds(geom: Column) -> Column:
    """The type that each part of a geometry belongs to, one text a part."""
    return F.when(geom["members"].isNull(), F.array_repeat(geom["geom_type"], F.size(geom["parts"]))).otherwise(
        F.flatten(F.transform(geom["members"], lambda m: F.array_repeat(m["geom_type"], m["parts"]))))


def point_geometry(*, lon: Column, lat: Column) -> Column:
    return geometry("Point", F.array(F.array(F.array(vertex(lon, lat)))))


def box_parts(*, min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """Counter-clockwise closed rectangle as polygon parts."""
    ring = F.array(
        vertex(min_lon, min_lat), vertex(max_lon, min_lat), vertex(max_lon, max_lat),
        vertex(min_lon, max_lat), vertex(min_lon, min_lat),
    )
    return F.array(F.array(ring))


def parts_literal(polygons) -> Column:
    """Polygon parts from nested Python lists of ``(lon, lat)`` pairs."""
    text = [[[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in poly]
            for poly in polygons]
    return F.from_json(F.lit(json.dumps(text)), PARTS_TYPE)


# -- GeoJSON ---------------------------------------------------------------------------


def _positions(coords: Column, depth: int) -> Column:
    """Nested vertex array of the given depth from a coordinates JSON text."""
    kind = "array<double>"
    for _ in range(depth):
        kind = f"array<{kind}>"

    def to_vertex(p):
        return vertex(F.get(p, F.lit(0)), F.get(p, F.lit(1)))

    def walk(value, level):
        return to_vertex(value) if level == 0 else F.transform(value, lambda v: walk(v, level - 1))

    return walk(F.from_json(coords, kind), depth)


def geometry_from_geojson(text: Column) -> Column:
    """Geometry struct from the JSON text of a GeoJSON *geometry* object.

    NULL for anything else, including positions that are not two or more numbers and collections with a
    member that is not understood.
    """
    wrap = {
        "Point": lambda v: F.array(F.array(F.array(v))),
        "MultiPoint": lambda v: F.array(F.array(v)),
        "LineString": lambda v: F.array(F.array(v)),
        "MultiLineString": lambda v: F.transform(v, lambda line: F.array(line)),
        "Polygon": lambda v: F.array(v),
        "MultiPolygon": lambda v: v,
    }

    def by_type(head):
        kind, coords = head["type"], head["coordinates"]
        parts = F.lit(None).cast(PARTS_TYPE)
        for name, depth in _DEPTH.items():
            parts = F.when(kind == name, wrap[name](_positions(coords, depth))).otherwise(parts)
        return let(parts, lambda p: F.when(p.isNotNull() & F.forall(
            flat_vertices(p), lambda v: v["lon"].isNotNull() & v["lat"].isNotNull()),
            geometry(kind, p)))

    head = "type STRING, coordinates STRING, geometries ARRAY<STRING>"
    return let(F.from_json(text, head), lambda h: F.when(h["type"] == COLLECTION, _collection(
        h["geometries"], lambda t: let(F.from_json(t, head), by_type))).otherwise(by_type(h)))


def _collection(texts: Column, parse) -> Column:
    """A collection of the geometries in an array of JSON texts; NULL if ``parse`` gives NULL for any."""

    def item(text, depth):
        return F.struct(text.alias("text"), F.lit(depth).alias("depth"))

    items = F.transform(texts, lambda t: item(t, 1))

    def opened(level):
        marker = F.struct(F.lit(None).cast("string").alias("text"), F.lit(level).alias("depth"))

        def widen(i):
            inner = F.from_json(i["text"], "type STRING, geometries ARRAY<STRING>")
            return let(inner, lambda h: F.when(
                (i["depth"] == level) & (h["type"] == COLLECTION) & h["geometries"].isNotNull(), F.concat(
                    F.array(marker), F.transform(h["geometries"], lambda t: item(F.coalesce(t, F.lit("null")), level + 1))))
                .otherwise(F.array(i)))

        return widen

    for level in range(1, NESTING):
        items = F.flatten(F.transform(items, opened(level)))
    parsed = F.transform(items, lambda i: F.struct(
        i["depth"].alias("depth"), i["text"].isNull().alias("open"), parse(i["text"]).alias("g")))

    def joined(found):
        parts = F.flatten(F.transform(F.filter(found, lambda i: ~i["open"]), lambda i: i["g"]["parts"]))
        members = F.transform(found, lambda i: F.struct(
            F.when(i["open"], COLLECTION).otherwise(i["g"]["geom_type"]).alias("geom_type"),
            F.when(i["open"], 0).otherwise(F.size(i["g"]["parts"])).alias("parts"), i["depth"].alias("depth")))
        sound = F.forall(found, lambda i: i["open"] | i["g"].isNotNull())
        return F.when(sound, geometry(COLLECTION, parts, members))

    return F.when(texts.isNotNull() & F.forall(texts, lambda t: t.isNotNull()), let(parsed, joined))


def geometry_to_geojson(geom: Column) -> Column:
    """JSON text of a GeoJSON geometry object."""
    return F.when(geom["members"].isNull(), _text_of(geom["geom_type"], geom["parts"])).otherwise(_collection_text(geom))


def _collection_text(geom: Column) -> Column:
    """Members as texts between the brackets of the collections that hold them."""
    members, last = geom["members"], F.size(geom["members"]) - 1

    def inside(m):  # the depth that what follows has if it belongs to this member
        return m["depth"] + F.when(m["geom_type"] == COLLECTION, 1).otherwise(0)

    def piece(m, i):
        ahead = F.get(members, i - 1)
        first = F.aggregate(F.slice(members, 1, i), F.lit(0), lambda n, x: n + x["parts"]) + 1
        text = F.when(m["geom_type"] == COLLECTION, '{"type":"GeometryCollection","geometries":[').otherwise(
            _text_of(m["geom_type"], F.slice(geom["parts"], first, m["parts"])))
        comma = F.when((i == 0) | (inside(ahead) > ahead["depth"]) & (m["depth"] > ahead["depth"]), "").otherwise(",")
        follows = F.when(i < last, F.get(members, i + 1)["depth"]).otherwise(1)
        return F.concat(comma, text, F.repeat(F.lit("]}"), inside(m) - follows))

    return F.concat(F.lit('{"type":"GeometryCollection","geometries":['),
                    F.array_join(F.transform(members, piece), ""), F.lit("]}"))


def _text_of(kind: Column, parts: Column) -> Column:
    def position(v):
        return F.array(v["lon"], v["lat"])

    def path(p):
        return F.transform(p, position)

    def encode(coords):
        return F.to_json(F.struct(kind.alias("type"), coords.alias("coordinates")))

    first = F.get(parts, F.lit(0))
    line = F.get(first, F.lit(0))
    return (
        F.when(kind == "Point", encode(position(F.get(line, F.lit(0)))))
        .when(kind.isin("MultiPoint", "LineString"), encode(path(line)))
        .when(kind == "MultiLineString",
              encode(F.transform(parts, lambda p: path(F.get(p, F.lit(0))))))
        .when(kind == "Polygon", encode(F.transform(first, path)))
        .when(kind == "MultiPolygon",
              encode(F.transform(parts, lambda p: F.transform(p, path))))
    )


# -- planar expressions ----------------------------------------------------------------


def flat_vertices(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def bounds_of(parts: Column) -> Column:
    """``STRUCT<min_lat, min_lon, max_lat, max_lon>``; NULL fields for an empty geometry."""
    vertices = flat_vertices(parts)
    lats, lons = vertices["lat"], vertices["lon"]
    return F.struct(
        F.array_min(lats).alias("min_lat"), F.array_min(lons).alias("min_lon"),
        F.array_max(lats).alias("max_lat"), F.array_max(lons).alias("max_lon"),
    )
