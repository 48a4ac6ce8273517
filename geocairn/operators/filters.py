"""Row filters: boxes, circles, polygons and attribute equality."""

from __future__ import annotations

import datetime as dt
import decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import check_bbox, check_columns, check_distance, check_point
from ..functions.geometry import parts_literal
from ..functions.sphere import circle_span, haversine_m
from ..plans.cells import quoted
from .joins import point_in_parts, within_join

# Literal polygons up to this many edges become one compiled expression.
UNROLL_EDGES = 40


def bbox_condition(min_lat, min_lon, max_lat, max_lon, *, lat: Column, lon: Column,
                   wrap: bool = False) -> Column:
    """Closed box; plain comparisons that reach the file scan."""
    a, b, c, d = check_bbox(min_lat, min_lon, max_lat, max_lon, wrap=wrap)
    lon_test = lon.between(b, d) if b <= d else (lon >= b) | (lon <= d)
    return lat.between(a, c) & lon_test


def radius_condition(*, lat: Column, lon: Column, centre_lat: float, centre_lon: float,
                     radius_m: float) -> tuple[Column, Column]:
    """``(condition, distance in metres)``; inclusive.

    The exact distance test is preceded by the circle's own box, split at 180 degrees
    where needed. Longitudes outside [-180, 180] pass the box and meet the exact test.
    """
    y, x = check_point(lat=centre_lat, lon=centre_lon)
    r = check_distance(radius_m)
    low, high, half = circle_span(lat=y, radius_m=r)
    box = lat.between(low, high)
    if half < 180.0:
        west, east = x - half, x + half
        if west < -180.0:
            lon_box = (lon >= west + 360.0) | (lon <= east)
        elif east > 180.0:
            lon_box = (lon >= west) | (lon <= east - 360.0)
        else:
            lon_box = lon.between(west, east) | (lon < -180.0) | (lon > 180.0)
        box = box & lon_box
    distance = haversine_m(lat1=lat, lon1=lon, lat2=y, lon2=x)
    return box & (distance <= r), distance


def within_filter(df: DataFrame, polygons, *, lat: str, lon: str) -> DataFrame:
    """Rows strictly inside any of the literal polygons (lists of rings of (lon, lat))."""
    polygons = [[[(float(x), float(y)) for x, y in ring] for ring in rings] for rings in polygons]
    if not polygons or any(not rings or any(len(r) < 3 for r in rings) for rings in polygons):
        raise ValueError("expected polygons whose rings have at least three positions")
    xs, ys = zip(*[p for rings in polygons for ring in rings for p in ring])
    inside_box = F.col(lat).between(min(ys), max(ys)) & F.col(lon).between(min(xs), max(xs))
    df = df.filter(inside_box)
    if len(xs) <= UNROLL_EDGES:
        return df.filter(point_in_parts(polygons, lat=quoted(lat), lon=quoted(lon)))
    zone = df.sparkSession.range(1).select(parts_literal(polygons).alias("polygons"))
    return within_join(df, zone, lat=lat, lon=lon, how="left_semi")


def _typed(kind: T.DataType, value):
    """``value`` in the column's type, or None when it cannot equal any value of it."""
    text = str(value).strip() if not isinstance(value, str) else value
    try:
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}[text.lower()]
        if isinstance(kind, T.IntegralType):
            number = decimal.Decimal(text)
            return int(number) if number == number.to_integral_value() else None
        if isinstance(kind, T.FractionalType):
            number = decimal.Decimal(text) if isinstance(kind, T.DecimalType) else float(text)
            return None if isinstance(kind, T.DecimalType) and not number.is_finite() else number
        if isinstance(kind, T.DateType):
            return value if type(value) is dt.date else dt.date.fromisoformat(text)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            moment = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(text)
            return moment.isoformat(" ")
    except (ValueError, KeyError, ArithmeticError):
        return None
    return text


_INT_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def equality_condition(df: DataFrame, where) -> Column:
    """All of ``{column: value}`` (or pairs) hold, compared in each column's own type.

    Text that does not parse as the column's type matches nothing. Comparing typed
    literals, not text, lets the condition reach the file scan.
    """
    pairs = list(where.items()) if isinstance(where, dict) else list(where)
    tests = []
    for name, value in pairs:
        if value is None:
            raise ValueError(f"no value given for {name!r}")
        (name,) = check_columns(df, [name])
        kind = df.schema[name].dataType
        typed = _typed(kind, value)
        bits = _INT_BITS.get(type(kind))
        if typed is None or (bits and not -(1 << bits) <= typed < (1 << bits)):
            tests.append(F.lit(False))
        elif isinstance(kind, (T.IntegralType, T.FloatType, T.DateType, T.TimestampType,
                               T.TimestampNTZType)):
            # a moment goes as text, so that the session's zone applies and not the process's
            tests.append(F.col(name) == F.lit(typed).cast(kind))
        else:
            tests.append(F.col(name) == F.lit(typed))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
