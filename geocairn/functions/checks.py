"""Parameter checks shared by every entry point."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted coordinate column names, most preferred first.
LAT_NAMES = ("latitude", "lat", "y", "ylat", "geo_lat")
LON_NAMES = ("longitude", "lon", "lng", "x", "xlon", "xlong", "geo_lon", "geo_lng")

# Metres per distance unit.
METRES_PER_UNIT = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "ft": 0.3048}

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_RADIUS = re.compile(rf"^\s*({_NUMBER})\s*(km|mi|ft|m)?\s*$")


class ColumnNotFound(ValueError):
    """A named column is missing."""


def check_identifier(name: str) -> str:
    """Table or column name: dot-separated parts of letters, digits and underscores."""
    parts = name.split(".") if name else [""]
    if not all(p and all(c.isalnum() or c == "_" for c in p) for p in parts):
        raise ValueError(f"invalid name: {name!r}")
    return name


def check_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Resolve names case-insensitively against ``df``; unknown names raise."""
    known = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name in names:
        name = name.strip()
        hit = name if name in df.columns else known.get(name.lower())
        if hit is None:
            raise ColumnNotFound(f"column {name!r} not found; available: {', '.join(df.columns)}")
        out.append(hit)
    return out


def detect_coordinates(
    columns: Sequence[str], lat: str | None = None, lon: str | None = None
) -> tuple[str, str]:
    """Pick the latitude and longitude columns by name, or check the given ones."""
    by_lower: dict[str, str] = {}
    for c in columns:
        by_lower.setdefault(c.lower(), c)

    def pick(given, names, label):
        for name in [given] if given else names:
            if name in columns:
                return name
            if name.lower() in by_lower:
                return by_lower[name.lower()]
        what = repr(given) if given else f"a {label} column"
        raise ColumnNotFound(f"{what} not found; available: {', '.join(columns)}")

    return pick(lat, LAT_NAMES, "latitude"), pick(lon, LON_NAMES, "longitude")


def check_point(*, lat: float, lon: float) -> tuple[float, float]:
    lat, lon = float(lat), float(lon)
    if not -90.0 <= lat <= 90.0:
        raise ValueError(f"latitude {lat} is outside [-90, 90]")
    if not -180.0 <= lon <= 180.0:
        raise ValueError(f"longitude {lon} is outside [-180, 180]")
    return lat, lon


def check_bbox(
    min_lat: float, min_lon: float, max_lat: float, max_lon: float, *, wrap: bool = False
) -> tuple[float, float, float, float]:
    """Validate a box; ``wrap=True`` allows ``min_lon > max_lon`` (across 180 degrees)."""
    min_lat, min_lon = check_point(lat=min_lat, lon=min_lon)
    max_lat, max_lon = check_point(lat=max_lat, lon=max_lon)
    if min_lat > max_lat:
        raise ValueError(f"min_lat {min_lat} exceeds max_lat {max_lat}")
    if min_lon > max_lon and not wrap:
        raise ValueError(f"min_lon {min_lon} exceeds max_lon {max_lon}")
    return min_lat, min_lon, max_lat, max_lon


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """``"min_lat,min_lon,max_lat,max_lon"``."""
    try:
        values = [float(v) for v in text.split(",")]
    except ValueError:
        raise ValueError(f"bbox must be four numbers, got {text!r}") from None
    if len(values) != 4:
        raise ValueError(f"bbox must be four numbers, got {text!r}")
    return check_bbox(*values)


def parse_radius(text: str | float) -> float:
    """Metres from ``"10km"``, ``"1 mi"``, ``"300ft"``, ``"5000m"`` or a bare number."""
    m = _RADIUS.match(str(text))
    if not m:
        raise ValueError(f"invalid radius: {text!r}")
    return check_distance(float(m.group(1)) * METRES_PER_UNIT[m.group(2) or "m"])


def check_distance(metres: float) -> float:
    metres = float(metres)
    if not 0.0 <= metres < float("inf"):
        raise ValueError(f"distance must be a non-negative number, got {metres}")
    return metres


def radius_metres(text: Column) -> Column:
    """Column form of :func:`parse_radius`; unparsable text gives NULL."""
    text = text.cast("string")
    pattern = rf"^\s*({_NUMBER})\s*(km|mi|ft|m)?\s*$"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.lit(1.0)
    for name, metres in METRES_PER_UNIT.items():
        factor = F.when(unit == name, metres).otherwise(factor)
    return F.when(number >= 0, number * factor)


def parse_where(text: str) -> list[tuple[str, str]]:
    """``"col:value,col2:value2"``; the first colon of a clause separates the parts."""
    clauses = []
    for clause in text.split(","):
        name, colon, value = clause.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"malformed condition: {clause!r}")
        clauses.append((name.strip(), value.strip()))
    return clauses
