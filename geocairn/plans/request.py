"""One call for a whole query given as named parameters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..dataset import PointDataset
from ..functions.checks import check_bbox, parse_bbox, parse_where
from ..operators.joins import DISTANCE_KM


def run_query(
    data: PointDataset, *, bbox=None, lat: float | None = None, lon: float | None = None,
    nearest: int | None = None, radius: float | str | None = None, within=None, where=None,
    select: list[str] | str | None = None, group_by: str | list[str] | None = None,
    agg: str | list[str] | None = None, limit: int | None = None,
    tie: str | list[str] | None = None,
) -> DataFrame:
    """Filter, then aggregate or project, then limit.

    One spatial mode applies: box, else nearest, else radius, else polygon. ``tie``
    orders rows of equal distance and is needed with ``nearest``, and with ``limit`` unless rows
    are grouped. ``group_by`` with ``nearest`` groups the nearest rows. A radius comes nearest first.
    Parameters that need each other raise when one is missing.
    """
    if (lat is None) != (lon is None):
        raise ValueError("lat and lon go together")
    if (nearest is not None or radius is not None) and lat is None:
        raise ValueError("nearest and radius need lat and lon")
    if (group_by is None) != (agg is None):
        raise ValueError("group_by and agg go together")
    if tie is None and (nearest is not None or limit is not None and group_by is None):
        raise ValueError("nearest and limit need tie= for a repeatable result")
    if where:
        data = data.where(parse_where(where) if isinstance(where, str) else where)
    ordered = False
    if bbox is not None:
        data = data.bbox(*(parse_bbox(bbox) if isinstance(bbox, str) else check_bbox(*bbox)))
    elif nearest is not None:
        top = data.nearest(lat=lat, lon=lon, k=nearest, tie=tie)
        if group_by is None:
            return _project(top if limit is None else top.limit(limit), select)
        data = replace(data, raw=top)
    elif radius is not None:
        data = data.radius(lat=lat, lon=lon, radius=radius)
        ordered = True
    elif within is not None:
        data = data.within(within)
    if group_by is not None:
        out = data.aggregate(by=group_by, aggs=agg)
        return out if limit is None else out.orderBy(*out.columns).limit(limit)
    if ordered:
        rows = data.by_distance(tie or ())
        return _project(rows if limit is None else rows.limit(limit), select)
    return _project(data.df if limit is None else data.limit(limit, tie), select)


def _project(df: DataFrame, select) -> DataFrame:
    if not select:
        return df
    names = [n.strip() for n in select.split(",")] if isinstance(select, str) else list(select)
    from ..functions.checks import check_columns

    names = check_columns(df, names)
    if DISTANCE_KM in df.columns and DISTANCE_KM not in names:
        names.append(DISTANCE_KM)
    return df.select(*names)
