"""Replacing a published dataset without ever exposing a bad one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import PointDataset
from ..functions.checks import check_identifier
from ..sources.layout import write_layout
from ..sources.readers import load_points
from . import versions

# Key of the column metadata that says which axis a column holds.
AXIS = "geocairn.axis"


class RefreshFailed(RuntimeError):
    """The candidate was rejected; the published dataset is unchanged."""


def refresh(
    spark: SparkSession, view: str, path: str, *, versions_dir: str, layout: bool = False, keep: int = 3,
    **load_options,
) -> PointDataset:
    """Load and check a candidate, then point ``view`` at it, for this session and all that share ``versions_dir``.

    The candidate is written to a folder of its own under ``versions_dir``, which all executors
    share, before the swap, so the view never depends on files that may
    still change, and a candidate that cannot be read, has no coordinate columns or no
    located rows leaves the old view in place. The copy has all rows, and its coordinate columns are
    marked as such. ``layout`` clusters the copy spatially. Other sessions read the new version with
    ``published(..., versions_dir=...)``; the ``keep`` newest versions stay on disk, so that readers of the last ones
    are not disturbed.
    """
    root = versions.root_of(versions_dir, view)
    try:
        candidate = load_points(spark, path, **load_options)
        data = uuid.uuid4().hex
        target = f"{root}-{data}"
        if layout:
            write_layout(candidate.raw, target, lat=candidate.lat_col, lon=candidate.lon_col)
        else:
            candidate.raw.write.parquet(target)
        fresh = _marked(spark.read.parquet(target), candidate.lat_col, candidate.lon_col, path)
        located = fresh.df.select(F.lit(1)).limit(1).count()
    except Exception as error:
        raise RefreshFailed(f"{path}: {error}") from error
    if not located:
        raise RefreshFailed(f"{path}: no rows with coordinates")
    versions.swap(spark, root, {"data": data, "lat": fresh.lat_col, "lon": fresh.lon_col, "path": path}, keep)
    fresh.raw.createOrReplaceTempView(view)
    return fresh


def _marked(raw: DataFrame, lat: str, lon: str, path: str) -> PointDataset:
    for axis, name in (("lat", lat), ("lon", lon)):
        raw = raw.withMetadata(name, {**raw.schema[name].metadata, AXIS: axis})
    return PointDataset(raw, lat, lon, path)


def published(spark: SparkSession, view: str, *, versions_dir: str | None = None) -> PointDataset:
    """The dataset that is published as ``view``, with the coordinate columns it was given.

    With ``versions_dir`` it is the newest version that any session has published there; the result stays
    with that version. Without it, it is the view of this session.
    """
    if versions_dir is not None:
        root = versions.root_of(versions_dir, view)
        pointer = versions.current(spark, root)
        if pointer is None:
            raise LookupError(f"nothing is published as {view} in {versions_dir}")
        return _marked(versions.rows_of(spark, root, pointer), pointer["lat"], pointer["lon"], pointer["path"])
    raw = spark.table(check_identifier(view))
    marked = {f.metadata[AXIS]: f.name for f in raw.schema.fields if AXIS in f.metadata}
    return load_points(spark, table=view, lat=marked.get("lat"), lon=marked.get("lon"))
