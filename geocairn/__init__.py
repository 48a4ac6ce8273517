"""Spatial analytics for tables of latitude/longitude points on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Arrow functions travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .dataset import PointDataset
from .functions.checks import ColumnNotFound
from .operators.joins import buffer_join, radius_join, within_join, zonal_stats
from .operators.knn import knn_join
from .operators.shapes import (
    bounds, buffer_points, centroids, convex_hull, dissolve, geodesic_distance, polygon_metrics,
    simplify, total_bounds, track_lengths, track_steps,
)
from .plans.request import run_query
from .plans.session import drop_scratch, scratch_mark
from .sources.geojson import (
    geometries_from_geojson, points_from_geojson, polygons_from_geojson, read_features,
)
from .sources.layout import write_layout
from .sources.readers import load_csv, load_geojson, load_parquet, load_points
from .sources.sinks import feature_lines, write_csv, write_geojson, write_json, write_rows
from .streaming.refresh import RefreshFailed, published, refresh
from .streaming.stream import publish_stream, stream_points, zone_counts

__all__ = [
    "ColumnNotFound", "PointDataset", "RefreshFailed", "bounds", "buffer_join", "buffer_points",
    "centroids", "convex_hull", "dissolve", "drop_scratch", "feature_lines", "geodesic_distance",
    "geometries_from_geojson", "knn_join", "load_csv", "load_geojson", "load_parquet",
    "load_points", "points_from_geojson", "polygon_metrics", "polygons_from_geojson",
    "publish_stream", "published", "radius_join", "read_features", "refresh", "run_query", "scratch_mark",
    "simplify",
    "stream_points", "total_bounds", "track_lengths", "track_steps", "within_join",
    "write_csv", "write_geojson", "write_json", "write_layout", "write_rows", "zonal_stats",
    "zone_counts",
]
