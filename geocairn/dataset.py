"""A table of points and the queries on it."""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.checks import check_columns, check_point, parse_radius
from .functions.sphere import haversine_m
from .operators import aggregates, filters, shapes
from .operators.joins import DISTANCE_KM


@dataclass(frozen=True)
class PointDataset:
    """Lazy table with known coordinate columns; every method returns a new lazy result."""

    raw: DataFrame
    lat_col: str
    lon_col: str
    source: str = "dataframe"

    @property
    def df(self) -> DataFrame:
        """Rows that have both coordinates."""
        return self.raw.filter(self._lat.isNotNull() & self._lon.isNotNull())

    @property
    def _lat(self) -> Column:
        return F.col(self.lat_col)

    @property
    def _lon(self) -> Column:
        return F.col(self.lon_col)

    def _with(self, df: DataFrame) -> PointDataset:
        return replace(self, raw=df)

    # -- filters, which compose ---------------------------------------------------------

    def bbox(self, min_lat, min_lon, max_lat, max_lon, *, wrap: bool = False) -> PointDataset:
        """Points in a closed box; ``wrap`` allows a box across 180 degrees."""
        return self._with(self.df.filter(filters.bbox_condition(
            min_lat, min_lon, max_lat, max_lon, lat=self._lat, lon=self._lon, wrap=wrap)))

    def radius(self, *, lat: float, lon: float, radius: float | str) -> PointDataset:
        """Points within ``radius`` (metres, or text like ``"10km"``), with ``_distance_km``.

        Rows come in no order; add :meth:`by_distance` for a sorted result.
        """
        condition, distance = filters.radius_condition(
            lat=self._lat, lon=self._lon, centre_lat=lat, centre_lon=lon,
            radius_m=parse_radius(radius))
        return self._with(self.df.filter(condition).withColumn(DISTANCE_KM, distance / 1000.0))

    def within(self, polygons) -> PointDataset:
        """Points strictly inside any polygon, given as lists of rings of (lon, lat)."""
        return self._with(filters.within_filter(self.df, polygons, lat=self.lat_col,
                                                lon=self.lon_col))

    def where(self, conditions) -> PointDataset:
        """Rows equal to every value of a dict or list of pairs."""
        return self._with(self.df.filter(filters.equality_condition(self.df, conditions)))

    # -- results ------------------------------------------------------------------------

    def by_distance(self, tie: str | list[str] = ()) -> DataFrame:
        """Rows of a radius query in order of distance, then of ``tie``."""
        ties = check_columns(self.raw, [tie] if isinstance(tie, str) else tie)
        return self.df.orderBy(DISTANCE_KM, *ties)

    def nearest(self, *, lat: float, lon: float, k: int, tie: str | list[str],
                start_radius_m: float | None = None) -> DataFrame:
        """The ``k`` nearest rows by distance, then by ``tie``.

        Tasks keep ``k`` rows each and nothing is shuffled. On clustered files
        ``start_radius_m`` first counts within growing circles, so that only the files
        near the centre are read. As in the joins by distance, rows with a latitude outside
        [-90, 90] or a longitude that is no finite number take no part. The ``k`` rows meet in one task at the end.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        if start_radius_m is not None and not start_radius_m > 0:
            raise ValueError("start_radius_m must be positive")
        lat, lon = check_point(lat=lat, lon=lon)
        ties = check_columns(self.raw, [tie] if isinstance(tie, str) else tie)
        rows = self
        radius = start_radius_m
        while radius is not None and radius < 5.0e6:
            circle = self.radius(lat=lat, lon=lon, radius=radius)
            if circle.raw.limit(k).count() >= k:
                rows = circle
                break
            radius *= 4.0
        km = haversine_m(lat1=self._lat, lon1=self._lon, lat2=lat, lon2=lon) / 1000.0
        ranked = rows.df.withColumn(DISTANCE_KM, km).filter(
            self._lat.between(-90.0, 90.0) & F.abs(self._lon).between(0.0, sys.float_info.max))
        return ranked.orderBy(DISTANCE_KM, *ties).limit(k)

    def select(self, *columns: str) -> DataFrame:
        """Only the named columns, plus ``_distance_km`` where there is one."""
        names = check_columns(self.raw, columns)
        if DISTANCE_KM in self.raw.columns and DISTANCE_KM not in names:
            names.append(DISTANCE_KM)
        return self.df.select(*names)

    def limit(self, n: int, tie: str | list[str]) -> DataFrame:
        """The first ``n`` rows in ``tie`` order."""
        return self.df.orderBy(*check_columns(
            self.raw, [tie] if isinstance(tie, str) else tie)).limit(n)

    def aggregate(self, *, by: str | list[str], aggs: str | list[str]) -> DataFrame:
        """Grouped ``"count"``, ``"sum:col"``, ``"avg:col"``, ``"min:col"``, ``"max:col"``."""
        return aggregates.aggregate(self.df, by=by, aggs=aggs)

    def convex_hull(self) -> DataFrame:
        return shapes.convex_hull(self.df, lat=self.lat_col, lon=self.lon_col)

    def dissolve(self, by: str | list[str], **options) -> DataFrame:
        return shapes.dissolve(self.df, by=by, lat=self.lat_col, lon=self.lon_col, **options)

    def bounds(self) -> DataFrame:
        return shapes.total_bounds(self.df, lat=self.lat_col, lon=self.lon_col)

    def profile(self) -> DataFrame:
        return aggregates.profile(self.raw, lat=self.lat_col, lon=self.lon_col)

    def schema_df(self) -> DataFrame:
        return aggregates.schema_report(self.raw, source=self.source, lat=self.lat_col,
                                        lon=self.lon_col)

    def write(self, path: str, *, format: str = "json", mode: str = "error") -> None:
        """Write the rows as JSON lines, CSV or GeoJSON features."""
        from .sources.sinks import write_rows

        write_rows(self.df, path, format=format, lat=self.lat_col, lon=self.lon_col, mode=mode)

    def refresh(self, view: str, path: str, **options) -> PointDataset:
        """Check a new file and point ``view`` at it; on failure nothing changes."""
        from .streaming.refresh import refresh

        return refresh(self.raw.sparkSession, view, path, **options)
