"""Points arriving as files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..dataset import PointDataset
from ..functions.checks import check_columns, detect_coordinates
from ..operators.joins import within_join
from ..sources.readers import format_of
from . import versions


def stream_points(
    spark: SparkSession, path: str, *, schema, format: str = "parquet", lat: str | None = None,
    lon: str | None = None, max_files_per_trigger: int | None = None, **options,
) -> PointDataset:
    """A streaming dataset over a directory: each new file is read once.

    Filters, ``within_join`` and ``radius_join`` against static regions and the sinks'
    row rules work as on a batch. Files are appended, never replaced; to replace a
    whole dataset use :func:`geocairn.refresh`. The stream holds no state; :func:`publish_stream` makes its rows a
    published dataset.
    """
    kind = format_of(path, format)
    if kind == "geojson":
        raise ValueError("stream CSV or Parquet files; convert GeoJSON first")
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    if kind == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(path)
    lat, lon = detect_coordinates(raw.columns, lat, lon)
    return PointDataset(raw, lat, lon, path)


def publish_stream(
    stream: PointDataset, view: str, *, versions_dir: str, checkpoint: str, keep: int = 3, **trigger,
) -> StreamingQuery:
    """Start publishing a stream as ``view``: after each batch all sessions see its rows, each row once.

    A batch is written to a folder of its number, which a repeated batch overwrites, and is then published by one
    swap of the pointer, which carries the number. A batch that was already published is passed over. So a query that
    stops between writing, swapping and committing and starts again from the same ``checkpoint`` loses and
    repeats nothing, whatever the moment. Another checkpoint is another stream, whose rows replace the old ones.
    ``trigger`` is passed to the writer (``availableNow=True``, ``processingTime="1 minute"``).
    """
    root = versions.root_of(versions_dir, view)
    data = f"stream-{hashlib.sha256(checkpoint.rstrip('/').encode()).hexdigest()[:16]}"
    lat, lon, path = stream.lat_col, stream.lon_col, stream.source
    if versions.BATCH in stream.raw.columns:
        raise ValueError(f"column name {versions.BATCH} is reserved")

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = versions.current(spark, root) or {}
        if now.get("data") == data and now["batch"] >= number:
            return
        batch.write.mode("overwrite").parquet(f"{root}-{data}/{versions.BATCH}={number}")
        versions.swap(spark, root, {"data": data, "batch": number, "lat": lat, "lon": lon, "path": path}, keep)

    writer = stream.raw.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def zone_counts(
    points: PointDataset, zones: DataFrame, *, time: str, window: str, delay: str, slide: str | None = None,
    **zone_options,
) -> DataFrame:
    """Points per zone and window of event time: window_start, window_end, zone_id, count.

    On a stream the counts are Spark's state, one number a zone and open window, summed in each task before they are
    shuffled. A window closes once a point has been seen that is ``delay`` past its end; written in append
    mode it comes out once, then. A point is late, and is dropped, if all its windows had closed when its batch
    began; points that arrive within ``delay`` are never dropped. The dropped groups of a batch are in the
    query's progress (``numRowsDroppedByWatermark``). On a batch nothing is late, and all windows come out. Points without a
    time take no part. ``slide`` makes windows overlap; ``zone_options`` go to :func:`within_join`.
    """
    (time,) = check_columns(points.raw, [time])
    timed = points.df.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    inside = within_join(timed, zones, lat=points.lat_col, lon=points.lon_col, **zone_options)
    counts = inside.groupBy(F.window(time, window, slide).alias("_window"), "zone_id").agg(F.count("*").alias("count"))
    return counts.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"),
                         "zone_id", "count")
