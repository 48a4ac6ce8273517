"""Spatially clustered Parquet, so that box filters skip row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_columns

# Masks and shifts that spread 16 bits to every other bit.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def z_order_key(*, lat: Column, lon: Column) -> Column:
    """Interleaved bits of the position on a 65536 x 65536 world grid."""

    def axis(value, span):
        cell = F.floor((F.least(F.greatest(value, F.lit(-span)), F.lit(span)) + span)
                       * (65535.0 / (2.0 * span))).cast("bigint")
        for shift, mask in _SPREAD:
            cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
        return cell

    return axis(lon, 180.0).bitwiseOR(F.shiftleft(axis(lat, 90.0), 1))


def write_layout(df: DataFrame, path: str, *, lat: str, lon: str, partitions: int | None = None,
                 mode: str = "error") -> None:
    """Write rows clustered along a Z curve; later box and radius filters prune by statistics.

    Ranges are cut on (curve, position, source task), so neither a crowded cell nor many
    copies of one position end up in a single output task. ``partitions`` is the number of
    files; by default ``spark.sql.shuffle.partitions``.
    """
    lat, lon = check_columns(df, [lat, lon])
    if {"_z", "_task"} & set(df.columns):
        raise ValueError("column names _z and _task are reserved")
    keyed = df.withColumn("_z", z_order_key(lat=F.col(lat), lon=F.col(lon))).withColumn(
        "_task", F.spark_partition_id())
    cut = ["_z", lat, lon, "_task"]
    files = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(files, *cut)
    ranged.sortWithinPartitions("_z", lat, lon).drop("_z", "_task").write.mode(mode).parquet(path)
