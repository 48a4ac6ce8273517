"""Session-level helpers: shared scratch space and broadcast bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A join side is broadcast only when its computed size bound is below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    shared = shared or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geocairn-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; :func:`drop_scratch` deletes what is there."""
    _MADE.append(f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables this process has written, of all calls or those after
    ``since = scratch_mark()``. Call it when the results that read them have been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in _MADE[since:]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _MADE[since:]


def scratch_mark() -> int:
    return len(_MADE)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives losing executors, and gives later
    plans real file sizes to cost with.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_width(df: DataFrame, names: list[str]) -> Column:
    """Upper estimate of the in-memory bytes of the named columns of a row."""
    width = F.lit(16)
    for name in names:
        kind, col = df.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.StringType, T.BinaryType)):
            width += F.coalesce(F.octet_length(col), F.lit(0)) + 16
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            width += 4 * F.coalesce(F.length(F.to_json(F.struct(col))), F.lit(0)) + 64
        else:
            width += 16
    return width


def join_side(df: DataFrame, bytes_bound: int | None, limit: int = BROADCAST_LIMIT_BYTES):
    """Broadcast ``df`` when its bound allows, else ask for a sort-merge join.

    The sort-merge plan is the one adaptive execution can split on a hot key.
    """
    if bytes_bound is not None and bytes_bound <= limit:
        return F.broadcast(df)
    return df.hint("merge")
