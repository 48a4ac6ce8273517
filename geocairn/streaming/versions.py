"""Versions of a published dataset, and the pointer that every session reads.

In ``<versions_dir>`` lie the data folders ``<view>-...`` and ``<view>.pointers``, a folder of numbered files. The file
with the highest number names the current version. A pointer is written aside and renamed to the next number, so
readers see the old version or the new one and nothing else. The rename is as atomic as the file system's.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import check_identifier

#: Column that holds the batch of a streamed row on disk.
BATCH = "_geocairn_batch"


def root_of(versions_dir: str, view: str) -> str:
    return f"{versions_dir.rstrip('/')}/{check_identifier(view)}"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}.pointers")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def _read(spark: SparkSession, root: str, number: int) -> dict:
    rows = spark.read.text(f"{root}.pointers/{number}", wholetext=True).collect()  # one line
    return json.loads(rows[0][0])


def current(spark: SparkSession, root: str) -> dict | None:
    """The pointer with the highest number, or None if nothing has been published."""
    while numbers := _numbers(spark, root):
        try:
            return _read(spark, root, numbers[-1])
        except Exception:  # pruned between listing and reading: a newer one exists then
            if numbers[-1] in _numbers(spark, root):
                raise
    return None


def swap(spark: SparkSession, root: str, pointer: dict, keep: int) -> int:
    """Make ``pointer`` the current one; versions beyond the ``keep`` newest are deleted. Returns its number."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    fs, aside = _fs(spark, f"{root}.pointers/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    while True:
        number = (_numbers(spark, root) or [0])[-1] + 1
        _, target = _fs(spark, f"{root}.pointers/{number}")
        if not fs.exists(target) and fs.rename(aside, target):
            break
    _prune(spark, root, keep)
    return number


def _prune(spark: SparkSession, root: str, keep: int) -> None:
    numbers = _numbers(spark, root)
    live = {_read(spark, root, n)["data"] for n in numbers[-keep:]}
    for n in numbers[:-keep]:
        data = _read(spark, root, n)["data"]
        fs, at = _fs(spark, f"{root}.pointers/{n}")
        if data not in live:
            fs.delete(_fs(spark, f"{root}-{data}")[1], True)
        fs.delete(at, False)


def rows_of(spark: SparkSession, root: str, pointer: dict) -> DataFrame:
    """The rows of a version; of a stream those of the batches that were published with it."""
    raw = spark.read.parquet(f"{root}-{pointer['data']}")
    if "batch" in pointer:
        raw = raw.where(F.col(BATCH) <= pointer["batch"]).drop(BATCH)
    return raw
