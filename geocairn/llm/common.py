"""Helpers shared by the operators: words, columns added by Arrow batches, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows computed at a time, so that what a task makes of long texts stays small.
ROWS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of a string column as UTF-8; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def with_columns(df: DataFrame, fields: list[tuple[str, T.DataType]],
                 compute: Callable[[pa.RecordBatch], list], reads: list[str]) -> DataFrame:
    """``df`` with columns that ``compute`` makes from each Arrow batch.

    A column of ``df`` that already has one of the new names is replaced. ``reads`` are the columns
    that ``compute`` needs.
    """
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names]
    hidden = [c for c in reads if c in names]
    wide = df.select(*kept, *(F.col(f"`{c}`").alias(f"__llm_in_{c}") for c in hidden))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            view = {c: batch.column(f"__llm_in_{c}" if c in hidden else c) for c in reads}
            made = compute(view)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, kept + names)

    return wide.mapInArrow(run, schema)


def share_below(key: Column, rows: int, bound: int) -> Column:
    """True for about ``bound`` of ``rows`` rows, the same ones in every run."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int((1 << 30) * bound / rows)
