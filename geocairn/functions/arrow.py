"""Moving nested geometry columns between Arrow and flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def list_offsets(column: pa.Array) -> np.ndarray:
    """Offsets into ``column.flatten()``; NULL lists count as empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def as_doubles(column: pa.Array) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


def vertices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) of an array of vertex structs."""
    lon, lat = column.flatten()
    return as_doubles(lon), as_doubles(lat)


def open_parts(column: pa.Array):
    """``(parts per row, paths per part, vertices per path)`` offsets, then lon and lat."""
    parts = column.flatten()
    paths = parts.flatten()
    lon, lat = vertices(paths.flatten())
    return list_offsets(column), list_offsets(parts), list_offsets(paths), lon, lat


def _offsets(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int32())


def vertex_array(lon, lat) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(lon, pa.float64()), pa.array(lat, pa.float64())], ["lon", "lat"])


def close_parts(row_offsets, part_offsets, path_offsets, lon, lat, mask=None) -> pa.ListArray:
    """Inverse of :func:`open_parts`; ``mask`` marks NULL rows."""
    paths = pa.ListArray.from_arrays(_offsets(path_offsets), vertex_array(lon, lat))
    parts = pa.ListArray.from_arrays(_offsets(part_offsets), paths)
    return pa.ListArray.from_arrays(_offsets(row_offsets), parts,
                                    mask=None if mask is None else pa.array(mask))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each offset range; empty ranges give 0."""
    owner = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    return np.bincount(owner, values, minlength=offsets.size - 1)
