"""Vector columns as plain numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """The vector is there, is not empty, and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def whole_numbers(vectors: np.ndarray | list, scale: int) -> np.ndarray:
    """floor(scale * x) of rows of one length: 64-bit numbers where they fit, Python's numbers of any size else."""
    with np.errstate(over="ignore"):
        scaled = np.floor(np.asarray(vectors, np.float64).reshape(len(vectors), -1) * float(scale))
    if np.isfinite(scaled).all():
        if np.abs(scaled).max(initial=0) < 1 << 62:
            return scaled.astype(np.int64)
        return np.array([[int(x) for x in v] for v in scaled], object)
    # A double near the largest is a whole number itself and is multiplied as one.
    return np.array([[int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in v] for v in np.asarray(vectors, np.float64)], object)


def dumped(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, row by row."""
    if values.dtype == object:
        return b"," + ",".join(map(str, values.ravel())).encode()
    return b"8" + np.ascontiguousarray(values, np.int64).tobytes()


def loaded(raw: bytes, rows: int) -> np.ndarray:
    """What ``dumped`` wrote, as so many rows."""
    if raw[:1] == b"8":
        return np.frombuffer(raw, np.int64, offset=1).reshape(rows, -1)
    return np.array([int(x) for x in raw[1:].split(b",")], object).reshape(rows, -1)
