"""What the vector operators share: valid vectors, and blocks of rows as matrices in one binary value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array, width: int, dtype: str = "f8") -> np.ndarray:
    """Rows of a list column, each padded with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out
