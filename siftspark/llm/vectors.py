"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """True where the vector is there and has no null and no component that isn't finite."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(column: pa.Array, dim: int, scale: int, most: int) -> np.ndarray:
    """column: lists of dim doubles, none null. floor(scale * x) of each component, as (rows, dim) 64-bit integers within -most .. most."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64)
