"""What both vector searches share: reading vectors out of Arrow lists and dealing rows into cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """``(vec_id long, v array<double>)`` without rows whose id or vector is null, empty, or not finite throughout."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def matrix(col: pa.Array) -> np.ndarray:
    """A list column without nulls whose rows have one length, as (rows, length)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def block_of(queries: Column, rows_per_block: int, count: int, salt: str) -> Column:
    """A block number by a hash: about ``rows_per_block`` rows in each, in as many blocks as the count needs."""
    return F.pmod(F.xxhash64(queries, F.lit(salt)), F.lit(max(1, -(-count // rows_per_block)))).cast("int")
