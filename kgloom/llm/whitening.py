"""Operator 12: whitening of embeddings by Spark MLlib's RowMatrix over exactly centred rows.

Entries become integers, so the sums over all rows are exact, and so is each row times n less the sums: the centred row is that over n,
rounded once.  ``RowMatrix.computeGramianMatrix`` over the centred rows, divided by n, is the covariance; its eigenvectors
are found on the driver (a matrix of the vectors' length squared, whatever the number of rows), and what is broadcast is
one vector for each component.  The covariance of the whitened rows is computed from these rows in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import materialize
from kgloom.llm.vectors import matrix

COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from this size on count as not finite: below it the sums of a batch of integers stay exact.
LIMIT = float(1 << 32)
#: A component below this share of the trace has no variance but what rounding leaves.
NOTHING = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(v * SCALE).astype(np.int64) + SHIFT


def squared_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n * x - sums)^2 of each row, exact; None where it is no long.

    ``sums``: Python integers, as they and n times an entry may exceed a long.
    """
    most = max((abs(int(s)) for s in sums), default=0) + n * int(np.abs(x).max(initial=0))
    exact = most * most * x.shape[1] < 1 << 63
    d = n * (x if exact else x.astype(object)) - sums.astype(np.int64 if exact else object)
    return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean: an exact integer over n."""
    whole = sums // n
    rest = (sums - whole * n).astype(np.float64) / n
    # Integers of at most 2**44: their difference is exact, and so is the sum up to one rounding.
    return (x - whole.astype(np.int64)).astype(np.float64) - rest


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of outer products of an array column, by MLlib; the vectors don't pass through Python."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def eigen(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1][:k]
    values, vectors = values[order], vectors[:, order]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each usable vector and component.

    ``n`` rows were fitted on, all that are usable.  ``deviation``: n squared times the squared distance from the mean, exact (null where it is no long).
    ``explained``: the component's share of the variance.  ``identity_error``: by how much the whitened rows' covariance is off the identity at most.

    Vectors that are null, empty, or hold null, non-finite or entries of LIMIT and more take no part.  Where lengths differ, those of the most frequent
    length (the shorter of equals) do.  Repeated rows and rows without id are rows of their own.  A component without variance (one row, constant or dependent
    entries) has ``whitened`` 0 and no part in ``identity_error``; without variance at all ``explained`` is 0.  There are no more components than entries, and no rows for none.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"))
    found = lengths.orderBy(F.desc("n"), "length").first()
    if found is None:
        return spark.createDataFrame([], RESULT)
    d, n = found["length"], found["n"]
    rows = rows.where(F.size("v") == d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(integers(matrix(b.column(0))).sum(axis=0))], ["place", "part"])

    # One sum for each entry reaches the driver.
    parts = rows.select("v").mapInArrow(add, "place int, part long").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.array([int(r["s"]) for r in sorted(parts, key=lambda r: r["place"])], object)
    means = spark.sparkContext.broadcast((n, sums))

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = means.value
        for b in batches:
            flat = centred(integers(matrix(b.column(0))), count, total).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d), pa.int32()), pa.array(flat))], ["c"])

    covariance = gramian(rows.select("v").mapInArrow(centre, "c array<double>"), "c") / n
    trace = float(np.trace(covariance))
    values, axes = eigen(covariance, min(components, d))
    live = values > NOTHING * trace
    scaled = np.where(live, axes / np.sqrt(np.where(live, values, 1.0)), 0.0)
    model = spark.sparkContext.broadcast((n, sums, scaled))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total, onto = model.value
        for frame in frames:
            if len(frame):
                x = integers(np.stack(frame["v"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "deviation": pd.array(squared_deviation(x, count, total), "Int64"), "y": list(centred(x, count, total) @ onto)})

    done = materialize(rows.mapInPandas(project, "vec_id long, deviation long, y array<double>"), "whitened")
    k = len(values)
    mean = np.array(done.agg(*[F.avg(F.col("y")[i]).alias(f"y{i}") for i in range(k)]).first(), float)
    off = done.select(F.array(*[F.col("y")[i] - F.lit(float(mean[i])) for i in range(k)]).alias("y"))
    error = np.abs(gramian(off, "y") / n - np.eye(k))[np.ix_(live, live)].max(initial=0.0)
    shares = F.array(*[F.lit(float(e) / trace if ok else 0.0) for e, ok in zip(values, live, strict=True)])
    out = done.select("vec_id", "deviation", F.posexplode("y").alias("i", "whitened"))
    return out.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )
