"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.sources.scratch import materialize, scratch_path, shared_root
from kgloom.sources.tables import table as read_table

__all__ = ["bind", "held_out", "materialize", "md5_fraction", "read_table", "scratch_path", "shared_root", "small_batches", "spare_name", "write_bytes"]


#: Rows and bytes of an Arrow batch at most, for batches of whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators; tighter settings of the session stay.

    Texts are long: the default of 10,000 rows holds tens of megabytes several times over, in the JVM's buffers and in each worker.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spare_name(df: DataFrame, name: str) -> str:
    """A column name like ``_name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through Hadoop's file system API (any scheme Spark knows)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def md5_fraction(value: Column, bits: int = 32) -> Column:
    """The first ``bits`` (a multiple of 4) of md5 as a long: the same in Spark and in DuckDB."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, bits // 4), 16, 10).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
