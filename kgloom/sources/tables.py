"""Readers for tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of a table's files that one task reads, and that one shuffle partition stands for, at most.
SPLIT_BYTES, SHUFFLE_BYTES = 16 << 20, 8 << 20


def stored_bytes(spark: SparkSession, folder: str, names: tuple[str, ...]) -> int:
    """The size of the tables' files, in any store that Spark reads."""
    sc, total = spark.sparkContext, 0
    for name in names:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        total += path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def bound_tasks(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """Let this session have more tasks for larger tables, not larger tasks: splits and shuffle partitions follow the size of the files.

    Settings of the session that give more tasks stay; adaptive execution joins small partitions again.
    """
    now = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    if not now.isdigit() or int(now) > SPLIT_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    parts = -(-stored_bytes(spark, folder, names) // SHUFFLE_BYTES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
