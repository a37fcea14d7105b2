"""The folder that driver and executors share, for results that are written once and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder.

    ``spark.checkpoint.dir`` when the session names one.  Otherwise the warehouse on a cluster, and
    a folder of this process (removed at exit) on ``local[*]``, where only one machine exists.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="kgloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/kgloom-{label}-{uuid.uuid4().hex}"


#: Lets Spark remove a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, compression: str | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    With ``free`` the shuffle files that went into it are removed as soon as it is written; else they stay until the driver's garbage collection.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, None)
    if free:
        spark.conf.set(_CLEANUP, "true")
        df = df.select("*")  # planned under this setting
    try:
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    finally:
        if free:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
