"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one set here where the session names none (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pairscope-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A folder of this application under shared_dir(), which is deleted when the application ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/scratch-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not store.exists(path):
        store.mkdirs(path)
        store.deleteOnExit(path)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
