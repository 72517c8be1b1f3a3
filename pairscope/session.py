"""Session construction and the few settings every operator relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "pairscope", master: str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session in UTC with adaptive execution on; on a cluster pass neither master nor partitions."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables, by Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
