"""Event ingest: a stream of files, summed up batch by batch, with a result equal to that of the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.sources.files import exists


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder as a stream of its files, be it one file or a folder of them."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    if store.getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def summary(spark: SparkSession, folder: str, name: str, state: str, *keys: str, event: str = "event_id") -> DataFrame:
    """(keys, n, last_event) over all events there are now.

    Each batch leaves its sums under its own number in `state`; a batch that is run again after a failure replaces what it
    left, so none counts twice. The sums of all batches are added up by one aggregate.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n"), F.max(event).alias("last_event")).write.mode("overwrite").parquet(f"{state}/sums/batch={number}")

    query = event_stream(spark, folder, name).writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if not exists(spark, f"{state}/sums"):
        return spark.read.parquet(f"{folder}/{name}.parquet").limit(0).groupBy(*keys).agg(F.count("*").alias("n"), F.max(event).alias("last_event"))
    return spark.read.parquet(f"{state}/sums").groupBy(*keys).agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))
