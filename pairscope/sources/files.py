"""Scans of the file formats a study is kept in, all by Spark's readers: any store, any number of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the store it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def jsonl(spark: SparkSession, path: str, schema: str, label: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line is an error. With labels only rows of those classes."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.filter(F.col(label).isin(labels)) if label and labels else rows


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with every field as text, "" where empty; another header than `columns` is an error."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, escape='"').csv(path)
    return rows.na.fill("", columns)


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a schema; a field that does not fit its type is an error."""
    return spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)


def first_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several Parquet tables that is there."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of {paths}")


def json_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of many shards, with shard (file name) and place, which rises within a shard."""
    rows = spark.read.schema(schema).json(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", F.col("_metadata.file_name").alias("shard"), at.alias("place"))


def first_match(rows: DataFrame, key: Column, wanted: DataFrame, value: str) -> DataFrame:
    """(key, value): the wanted keys only, and for each the value of its first row by shard and place."""
    held = rows.select(key.alias("key"), F.col(value).alias("value"), "shard", "place")
    return held.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min_by("value", F.struct("shard", "place")).alias("value"))


def pages_of(cache: DataFrame, shards: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, source): a page from the cache, else from the shards. Two contents of one key in a source are an error."""

    def single(rows: DataFrame, source: str) -> DataFrame:
        held = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
        return held.select(key, F.when(F.col("low") != F.col("high"), F.raise_error(F.concat(F.lit("normalization_collision:"), F.col(key)))).otherwise(F.col("low")).alias(value), F.lit(source).alias("source"))

    kept = single(cache, "cache")
    return kept.unionByName(single(shards.join(cache.select(key), key, "left_anti"), "shards"))


def records(content: Column, schema: str, whole_first: bool = True) -> Column:
    """The records of a batch file's content: a JSON array, or one JSON object a line; blank content has none.

    whole_first: content that is one JSON value but no array is an error; else only a leading bracket tells an array.
    """
    return _records(_trimmed(content), schema, whole_first)


def _trimmed(content: Column) -> Column:
    return F.btrim(content, F.lit(" \t\n\x0b\f\r"))


def _records(body: Column, schema: str, whole_first: bool) -> Column:
    """records() of content without white space at its ends."""
    as_array = F.from_json(body, f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    lines = F.transform(F.filter(F.split(body, r"\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{schema}>", {"mode": "FAILFAST"}))
    single = F.raise_error(F.lit("top-level JSON is not a list"))
    other = F.when(~body.contains("\n"), single).otherwise(lines) if whole_first else lines
    return F.when(body == "", F.array().cast(f"array<struct<{schema}>>")).when(body.startswith("["), as_array).otherwise(other)


def batch_files(spark: SparkSession, path: str, schema: str, whole_first: bool = True) -> DataFrame:
    """(batch, columns): the records of batch files, a row a record; batch is the file's folder and name.

    A file's content is trimmed once, by its characters, before it is looked at: it may be long."""
    held = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1).alias("batch"), _trimmed(F.col("value")).alias("body"))
    return held.select("batch", F.inline(_records(F.col("body"), schema, whole_first)))


def unfenced(raw: Column) -> Column:
    """JSON text without a fence of three backticks and `json` around it."""
    body = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    fenced = body.startswith("```json\n") & body.endswith("```")
    return F.when(fenced, F.regexp_replace(F.regexp_replace(body, r"^```json\n", ""), r"\s*```$", "")).otherwise(body)


#: The lines a runner's log has, by kind of event.
LOG = {
    "start": r"^START (\S+) panel=\S+ attempt=(\d+)",
    "attempt_failed": r"^ATTEMPT_FAILED (\S+) attempt=(\d+) code=\d+",
    "checkpoint_failed": r"^CHECKPOINT_FAILED (\S+) attempt=(\d+)",
}


def log_events(lines: DataFrame, number: str = "number", line: str = "line") -> DataFrame:
    """(job, attempt, and a sorted list of line numbers a kind): each line is read by itself, others are passed over."""
    kind = reduce(lambda c, k: c.when(F.col(line).rlike(LOG[k]), k), list(LOG)[1:], F.when(F.col(line).rlike(LOG["start"]), "start"))
    part = lambda i: F.coalesce(*(F.nullif(F.regexp_extract(line, p, i), F.lit("")) for p in LOG.values()))
    held = lines.select(kind.alias("kind"), part(1).alias("job"), part(2).cast("int").alias("attempt"), F.col(number).alias("at")).filter("kind is not null")
    return held.groupBy("job", "attempt").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("at")))).alias(k) for k in LOG))


#: Bytes of a file that is digested as one cell; the digest of a larger one is taken from a stream.
WHOLE = 64 << 20


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, size, sha256, mtime) of files read block by block, so that memory does not depend on their size."""
    from pyarrow import fs

    for batch in batches:
        for path in batch.column(0).to_pylist():
            local = path.startswith("file:")
            store, name = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with store.open_input_stream(name) as body:
                while block := body.read(1 << 20):
                    digest.update(block)
            info = store.get_file_info(name)
            changed = pa.array([info.mtime_ns // 1000], pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([info.size], pa.int64()), pa.array([digest.hexdigest()]), changed], ["uri", "size", "sha256", "mtime"])


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, mtime): every file under a folder; mtime is when it was last changed.

    Files up to WHOLE bytes are digested by the scan itself. Larger ones are never held: the scan gives their names alone,
    and each is streamed by the task that has its name. Empty files, which scans pass over, come from the scan's listing,
    which the driver holds. Both must be in a store that Arrow reads (local, HDFS, S3, GCS). A store of objects has no
    symbolic links to flag; links of a local folder are followed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select(F.col("path").alias("uri"), F.col("length").alias("size"))
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "uri string")
    slashes = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  a listing and a scan write local names apart
    empty = listed.select(slashes("uri").alias("uri")).join(found.select(slashes("uri").alias("uri")), "uri", "left_anti")
    streamed = found.filter(F.col("size") > WHOLE).select("uri").unionByName(empty).repartition("uri").mapInArrow(_streamed, "uri string, size bigint, sha256 string, mtime timestamp")
    small = files.filter(F.col("length") <= WHOLE).select(F.col("path").alias("uri"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"))
    return small.unionByName(streamed).withColumn("path", F.regexp_extract("uri", r"([^/]+/[^/]+)$", 1)).select("path", "size", "sha256", "mtime")
