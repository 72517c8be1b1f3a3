"""Sinks: fixed field order, write-once, replacement by renaming, versioned results, summaries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.sources.files import exists

#: Fixed value: what a version may be called.
VERSION = r"[a-z0-9][a-z0-9_-]{0,63}"


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with the fields in this order, a header, quotes doubled; lines end in LF on every platform."""
    rows.select(*columns).write.options(header=True, escape='"', lineSep="\n", emptyValue="").csv(path)


def jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; characters stay as they are, null fields stay in."""
    rows.write.options(ignoreNullFields=False, lineSep="\n", encoding="UTF-8").json(path)


#: Files that name the version to read, one a published state, numbered upwards.
POINTERS = "_pointers"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published states, in order."""
    where, store = _store(spark, f"{path}/{POINTERS}")
    if not store.exists(where):
        return []
    return sorted(int(s.getPath().getName()) for s in store.listStatus(where) if re.fullmatch(r"[0-9]+", s.getPath().getName()))


def _point(spark: SparkSession, path: str, number: int, version: str) -> bool:
    """Makes version the state of that number; False if another writer has made one. A file that is made without leave to
    overwrite is the one step that counts: it is there whole or not at all, and of two writers one makes it."""
    where, store = _store(spark, f"{path}/{POINTERS}/{number:020d}")
    try:
        out = store.create(where, False)
    except Exception as e:  # the store says in its own words that the file is there
        if store.exists(where):
            return False
        raise e
    out.write(bytearray(version.encode()))
    out.close()
    return True


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the table that path's last whole pointer names; None before the first. A pointer that a writer left
    unwritten names nothing and is passed over."""
    for number in reversed(_numbers(spark, path)):
        where, store = _store(spark, f"{path}/{POINTERS}/{number:020d}")
        size = store.getFileStatus(where).getLen()
        if size:
            name = "".join(r["value"] for r in spark.read.text(f"{path}/{POINTERS}/{number:020d}").collect())
            return f"{path}/{name}"
    return None


def replace(rows: DataFrame, path: str) -> str:
    """rows as the new state of the table at path: written beside the old state, which is never touched, then pointed to.

    A reader (current()) sees the old state or the new one, whole, whenever a writer stops. Of writers at the same time
    each gets a number of its own; the highest is read. Old states stay until swept().
    """
    spark = rows.sparkSession
    version = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    while not _point(spark, path, max(_numbers(spark, path), default=-1) + 1, version):
        pass
    return f"{path}/{version}"


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that replace() published last."""
    folder = published(spark, path)
    if folder is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(folder)


def swept(spark: SparkSession, path: str) -> int:
    """Removes all states but the one that is published, for when no reader holds an old one; returns how many."""
    kept = published(spark, path)
    where, store = _store(spark, path)
    old = [s.getPath() for s in store.listStatus(where) if s.getPath().getName().startswith("data-") and f"{path}/{s.getPath().getName()}" != kept] if kept else []
    for p in old:
        store.delete(p, True)
    return len(old)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables have the same columns and rows, repeats counted."""
    if left.columns != right.columns:
        return False
    both = left.withColumn("__d", F.lit(1)).unionByName(right.withColumn("__d", F.lit(-1))).groupBy(*left.columns).agg(F.sum("__d").alias("__d"))
    return both.filter("__d <> 0").isEmpty()


def write_once(rows: DataFrame, path: str) -> str:
    """written, or identical where the same rows are there already; other rows are an error."""
    if not exists(rows.sparkSession, path):
        rows.write.parquet(path)
        return "written"
    if same_rows(rows.sparkSession.read.parquet(path), rows):
        return "identical"
    raise ValueError(f"immutable table differs: {path}")


def versioned(rows: DataFrame, folder: str, version: str) -> str:
    """The path of a new version under folder; it is never overwritten, and shows only when it is whole.

    A claim, a file that only one writer can make, is taken before the rows are moved into place, so of two writers of one
    version one is refused, and no version ends up inside another. A claim without a version is one whose writer stopped.
    """
    if not re.fullmatch(VERSION, version):
        raise ValueError("a version has 1 to 64 lower-case letters, digits, underscores or hyphens")
    spark, path = rows.sparkSession, f"{folder.rstrip('/')}/{version}"
    claim, store = _store(spark, f"{folder.rstrip('/')}/.claims/{version}")
    if exists(spark, path) or store.exists(claim):
        raise FileExistsError(path)
    own = f"{folder.rstrip('/')}/.incomplete-{uuid.uuid4().hex}"
    rows.write.parquet(own)
    source = _store(spark, own)[0]
    try:
        store.create(claim, False).close()
    except Exception as e:
        store.delete(source, True)
        raise FileExistsError(path) from e
    if not store.rename(source, _store(spark, path)[0]):
        store.delete(claim, False)
        raise OSError(f"{own} could not be renamed to {path}")
    return path


def summary(rows: DataFrame, key: str, good: str, preview: int = 25) -> DataFrame:
    """One row: rows in all, good ones, others, and the first ids (by order) of the others; a bounded list."""
    bad = rows.filter(~F.col(good)).orderBy(key).limit(preview).agg(F.array_sort(F.collect_list(key)).alias("preview"))
    return rows.agg(F.count("*").alias("input_rows"), F.count_if(good).alias("written_rows"), F.count_if(~F.col(good)).alias("unresolved_count")).crossJoin(F.broadcast(bad))
