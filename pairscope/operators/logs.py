"""A runner's text logs: lines of any number of files read into events, with the job that is running carried along."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscope.operators.ranks import carried, placed
from pairscope.storage import settle

#: What the lines of a runner's log look like.
PREFIX = r"^\s*\d+\|"
START = r"^START (\S+) panel=\S+ attempt=(\d+)"
FAILED = r"^(ATTEMPT_FAILED|CHECKPOINT_FAILED) (\S+) attempt=(\d+) code=(-?\d+)"
ACCEPTED = "ACCEPTED "
MESSAGES = ["workspace or record dir already exists", "archive already contains", "delivered output already exists"]
INFO = r"^(\d\d:\d\d:\d\d\.\d+) INFO"
PENDING = '{"status":"pending_human_review"'


def text_lines(spark: SparkSession, path: str, folder: str = "log") -> DataFrame:
    """(log, place, line) of the text files under folders log=... (or another name); a log of several files is read in the
    order of their names."""
    rows = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col(folder).cast("string").alias("log"), place.alias("place"), F.col("value").alias("line"))


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, place, line) of text files of many small logs: a line is its log's name, a tab and what the log says; the lines
    of a log are together and in order, in one file or in several of one order of names."""
    rows = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    value = F.split("value", "\t", 2)
    return rows.select(value[0].alias("log"), place.alias("place"), value[1].alias("line"))


def numbered(lines: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """lines of text_lines() or packed_lines(), with their position in their log from 1, __part and __at as ranks.ranged().
    Where lines are a choice, whole has all of them.

    A block of a file is read in order by one task, so a line's place in it is its own number less the block's first; what
    lies before the block is a sum over a table with a row a log and block. No line is moved.
    """
    marked = lambda x: x.select("*", F.col("place.file").alias("__file"), F.col("place.block").alias("__block"))
    held = marked(lines)
    order = [F.col("log"), F.col("file"), F.col("block")]
    blocks = marked(lines if whole is None else whole).groupBy("log", F.col("__file").alias("file"), F.col("__block").alias("block")).agg(F.min("place.row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("log").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = blocks.select(F.col("log").alias("__log"), "file", "block", "first", before.alias("before"), F.row_number().over(W.orderBy(*order)).alias("__part"))
    same = F.col("log").eqNullSafe(F.col("__log")) & (F.col("__file") == F.col("file")) & (F.col("__block") == F.col("block"))
    at = (F.col("place.row") - F.col("first")).alias("__at")
    return held.join(known, same).select(*lines.columns, "__part", at, (F.col("before") + at + 1).cast("bigint").alias("position"))


def _in_order(lines: DataFrame) -> DataFrame:
    """lines with position, __part and __at: by the blocks of their files, or by place where that is something else."""
    kind = lines.schema["place"].dataType
    return numbered(lines) if getattr(kind, "names", None) == ["file", "block", "row"] else placed(lines, ["log"], ["place"])


def log_events(lines: DataFrame) -> DataFrame:
    """(log, line, event, job, attempt, code, text, clock, agent_id, run_id), a row an event, line from 1 within its log.

    START names the job that runs from there on; ACCEPTED, messages and the first clock of an attempt in a log belong to
    the job that runs then, wherever in the log its START stands. Failures and the record of a finished run name their job
    themselves. Other lines, and lines of no running job that would need one, are no events.
    """
    body = F.regexp_replace("line", PREFIX, "")
    ordered = _in_order(lines.select("log", "place", body.alias("body"))).drop("place")
    starts = F.col("body").rlike(START)
    began = F.when(starts, F.struct(F.regexp_extract("body", START, 1).alias("job"), F.regexp_extract("body", START, 2).cast("bigint").alias("attempt")))
    held = carried(ordered, ["log"], current=began)
    running = F.col("current").isNotNull()
    failed, ended = F.col("body").rlike(FAILED), F.from_json("body", "job_id string, attempt bigint, agent_id string, run_id string")
    says = reduce(lambda a, b: a | b, (F.contains(F.col("body"), F.lit(m)) for m in MESSAGES))
    event = (
        F.when(starts, "START")
        .when(failed, F.regexp_extract("body", FAILED, 1))
        .when(running & F.startswith(F.col("body"), F.lit(ACCEPTED)), "ACCEPTED")
        .when(running & says, "message")
        .when(running & F.col("body").rlike(INFO), "node_started")
        .when(F.startswith(F.col("body"), F.lit(PENDING)), "run_finished")
    )
    told = held.select("log", F.col("position").alias("line"), event.alias("event"), "current", "body").filter("event is not null").withColumn("ended", F.when(F.col("event") == "run_finished", ended))
    of = lambda e: F.col("event") == e
    fails = F.col("event").endswith("_FAILED")
    events = told.select(
        "log",
        "line",
        "event",
        F.when(fails, F.regexp_extract("body", FAILED, 2)).when(of("run_finished"), F.col("ended.job_id")).otherwise(F.col("current.job")).alias("job"),
        F.when(fails, F.regexp_extract("body", FAILED, 3).cast("bigint")).when(of("run_finished"), F.col("ended.attempt")).otherwise(F.col("current.attempt")).alias("attempt"),
        F.when(fails, F.regexp_extract("body", FAILED, 4).cast("bigint")).alias("code"),
        F.when(of("message"), F.trim("body")).alias("text"),
        F.when(of("node_started"), F.regexp_extract("body", INFO, 1)).alias("clock"),
        F.col("ended.agent_id").alias("agent_id"),
        F.col("ended.run_id").alias("run_id"),
    )
    events = settle(events)
    rest = [c for c in events.columns if c not in ("log", "job", "attempt")]
    first = events.filter("event = 'node_started'").groupBy("log", "job", "attempt").agg(F.min(F.struct(*rest)).alias("first")).select("log", "job", "attempt", *(F.col(f"first.{c}").alias(c) for c in rest))
    return events.filter("event <> 'node_started'").unionByName(first)


def exit_events(events: DataFrame) -> DataFrame:
    """(job, attempt, event, n, first_line, last_line): starts, failures by their exit code (exit_<code>), failed checkpoints."""
    key: Column = F.when(F.col("event") == "START", "start").when(F.col("event") == "ATTEMPT_FAILED", F.concat(F.lit("exit_"), F.col("code"))).when(F.col("event") == "CHECKPOINT_FAILED", "checkpoint_failed")
    held = events.select("job", "attempt", key.alias("event"), "line").filter("event is not null")
    return held.groupBy("job", "attempt", "event").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
