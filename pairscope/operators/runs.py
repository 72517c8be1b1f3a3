"""Event streams of runs: JSON lines of any number of files, summed up a log at a time without collecting a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.operators.ranks import placed

FORM = "type string, status string, agent_id string, run_id string, call_id string, name string, message string"


def parsed(lines: DataFrame) -> DataFrame:
    """(log, place, fields of FORM): an event a line of text_lines(); blank lines are skipped, a broken one is an error."""
    held = lines.filter(F.trim("line") != "").select("log", "place", F.from_json("line", FORM, {"mode": "FAILFAST"}).alias("e"))
    return held.select("log", "place", "e.*")


def totals(events: DataFrame) -> DataFrame:
    """(log, field, value, n): how often each type occurs, each status of status events, each tool of completed calls.

    A field that an event lacks counts as a null value, once a log.
    """
    status, done = F.col("type") == "status", (F.col("type") == "tool_call") & (F.col("status") == "completed")
    cell = lambda field, value: F.struct(F.lit(field).alias("field"), F.col(value).alias("value"))
    cells = F.array_compact(F.array(cell("type", "type"), F.when(status, cell("status", "status")), F.when(done, cell("completed_tool", "name"))))
    return events.select("log", F.inline(cells)).groupBy("log", "field", "value").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, fields: list[str]) -> DataFrame:
    """(log, field, position, value, n): the distinct values of each field in the order in which they first occur in a log.

    Partial minima by value come before any order, so a log of any length moves its distinct values only; a log of very
    many values is numbered over several ranges. Null and empty values are none.
    """
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    each = events.select("log", "place", F.inline(cells)).filter(F.coalesce(F.col("value"), F.lit("")) != "")
    seen = each.groupBy("log", "field", "value").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return placed(seen, ["log", "field"], ["first"]).select("log", "field", "position", "value", "n")


def outcomes(events: DataFrame) -> DataFrame:
    """(log, n_events, last_status, errors, error_message): a row a log; the message is that of its last ERROR, null if it
    has none."""
    status, failed = F.col("type") == "status", (F.col("type") == "status") & (F.col("status") == "ERROR")
    last = lambda c, when: F.max_by(F.struct(c), F.when(when, F.col("place")))[c]
    return events.groupBy("log").agg(F.count("*").alias("n_events"), last("status", status).alias("last_status"), F.count_if(failed).alias("errors"), last("message", failed).alias("error_message"))


def tool_calls(events: DataFrame) -> DataFrame:
    """(log, name, calls, completed, unfinished, unopened): calls of each tool, starts paired with completions by call_id.

    Repeated events of one call count once. Events without a call_id are a call each.
    """
    alone = F.when(F.col("call_id").isNull(), F.col("place"))
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    calls = events.filter("type = 'tool_call'").groupBy("log", "name", "call_id", alone.alias("alone")).agg(has("started").alias("started"), has("completed").alias("completed"))
    return calls.groupBy("log", "name").agg(F.count("*").alias("calls"), F.count_if("completed").alias("completed"), F.count_if(F.col("started") & ~F.col("completed")).alias("unfinished"), F.count_if(F.col("completed") & ~F.col("started")).alias("unopened"))
