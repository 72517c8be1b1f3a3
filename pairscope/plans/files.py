"""Queries on file formats: a driver table is written in a format, and read again by the scan under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairscope.operators import ranks as R
from pairscope.plans.book import Book
from pairscope.plans.studies import claims
from pairscope.sources import files, sinks
from pairscope.storage import scratch
from pairscope.streaming import events as stream

book = Book()
add = book.add
CUSTOMER = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]
SEGMENTS = ["BUILDING", "MACHINERY"]


def place(df) -> str:
    return f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"


def scan_jsonl(c):
    """JSON lines with a blank line after each."""
    path = place(c)
    c.select(F.explode(F.array(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")), F.lit(""))).alias("value")).write.text(path)
    return files.jsonl(c.sparkSession, path, "c_custkey bigint, c_name string, c_mktsegment string", "c_mktsegment", SEGMENTS)


def scan_csv(c, typed: bool):
    path = place(c)
    sinks.csv(c, path, CUSTOMER)
    if typed:
        return files.csv_typed(c.sparkSession, path, "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey int")
    return files.csv_text(c.sparkSession, path, CUSTOMER)


def scan_fallback(c):
    path = place(c)
    c.select(*CUSTOMER).write.parquet(path)
    return files.first_table(c.sparkSession, [f"{path}-enriched", path])


add("S01_jsonl_scan", "", scan_jsonl, "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", tables="customer")
add("S02_csv_text_scan", "", lambda c: scan_csv(c, False), "SELECT c_custkey::varchar AS c_custkey, c_name, c_mktsegment, c_nationkey::varchar AS c_nationkey FROM customer", tables="customer")
add("S03_csv_typed_scan", "", lambda c: scan_csv(c, True), "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer", tables="customer")
add("S04_parquet_fallback", "", scan_fallback, "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer", tables="customer")


def page_shards(conv):
    """conversations as shards of JSON lines, a page a conversation, in the order of pages and turns."""
    path = place(conv)
    rows = conv.select(F.concat(F.lit("page "), F.col("conv_id").cast("string")).alias("id"), "conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("lines"))
    rows.repartitionByRange(8, "conv_id").sortWithinPartitions("conv_id", "turn").write.json(path)
    return files.json_shards(conv.sparkSession, f"{path}/part-*.json", "id string, conv_id bigint, turn bigint, lines string")


_page = lambda: F.replace(F.col("id"), F.lit(" "), F.lit("_"))
add("S05_sorted_shards", "", lambda c: R.placed(page_shards(c), [], ["shard", "place"]).select("conv_id", "turn", "position"), "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS position FROM conversations", tables="conversations")
add("S06_page_scan", "", lambda c: files.first_match(page_shards(c), _page(), claims(c).select(F.concat(F.lit("page_"), F.col("conv_id").cast("string")).alias("key")), "lines"), "SELECT 'page_' || conv_id AS key, arg_min(md5(coalesce(text, '')), turn) AS value FROM conversations GROUP BY conv_id", tables="conversations")


def cache_then_shards(conv):
    """Pages of even conversations from a cache, all others from shards; both hold one text a page."""
    pages = conv.groupBy("conv_id").agg(F.md5(F.coalesce(F.min_by("text", "turn"), F.lit(""))).alias("lines")).withColumn("page", F.concat(F.lit("page_"), F.col("conv_id").cast("string")))
    return files.pages_of(pages.filter("conv_id % 2 = 0").select("page", "lines"), pages.select("page", "lines").unionByName(pages.select("page", "lines")), "page", "lines")


add("S07_cache_then_shards", "", cache_then_shards, "SELECT 'page_' || conv_id AS page, md5(coalesce(arg_min(text, turn), '')) AS lines, CASE WHEN conv_id % 2 = 0 THEN 'cache' ELSE 'shards' END AS source FROM conversations GROUP BY conv_id", tables="conversations")

_RECORD = "item_id bigint, stage string, judge_no int, verdict string"


def batch_scan(j, whole_first: bool):
    """Judgments as batch files of 20,000 ids a judge and stage, arrays and JSON lines in turn, and one empty file."""
    path = place(j)
    chunk = F.floor(F.col("item_id") / 20_000).cast("bigint")
    rows = j.groupBy(F.concat_ws("_", "stage", "judge_id", chunk.cast("string")).alias("batch"), chunk.alias("chunk")).agg(F.collect_list(F.to_json(F.struct("item_id", "stage", "judge_no", "verdict"))).alias("r"))
    array = F.concat(F.lit("["), F.array_join("r", ","), F.lit("]"))
    held = rows.select("batch", F.when((F.col("chunk") % 2 == 0) | (F.size("r") == 1), array).otherwise(F.array_join("r", "\n")).alias("value"))
    held.unionByName(j.sparkSession.createDataFrame([("none", "")], "batch string, value string")).write.partitionBy("batch").text(path)
    return files.batch_files(j.sparkSession, f"{path}/batch=*", _RECORD, whole_first).select("item_id", "stage", "judge_no", "verdict")


add("S08_batch_scan", "judgments", lambda j: batch_scan(j, True), "SELECT item_id, stage, judge_no, verdict FROM judgments")
add("S09_batch_scan_by_prefix", "judgments", lambda j: batch_scan(j, False), "SELECT item_id, stage, judge_no, verdict FROM judgments")
add("S10_fenced_json", "", lambda e: e.select("event_id", F.get_json_object(files.unfenced(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```\n"))).otherwise(F.concat(F.lit(" "), "props"))), "$.k").cast("bigint").alias("k")), "SELECT event_id, (props->>'$.k')::bigint AS k FROM events", tables="events")


def runner_log(a):
    """Attempts as the lines of a runner's log."""
    head = F.concat(F.lit(" "), F.col("job_id").cast("string"))
    tail = F.concat(F.lit(" attempt="), F.col("attempt").cast("string"))
    line = F.when(F.col("status") == "accepted", F.concat(F.lit("START"), head, F.lit(" panel=p1"), tail)).when(F.col("status") == "error", F.concat(F.lit("ATTEMPT_FAILED"), head, tail, F.lit(" code=2"))).when(F.col("status") == "invalid", F.concat(F.lit("CHECKPOINT_FAILED"), head, tail)).otherwise("waiting")
    held = files.log_events(a.select(F.col("event_id").alias("number"), line.alias("line")))
    return held.select(F.col("job").cast("bigint").alias("job"), "attempt", *(F.array_join(F.col(k).cast("array<string>"), ",").alias(k) for k in files.LOG))


_LOGGED = {"start": "accepted", "attempt_failed": "error", "checkpoint_failed": "invalid"}
add("S13_log_events", "attempts", runner_log, "SELECT job_id AS job, attempt, " + ", ".join(f"coalesce(string_agg(event_id::varchar, ',' ORDER BY event_id) FILTER (status = '{s}'), '') AS {k}" for k, s in _LOGGED.items()) + " FROM attempts WHERE status <> 'blocked' GROUP BY ALL")


def inventory(c):
    """Customers' names as one text file a nation."""
    path = place(c)
    c.select("c_nationkey", "c_name").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_name").write.partitionBy("c_nationkey").option("lineSep", "\n").text(path)
    return files.inventory(c.sparkSession, path).filter("path like 'c_nationkey=%'").select(F.regexp_extract("path", r"=(\d+)/", 1).cast("bigint").alias("nation"), "size", "sha256")


add("S14_inventory", "", inventory, "SELECT c_nationkey::bigint AS nation, sum(length(c_name) + 1)::bigint AS size, sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256 FROM customer GROUP BY c_nationkey", tables="customer")


def round_trip(rows, write, read):
    path = place(rows)
    write(rows, path)
    return read(rows.sparkSession, path)


def replaced(c):
    path = place(c)
    sinks.replace(c.select("c_custkey", F.lit("old").alias("c_name")), path)
    sinks.replace(c.select("c_custkey", "c_name"), path)
    return sinks.current(c.sparkSession, path)


def summary(p):
    path = place(p)
    sinks.jsonl(sinks.summary(p.select("claim_id", F.col("model_output").isin("Supported", "Refuted").alias("ok")), "claim_id", "ok"), path)
    return p.sparkSession.read.schema("input_rows bigint, written_rows bigint, unresolved_count bigint, preview array<bigint>").json(path).withColumn("preview", F.array_join(F.col("preview").cast("array<string>"), ","))


def line_ends(r):
    """The bytes of a small CSV: what is written is the same on every platform."""
    path = place(r)
    sinks.csv(r.coalesce(1).sortWithinPartitions("r_regionkey"), path, ["r_regionkey", "r_name"])
    return files.inventory(r.sparkSession, path).filter("path like '%.csv'").select("size", "sha256")


def outcomes(rows, *steps):
    """(step, outcome) of steps that may be refused."""
    found = []
    for k, step in enumerate(steps, 1):
        try:
            found.append((k, step()))
        except (ValueError, FileExistsError):
            found.append((k, "refused"))
    return rows.sparkSession.createDataFrame(found, "step bigint, outcome string")


def write_once(n):
    path = place(n)
    rows = n.select("n_nationkey", "n_name")
    return outcomes(n, lambda: sinks.write_once(rows, path), lambda: sinks.write_once(rows, path), lambda: sinks.write_once(rows.withColumn("n_name", F.lower("n_name")), path))


def versions(n):
    path = place(n)
    kept = lambda v: "written" if sinks.versioned(n.select("n_nationkey"), path, v) else ""
    return outcomes(n, lambda: kept("v1"), lambda: kept("v1"), lambda: kept("v2"), lambda: kept("V 3"))


add("S15_csv_sink", "", lambda c: round_trip(c, lambda d, p: sinks.csv(d, p, CUSTOMER[::-1]), lambda s, p: files.csv_typed(s, p, "c_nationkey int, c_mktsegment string, c_name string, c_custkey bigint")), "SELECT c_nationkey, c_mktsegment, c_name, c_custkey FROM customer", tables="customer")
add("S16_atomic_overwrite", "", replaced, "SELECT c_custkey, c_name FROM customer", tables="customer")
add("S17_summary_sink", "predictions", summary, "WITH x AS (SELECT claim_id, model_output IN ('Supported', 'Refuted') AS ok FROM predictions) SELECT count(*) AS input_rows, count(*) FILTER (ok) AS written_rows, count(*) FILTER (NOT ok) AS unresolved_count, (SELECT string_agg(claim_id::varchar, ',' ORDER BY claim_id) FROM (SELECT claim_id FROM x WHERE NOT ok ORDER BY claim_id LIMIT 25) y) AS preview FROM x")
add("S18_jsonl_unicode_sink", "", lambda c: round_trip(c.select("c_custkey", F.concat("c_name", F.lit(" é ﬁ 日本 \"q\"")).alias("name")), sinks.jsonl, lambda s, p: s.read.schema("c_custkey bigint, name string").json(p)), "SELECT c_custkey, c_name || ' é ﬁ 日本 \"q\"' AS name FROM customer", tables="customer")
add("S19_line_ends", "", line_ends, "WITH x AS (SELECT 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey) AS body FROM region) SELECT length(body)::bigint AS size, sha256(body) AS sha256 FROM x", tables="region")
add("S20_write_once", "", write_once, "SELECT * FROM (VALUES (1::bigint, 'written'), (2, 'identical'), (3, 'refused')) AS t(step, outcome)", tables="nation")
add("S21_versioned_results", "", versions, "SELECT * FROM (VALUES (1::bigint, 'written'), (2, 'refused'), (3, 'written'), (4, 'refused')) AS t(step, outcome)", tables="nation")


def streamed(spark, sf_dir: str):
    """The event table read as a stream and summed up batch by batch."""
    return stream.summary(spark, sf_dir, "events", place(spark.range(0)), "user_id", "event_type")


book.queries["S11_event_stream"] = streamed
book.oracles["S11_event_stream"] = "SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL"
