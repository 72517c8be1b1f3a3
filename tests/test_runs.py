"""Event streams of runs against a loop over lines, inventories of files, labels derived anew."""

from __future__ import annotations

import hashlib
import json
import os
import random
from collections import Counter, defaultdict

import pytest

from pairscope.operators import panel as N
from pairscope.operators import provenance as Q
from pairscope.operators import runs as E
from pairscope.sources import files
from pyspark.sql import functions as F


def random_events(rng, n):
    lines = []
    for i in range(n):
        call = {"type": "tool_call", "status": rng.choice(["started", "completed"]), "name": rng.choice("pqr"), "call_id": rng.choice([None, f"c{rng.randrange(n)}"])}
        status = {"type": "status", "status": rng.choice(["RUNNING", "ERROR", "FINISHED"]), "message": rng.choice([None, f"m{i}"]), "run_id": f"r{rng.randrange(5)}"}
        other = {"agent_id": rng.choice(["", None, f"a{rng.randrange(7)}"]), "extra": [1]}
        lines.append(rng.choice(["", "  ", json.dumps(call), json.dumps(status), json.dumps(other)]))
    return lines


def loop_over(lines):
    """(totals, values in order, events, errors, last message, calls by tool) of one log, line by line."""
    totals, seen, calls = Counter(), {"agent_id": [], "run_id": []}, defaultdict(set)
    n = errors = 0
    message = None
    for at, line in enumerate(lines):
        if not line.strip():
            continue
        e = json.loads(line)
        n += 1
        totals["type", e.get("type")] += 1
        for field, bucket in seen.items():
            if e.get(field) and e[field] not in bucket:
                bucket.append(e[field])
        if e.get("type") == "status":
            totals["status", e.get("status")] += 1
            if e.get("status") == "ERROR":
                errors, message = errors + 1, e.get("message")
        if e.get("type") == "tool_call":
            if e.get("status") == "completed":
                totals["completed_tool", e.get("name")] += 1
            calls[e.get("name"), e.get("call_id"), at if e.get("call_id") is None else None].add(e.get("status"))
    tools = {}
    for (name, _, _), what in calls.items():
        held = tools.setdefault(name, [0, 0, 0, 0])
        for k, yes in enumerate((True, "completed" in what, what == {"started"}, what == {"completed"})):
            held[k] += yes
    return totals, seen, n, errors, message, {k: tuple(v) for k, v in tools.items()}


def test_event_streams_by_a_loop(spark):
    """Several logs, one with half of all lines, over many ranges."""
    rng = random.Random(5)
    logs = {"a": random_events(rng, 400), "b": random_events(rng, 3), "c": random_events(rng, 200), "d": ["", " "]}
    rows = [(log, at, line) for log, lines in logs.items() for at, line in enumerate(lines)]
    rng.shuffle(rows)
    events = E.parsed(spark.createDataFrame(rows, "log string, place bigint, line string").repartition(9))
    want = {log: loop_over(lines) for log, lines in logs.items() if any(x.strip() for x in lines)}
    totals, firsts, tools = defaultdict(Counter), defaultdict(dict), defaultdict(dict)
    for r in E.totals(events).collect():
        totals[r["log"]][r["field"], r["value"]] = r["n"]
    for r in E.first_seen(events, ["agent_id", "run_id"]).collect():
        firsts[r["log"], r["field"]][r["position"]] = r["value"]
    for r in E.tool_calls(events).collect():
        tools[r["log"]][r["name"]] = (r["calls"], r["completed"], r["unfinished"], r["unopened"])
    ends = {r["log"]: r for r in E.outcomes(events).collect()}
    assert set(ends) == set(want)
    for log, (counted, seen, n, errors, message, calls) in want.items():
        assert totals[log] == counted and tools[log] == calls
        assert all([firsts[log, f][k] for k in sorted(firsts[log, f])] == values and sorted(firsts[log, f]) == list(range(1, len(values) + 1)) for f, values in seen.items())
        assert (ends[log]["n_events"], ends[log]["errors"], ends[log]["error_message"]) == (n, errors, message)


def test_event_streams_empty_and_broken(spark):
    none = E.parsed(spark.createDataFrame([], "log string, place bigint, line string"))
    assert [f(none).count() for f in (E.totals, E.outcomes, E.tool_calls, lambda e: E.first_seen(e, ["agent_id"]))] == [0] * 4
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        E.parsed(spark.createDataFrame([("a", 1, '{"type": ')], "log string, place bigint, line string")).collect()


@pytest.mark.parametrize("whole", [files.WHOLE, 1000, 0])
def test_inventory_of_files(spark, tmp_path, monkeypatch, whole):
    """Digests and times as the file system has them, whichever files are streamed; names with blanks and percent signs."""
    monkeypatch.setattr(files, "WHOLE", whole)
    bodies = {"x/empty.txt": b"", "x/a b.txt": b"1" * 999, "x/edge.bin": b"2" * 1000, "y/50%25.bin": os.urandom(3_000_000), "y/z/c.bin": b"3" * 1001}
    for name, body in bodies.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
        os.utime(path, (1_700_000_000, 1_700_000_000 + len(body)))
    got = {r["path"]: (r["size"], r["sha256"], r["at"]) for r in files.inventory(spark, str(tmp_path)).withColumn("at", F.unix_timestamp("mtime")).collect()}
    assert got == {"/".join(n.split("/")[-2:]): (len(b), hashlib.sha256(b).hexdigest(), 1_700_000_000 + len(b)) for n, b in bodies.items()}


def test_a_file_beyond_a_cell_is_streamed(spark, tmp_path):
    """A sparse file of 2.2 GB, more than one cell can hold."""
    path = tmp_path / "d" / "big.bin"
    path.parent.mkdir()
    with open(path, "wb") as out:
        out.truncate(2_200_000_000)
    want = hashlib.sha256()
    for _ in range(2200):
        want.update(bytes(1_000_000))
    row = files.inventory(spark, str(tmp_path)).first()
    assert (row["path"], row["size"], row["sha256"]) == ("d/big.bin", 2_200_000_000, want.hexdigest())


def test_every_path_is_derived_as_the_taxonomy_says(spark):
    """All panels' paths over three stages, by both derivations; edited, missing and stray labels are named."""
    kinds = {"Supported": ["Supported"] * 5, "Refuted": ["Refuted"] * 4 + ["Ambiguous"], "Ambiguous": ["Ambiguous"] * 3 + ["Supported"] * 2, "Unresolved": ["Supported"] * 3 + ["Refuted"] * 2}
    paths = [(g, a, b, c) for g in ("Supported", "Refuted") for a in kinds for b in kinds for c in kinds]
    rows = [(i, s, j, kinds[p[k]][j - 1], "clearly_sufficient", p[0]) for i, p in enumerate(paths) for k, s in enumerate("ABC", 1) for j in range(1, 6)]
    judged = spark.createDataFrame(rows, "item_id bigint, stage string, judge_no int, verdict string, sufficiency string, gold string")
    labels = spark.createDataFrame([(i, *p) for i, p in enumerate(paths)], "item_id bigint, gold string, a string, b string, c string")
    more = F.col("item_id") % 2 == 0
    stored = labels.select("item_id", N.taxonomy(F.col("gold"), F.col("a"), F.col("b"), F.col("c"), more).alias("label"))
    again = Q.categories_again(judged, more)
    assert again.count() == len(paths) == 128
    assert Q.label_edits(stored, again, "item_id", "label", "category").count() == 0
    broken = stored.filter("item_id <> 9").withColumn("label", F.when(F.col("item_id") == 4, "x").when(F.col("item_id") != 5, F.col("label"))).union(spark.createDataFrame([(999, "y")], "item_id bigint, label string"))
    got = {r["item_id"]: r["kind"] for r in Q.label_edits(broken, again, "item_id", "label", "category").collect()}
    assert got == {4: "edited", 5: "edited", 9: "not_stored", 999: "not_derived"}
