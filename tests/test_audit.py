"""Logs, attempts, batches, blinding and cross-validation against loops and literal cases."""

from __future__ import annotations

import json
import random
import re

import numpy as np
import pytest

from conftest import SF
from pairscope.operators import attempts as A
from pairscope.operators import batches as B
from pairscope.operators import crossval as X
from pairscope.operators import logs as G
from pairscope.operators import ranks as R
from pyspark.sql import functions as F


def loop_over(lines):
    """The events of one log's lines, line by line."""
    found, current, clocked = [], None, set()
    for number, line in enumerate(lines, 1):
        line = re.sub(G.PREFIX, "", line)
        if m := re.match(G.START, line):
            current = (m[1], int(m[2]))
            found.append((number, "START", *current, None, None, None, None))
        elif m := re.match(G.FAILED, line):
            found.append((number, m[1], m[2], int(m[3]), int(m[4]), None, None, None))
        elif current and line.startswith("ACCEPTED "):
            found.append((number, "ACCEPTED", *current, None, None, None, None))
        elif current and any(x in line for x in G.MESSAGES):
            found.append((number, "message", *current, None, line.strip(), None, None))
        elif current and (m := re.match(G.INFO, line)) and current not in clocked:
            clocked.add(current)
            found.append((number, "node_started", *current, None, None, m[1], None))
        elif line.startswith(G.PENDING):
            data = json.loads(line)
            found.append((number, "run_finished", data["job_id"], data["attempt"], None, None, None, data.get("agent_id")))
    return found


def random_log(rng, n):
    lines = []
    for _ in range(n):
        job, attempt = f"j{rng.randrange(9)}", rng.randrange(1, 4)
        lines.append(
            rng.choice(
                [f"START {job} panel=p attempt={attempt}", f" 7|START {job} panel=p attempt={attempt}", f"xSTART {job} panel=p attempt=1", "ACCEPTED it", f"ATTEMPT_FAILED {job} attempt={attempt} code=-2", f"CHECKPOINT_FAILED {job} attempt={attempt} code=31", "", "noise", "10:00:01.25 INFO up", "11:30:00.1 INFO up"]
                + ["oh: workspace or record dir already exists ", json.dumps({"status": "pending_human_review", "job_id": job, "attempt": attempt, "agent_id": "a1"}, separators=(",", ":"))] + ["noise"] * rng.choice([0, 20])
            )
        )
    return lines


@pytest.fixture
def many_ranges(spark):
    """Twelve ranges, however few rows there are."""
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_log_events_equal_a_loop(spark, tmp_path, many_ranges):
    rng = random.Random(4)
    logs = {str(k): random_log(rng, n) for k, n in enumerate([0, 1, 700, 60, 300])}
    for k, lines in logs.items():
        (tmp_path / f"log={k}").mkdir()
        half = len(lines) // 2
        for part, some in (("a.txt", lines[:half]), ("b.txt", lines[half:])):
            if some:
                (tmp_path / f"log={k}" / part).write_text("\n".join(some) + "\n")
    got = G.log_events(G.text_lines(spark, str(tmp_path))).collect()
    for k, lines in logs.items():
        mine = sorted(((r["line"], r["event"], r["job"], r["attempt"], r["code"], r["text"], r["clock"], r["agent_id"]) for r in got if r["log"] == k))
        assert mine == loop_over(lines)


def test_a_value_is_carried_over_many_ranges(spark, many_ranges):
    rows = spark.range(400).selectExpr("id", "id div 150 as g", "if(id in (3, 160, 161, 390), id, null) as v")
    held = R.ranged(rows.repartition(9), "g", "id")
    assert held.select("__part").distinct().count() >= 8
    got = {r["id"]: r["last"] for r in R.carried(held, ["g"], last=F.col("v")).collect()}
    want, last = {}, None
    for i in range(400):
        last = None if i % 150 == 0 else last
        last = i if i in (3, 160, 161, 390) else last
        want[i] = last
    assert got == want


def test_exit_codes(spark):
    rows = [("1", 1, "START", "a", 1, None), ("1", 5, "ATTEMPT_FAILED", "a", 1, -2), ("1", 9, "ATTEMPT_FAILED", "a", 1, -2), ("1", 11, "ATTEMPT_FAILED", "a", 1, 7), ("1", 12, "CHECKPOINT_FAILED", "a", 1, 1), ("1", 13, "message", "a", 1, None)]
    got = G.exit_events(spark.createDataFrame(rows, "log string, line bigint, event string, job string, attempt bigint, code bigint"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "checkpoint_failed", 1, 12, 12), ("a", 1, "exit_-2", 2, 5, 9), ("a", 1, "exit_7", 1, 11, 11), ("a", 1, "start", 1, 1, 1)]


def plain_fit(x, y, c, balanced):
    """Newton's method on whole arrays."""
    x = np.c_[np.ones(len(x)), x]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    beta, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1 / c] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + step
        if abs(step).max() < 1e-12:
            break
    return beta


def plain_auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def labelled(n=400):
    rng = np.random.default_rng(3)
    texts = [f"text {i % 150}" for i in range(n)]
    x = rng.normal(size=(150, 2))[[i % 150 for i in range(n)]] + 0.01 * rng.normal(size=(n, 2))
    y = (x[:, 0] + rng.normal(size=n) > 0.8).astype(int)
    return [(i, texts[i], float(x[i, 0]), float(x[i, 1]), int(y[i]), int(i % 3 == 0)) for i in range(n)]


TABLE = "id int, text string, a double, b double, y int, z int"


def test_features_are_made_once_a_row(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measure(v):
        made.add(1)
        return None if v % 7 == 0 else float(v)

    rows = spark.range(60).select(F.col("id"), measure("id").alias("a"), (F.col("id") % 2).alias("y"))
    held = X.prepared(rows, "id", {"y": F.col("y") == 1}, ["a"], {"id": F.col("id")})
    assert made.value == 60
    assert sorted(r["key"] for r in held.collect()) == [i for i in range(60) if i % 7]
    assert made.value == 60


def test_out_of_fold_scores_equal_plain_fits(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, TABLE).repartition(4)
    held = X.prepared(df, "id", {"y": F.col("y") == 1, "z": F.col("z") == 1}, ["a", "b"], {"id": F.col("id"), "text": F.col("text")})
    beta = X.fit_folds(held, 2, 2, 2, c=0.1)
    got = X.out_of_fold(held, beta, ["y", "z"], ["id", "text"]).collect()
    assert len(got) == 4 * len(rows)
    x = np.array([r[2:4] for r in rows])
    for t, target in enumerate(["y", "z"]):
        y = np.array([r[4 + t] for r in rows])
        for grouping in ("id", "text"):
            mine = {r["key"]: r for r in got if r["target"] == target and r["grouping"] == grouping}
            fold = np.array([mine[i]["fold"] for i in range(len(rows))])
            for f in range(5):
                b = plain_fit(x[fold != f], y[fold != f], 0.1, True)
                want = 1 / (1 + np.exp(-(b[0] + x[fold == f] @ b[1:])))
                assert np.allclose([mine[i]["score"] for i in np.flatnonzero(fold == f)], want, atol=1e-8)
            if grouping == "text":
                assert len({(i % 150, fold[i]) for i in range(len(rows))}) == 150
    by = {(r["target"], r["grouping"]): r["auc"] for r in X.grouped_auc(df, "id", {"y": F.col("y") == 1}, ["a", "b"], {"id": F.col("id"), "text": F.col("text")}, c=0.1).collect()}
    y = np.array([r[4] for r in rows])
    for grouping in ("id", "text"):
        score = {r["key"]: r["score"] for r in got if r["target"] == "y" and r["grouping"] == grouping}
        assert abs(by["y", grouping] - plain_auc(np.array([score[i] for i in range(len(rows))]), y)) < 1e-9


def test_duplicates_flatter_a_model_that_can_remember(spark):
    """Texts come five times with one label drawn at random: by id a copy is always in the other folds, by text never."""
    rng = random.Random(5)
    rows = [(i, f"t{i // 5}", i // 5) for i in range(200)]
    drawn = [rng.randrange(2) for _ in range(40)]
    df = spark.createDataFrame([(i, t, drawn[k], *(float(k == j) for j in range(40))) for i, t, k in rows], "id int, text string, y int, " + ", ".join(f"f{j} double" for j in range(40)))
    got = {r["grouping"]: r["auc"] for r in X.grouped_auc(df, "id", {"y": F.col("y") == 1}, [f"f{j}" for j in range(40)], {"id": F.col("id"), "text": F.col("text")}).collect()}
    assert got["id"] > 0.9 and got["text"] < 0.6


def test_fits_and_awkward_rows(spark):
    rows = labelled()
    df = spark.createDataFrame([*rows, (900, None, None, 1.0, 1, 0), (901, "n", float("nan"), 1.0, 1, 0), (902, "n", 1.0, 1.0, None, 0)], TABLE)
    got = {(r["setting"], r["term"]): r["coefficient"] for r in X.fits(df, "id", F.col("y") == 1, ["a", "b"], {"l2": (1.0, True), "plain": (0.5, False)}).collect()}
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows])
    for setting, c, balanced in (("l2", 1.0, True), ("plain", 0.5, False)):
        assert np.allclose([got[setting, t] for t in ("intercept", "a", "b")], plain_fit(x, y, c, balanced), atol=1e-8)
    assert X.outcome_derived(["words", "agree_x", "gpt54_out", "semantic_outlier"]) == ["agree_x", "gpt54_out", "semantic_outlier"]
    one = X.grouped_auc(df.filter("y = 1"), "id", {"y": F.col("y") == 1}, ["a", "b"], {"id": F.col("id")}).collect()
    assert one == []
    assert X.grouped_auc(df.limit(0), "id", {"y": F.col("y") == 1}, ["a"], {"id": F.col("id")}).collect() == []


def test_auc_of_ties_by_key(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.integers(0, 6)), int(rng.integers(0, 2))) for k in ("a", "b", "c") for _ in range(50)] + [("d", 1.0, 1), (None, 0.0, 1), (None, 1.0, 0)]
    got = {r["k"]: r["auc"] for r in X.auc_by(spark.createDataFrame(rows, "k string, score double, y int"), "k").collect()}
    for key in ("a", "b", "c", None):
        mine = [r for r in rows if r[0] == key]
        assert abs(got[key] - plain_auc(np.array([r[1] for r in mine]), np.array([r[2] for r in mine]))) < 1e-12
    assert got["d"] is None


def first_error(asked, got):
    """The first fault of one batch, by walking both lists."""
    for at in range(max(len(asked), len(got))):
        a, g = asked[at] if at < len(asked) else None, got[at] if at < len(got) else None
        if a == g:
            continue
        kind = "missing" if g is None else "repeated" if g in got[:at] else "extra" if a is None else "misplaced" if g in asked else "unexpected"
        return (at + 1, a, g, kind)
    return None


def test_every_fault_of_order_is_named(spark, many_ranges):
    rng = random.Random(2)
    cases = {"good": ([1, 2, 3], [1, 2, 3]), "missing": ([1, 2, 3], [1, 2]), "extra": ([1, 2], [1, 2, 9]), "swapped": ([1, 2, 3], [1, 3, 2]), "repeated": ([1, 2, 3], [1, 2, 2]), "again": ([1, 2, 3], [1, 2, 3, 1]), "wrong": ([1, 2, 3], [1, 8, 3]), "gap": ([1, 2, 3, 4], [1, 3, 4]), "none": ([1], [])}
    for i in range(40):
        asked = rng.sample(range(50), 12)
        got = list(asked)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(got))
            rng.choice([lambda at=at: got.pop(at), lambda at=at: got.insert(at, rng.randrange(60)), lambda at=at: got.insert(0, got.pop(at))])()
        cases[f"r{i}"] = (asked, got)
    rows = lambda k: spark.createDataFrame([(j, p, x) for j, both in cases.items() for p, x in enumerate(both[k])], "job string, place int, item int").repartition(5)
    got = {r["job"]: (r["position"], r["asked"], r["got"], r["error"]) for r in B.order_errors(rows(0), rows(1), "job", "place", "item").collect()}
    assert got == {j: e for j, (a, g) in cases.items() if (e := first_error(a, g))}
    assert [got[j][3] for j in ("missing", "extra", "swapped", "repeated", "again", "wrong", "none")] == ["missing", "extra", "misplaced", "repeated", "repeated", "unexpected", "missing"]


def test_record_fields(spark):
    good = {"judge_id": "judge_1", "stage": "C", "verdict": "Refuted", "evidence_sufficiency": "clearly_sufficient", "confidence": 0, "issue_flags": ["none"], "brief_reason": "why"}
    breaks = [{}, {"judge_id": None}, {"stage": "A"}, {"verdict": "Unresolved"}, {"evidence_sufficiency": ""}, {"confidence": 101}, {"confidence": None}, {"issue_flags": []}, {"issue_flags": None}, {"issue_flags": ["none", "odd"]}, {"brief_reason": " \t"}, {"verdict": None, "confidence": -1}]
    rows = [(i, *(good | b).values()) for i, b in enumerate(breaks)]
    df = spark.createDataFrame(rows, "i int, judge_id string, stage string, verdict string, evidence_sufficiency string, confidence int, issue_flags array<string>, brief_reason string")
    got = [r["e"] for r in df.select("i", B.record_error(F.lit("judge_1"), F.lit("C")).alias("e")).orderBy("i").collect()]
    assert got == [None, "judge_id", "stage", "verdict", "evidence_sufficiency", "confidence", "confidence", "issue_flags", "issue_flags", "issue_flags", "brief_reason", "verdict"]


def test_broken_lines_and_missing_ids(spark, tmp_path):
    (tmp_path / "batch=a").mkdir()
    (tmp_path / "batch=a" / "x.txt").write_text('{"id": 1}\n\n{"id": \n[3]\n{"id": "x"}\n{"id": 2, "more": 1}\nnull\n  {"id": 5}  \n')
    got = B.parsed_lines(G.text_lines(spark, str(tmp_path), "batch"), "log", "place", "line", "id int")
    assert sorted((r["line_number"], r["record"]["id"] if r["record"] else None) for r in got.collect()) == [(1, 1), (3, None), (4, None), (5, None), (6, 2), (7, None), (8, 5)]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert sorted(r["id"] for r in B.missing_ids(frame([1, 2, 2, 3, 4]), frame([2, 4, 9]), ["id"]).collect()) == [1, 3]


def test_keys_at_any_depth(spark):
    deep = {"a": {"b": [{"c": {"d": {"e": 1}}}, [{"f": 2}]]}, "g": [1, "{\"h\": 1}"], "i": {}}
    rows = [(1, json.dumps(deep)), (2, "{"), (3, None), (4, "[]"), (5, "7"), (6, json.dumps({"gold_label": 1})), (7, json.dumps([{"x": {"y": {"z": {"u": {"v": 1}}}}}]))]
    got = {(r["k"], r["path"], r["depth"]) for r in B.key_paths(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect()}
    want = {(1, "a", 1), (1, "a.b", 2), (1, "a.b[].c", 3), (1, "a.b[].c.d", 4), (1, "a.b[].c.d.e", 5), (1, "a.b[][].f", 3), (1, "g", 1), (1, "i", 1), (2, "!not_json", 0), (6, "gold_label", 1)}
    want |= {(7, "[].x", 1), (7, "[].x.y", 2), (7, "[].x.y.z", 3), (7, "[].x.y.z.u", 4), (7, "[].x.y.z.u.v", 5)}
    assert got == want
    bad = B.not_allowed(spark.createDataFrame(rows, "k int, j string"), "k", "j", [p for _, p, _ in want if p not in ("gold_label", "[].x.y.z", "a.b[].c.d.e", "!not_json")])
    assert {(r["k"], r["path"]) for r in bad.collect()} == {(6, "gold_label"), (7, "[].x.y.z"), (1, "a.b[].c.d.e"), (2, "!not_json")}
    with pytest.raises(ValueError):
        B.key_paths(spark.createDataFrame(rows, "k int, j string"), "k", "j", most=3)


def test_contradictions_of_three_sources(spark):
    records = [("j", 1, "accepted", "a1"), ("j", 2, "error", "unknown"), ("j", 3, "error", "a9"), ("k", 1, "accepted", None)]
    staging = [("j", 1, "events", "s1", "a1", None), ("j", 1, "output", "s2", None, True), ("j", 2, "output", "s3", "a2", False), ("j", 3, "events", "s4", "a3", None), ("m", 1, "output", "s5", None, True)]
    inventory = [("j", 1, "events", "s1", "a1", None), ("j", 1, "output", "XX", None, None), ("j", 3, "routing", "s6", "a9", None), ("m", 1, "output", "s5", None, None)]
    files = "job string, attempt int, name string, sha256 string, agent string, schema_valid boolean"
    slots = A.evidence(spark.createDataFrame(records, "job string, attempt int, status string, session string"), spark.createDataFrame(staging, files), spark.createDataFrame(inventory, files))
    got = {(r["job"], r["attempt"]): (r["in_records"], r["in_staging"], r["in_inventory"], r["agents"], r["mismatches"], r["contradictions"]) for r in slots.collect()}
    assert got == {
        ("j", 1): (True, True, True, ["a1"], ["output"], ["staging/inventory:digest"]),
        ("j", 2): (True, True, False, ["a2"], [], []),
        ("j", 3): (True, True, True, ["a3", "a9"], [], ["records/staging:session"]),
        ("k", 1): (True, False, False, [], [], ["files/records:no_files"]),
        ("m", 1): (False, True, True, [], [], ["records/files:missing_record"]),
    }
    jobs = {r["job"]: (r["slots"], r["records"], r["accepted"], r["first_accepted"], r["first_valid"], r["contradicted"], r["earlier_valid"]) for r in A.job_evidence(slots).collect()}
    assert jobs == {"j": (3, 3, 1, 1, 1, 2, False), "k": (1, 1, 1, 1, None, 1, False), "m": (1, 0, 0, None, 1, 1, False)}


def test_orders_are_multiplied_where_their_items_are_grouped(spark):
    """Judgments are made in many tasks whatever the files, and grouped by item without being moved: one exchange, of orders."""
    from pairscope.sources.adapters import adapter

    judged = adapter(spark, SF, "judgments")
    assert judged.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = judged.groupBy("item_id", "stage").agg(F.min("verdict"), F.max("sufficiency"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["predictions", "judgments"])
def test_adapters_plans_say_what_their_sql_says(spark, name):
    from pairscope.sources import adapters

    rows = adapters.adapter(spark, SF, name)
    plain = spark.sql(adapters._engine(adapters.ADAPTERS[name][1], "spark").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{SF}/orders.parquet"))
    assert rows.columns == plain.columns and rows.count() == plain.count() > 0
    assert rows.exceptAll(plain).isEmpty()


def test_agreement_without_items_of_a_verdict(spark):
    """Items to which a judge gave the verdict are left out; a missing verdict leaves its item in."""
    from pairscope.operators import agreement as G

    rows = [(1, "A", 1, "x"), (1, "A", 2, "x"), (2, "A", 1, "x"), (2, "A", 2, "z"), (3, "A", 1, "y"), (3, "A", 2, None), (1, "B", 1, "z"), (1, "B", 2, "z")]
    got = G.judge_pairs(spark.createDataFrame(rows, "item_id int, stage string, judge_no int, verdict string"), 2, "stage", without="z").collect()
    assert [(r["stage"], r["same"], r["n"]) for r in got] == [("A", 1, 1)]


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    """Blocks of files of one log and of packed files of many, numbered by their blocks alone; nothing is moved by a range."""
    rng = random.Random(8)
    logs = {f"b{i}": [f"{i}:{k}" for k in range(rng.choice([1, 2, 900]))] for i in range(60)}
    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{log}\t{line}\n" for i, (log, lines) in enumerate(sorted(logs.items())) if i % 3 == part for line in lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        held = G.numbered(G.packed_lines(spark, str(tmp_path)))
        assert "rangepartitioning" not in held._jdf.queryExecution().executedPlan().toString().split("Window")[0]
        got = {(r["log"], r["position"]): r["line"] for r in held.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {(log, k): line for log, lines in logs.items() for k, line in enumerate(lines, 1)}


def test_missing_ids_with_nulls(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a int, b string")
    got = B.missing_ids(frame([(1, "x"), (1, None), (None, "y"), (2, "x"), (2, "x")]), frame([(1, None), (None, "y"), (2, "x"), (9, "z")]), ["a", "b"])
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "x"), (1, None), (None, "y")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_parsed_once(spark):
    """Each field of a record that is used must not parse the line anew."""
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), (" \t{bad",), ("  ",), ("[1]",), ('{"a": null}',)], "line string")
    got = B.parsed(lines, "line", "a int, b string")
    found = got.filter("record is not null").select("record.*")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "x"), (None, None)]
    assert sorted(r["raw"] for r in got.filter("record is null").collect()) == [" \t{bad", "[1]"]


def test_medians_of_histograms(spark, many_ranges):
    """Odd and even numbers of values, ties over ranges, nulls, and a group of nulls alone, which has no median."""
    rng = random.Random(3)
    rows = [(g, None if rng.random() < 0.1 else rng.choice([0.5, 1.0, rng.random()]), rng.randrange(1, 4)) for g in (None, "a", "b", "c") for _ in range(rng.choice([1, 40, 41]))] + [("d", None, 3)]
    want = {}
    for g in (None, "a", "b", "c"):
        values = [v for h, v, n in rows if h == g and v is not None for _ in range(n)]
        if values:
            want[g] = round(float(np.median(values)), 12)
    cells = spark.createDataFrame(rows, "g string, v double, n int")
    assert {r["g"]: round(r["median"], 12) for r in R.medians(cells, ["g"], "v", "n").collect()} == want
    every = [v for _, v, n in rows if v is not None for _ in range(n)]
    assert R.medians(cells, [], "v", "n").first()["median"] == pytest.approx(np.median(every))


def test_boosted_trees_fit_cells(spark, monkeypatch):
    """A fit goes over cells, not rows; each row gets its cell's score, and the scores tell the classes apart."""
    from pyspark.ml.classification import GBTClassifier

    from pairscope.operators import models as M

    rng = random.Random(4)
    rows = [(i, float(rng.random() < (0.9 if (x := rng.random()) > 0.5 else 0.1)), x, float(i % 2), i % 2) for i in range(4000)]
    sizes = []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, held: (sizes.append(held.count()), fit(self, held))[1])
    frame = spark.createDataFrame(rows, "id int, y double, x double, z double, fold int")
    got = {r["id"]: r["score"] for r in M.boosted(frame, "y", ["x", "z"], "id", "fold", k=2, rounds=5).collect()}
    assert len(got) == 4000 and max(sizes) <= 32 * 2 * 2
    assert np.mean([(got[i] > 0.5) == (y > 0.5) for i, y, *_ in rows]) > 0.85


def test_batch_files_are_trimmed_once(spark, tmp_path):
    """White space around a file's content, arrays, lines and blank files; no regex runs over a whole file."""
    from pairscope.sources import files

    for name, body in (("a", ' \n[{"i": 1}, {"i": 2}]\n\t'), ("b", '\r\n{"i": 3}\n\n {"i": 4} \n'), ("c", " \n\x0b"), ("d", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_bytes(body.encode())
    for whole_first in (True, False):
        got = files.batch_files(spark, f"{tmp_path}/*", "i bigint", whole_first)
        assert sorted(map(tuple, got.collect())) == [("a/x.txt", 1), ("a/x.txt", 2), ("b/x.txt", 3), ("b/x.txt", 4)]
        assert "regexp_replace" not in got._jdf.queryExecution().toString()


def test_batches_are_made_once(spark):
    """What was asked and what came are read several times, but each row is made once."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"j{i % 4}", i, i, None) for i in range(40)], "job string, place int, item int, field string")
    counted = rows.mapInArrow(run, rows.schema)
    assert B.order_errors(counted, rows.filter("item <> 5"), "job", "place", "item").count() == 1 and made.value == 40
    made.value = 0
    got = B.batch_verdicts(rows, counted, "job", "place", "item", F.when(F.col("item") == 6, "verdict")).collect()
    assert made.value == 40 and {r["job"]: (r["status"], r["reason"]) for r in got} == {"j0": ("valid", ""), "j1": ("valid", ""), "j2": ("invalid_record", "6:verdict"), "j3": ("valid", "")}


@pytest.mark.parametrize("lines", [700, 5_000_000])
def test_lines_of_batches_are_written_where_they_are_made(spark, monkeypatch, lines):
    """Files of batches are compressed and may end within a batch; lines come in order from the adapter, and none is moved."""
    from pairscope.plans import audit
    from pairscope.sources.adapters import ADAPTERS, _engine, adapter

    monkeypatch.setattr(audit, "LINES", lines)
    spark.sql("set spark.sql.adaptive.enabled=false")
    try:
        made = adapter(spark, SF, "batch_lines")
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("set spark.sql.adaptive.enabled=true")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Exchange hashpartitioning") > plan.index("inline(")
    spark.sql(_engine(ADAPTERS["batch_lines"][1].replace("FROM judgments", "FROM {judgments}"), "spark"), judgments=adapter(spark, SF, "judgments")).createOrReplaceTempView("plain_lines")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, spark.table("plain_lines").select(made.columns).collect()))
    read = audit.batch_files(made)
    assert all(f.endswith(".txt.gz") for f in read.inputFiles())
    got = G.numbered(read).select("log", "position", "line")
    want = spark.sql("select batch, row_number() over (partition by batch order by place) position, line from plain_lines")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_missing_ids_move_a_bit_an_id(spark):
    """64 neighbours of a whole number are a row; ends of the type, negative numbers, nulls and repeated keys."""
    rng = random.Random(4)
    ids = [*range(-200, 200), 63, 64, -64, -65, 2**63 - 1, -(2**63), None]
    asked = [(rng.choice("ab"), i) for i in ids for _ in range(2)] + [(None, 5)]
    found = [k for k in asked if rng.random() < 0.6] + [("a", 999), ("a", None)]
    frame = lambda rows: spark.createDataFrame(rows, "s string, i bigint")
    got = B.missing_ids(frame(asked), frame(found), ["s", "i"])
    assert got.schema.simpleString() == "struct<s:string,i:bigint>"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted({k for k in asked if None in k or k not in found}, key=repr)
    moved = B.missing_ids(frame([("a", i) for i in range(6400)]), frame([]), ["s", "i"])
    held = moved._jdf.queryExecution().executedPlan().toString()
    assert moved.count() == 6400 and "__tile" in held and re.search(r"Exchange hashpartitioning\(s#\d+, __tile", held)
