"""Literal cases and brute force for ranges, joins, files, provenance, batteries and models."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairscope.functions import special
from pairscope.functions import text as T
from pairscope.operators import batteries as B
from pairscope.operators import cohort as C
from pairscope.operators import evidence as E
from pairscope.operators import integrity as V
from pairscope.operators import intake as I
from pairscope.operators import joins as J
from pairscope.operators import models as M
from pairscope.operators import panel as N
from pairscope.operators import provenance as Q
from pairscope.operators import ranks as R
from pairscope.operators import stats as S
from pairscope.sources import files, sinks


def test_placed_with_null_keys_ties_and_hot_groups(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 4}", rng.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(5)
    got = {r.id: (r.position, r.size) for r in R.placed(df, ["g"], ["v", "id"]).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        own = sorted((v, i) for i, k, v in rows if k == g)
        want |= {i: (n, len(own)) for n, (_, i) in enumerate(own, 1)}
    assert got == want
    whole = {r.id: r.position for r in R.placed(df, [], [F.col("v").desc(), F.col("id")]).collect()}
    assert whole == {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, _, v in rows), 1)}
    assert R.placed(df.limit(0), ["g"], ["v"]).count() == 0 and R.placed(df.limit(0), [], ["v"]).count() == 0


def test_running_sums(spark):
    rows = [(i, (i * 37) % 101) for i in range(200)]
    got = {r.id: r.before for r in R.cumulated(spark.createDataFrame(rows, "id int, v int").repartition(7), ["id"], before=F.col("v")).collect()}
    assert got == {i: sum(v for _, v in rows[:i]) for i, _ in rows}


def test_bh_against_definition(spark):
    rng = random.Random(3)
    rows = [("ab"[i % 2], i, None if i % 9 == 0 else round(rng.random() ** 3, 4)) for i in range(150)]
    got = {r.test: (r.p_bh, r.family_size) for r in S.adjusted(spark.createDataFrame(rows, "family string, test int, p double")).collect()}
    for family in "ab":
        held = sorted((p, t) for f, t, p in rows if f == family and p is not None)
        low = 1.0
        for rank in range(len(held), 0, -1):
            low = min(low, held[rank - 1][0] * len(held) / rank)
            assert math.isclose(got[held[rank - 1][1]][0], low, abs_tol=1e-12) and got[held[rank - 1][1]][1] == len(held)
    assert all(got[t] == (None, 0) for _, t, p in rows if p is None)


def test_ids_are_unique_over_the_table(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300)], "id int, g string").repartition(4)
    held = C.opaque_ids(df, "id", "salt")
    assert sorted(r.opaque for r in held.collect()) == [f"SA-{i:06d}" for i in range(1, 301)]
    assert {r["check"]: r.violations for r in V.id_checks(held, "opaque", r"^SA-\d{6}$").collect()} == {"bad_format": 0, "repeated": 0}
    twice = held.unionByName(held.limit(2)).unionByName(held.limit(1).withColumn("opaque", F.lit("SA-1")))
    assert {r["check"]: (r.violations, r.status) for r in V.id_checks(twice, "opaque", r"^SA-\d{6}$").collect()} == {"bad_format": (1, "FAIL"), "repeated": (2, "FAIL")}


def test_controls_top_up_and_cap(spark):
    pool = spark.createDataFrame([(i, i % 3) for i in range(60)], "id int, k int")
    targets = spark.createDataFrame([(100 + i, 0) for i in range(4)] + [(200, 9)], "id int, k int")
    got = C.matched(targets, pool, ["k"], "id", "s:", most=10).collect()
    assert [r.pick for r in got].count("stratum") == 4 and len(got) == 10 and all(r.k == 0 for r in got if r.pick == "stratum")
    assert len(C.matched(targets, pool, ["k"], "id", "s:", most=3).collect()) == 3


def test_usability_without_ids(spark):
    rows = [(None, i, "t", "Supported", "e") for i in range(5)] + [("a", 9, "t", "Supported", "e"), ("a", 10, "t", "Supported", "e")]
    df = spark.createDataFrame(rows, "id string, p int, text string, label string, ev string")
    got = {r.p: r.reason for r in I.usability(df, "id", "p", "text", "label", "ev", ["Supported"]).collect()}
    assert got == {**{i: "missing_claim_id" for i in range(5)}, 9: None, 10: "duplicate_claim_id"}


def test_tails_for_large_counts():
    assert math.isclose(special.binomial_half(50_000, 50_400), 0.2073, abs_tol=2e-3)
    assert special.binomial_half(10**8, 2 * 10**8) < 1e-300 and special.binomial_half(3, 3) == 1.0
    assert 0 <= special.fisher(10**6, 10**6, 10**6, 10**6 + 3000) <= 1 and special.fisher(0, 0, 0, 0) == 1.0


def test_chi_squared_without_grid(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), rng.choice("abc")) for _ in range(500)]
    table = np.array([[sum(1 for x, y in rows if (x, y) == (i, j)) for j in "abc"] for i in range(4)], float)
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    got = S.chi_squared(spark.createDataFrame(rows, "l int, r string"), "l", "r").first()
    assert math.isclose(got.chi2, ((table - e) ** 2 / e).sum(), rel_tol=1e-9)
    two = spark.createDataFrame([(0, 0)] * 88 + [(0, 1)] * 4912 + [(1, 0)] * 27 + [(1, 1)] * 4973, "l int, r int")
    assert math.isclose(special.chi2_tail(S.chi_squared(two, "l", "r").first().chi2, 1), 1.8286e-08, rel_tol=1e-3)


def test_bootstrap_interval(spark):
    rows = [(i, i % 4 == 0) for i in range(4000)]
    got = S.bootstrap(spark.createDataFrame(rows, "k int, h boolean"), "k", "h").first()
    assert got.replicates == 2000 and 0.225 < got.ci_low < 0.245 and 0.255 < got.ci_high < 0.275


def test_checked_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, v string")
    assert J.suffixed(a, b, ["k"]).columns == ["k", "v_1", "v_2"]
    assert [r.k for r in J.missing(a, b, ["k"]).collect()] == [2]
    assert {(r.k, r.which) for r in J.membership(a, b, ["k"]).collect()} == {(2, "missing"), (3, "unexpected")}
    assert {(r.k, r.w) for r in J.one_to_one(a, b.withColumnRenamed("v", "w"), ["k"]).collect()} == {(1, "p"), (2, None)}
    for broken in (lambda: J.one_to_one(a, b.unionByName(b), ["k"], "inner"), lambda: J.both_ways(a, b, "k"), lambda: J.lookup(a, b.withColumnRenamed("v", "w"), "k", "w", required=True)):
        with pytest.raises(PySparkException):
            broken().collect()


def test_batch_containers(spark):
    schema = "item_id string, n int"
    cases = ['[{"item_id": "a", "n": 1}, {"item_id": "b", "n": 2}]', '{"item_id": "a", "n": 1}\n\n{"item_id": "b", "n": 2}\n', "", " \n "]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r.i: [(x.item_id, x.n) for x in r.r] for r in df.select("i", files.records(F.col("c"), schema).alias("r")).collect()}
    assert got == {0: [("a", 1), ("b", 2)], 1: [("a", 1), ("b", 2)], 2: [], 3: []}
    one = spark.createDataFrame([('{"item_id": "a", "n": 1}',)], "c string")
    with pytest.raises(PySparkException):
        one.select(files.records(F.col("c"), schema)).collect()
    assert one.select(F.size(files.records(F.col("c"), schema, whole_first=False))).first()[0] == 1


def test_pages_that_conflict(spark):
    pages = spark.createDataFrame([("a", "1"), ("a", "2")], "page string, lines string")
    with pytest.raises(PySparkException):
        files.pages_of(pages, pages.limit(0), "page", "lines").collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é"), (2, 'q"t')], "k int, v string")
    assert sinks.write_once(rows, f"{tmp_path}/once") == "written" and sinks.write_once(rows, f"{tmp_path}/once") == "identical"
    with pytest.raises(ValueError):
        sinks.write_once(rows.limit(1), f"{tmp_path}/once")
    with pytest.raises(ValueError):
        sinks.versioned(rows, str(tmp_path), "Not OK")
    sinks.csv(rows, f"{tmp_path}/c", ["v", "k"])
    assert files.csv_text(spark, f"{tmp_path}/c", ["v", "k"]).count() == 2
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.csv_text(spark, f"{tmp_path}/c", ["k", "v"]).collect()


def test_evidence_errors(spark):
    raws = ["no json", "[]", "[[]]", '[[["a", "b", "p"]]]', '[[["a", "b", "", "1"]]]', '[[["a", "b", "p", "x"]]]', '[[["a", "b", "p", 3]]]']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [r.e for r in df.select(E.raw_error(F.col("raw")).alias("e")).collect()]
    assert got == [f"bad_raw_evidence:{x}" for x in ("ValueError", "no_evidence_sets", "no_evidence_sets", "invalid_evidence_pointer", "invalid_evidence_pointer_title", "invalid_evidence_pointer_sentence_index")] + [None]
    lengths = spark.createDataFrame([("[1, 2]",), ("{}",), ("[",), (None,), ("",)], "j string")
    assert [r.n for r in lengths.select(E.json_length(F.col("j")).alias("n")).collect()] == [2, 0, 0, 0, 0]


def test_line_end_digests(spark):
    df = spark.createDataFrame([("a\nb\n", "a\nb\n"), ("a\r\nb\r\n", "a\nb\n"), ("a b\n", "a\nb\n"), ("a\nb", "a\nb\n")], "now string, old string")
    digest = F.sha2("old", 256)
    assert [r.s for r in df.select(T.digest_status(F.col("now"), digest, digest).alias("s")).collect()] == ["exact_recorded_bytes", "eol_only_equivalent", "changed", "changed"]


def test_minhash_estimates_jaccard(spark):
    a, b = [f"s{i}" for i in range(100)], [f"s{i}" for i in range(20, 120)]
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(T.minhash(F.col("a")).alias("a"), T.minhash(F.col("b")).alias("b")).first()
    assert len(row.a) == 200 and abs(sum(x == y for x, y in zip(row.a, row.b, strict=True)) / 200 - 80 / 120) < 0.12


def test_panels_need_each_slot_once(spark):
    rows = [(1, "A", j, "Supported", "clearly_sufficient", 50) for j in (1, 2, 3, 4, 5)]
    schema = "item_id int, stage string, judge_no int, verdict string, sufficiency string, confidence int"
    assert N.consensus(spark.createDataFrame(rows, schema), slots=5).first().consensus == "Supported"
    for broken in (rows[:4], rows + rows[:1], rows[:4] + rows[:1]):
        with pytest.raises(PySparkException):
            N.consensus(spark.createDataFrame(broken, schema), slots=5).collect()


def test_gates_and_drift(spark):
    stages = spark.createDataFrame([("A", True), ("B", False), ("C", True)], "stage string, complete boolean")
    assert [(r.stage, r.frozen, r.reason) for r in Q.gates(stages, ["A", "B", "C"]).collect()] == [("A", True, ""), ("B", False, "incomplete"), ("C", False, "predecessor_not_frozen")]
    old = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 1)], "part string, v int")
    new = spark.createDataFrame([("x", 2), ("x", 1), ("y", 5), ("w", 1)], "part string, v int")
    got = Q.drift(Q.manifest(old, ["part"], ["v"]), Q.manifest(new, ["part"], ["v"]), ["part"])
    assert {r.part: r.status for r in got.collect()} == {"x": "unchanged", "y": "changed", "z": "missing", "w": "new"}


def test_published_odds_and_replication(spark):
    counts = spark.createDataFrame([("shared_1", "odds", 18, 22, 53, 133), ("shared_2", "odds", 14, 26, 27, 159)], "analysis string, kind string, a bigint, b bigint, c bigint, d bigint")
    got = B._tested(counts, floor_all=True).collect()
    assert [round(r.odds_ratio, 3) for r in got] == [2.053, 3.171] and [round(r.p, 4) for r in got] == [0.0592, 0.0054]
    assert [(round(r.ci_low, 3), round(r.ci_high, 3)) for r in got] == [(1.020, 4.133), (1.472, 6.829)]


def test_battery_statuses(spark):
    rows = [("r", "rate", 0, 0, 0, 0), ("o", "odds", 0, 4, 1, 1), ("e", "odds", 0, 0, 1, 1), ("p", "paired", 3, 0, 0, 2), ("t", "table", 5, 0, 4, 0), ("x", "exact", 1, 5, 0, 1)]
    got = {r.analysis: r for r in B._tested(spark.createDataFrame(rows, "analysis string, kind string, a bigint, b bigint, c bigint, d bigint")).collect()}
    assert got["r"].status == "not_estimable_empty_denominator" and got["r"].rate_pct is None
    assert got["o"].status == "undefined_historical_OR_zero_event_cell" and got["o"].odds_ratio is None and got["o"].p is not None
    assert got["e"].status == "not_estimable_empty_group" and got["e"].p is None
    assert got["p"].status == "undefined_no_discordant_pairs" and got["p"].p is None
    assert got["t"].status == "not_estimable_constant_margin" and math.isclose(got["x"].p, 0.0625)


def test_logit_against_newton_and_separation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2)).round(2)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, (b, c) in zip(y, x, strict=True)], "y double, p double, q double")
    full, beta = np.c_[np.ones(600), x], np.zeros(3)
    for _ in range(30):
        prob = 1 / (1 + np.exp(-full @ beta))
        info = full.T @ (full * (prob * (1 - prob))[:, None])
        beta = beta + np.linalg.solve(info, full.T @ (y - prob))
    got = M.logit(df, "y", ["p", "q"]).collect()
    assert np.allclose([r.coefficient for r in got], beta, atol=1e-8) and np.allclose([r.se for r in got], np.sqrt(np.diag(np.linalg.inv(info))), atol=1e-8)
    ridge = np.zeros(3)
    for _ in range(60):
        prob = 1 / (1 + np.exp(-full @ ridge))
        keep = np.diag([0.0, 1.0, 1.0])
        ridge = ridge + np.linalg.solve(full.T @ (full * (prob * (1 - prob))[:, None]) + keep, full.T @ (y - prob) - keep @ ridge)
    assert np.allclose(sorted(r.coefficient for r in M.l2_logistic(df, "y", ["p", "q"]).collect()), sorted(ridge), atol=1e-7)
    apart = spark.createDataFrame([(float(i > 5), float(i)) for i in range(12)], "y double, p double")
    assert {r.status for r in M.logit(apart, "y", ["p"]).collect()} == {"separated"}
    assert {r.status for r in M.logit(apart.limit(0), "y", ["p"]).collect()} == {"not_estimable_one_class"}


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(0, 5), (0, 5), (1, 7), (1, 7)], "a int, b int")
    assert M.adjusted_rand(same, "a", "b").first().ari == 1.0
    crossed = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert math.isclose(M.adjusted_rand(crossed, "a", "b").first().ari, -0.5)


def test_krippendorff_with_missing_ratings(spark):
    from pairscope.operators import agreement as G

    rng = random.Random(8)
    rows = [(i, "A", j, rng.choice(N.VERDICTS)) for i in range(60) for j in range(1, 6) if rng.random() < 0.8]
    got = G.krippendorff(G.item_counts(spark.createDataFrame(rows, "item_id int, stage string, judge_no int, verdict string"), N.VERDICTS, "stage"), 3, "stage").first()
    units = [u for u in ([v for i, _, _, v in rows if i == k] for k in range(60)) if len(u) > 1]
    values = [v for u in units for v in u]
    seen = sum(sum(a != b for a in u for b in u) / (len(u) - 1) for u in units) / len(values)
    chance = sum(a != b for a in values for b in values) / (len(values) * (len(values) - 1))
    assert math.isclose(got.alpha, 1 - seen / chance, rel_tol=1e-9)
    gaps = N.complete(spark.createDataFrame(rows, "item_id int, stage string, judge_no int, verdict string"))
    assert {r.item_id: r.complete for r in gaps.collect()} == {i: len([1 for r in rows if r[0] == i]) == 5 for i in {r[0] for r in rows}}
