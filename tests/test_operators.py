"""Literal cases and exhaustive sweeps of single operators."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pairscope.functions import special
from pairscope.functions import text as T
from pairscope.operators import dedup as D
from pairscope.operators import evidence as E
from pairscope.operators import intake as I
from pairscope.operators import paired as P
from pairscope.operators import panel as N
from pairscope.operators import stats as S


def rule(verdicts: list[str], weak: int) -> tuple[str, str]:
    """The consensus rules, in plain Python and judge order."""
    n = {v: verdicts.count(v) for v in N.VERDICTS}
    for v in N.DECISIVE:
        if n[v] >= 4:
            return v, "high_consensus"
    modal = max(n, key=lambda v: (n[v], -verdicts.index(v) if v in verdicts else -99))
    if modal == "Ambiguous" and n[modal] >= 2:
        return "Ambiguous", "ambiguous_majority"
    return ("Ambiguous", "ambiguous_weak_sufficiency") if weak >= 3 else ("Unresolved", "unresolved")


def test_consensus_sweep(spark):
    rows, want = [], {}
    for item, (votes, weak) in enumerate(itertools.product(itertools.product(N.VERDICTS, repeat=5), (0, 3, 5))):
        want[item] = rule(list(votes), weak)
        rows += [(item, "A", j + 1, v, "clearly_insufficient" if j < weak else "clearly_sufficient", 50) for j, v in enumerate(votes)]
    df = spark.createDataFrame(rows[::-1], "item_id int, stage string, judge_no int, verdict string, sufficiency string, confidence int").repartition(7)
    got = {r.item_id: (r.consensus, r["rule"]) for r in N.consensus(df).collect()}
    assert len(got) == 729 and got == want


def test_transitions(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False), (True, False)], "a boolean, b boolean")
    assert [r.t for r in df.select(P.transition(F.col("a"), F.col("b")).alias("t")).collect()] == ["robust", "rescue", "resistant", "regression"]


def test_usability_first_reason(spark):
    rows = [("1", 1, "t", "Bad", "e"), ("1", 2, "t", "Supported", "e"), ("1", 3, "", "Supported", "e"), (None, 4, "t", "Supported", "e"), ("2", 5, " ", "Refuted", "e"), ("3", 6, "t", "Refuted", "")]
    df = spark.createDataFrame(rows, "id string, p int, text string, label string, ev string")
    got = {r.p: r.reason for r in I.usability(df, "id", "p", "text", "label", "ev", P.LABELS).collect()}
    assert got == {1: "invalid_true_label:Bad", 2: None, 3: "duplicate_claim_id", 4: "missing_claim_id", 5: "missing_claim_text", 6: "missing_gold_evidence"}


def test_bh(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, None)], "family string, test int, p double")
    got = {r.test: r.p_bh for r in S.adjusted(df).collect()}
    assert got[4] is None and [round(got[i], 9) for i in (1, 2, 3)] == [0.03, 0.04, 0.04]


@pytest.mark.parametrize("b,c,p", [(5, 0, 0.0625), (0, 0, 1.0), (238, 158, 6.82e-05), (201, 245, 0.0416)])
def test_binomial(b, c, p):
    assert math.isclose(special.binomial_half(b, c), p, rel_tol=2e-3)


@pytest.mark.parametrize("cells,p", [((18, 22, 53, 133), 0.0592), ((14, 26, 27, 159), 0.0054)])
def test_fisher(cells, p):
    assert abs(special.fisher(*cells) - p) < 6e-5


def test_mcnemar_and_odds(spark):
    df = spark.createDataFrame([(115, 850), (151, 1238), (0, 0)], "b int, c int")
    got = [r.x for r in df.select(S.mcnemar(F.col("b"), F.col("c")).alias("x")).collect()]
    assert [round(x, 1) for x in got[:2]] == [558.3, 849.1] and got[2] is None
    one = spark.createDataFrame([(18, 22, 53, 133), (0, 4, 1, 1)], "a int, b int, c int, d int")
    rows = one.select(*(x.alias(n) for x, n in zip(S.odds_ratio(*(F.col(k) for k in "abcd")), ("r", "lo", "hi"), strict=True))).collect()
    assert [round(rows[0][i], 3) for i in range(3)] == [2.053, 1.020, 4.133] and rows[1].r is None


def test_cramers_v(spark):
    cells = [[170, 16, 8, 5], [37, 371, 0, 12], [53, 3, 337, 11], [17, 13, 4, 3]]
    rows = [(i, j) for i, r in enumerate(cells) for j, n in enumerate(r) for _ in range(n)]
    got = S.chi_squared(spark.createDataFrame(rows, "l int, r int"), "l", "r").first()
    assert round(got.cramers_v, 4) == 0.6474


def test_empty_rate(spark):
    got = S.rate(spark.createDataFrame([(1, None)], "k int, x boolean"), F.col("x"), "k").first()
    assert got.n == 0 and got.rate is None and got.ci_low is None and got.status == "empty_denominator"


def test_sentence(spark):
    lines = "0\tFirst\tlink\n3\tNeil here.\tNeil Gaiman\tNeil Gaiman\n4\t\n5\tCarriage\r"
    df = spark.createDataFrame([(lines, i) for i in (0, 3, 4, 5, 9)], "l string, i int")
    assert [r.s for r in df.select(E.sentence(F.col("l"), F.col("i")).alias("s")).collect()] == ["First", "Neil here.", None, "Carriage", None]


def test_overlap_and_nfc(spark):
    df = spark.createDataFrame([("The film was not released in 2010.", "The film was released in 2010."), ("Claim.", "")], "a string, b string")
    rows = df.select(*(c.alias(n) for n, c in T.overlap(F.col("a"), F.col("b")).items())).collect()
    assert rows[0].lexical_overlap > 0.5 and rows[0].numeric_overlap == 1.0 and rows[1].numeric_overlap == 1.0
    assert spark.createDataFrame([("Café x",)], "t string").select(T.page_key(F.col("t"))).first()[0] == "Café_x"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id int, stage string, judge_no int, verdict string, sufficiency string, confidence int, flags string")
    assert N.consensus(empty).count() == 0 and N.flag_counts(empty).count() == 0


@pytest.mark.parametrize("part", [1000, 3])
def test_near_pairs_are_whole(spark, part):
    """Every link of a group, not only those to the least key of a bucket, against brute force."""
    rng = random.Random(2)
    rows = []
    for g in range(4):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)]
        for _ in range(9):
            text = list(base)
            for at in rng.sample(range(400), rng.randint(2, 7)):
                text[at] = rng.choice("0123456789")
            rows.append((len(rows) * 17 % 37, "".join(text)))
    rows += [(100, rows[0][1]), (101, None), (102, "")]
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in ((i, " ".join(t.split())) for i, t in rows[:36])}
    jaccard = {(a, b): len(x & y) / len(x | y) for a, x in grams.items() for b, y in grams.items() if a < b}
    want = {k: round(v, 9) for k, v in jaccard.items() if v >= 0.85}
    got = D.near_pairs(spark.createDataFrame(rows, "id int, text string"), "text", "id", part=part).collect()
    assert len(want) > 60 and len(got) == len(want) and {(r.a, r.b): round(r.jaccard, 9) for r in got} == want
