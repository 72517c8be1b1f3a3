"""Mixing against plain loops: shares, draws, limits, awkward rows."""

from __future__ import annotations

import hashlib
import math
import random

import oracle
import pytest

from conftest import SF
from pairscope.llm import mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, source string, target string, size string, row int, no int"


def shares(sizes: dict, weights=(1, 2, 3), most=3):
    """Targets by resharing what is over, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0.0
        over = [s for s in open_ if most * sizes[s] < weight[s] * level]
        if not over:
            return {s: float(most * sizes[s]) if s in full else weight[s] * level for s in order}
        full |= set(over)


def brute(rows):
    sized = [(key, source, len([w for w in __import__("re").split("[ \t-\r]+", text or "") if w])) for key, text, source, *_ in rows]
    sums: dict = {}
    for _, source, n in sized:
        sums[source] = sums.get(source, 0) + n
    aims, out = shares(sums), []
    for source, aim in aims.items():
        mine, ranked = [r for r in sized if r[1] == source], []
        copies = min(3.0, aim / sums[source]) if sums[source] else 0.0
        sure, part = math.floor(copies), copies - math.floor(copies)
        room = math.floor(aim - sure * sums[source])
        for i, (key, _, n) in enumerate(mine):
            draw = (int(hashlib.md5("|".join(["42", "" if key is None else str(key), source or "", str(n)]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if part > 0 and n:
                odds = (draw / (1 - draw)) / (part / (1 - part))
                ranked.append((math.floor(odds / (1 + odds) * float(2**53 - 1)), i))
        pool, taken = sorted(ranked), set()
        for _ in range(mixing.ROUNDS):
            cut = None
            for at, (_, i) in enumerate(pool):
                if mine[i][2] > room:
                    cut = at
                    break
                taken.add(i)
                room -= mine[i][2]
            if cut is None or room <= 0:
                break
            pool = [(r, i) for r, i in pool[cut + 1 :] if mine[i][2] <= room]
        spare = sorted((abs(mine[i][2] - room), r, i) for r, i in ranked if i not in taken and abs(mine[i][2] - room) < room)
        if spare and room > 0:
            taken.add(spare[0][2])
        out += [(key, n, sums[source], aim, n * (sure + (i in taken))) for i, (key, _, n) in enumerate(mine)]
    return sorted(out, key=repr)


def documents(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = 4000 if rng.random() < 0.03 else rng.choice([0, 1, 5, 17, 60, 120])
        rows.append((rng.choice([i, i, i, None, 3]), rng.choice(["\t", " \n", " "]).join(["w"] * size) if rng.random() < 0.95 else None, rng.choice(["hot"] * 6 + ["a", "é", "z", "Z", "", None]), "x", "y", 1, 2))
    return rows + rows[: n // 5] + [(1, "", "empty", "x", "y", 1, 2), (2, None, "empty", "x", "y", 1, 2), (3, "w " * 9000, "one", "x", "y", 1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_loops(spark, seed):
    rows = documents(seed, 240)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_digits_are_searched_to_the_last_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DIGIT", 20)
    rows = [(7, "a b c", "s", "x", "y", 1, 2)] * 40 + [(8, "a " * 90, "t", "x", "y", 1, 2)] * 2
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_preference_within_a_source(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b"][i % 2], "x", "y", 1, 2) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, favour=F.when(F.col("doc_id") % 4 < 2, 5.0).when(F.col("doc_id") % 8 < 4, None).otherwise(1.0)).collect()
    for source in (0, 1):
        mine = [r for r in got if r["doc_id"] % 2 == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4 and max(r["copies"] for r in mine) <= 3
        liked = [r["copies"] for r in mine if r["doc_id"] % 4 < 2]
        less = [r["copies"] for r in mine if r["doc_id"] % 8 >= 6 or r["doc_id"] % 8 in (4, 5) and r["doc_id"] % 4 >= 2]
        assert sum(liked) / len(liked) > sum(less) / len(less)


def test_inclusion_follows_the_probabilities(spark):
    draws = spark.range(20_000).select("id", mixing.uniform(F.col("id")).alias("u"))
    found = draws.agg(F.avg("u").alias("m"), F.min("u").alias("a"), F.max("u").alias("b")).first()
    assert abs(found["m"] - 0.5) < 0.01 and 0 < found["a"] and found["b"] < 1
    likely = F.when(F.col("id") % 2 == 0, 0.75).otherwise(0.25)
    taken = draws.withColumn("k", mixing.pareto_rank(F.col("u"), likely)).orderBy("k").limit(10_000)
    assert abs(taken.filter("id % 2 = 0").count() / 10_000 - 0.75) < 0.02


def test_nothing_and_only_empty_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, "x", "y", 1, 2), (2, " ", "a", "x", "y", 1, 2)]
    assert sorted(tuple(r)[1:6] for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()) == [(0, 0, 0.0, 0, 0)] * 2


def test_twin(spark):
    assert oracle.compare(spark, oracle.connect(SF), mixing.op13, mixing.OP13_SQL, SF) is None
