"""Rolling distinct users against a loop over clicks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import oracle
import pytest

from conftest import SF
from pairscope.llm import rolling

SCHEMA = "click_id bigint, ts timestamp_ntz, client_id bigint, kind string, minute string, n int"
START = datetime(2024, 1, 1)


def brute(rows, measures=rolling.MEASURES):
    """Every minute and kind with a click: users by their clicks in each window."""
    best: dict = {}
    for i, (key, ts, user, kind, *_) in enumerate(rows):
        if ts is None or kind is None:
            continue
        minute = (ts - datetime(1970, 1, 1)) // timedelta(minutes=1)
        click = (minute, kind, user is not None, user or 0)
        slot = ("own", i) if key is None else ("key", key)
        best[slot] = min(best.get(slot, click), click)
    clicks = [(kind, minute, user if known else None) for minute, kind, known, user in best.values()]
    out = set()
    for kind, minute in {(k, m) for k, m, _ in clicks}:
        counts = []
        for window, threshold in measures.values():
            seen: dict = {}
            for k, m, u in clicks:
                if k == kind and minute - window < m <= minute and u is not None:
                    seen[u] = seen.get(u, 0) + 1
            counts.append(sum(v >= threshold for v in seen.values()))
        out.add((kind, minute, *counts))
    return out


def found(frame, measures=rolling.MEASURES):
    rows = [tuple(r) for r in frame.select("kind", "minute", *measures).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clicks_of(seed, n, days, users):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(minutes=rng.randrange(days * 1440) if rng.random() < 0.7 else rng.choice([0, 10079, 10080, 10081, 20160]), seconds=rng.randrange(60))
        rows.append((i if rng.random() < 0.95 else None, at, rng.choice([None, *range(users)]), rng.choice(["a", "b", "b"]), "x", 1))
    rows += rng.sample(rows, n // 10)
    rows += [(n + 1, None, 1, "a", "x", 1), (n + 2, START, 1, None, "x", 1), (n + 3, datetime(1969, 12, 31, 23, 59, 1), 1, "a", "x", 1), (n + 4, START, 1, "a", "x", 1), (n + 4, START - timedelta(minutes=3), 1, "a", "x", 1)]
    return rows


@pytest.mark.parametrize("heavy", [1, 6, 10**9])
def test_all_heavy_some_heavy_none_heavy(spark, heavy):
    rows = clicks_of(heavy % 97, 300, 30, 12)
    got = rolling.rolling_users(spark.createDataFrame(rows, SCHEMA), heavy=heavy)
    assert found(got) == brute(rows)


def test_more_users_than_a_matrix_has_rows(spark, monkeypatch):
    rows = clicks_of(5, 250, 9, 9)
    per = rolling.minutes(spark.createDataFrame(rows, SCHEMA)).filter("user is not null").coalesce(1)
    few, many = (rolling.dense(per, rolling.MEASURES, 10_080, users=u).groupBy("kind", "minute").sum(*rolling.MEASURES).filter(" or ".join(f"`sum({m})` <> 0" for m in rolling.MEASURES)) for u in (2, 64))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_other_windows_and_thresholds(spark):
    measures = {"two_in_seven": (7, 2), "four_in_hour": (60, 4), "any_in_two": (2, 1)}
    rows = clicks_of(8, 300, 1, 4)
    got = rolling.rolling_users(spark.createDataFrame(rows, SCHEMA), measures, heavy=20)
    assert found(got, measures) == brute(rows, measures)


def test_times_with_a_zone_and_another_session_zone(spark):
    rows = clicks_of(9, 60, 3, 4)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        plain = found(rolling.rolling_users(spark.createDataFrame(rows, SCHEMA)))
        zoned = spark.createDataFrame(rows, SCHEMA).selectExpr("cast(ts as timestamp) as ts")
        minutes = {r[0] for r in zoned.select(rolling.minute_of(zoned, "ts").alias("m")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert plain == brute(rows)
    assert min(m for m in minutes if m is not None) == 299  # 23:59 of the last day of 1969 in New York


def test_empty_and_only_unknown_users(spark):
    assert rolling.rolling_users(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, START, None, "a", "x", 1), (1, START, None, "a", "x", 1)]
    assert found(rolling.rolling_users(spark.createDataFrame(rows, SCHEMA))) == {("a", 28401120, 0, 0, 0, 0)}


def test_twin(spark):
    assert oracle.compare(spark, oracle.connect(SF), rolling.op11, rolling.OP11_SQL, SF) is None
