"""Publication of tables: what a reader sees when a writer stops, and what two writers do to each other."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from pairscope.operators import cohort as C
from pairscope.operators import provenance as Q
from pairscope.sources import sinks
from pyspark.sql import functions as F


def test_a_stopped_writer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path)
    sinks.replace(spark.range(3), path)
    monkeypatch.setattr(sinks, "_point", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        sinks.replace(spark.range(9), path)
    monkeypatch.undo()
    assert sinks.current(spark, path).count() == 3
    # a writer that stopped before it wrote its pointer's text
    where, store = sinks._store(spark, f"{path}/{sinks.POINTERS}/{7:020d}")
    store.create(where, False).close()
    assert sinks.current(spark, path).count() == 3
    sinks.replace(spark.range(5), path)
    assert sinks.current(spark, path).count() == 5 and sinks.swept(spark, path) == 2 and sinks.current(spark, path).count() == 5


def test_writers_at_once(spark, tmp_path):
    path, folder = str(tmp_path / "t"), str(tmp_path / "v")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: sinks.replace(spark.range(n), path), range(1, 9)))
    assert len(sinks._numbers(spark, path)) == 8 and sinks.current(spark, path).count() in range(1, 9)

    def version(n):
        try:
            return sinks.versioned(spark.range(n), folder, "v1") and n
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [n for n in pool.map(version, range(1, 9)) if n]
    assert len(won) == 1 and spark.read.parquet(f"{folder}/v1").count() == won[0]
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if not p.name.startswith(".claims")) == ["v1"]


def test_digests_tell_nulls_and_cuts_apart(spark):
    rows = lambda *r: Q.manifest(spark.createDataFrame([("k", *x) for x in r], "k string, a string, b string"), ["k"], ["a", "b"])
    status = lambda x, y: Q.drift(rows(*x), rows(*y), ["k"]).first()["status"]
    assert status([("a", "b"), ("c", None)], [("c", None), ("a", "b")]) == "unchanged"
    for x, y in (([("a", None)], [("a", "")]), ([("a|b", "c")], [("a", "b|c")]), ([("1:a", "b")], [("1", "a:b")]), ([("a", "b"), ("a", "b")], [("a", "b"), ("a", "c")]), ([(None, "-")], [("-", None)])):
        assert status(x, y) == "changed"


def test_opaque_ids_are_as_wide_as_the_count(spark):
    got = [r["opaque"] for r in C.opaque_ids(spark.range(1, 1203).withColumnRenamed("id", "k"), "k", "s", digits=3).collect()]
    assert len(set(got)) == 1202 and {len(x) for x in got} == {7} and max(got) == "SA-1202"
    assert C.opaque_ids(spark.range(2), "id", "s").agg(F.max("opaque")).first()[0] == "SA-000002"
