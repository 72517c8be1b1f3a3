"""Whitening against numpy over the whole table, and exact sums against Python's numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from conftest import SF
from pairscope.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int"


def codes(rows, dims):
    out = []
    for key, vector, *_ in rows:
        if vector is None or len(vector) != dims or any(c is None or not math.isfinite(c) for c in vector):
            continue
        x = [math.floor(1024 * float(np.float32(c))) + 100_000 for c in vector]
        if max(map(abs, x)) < 2**62:
            out.append((key, x))
    return out


def brute(rows, dims, components=8):
    """(key, deviation, whitened) a vector, explained a component, by whole-table algebra."""
    kept = codes(rows, dims)
    n, sums = len(kept), [sum(x[d] for _, x in kept) for d in range(dims)]
    z = np.array([[float(v - s // n) - (s % n) / n for v, s in zip(x, sums, strict=True)] for _, x in kept])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, dims)
    with np.errstate(divide="ignore", invalid="ignore"):
        white = z @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = [sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)) for _, x in kept]
    return [key for key, _ in kept], deviation, white, values[:k] / values.sum()


def vectors_of(seed, n, dims):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) * np.linspace(1, 3, dims) @ rng.normal(size=(dims, dims))
    rows = [(i, [float(v) for v in row], 0, 1) for i, row in enumerate(mixed)]
    rows += [(None, rows[0][1], 0, 1), (3, rows[3][1], 0, 1), (-1, None, 0, 1), (-2, [None] + rows[1][1][1:], 0, 1), (-3, [float("nan")] + rows[1][1][1:], 0, 1)]
    rows += [(-4, [float("inf")] + rows[1][1][1:], 0, 1), (-5, [], 0, 1), (-6, [1.0] * (dims + 1), 0, 1), (-7, [3e38] + rows[1][1][1:], 0, 1)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("dims, columns, block", [(20, 7, 16), (5, 32, 4096), (1, 1, 3)])
def test_equals_the_whole_table(spark, dims, columns, block):
    rows = vectors_of(dims, 150, dims)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), rows=block, columns=columns).collect()
    keys, deviation, white, explained = brute(rows, dims)
    assert len(got) == len(keys)
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    signs = None
    for r in got:
        i = first[r["vec_id"]]
        assert r["n"] == len(keys) and int(r["deviation"]) == deviation[i]
        mine = np.array(r["whitened"])
        signs = np.sign(mine * white[i]) if signs is None else signs
        assert np.allclose(mine * signs, white[i], atol=1e-8)
        assert np.allclose(r["explained"], explained, rtol=1e-10) and r["identity_error"] < 1e-9


def test_fewer_dimensions_than_entries(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0], 0, 1) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in got)
    assert got[0]["identity_error"] < 1e-9 and abs(got[0]["explained"][0] - 1) < 1e-12


def test_one_vector_and_none(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 0, 1)], SCHEMA)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, [None, None], [None, None], None)]
    for rows in ([], [(1, None, 0, 1)], [(1, [None], 0, 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_sums_beyond_doubles(spark):
    rows = [(i, [v], 0, 1) for i, v in enumerate([4e15, -4e15, 1e10, 0.0, 1.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    keys, deviation, *_ = brute(rows, 1)
    assert {k: d if d < 10**38 else None for k, d in zip(keys, deviation, strict=True)} == {k: d if d is None else int(d) for k, d in got.items()}


def test_query_over_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    dims = len(rows[0][1])
    keys, deviation, white, explained = brute(rows, dims)
    got = {(r["vec_id"], r["component"]): r for r in whitening.op12(spark, SF).collect()}
    assert len(got) == 8 * len(keys)
    for c in range(8):
        mine = np.array([got[k, c + 1]["whitened"] for k in keys])
        assert np.allclose(mine * np.sign(mine[0] * white[0, c]), white[:, c], atol=1e-7)
        assert all(got[k, c + 1]["deviation"] == d for k, d in zip(keys, deviation, strict=True))
        assert abs(got[keys[0], c + 1]["explained"] - explained[c]) < 1e-10
