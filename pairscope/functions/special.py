"""Tail probabilities that Spark has no function for, as vectorized functions for small tables of statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def beta_ratio(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (Lentz); about sqrt(a + b) steps."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_ratio(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def binomial_half(b: int, c: int) -> float:
    """Two-sided exact p of b against c at one half; 1 where both are 0."""
    n, k = int(b + c), int(min(b, c))
    if 2 * k >= n:
        return 1.0
    return min(1.0, 2 * beta_ratio(n - k, k + 1, 0.5))


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2x2 table: tables no likelier than the one seen.

    Weights are taken relative to the likeliest table, step by step away from it until they no longer count.
    """
    a, b, c, d = int(a), int(b), int(c), int(d)
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - n), min(row, col)
    mode = min(high, max(low, (row + 1) * (col + 1) // (n + 2)))
    weigh = lambda x: log_choose(col, x) + log_choose(n - col, row - x)
    bar = math.exp(weigh(a) - weigh(mode)) * (1 + 1e-7)
    total = tail = 0.0
    for step, stop in ((1, high), (-1, low)):
        x, w = mode, 1.0
        while True:
            if step == 1 or x != mode:
                total += w
                tail += w if w <= bar else 0.0
            if x == stop or w < 1e-20 * total:
                break
            w *= (col - x) * (row - x) / ((x + 1) * (n - col - row + x + 1)) if step == 1 else x * (n - col - row + x) / ((col - x + 1) * (row - x + 1))
            x += step
    # beyond where weights count, the table seen itself may lie: its own weight is the least to report
    return min(1.0, max(tail, bar / (1 + 1e-7)) / total)


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of chi squared with whole degrees of freedom, by the finite sums."""
    if x <= 0:
        return 1.0
    h, dof = x / 2, int(dof)
    if dof % 2 == 0:
        return math.exp(-h) * math.fsum(h**i / math.factorial(i) for i in range(dof // 2))
    return math.erfc(math.sqrt(h)) + math.exp(-h) * math.fsum(h ** (i + 0.5) / math.gamma(i + 1.5) for i in range(dof // 2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def apply(f, *columns: Column) -> Column:
    """f over columns, null where any of them is."""

    @F.pandas_udf("double")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in rows.itertuples(index=False)], dtype="float64")

    return run(F.struct(*(c.alias(f"a{i}") for i, c in enumerate(columns))))
