"""Cohorts: priority classes, terciles, blinding ids, matched controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators.intake import draw
from pairscope.operators.ranks import placed


def cohort_class(first: Column, second: Column) -> Column:
    """The class of a claim over two models, by priority, so classes exclude each other."""
    either = lambda t: (first == t) | (second == t)
    return F.when(either("regression"), "regression").when(either("resistant"), "resistant").when(either("rescue"), "rescue").otherwise("robust")


def regression_type(first: Column, second: Column) -> Column:
    a, b = first == "regression", second == "regression"
    return F.when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("")


def terciles(rows: DataFrame, value: str, key: str, within: str | None = None, name: str = "tercile") -> DataFrame:
    """rows with a bin 1 to 3 by rank (of the whole table, or within a group); ties broken by key, edges as quantiles of the ranks."""
    held = placed(rows, [within] if within else [], [value, key])
    r, n = F.col("position"), F.col("size")
    return held.select(*rows.columns, F.when(3 * (r - 1) < n - 1, 1).when(3 * (r - 1) < 2 * (n - 1), 2).otherwise(3).alias(name))


def opaque_ids(rows: DataFrame, key: str, salt: str, prefix: str = "SA-", digits: int = 6) -> DataFrame:
    """rows with opaque: sequential ids over the whole table in the order of salted md5; every row has its own.

    An id has `digits` digits, or as many as the number of rows has, so ids sort as text as they do by number."""
    held = placed(rows, [], [F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), F.col(key)])
    return held.select(*rows.columns, F.concat(F.lit(prefix), F.lpad(F.col("position").cast("string"), F.greatest(F.lit(digits), F.length(F.col("size").cast("string"))), F.lit("0"))).alias("opaque"))


def matched(targets: DataFrame, pool: DataFrame, keys: list[str], key: str, seed: str, most: int = 250) -> DataFrame:
    """`most` controls at most: as many of each stratum as it has targets, in md5 order, topped up from the rest of the
    pool in md5 order where that gives fewer; pick tells stratum or top_up."""
    wanted = targets.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count("*").alias("wanted"))
    order = [draw(seed, key), F.col(key)]
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    dealt = placed(pool, keys, order).join(F.broadcast(wanted) if wanted.count() <= 100_000 else wanted, same, "left")
    ranked = dealt.select(*pool.columns, F.when(F.col("position") <= F.col("wanted"), "stratum").otherwise("top_up").alias("pick"))
    return ranked.orderBy((F.col("pick") == "top_up").cast("int"), *order).limit(most)
