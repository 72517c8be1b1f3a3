"""Models on study tables: logistic regression, folds by group, leakage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.functions import special
from pairscope.functions.text import normalized
from pairscope.operators import ranks
from pairscope.storage import settle


def fold_of(key: Column, k: int = 5) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """rows with fold: all rows of a group in one fold, from the group's md5."""
    return rows.withColumn("fold", fold_of(F.col(group), k))


def _newton(rows: DataFrame, y: str, x: list[str], ridge: float, rounds: int = 25) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Coefficients (intercept first) and their covariance by Newton steps; each step is one aggregate of a few sums.

    None where the information matrix cannot be inverted.
    """
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    d = len(columns)
    held = rows.select(F.col(y).cast("double").alias("__y"), *(c.alias(f"__{i}") for i, c in enumerate(columns))).groupBy("__y", *(f"__{i}" for i in range(d))).agg(F.count("*").cast("double").alias("__n")).cache()
    beta = np.zeros(d)
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * F.col(f"__{i}") for i, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        sums = held.agg(*(F.sum(F.col("__n") * (F.col("__y") - p) * F.col(f"__{i}")) for i in range(d)), *(F.sum(F.col("__n") * p * (1 - p) * F.col(f"__{i}") * F.col(f"__{j}")) for i in range(d) for j in range(d))).first()
        keep = np.diag([0.0] + [ridge] * (d - 1))
        gradient = np.array(sums[:d], float) - keep @ beta
        information = np.array(sums[d:], float).reshape(d, d) + keep
        if not np.isfinite(information).all() or np.linalg.matrix_rank(information) < d:
            held.unpersist()
            return None, None
        step = np.linalg.solve(information, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    held.unpersist()
    return beta, np.linalg.inv(information)


def logit(rows: DataFrame, y: str, x: list[str]) -> DataFrame:
    """term, coefficient, standard error, z, Wald p and interval of an unpenalized logistic regression, and its status.

    Where the classes can be told apart without error the likelihood has no maximum: the status is `separated` and the
    figures but the term are null. One class only, or no rows at all, is `not_estimable_one_class`.
    """
    kinds = rows.agg(F.count_distinct(y)).first()[0]
    status, beta, cov = "not_estimable_one_class", None, None
    if kinds > 1:
        beta, cov = _newton(rows, y, x, 0.0)
        status = "separated" if beta is None or np.abs(beta).max() > 20 or np.diag(cov).max() > 1e4 else "estimated"
    out = []
    for i, name in enumerate(["intercept", *x]):
        if status != "estimated":
            out.append((name, *[None] * 6, status))
            continue
        b, se = float(beta[i]), float(np.sqrt(cov[i, i]))
        out.append((name, b, se, b / se, special.normal_two_sided(b / se), b - 1.959963984540054 * se, b + 1.959963984540054 * se, status))
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, se double, z double, p double, ci_low double, ci_high double, status string")


def l2_logistic(rows: DataFrame, y: str, x: list[str], c: float = 1.0) -> DataFrame:
    """term and coefficient of a logistic regression with penalty 1/c on all but the intercept, by size."""
    beta, _ = _newton(rows, y, x, 1.0 / c)
    terms = [] if beta is None else sorted(zip(["intercept", *x], map(float, beta), strict=True), key=lambda t: -abs(t[1]))
    return rows.sparkSession.createDataFrame(terms, "term string, coefficient double")


def imputed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with each column's nulls filled by its exact median (null stays where a column has no value)."""
    out = rows
    for c in columns:
        middle = ranks.medians(rows.select(c).withColumn("__n", F.lit(1)), [], c, "__n").select(F.col("median").alias(f"__{c}"))
        out = out.crossJoin(F.broadcast(middle)).withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"__{c}"))).drop(f"__{c}")
    return out


def binned(rows: DataFrame, x: list[str], bins: int = 32) -> dict[str, Column]:
    """Each column as it is where it has `bins` values at most, else the number of its quantiles (over all rows) below it."""
    out = {}
    for c in x:
        few = rows.select(c).distinct().limit(bins + 1).count() <= bins
        edges = [] if few else sorted(set(rows.approxQuantile(c, [i / bins for i in range(1, bins)], 0.1 / bins)))
        out[c] = F.col(c).cast("double") if few else sum(((F.col(c) > e).cast("double") for e in edges), F.col(c).cast("double") * 0)
    return out


def boosted(rows: DataFrame, y: str, x: list[str], key: str, fold: str, k: int = 5, depth: int = 3, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(key, y, score): out-of-fold probabilities of gradient-boosted trees, each fold scored by trees of the others.

    Trees see a feature in 32 bins, so all rows with the same bins, label and fold are one row of their number as weight:
    the many passes of a fit go over these cells, the rows are read a few times whatever the rounds and folds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    held = settle(rows.select(key, fold, F.col(y).cast("double").alias("__y"), *x))
    at = binned(held, x)
    names = [f"__b{i}" for i in range(len(x))]
    marked = held.select(key, fold, "__y", *(at[c].alias(n) for c, n in zip(x, names, strict=True)))
    cells = settle(marked.groupBy(fold, "__y", *names).agg(F.count("*").cast("double").alias("__w")))
    assembled = VectorAssembler(inputCols=names, outputCol="__x").transform(cells)
    out = None
    for i in range(k):
        trees = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxDepth=depth, maxIter=rounds, seed=seed).fit(assembled.filter(F.col(fold) != i))
        part = trees.transform(assembled.filter(F.col(fold) == i).dropDuplicates(names)).select(F.col(fold).alias(fold), *names, vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return marked.join(settle(out), [fold, *names]).select(key, F.col("__y").alias("y"), "score")


def clusters(rows: DataFrame, vector: str, k: int, seeds: list[int], gate: float = 0.5) -> DataFrame:
    """(seed_1, seed_2, ari, stable): how well k-means of two seeds agree (adjusted Rand index), and whether enough."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    held = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    models = {s: KMeans(k=k, seed=s, maxIter=20).fit(held) for s in seeds}
    out = None
    for i, a in enumerate(seeds):
        for b in seeds[i + 1 :]:
            both = models[b].setPredictionCol("b").transform(models[a].setPredictionCol("a").transform(held))
            part = adjusted_rand(both, "a", "b").select(F.lit(a).alias("seed_1"), F.lit(b).alias("seed_2"), "ari", (F.col("ari") >= gate).alias("stable"))
            out = part if out is None else out.unionByName(part)
    return out


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two groupings, from the counts of their cells; 1 where neither could differ."""
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias(f"s_{k}"))
    held = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n")).crossJoin(F.broadcast(side("a"))).crossJoin(F.broadcast(side("b")))
    chance = F.col("s_a") * F.col("s_b") / F.nullif(two("n"), F.lit(0.0))
    top = (F.col("s_a") + F.col("s_b")) / 2
    return held.select(F.col("n"), F.when(top == chance, 1.0).otherwise((F.col("s") - chance) / (top - chance)).alias("ari"))


def leakage(rows: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """Groups of equal normalized text, and how many of them plain folds by key would tear apart."""
    held = rows.groupBy(normalized(F.col(text)).alias("t")).agg(F.count("*").alias("n"), F.count_distinct(fold_of(F.col(key), k)).alias("folds"))
    return held.agg(F.sum("n").alias("total_rows"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.count_if(F.col("folds") > 1).alias("groups_across_folds"))
