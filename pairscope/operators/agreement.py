"""Agreement among raters, from counts a rating item; every coefficient is one or two aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.operators.paired import n_if, share


def item_counts(ratings: DataFrame, values: list[str], *keys: str) -> DataFrame:
    """Per item the votes for each value and their number m."""
    return ratings.filter(F.col("verdict").isNotNull()).groupBy(*keys, "item_id").agg(*(n_if(F.col("verdict") == v).alias(f"n_{i}") for i, v in enumerate(values)), F.count("*").alias("m"))


def judge_pairs(ratings: DataFrame, judges: int, *keys: str, without: str | None = None) -> DataFrame:
    """Agreement of every pair of judges: a panel's few verdicts are put in a row an item, then compared in place.

    without: items (by keys) to which any judge gave this verdict are left out.
    """
    wide = ratings.groupBy(*keys, "item_id").agg(*(F.min(F.when(F.col("judge_no") == j, F.col("verdict"))).alias(f"j{j}") for j in range(1, judges + 1)), n_if(F.col("verdict") == without).alias("__without") if without else F.lit(0).alias("__without")).filter("__without = 0")
    pairs = [(i, j) for i in range(1, judges + 1) for j in range(i + 1, judges + 1)]
    sums = wide.groupBy(*keys).agg(*(x for i, j in pairs for x in (n_if(F.col(f"j{i}") == F.col(f"j{j}")).alias(f"same_{i}_{j}"), n_if(F.col(f"j{i}").isNotNull() & F.col(f"j{j}").isNotNull()).alias(f"n_{i}_{j}"))))
    cells = F.array(*(F.struct(F.lit(i).alias("judge_1"), F.lit(j).alias("judge_2"), F.col(f"same_{i}_{j}").alias("same"), F.col(f"n_{i}_{j}").alias("n")) for i, j in pairs))
    return sums.select(*keys, F.inline(cells)).withColumn("agreement", share(F.col("same"), F.col("n")))


def pairwise(ratings: DataFrame, judges: int, *keys: str, without: str | None = None) -> DataFrame:
    return judge_pairs(ratings, judges, *keys, without=without).groupBy(*keys).agg(F.avg("agreement").alias("mean_agreement"), F.min("agreement").alias("min_agreement"))


def fleiss(counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """Fleiss' kappa of complete panels; 1 where chance agreement is complete."""
    within = sum((F.col(f"n_{i}") * (F.col(f"n_{i}") - 1) for i in range(k)), F.lit(0)) / (F.col("m") * (F.col("m") - 1))
    held = counts.filter("m >= 2").groupBy(*keys).agg(F.count("*").alias("items"), F.avg(within).alias("observed"), F.sum("m").alias("votes"), *(F.sum(f"n_{i}").alias(f"t_{i}") for i in range(k)))
    expected = sum(((F.col(f"t_{i}") / F.col("votes")) * (F.col(f"t_{i}") / F.col("votes")) for i in range(k)), F.lit(0.0))
    return held.select(*keys, "items", "observed", expected.alias("expected"), F.when(expected == 1, 1.0).otherwise((F.col("observed") - expected) / (1 - expected)).alias("kappa"))


def krippendorff(counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """Nominal alpha by coincidences; items with fewer than two votes are left out; 1 where nothing can disagree."""
    apart = sum((F.col(f"n_{i}") * (F.col("m") - F.col(f"n_{i}")) for i in range(k)), F.lit(0)) / (F.col("m") - 1)
    held = counts.filter("m >= 2").groupBy(*keys).agg(F.sum(apart).alias("observed"), F.sum("m").alias("n"), *(F.sum(f"n_{i}").alias(f"t_{i}") for i in range(k)))
    expected = (F.col("n") * F.col("n") - sum((F.col(f"t_{i}") * F.col(f"t_{i}") for i in range(k)), F.lit(0))) / (F.col("n") - 1)
    return held.select(*keys, F.col("n").alias("votes"), F.when(expected == 0, 1.0).otherwise(1 - F.col("observed") / expected).alias("alpha"))


def cohen(pairs: DataFrame, left: str, right: str, values: list[str], *keys: str) -> DataFrame:
    """Cohen's kappa of two raters; null where the margins are constant."""
    held = pairs.groupBy(*keys).agg(F.count("*").alias("n"), n_if(F.col(left) == F.col(right)).alias("same"), *(n_if(F.col(left) == v).alias(f"l_{i}") for i, v in enumerate(values)), *(n_if(F.col(right) == v).alias(f"r_{i}") for i, v in enumerate(values)))
    observed = share(F.col("same"), F.col("n"))
    expected = share(sum((F.col(f"l_{i}") * F.col(f"r_{i}") for i in range(len(values))), F.lit(0)), F.col("n") * F.col("n"))
    return held.select(*keys, "n", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"))
