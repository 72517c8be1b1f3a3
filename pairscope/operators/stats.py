"""Inference over contingency counts, ranks and groups. Counts come from one aggregate; the rest is column math."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscope.functions import special
from pairscope.operators.paired import share
from pairscope.operators.ranks import cumulated, placed
from pairscope.storage import settle

Z95 = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, clipped to 0 and 1; null where n is 0."""
    p = share(hits, n)
    size = F.nullif(n, F.lit(0)).cast("double")
    middle = (p + z * z / (2 * size)) / (1 + z * z / size)
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / (1 + z * z / size)
    # greatest() and least() pass over nulls, so an empty group is guarded
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


#: What a rate's status says in reports.
REPORTED = ("estimated", "not_estimable_empty_denominator")


def rate(rows: DataFrame, hit: Column, *keys: str, status: tuple[str, str] = ("ok", "empty_denominator")) -> DataFrame:
    """n, hits, rate and its Wilson interval, with a status; an empty group has no rate."""
    held = rows.groupBy(*keys).agg(F.count(hit).alias("n"), F.count_if(hit).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return held.select(*keys, "n", "hits", F.when(F.col("n") == 0, status[1]).otherwise(status[0]).alias("status"), share(F.col("hits"), F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def mcnemar(b: Column, c: Column) -> Column:
    """Chi squared with continuity correction; null where no pair differs."""
    return F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double"), 2) / F.nullif(b + c, F.lit(0)).cast("double")


def odds_ratio(a: Column, b: Column, c: Column, d: Column, mode: str = "strict") -> tuple[Column, Column, Column]:
    """Odds ratio and its Wald interval. mode strict: null unless all cells are positive; floor: cells of 0 become one half."""
    cells = [F.greatest(x.cast("double"), F.lit(0.5)) if mode == "floor" else F.when(x > 0, x.cast("double")) for x in (a, b, c, d)]
    ratio = cells[0] * cells[3] / (cells[1] * cells[2])
    spread = Z95 * F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3])
    return ratio, F.exp(F.ln(ratio) - spread), F.exp(F.ln(ratio) + spread)


def chi_squared(rows: DataFrame, left: str, right: str) -> DataFrame:
    """One row: n, rows, columns, statistic (Yates for 2x2), phi and Cramer's V; null where a margin is constant.

    Only cells that occur are looked at: the sum of squares over all cells is n less than the sum of o * o / e over those.
    In a 2x2 table every cell is as far from what is expected, so one cell tells the correction.
    """
    cells = settle(rows.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count("*").alias("o")))
    lefts = cells.groupBy(F.col("l").alias("__l")).agg(F.sum("o").cast("double").alias("lt"))
    rights = cells.groupBy(F.col("r").alias("__r")).agg(F.sum("o").cast("double").alias("rt"))
    margin = lambda m, c, k: m.agg(F.sum(c).alias("n"), F.count("*").alias(f"k_{k}"), F.sum(1 / F.col(c)).alias(f"i_{k}"))
    whole = margin(lefts, "lt", "left").crossJoin(F.broadcast(margin(rights, "rt", "right").drop("n")))
    each = cells.join(lefts, F.col("l").eqNullSafe(F.col("__l"))).join(rights, F.col("r").eqNullSafe(F.col("__r")))
    product = F.col("lt") * F.col("rt")
    sums = each.agg(F.sum(F.col("o") * F.col("o") / product).alias("s"), F.max_by(F.struct("o", product.alias("p")), F.col("o")).alias("one"))
    held = sums.crossJoin(F.broadcast(whole))
    n = F.col("n")
    plain = F.greatest(n * F.col("s") - n, F.lit(0.0))
    gap = F.abs(F.col("one.o") - F.col("one.p") / n)
    shifted = F.pow(gap - F.least(F.lit(0.5), gap), 2) * n * F.col("i_left") * F.col("i_right")
    fit = (F.col("k_left") >= 2) & (F.col("k_right") >= 2)
    least = F.least("k_left", "k_right") - 1
    chi2 = F.when((F.col("k_left") == 2) & (F.col("k_right") == 2), shifted).otherwise(plain)
    return held.select(n.cast("bigint").alias("n"), "k_left", "k_right", F.when(fit, chi2).alias("chi2"), F.when(fit, F.sqrt(plain / n)).alias("phi"), F.when(fit, F.sqrt(plain / (n * least))).alias("cramers_v"))


def adjusted(tests: DataFrame, p: str = "p", family: str = "family") -> DataFrame:
    """Benjamini-Hochberg within a family: p_bh, and the size of the family; null p are left out of it (size 0).

    The running minimum from the largest p down is one within each range of ranks and one over later ranges of the family.
    """
    tests = settle(tests)
    held = placed(tests.filter(F.col(p).isNotNull()), [family], [F.col(p), F.col("test")]).withColumn("__q", F.col(p) * F.col("size") / F.col("position"))
    down = W.partitionBy(family).orderBy(F.col("__part").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = held.groupBy(family, "__part").agg(F.min("__q").alias("__least")).select(F.col(family).alias("__family"), F.col("__part").alias("__range"), F.min("__least").over(down).alias("__later"))
    inside = W.partitionBy(family, "__part").orderBy(F.col("__at").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = held.withColumn("__least", F.min("__q").over(inside)).join(later, F.col(family).eqNullSafe(F.col("__family")) & (F.col("__part") == F.col("__range")))
    least = F.least("__least", F.coalesce("__later", F.lit(1.0)), F.lit(1.0))
    names = tests.columns
    out = found.select(*names, F.greatest(F.lit(0.0), least).alias("p_bh"), F.col("size").cast("bigint").alias("family_size"))
    return out.unionByName(tests.filter(F.col(p).isNull()).select(*names, F.lit(None).cast("double").alias("p_bh"), F.lit(0).cast("bigint").alias("family_size")))


def value_ranks(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """A row a distinct value: how often it occurs, in all and by key columns' sums, how many rows lie below it, and its
    average rank. What is ordered is the histogram, and that by ranges."""
    held = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("times"), *(F.sum(F.col(k).cast("bigint")).alias(k) for k in keys))
    below = cumulated(settle(held), [value], below=F.col("times"), **{f"{k}_below": F.col(k) for k in keys})
    return below.withColumn("avg_rank", F.col("below") + (F.col("times") + 1) / 2.0)


def kruskal(rows: DataFrame, value: str, group: str, least: int = 20) -> DataFrame:
    """H with the correction for ties over groups of `least` rows or more."""
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    kept = rows.filter(F.col(value).isNotNull()).join(sizes, group)
    cells = kept.groupBy(value, group).agg(F.count("*").alias("c"), F.max("size").alias("size"))
    ranks = value_ranks(kept, value).select(value, "times", "avg_rank")
    sums = cells.join(ranks, value).groupBy(group).agg(F.sum(F.col("c") * F.col("avg_rank")).alias("r"), F.max("size").alias("size"))
    ties = ranks.agg(F.sum(F.pow(F.col("times").cast("double"), 3) - F.col("times")).alias("t"), F.sum("times").alias("n"))
    held = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("size")).alias("s"), F.count("*").alias("groups")).crossJoin(F.broadcast(ties))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return held.select("n", "groups", h.alias("h"))


def _ranked(ranks: DataFrame) -> DataFrame:
    held = ranks.agg(F.sum("times").alias("n"), F.sum("__pos").alias("n1"), F.sum(F.col("__pos") * F.col("avg_rank")).alias("r1"), F.sum(F.pow(F.col("times").cast("double"), 3) - F.col("times")).alias("t"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    gap = F.abs(u - n1 * n2 / 2)
    return held.select("n", "n1", u.alias("u"), (F.greatest(gap - 0.5, F.lit(0.0)) / sd).alias("z"), (u / (n1 * n2)).alias("auc"))


def mann_whitney(rows: DataFrame, value: str, positive: str) -> DataFrame:
    """U of the positive group, z with ties and continuity, and the area under the curve, from the value histogram."""
    return _ranked(value_ranks(rows.withColumn("__pos", F.col(positive).cast("int")), value, "__pos"))


def curves(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """AUC, average precision over distinct thresholds, and Brier score; the histogram is ordered once."""
    held = rows.withColumn("__pos", F.col(positive).cast("int"))
    ranks = value_ranks(held, score, "__pos")
    total = ranks.agg(F.sum("times").alias("all"), F.sum("__pos").alias("all_pos"))
    at = ranks.crossJoin(F.broadcast(total))
    precision = (F.col("all_pos") - F.col("__pos_below")) / (F.col("all") - F.col("below"))
    ap = at.agg((F.sum(F.col("__pos") * precision) / F.max("all_pos")).alias("average_precision"))
    brier = held.agg(F.avg(F.pow(F.col(score) - F.col("__pos"), 2)).alias("brier"))
    return _ranked(ranks).select("auc").crossJoin(F.broadcast(ap)).crossJoin(F.broadcast(brier))


def md5_share(c: Column) -> Column:
    """A draw in [0, 1) from the first eight hex digits of the md5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("double") / 4294967296.0


def bootstrap(rows: DataFrame, key: str, hit: str, *keys: str, iterations: int = 2000, buckets: int = 1024) -> DataFrame:
    """Percentile interval of a rate by key columns. Rows are dealt to buckets by the md5 of their key; each replicate
    weighs a bucket by a Poisson(1) draw of an md5. What is drawn for is a bucket's sums, whatever the number of rows."""
    bounds, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        bounds.append(total)
        term /= k + 1
    times = F.lit(8)
    for k in reversed(range(8)):
        times = F.when(F.col("u") < bounds[k], k).otherwise(times)
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    sums = rows.groupBy(*keys, bucket.alias("b")).agg(F.count(hit).alias("n"), F.sum(F.col(hit).cast("bigint")).alias("h"))
    draws = sums.select(*keys, "b", "n", "h", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("i"))
    weighed = draws.withColumn("u", md5_share(F.concat_ws(":", F.col("i").cast("string"), F.col("b").cast("string")))).select(*keys, "i", "n", "h", times.alias("w"))
    means = weighed.groupBy(*keys, "i").agg((F.sum(F.col("w") * F.col("h")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    return means.groupBy(*keys).agg(F.count("m").alias("replicates"), F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))


def discordant(rows: DataFrame, before: Column, after: Column, *keys: str) -> DataFrame:
    """b (before only) and c (after only) by key, with both McNemar tests."""
    held = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(before & ~after).alias("b"), F.count_if(~before & after).alias("c"))
    return held.withColumn("chi2", mcnemar(F.col("b"), F.col("c")))


def with_p(tests: DataFrame) -> DataFrame:
    """Adds the asymptotic and the exact p of discordant()."""
    return tests.withColumn("p_asymptotic", special.apply(lambda x: special.chi2_tail(x, 1), F.col("chi2"))).withColumn("p_exact", special.apply(special.binomial_half, F.col("b"), F.col("c")))
