"""Checks: schemas, order, completeness, attempts, logs, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checks(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row a rule: violations and PASS or FAIL, all in one scan. A rule is true where a row violates it."""
    return _verdicts(rows.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items())), list(rules))


def _verdicts(sums: DataFrame, names: list[str]) -> DataFrame:
    return sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("violations")) for n in names)))).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def id_checks(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """Two checks of ids: how many rows break the format, and how many repeat an id."""
    kinds = rows.groupBy(key).agg(F.count("*").alias("n"))
    sums = kinds.agg(F.coalesce(F.sum(F.when(~F.col(key).rlike(pattern), F.col("n"))), F.lit(0)).alias("bad_format"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return _verdicts(sums, ["bad_format", "repeated"])


def headlines(metrics: DataFrame, registry: list[tuple[str, float, float]]) -> DataFrame:
    """metrics(id, value) against (id, expected, tolerance): a metric that is missing fails."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame(registry, "id string, expected double, tol double")
    return wanted.join(metrics, "id", "left").select("id", "expected", "value", F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tol"), F.lit(False)).alias("ok"))


def difference(left: DataFrame, right: DataFrame, ignore: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows on one side only, with the side, repeats counted; ignored columns play no part."""
    names = [c for c in left.columns if c not in ignore]
    a, b = left.select(*names), right.select(*names)
    both = a.withColumn("__d", F.lit(1)).unionByName(b.withColumn("__d", F.lit(-1))).groupBy(*names).agg(F.sum("__d").alias("__d"))
    return both.filter("__d <> 0").select(*names, F.when(F.col("__d") > 0, "left").otherwise("right").alias("side"), F.abs("__d").alias("times"))


def carried(lines: DataFrame, value: Column, group: str, order: list[str]) -> DataFrame:
    """lines with job: the last value set at or before each line of its group."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("job", F.last(value, ignorenulls=True).over(w))


def event_summary(events: DataFrame, group: str) -> DataFrame:
    kinds = ["accepted", "error", "invalid", "blocked"]
    return events.groupBy(group).agg(*(F.count_if(F.col("status") == k).alias(f"n_{k}") for k in kinds), F.count_distinct("agent").alias("agents"), F.max_by("event_id", F.when(F.col("status") == "error", F.struct("ts", "event_id"))).alias("last_error"))


def selected(attempts: DataFrame, policy: str = "accepted") -> DataFrame:
    """One attempt a job: the last accepted one, or the first valid (accepted or error)."""
    if policy == "accepted":
        return attempts.filter("status = 'accepted'").groupBy("job_id").agg(F.max("attempt").alias("attempt"))
    return attempts.filter("status in ('accepted', 'error')").groupBy("job_id").agg(F.min("attempt").alias("attempt"))


def rollup(attempts: DataFrame) -> DataFrame:
    """Per job: attempts, whether they run from 1 without a gap, first valid and accepted, and whether a valid one came before."""
    held = attempts.groupBy("job_id").agg(F.count("*").alias("n"), F.max("attempt").alias("last"), F.min(F.when(F.col("status").isin("accepted", "error"), F.col("attempt"))).alias("first_valid"), F.min(F.when(F.col("status") == "accepted", F.col("attempt"))).alias("first_accepted"))
    return held.select("job_id", "n", (F.col("n") == F.col("last")).alias("contiguous"), "first_valid", "first_accepted", (F.col("first_valid") < F.col("first_accepted")).alias("earlier_valid"))


def reuse(attempts: DataFrame) -> DataFrame:
    """Agents that served more than one job, and how many attempts share them; counted by agent, joined to none."""
    held = attempts.groupBy("agent").agg(F.count_distinct("job_id").alias("jobs"), F.count("*").alias("attempts")).filter("jobs > 1")
    return held.select("agent", "jobs", "attempts")


def exact_order(batches: DataFrame, group: str, place: str, item: str, expected: str) -> DataFrame:
    """Per batch whether the items came in exactly the expected order, by comparing ranks row by row."""
    a = F.row_number().over(W.partitionBy(group).orderBy(place))
    b = F.row_number().over(W.partitionBy(group).orderBy(expected))
    return batches.withColumn("__a", a).withColumn("__b", b).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("__a") != F.col("__b")).alias("misplaced")).withColumn("in_order", F.col("misplaced") == 0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
