"""Rows on their way in: usability, remaining work, merges, batches, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscope.operators.ranks import placed


def filled(*columns: Column) -> Column:
    """The first that is not blank, trimmed; an empty string counts as missing."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def usability(rows: DataFrame, key: str, position: str, text: str, label: str, evidence: str, labels: list[str]) -> DataFrame:
    """rows with reason: the first of missing_claim_id, duplicate_claim_id, missing_claim_text,
    invalid_true_label:<label>, missing_gold_evidence; null if usable.

    A row that fails does not claim its id, so a later sound row with that id is usable; a repeat after it is a duplicate.
    """
    own = F.when(filled(F.col(text)).isNull(), "missing_claim_text").when(~F.coalesce(F.col(label).isin(labels), F.lit(False)), F.concat(F.lit("invalid_true_label:"), F.coalesce(F.col(label), F.lit("")))).when(filled(F.col(evidence)).isNull(), "missing_gold_evidence")
    marked = rows.withColumn("__id", filled(F.col(key).cast("string"))).withColumn("__own", own)
    # rows without an id meet no other, so they are kept from the join
    first = marked.filter(F.col("__id").isNotNull() & F.col("__own").isNull()).groupBy(F.col("__id").alias("__of")).agg(F.min(position).alias("__first"))
    known = marked.filter(F.col("__id").isNotNull()).join(first, F.col("__id") == F.col("__of"), "left")
    found = known.withColumn("reason", F.when(F.col(position) > F.col("__first"), "duplicate_claim_id").otherwise(F.col("__own")))
    return found.select(*rows.columns, "reason").unionByName(marked.filter(F.col("__id").isNull()).select(*rows.columns, F.lit("missing_claim_id").alias("reason")))


def remaining(runs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return runs.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(runs: DataFrame, sources: list[DataFrame], keys: list[str], value: str, valid: Column) -> DataFrame:
    """Every run with the value of the last source that has a valid one, null where none has."""
    rows = None
    for rank, source in enumerate(sources):
        part = source.filter(valid).select(*keys, value, F.lit(rank).alias("__rank"))
        rows = part if rows is None else rows.unionByName(part)
    last = rows.groupBy(*keys).agg(F.max_by(value, "__rank").alias(value))
    return runs.select(*keys).join(last, keys, "left")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, counted, in one pass over both."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"))


def batches(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """rows with position in their group and batch number from 1."""
    return placed(rows, [by], order).select(*rows.columns, "position", (F.floor((F.col("position") - 1) / size) + 1).alias("batch"))


def shards(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """k contiguous shards of ceil(n / k) rows a group."""
    return placed(rows, [by], order).select(*rows.columns, "position", (F.floor((F.col("position") - 1) / F.ceil(F.col("size") / k)) + 1).alias("shard"))


def draw(seed: str, key: str) -> Column:
    """A reproducible order: md5 of the seed and the key."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def balanced_sample(rows: DataFrame, label: str, key: str, per_label: int, seed: str) -> DataFrame:
    """per_label rows a label in md5 order; a bounded top-k, so Spark drops rows before the shuffle."""
    place = F.row_number().over(W.partitionBy(label).orderBy(draw(seed, key), key))
    return rows.withColumn("pick", place.cast("bigint")).filter(F.col("pick") <= per_label)


def natural_order(key: Column) -> list[Column]:
    """Numeric keys by value before others by text."""
    number = F.try_to_number(key, F.lit("999999999999999999"))
    return [number.isNull(), number, key]
