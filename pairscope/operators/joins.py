"""Joins that check what they join: one to one, lookups, both directions, chains of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, with an error where a key occurs twice: an aggregate by key, so it costs no more than the join after it."""
    rest = [c for c in rows.columns if c not in keys]
    held = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest) if rest else F.lit(True)).alias("__r"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("a key occurs twice: "), F.to_json(F.struct(*keys))))).otherwise(F.col("__r"))
    return held.select(*keys, checked.alias("__r")).filter(F.col("__r").isNotNull()).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys that are unique on both sides."""
    return unique(left, keys).join(unique(right, keys), keys, how)


def suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_1", "_2"), how: str = "inner") -> DataFrame:
    """A join; columns that both sides have, other than keys, get a suffix a side."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    named = lambda rows, s: rows.select(*(F.col(f"`{c}`").alias(f"{c}{s}" if c in both else c) for c in rows.columns))
    return named(left, suffixes[0]).join(named(right, suffixes[1]), keys, how)


def lookup(facts: DataFrame, dimension: DataFrame, key: str, value: str, required: bool = False) -> DataFrame:
    """facts with the dimension's value of its key; a key without one gets null or, if required, is an error."""
    known = unique(dimension.select(key, value), [key]).withColumn("__known", F.lit(True))
    found = facts.join(known, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn(value, F.when(F.col("__known").isNull(), missing).otherwise(F.col(value)) if required else F.col(value)).drop("__known")


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of two panels by key, unique on both sides; a key that one side lacks is an error."""
    a, b = unique(left, [key]).withColumn("__l", F.lit(True)), unique(right, [key]).withColumn("__r", F.lit(True))
    held = suffixed(a, b, [key], how="full_outer")
    bad = F.col("__l").isNull() | F.col("__r").isNull()
    return held.withColumn(key, F.when(bad, F.raise_error(F.concat(F.lit("one side lacks "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("__l", "__r")


def star(facts: DataFrame, dimensions: list[tuple[DataFrame, str]]) -> DataFrame:
    """facts joined with each dimension on its key, one after the other; each must be unique on it and know every fact."""
    for rows, key in dimensions:
        facts = facts.join(unique(rows, [key]), key, "inner")
    return facts


def translated(ids: DataFrame, first: DataFrame, second: DataFrame, keys: tuple[str, str, str]) -> DataFrame:
    """ids (keys[0]) carried over two maps to keys[2]; an id that a map lacks has nulls from there on."""
    a, b, c = keys
    return ids.join(unique(first.select(a, b), [a]), a, "left").join(unique(second.select(b, c), [b]), b, "left")


def missing(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Keys expected and not there, each once."""
    return expected.select(*keys).distinct().join(got.select(*keys).distinct(), keys, "left_anti")


def membership(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, each once, with which: missing or unexpected; one pass over both."""
    both = expected.select(*keys, F.lit(1).alias("__e"), F.lit(0).alias("__g")).unionByName(got.select(*keys, F.lit(0).alias("__e"), F.lit(1).alias("__g")))
    held = both.groupBy(*keys).agg(F.max("__e").alias("__e"), F.max("__g").alias("__g")).filter(F.col("__e") != F.col("__g"))
    return held.select(*keys, F.when(F.col("__e") == 1, "missing").otherwise("unexpected").alias("which"))
