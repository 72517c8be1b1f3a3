"""Order over whole tables without a window over a whole group: ranges, sums of ranges, offsets.

Rows are dealt out by ranges of their order and numbered within a range, once, in a settled table. What comes before a
range is a sum over earlier ranges: a table with as many rows as there were tasks. So neither a hot group nor an
ungrouped table is ever in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscope.storage import settle

_PLACE = (1 << 33) - 1


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with __part, which rises with the order, and __at, from 0 within it; settled, so every use sees the same."""
    held = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    return held.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit(_PLACE))).drop("__id")


def offsets(held: DataFrame, **values: Column) -> DataFrame:
    """(__part, names): the sum of each value over all earlier ranges. As many rows as ranges."""
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = held.groupBy("__part").agg(*(F.sum(v).alias(n) for n, v in values.items()))
    return sums.select("__part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in values))


def placed(rows: DataFrame, within: list[str], order: list[Column | str]) -> DataFrame:
    """rows with position (from 1) and size of their group, by order; __part and __at of ranged() stay.

    Null keys make a group of their own. An empty `within` numbers the whole table. Ties of the order are numbered in
    some order, so end it with a key where that matters.
    """
    held = ranged(rows, *within, *order)
    numbered = held.join(F.broadcast(offsets(held, __before=F.lit(1).cast("bigint"))), "__part").withColumn("__all", F.col("__before") + F.col("__at") + 1)
    if not within:
        total = held.agg(F.count("*").alias("size"))
        return numbered.crossJoin(F.broadcast(total)).withColumn("position", F.col("__all").cast("bigint")).drop("__before", "__all")
    groups = numbered.groupBy(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(within))).agg(F.min("__all").alias("__first"), F.count("*").alias("size"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(within)))
    joined = numbered.join(groups, same).withColumn("position", (F.col("__all") - F.col("__first") + 1).cast("bigint"))
    return joined.drop("__before", "__all", "__first", *(f"__key{i}" for i in range(len(within))))


def cumulated(rows: DataFrame, order: list[Column | str], **values: Column) -> DataFrame:
    """rows with, under each name, the sum of its value over all rows before in the order."""
    held = ranged(rows, *order)
    inside = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    joined = held.join(F.broadcast(offsets(held, **values).withColumnsRenamed({n: f"__{n}" for n in values})), "__part")
    return joined.select(*rows.columns, *((F.col(f"__{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for n, v in values.items()))


def medians(cells: DataFrame, within: list[str], value: str, n: str) -> DataFrame:
    """(within, median): the exact median of value in each group of a histogram whose rows occur n times; nulls are passed over.

    Values are ordered in ranges over the whole table, so a group's values are in no one task.
    """
    held = settle(cells.filter(F.col(value).isNotNull()).groupBy(*within, F.col(value).cast("double").alias("__v")).agg(F.sum(n).alias("__n")))
    below = settle(cumulated(held, [*within, "__v"], __below=F.col("__n")))
    sizes = below.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(within)), "__below", "__n").groupBy(*(f"__k{i}" for i in range(len(within)))).agg(F.min("__below").alias("__first"), F.sum("__n").alias("__size"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(within)), F.lit(True))
    at = F.col("__below") - F.col("__first")
    lies = lambda place: (place >= at) & (place < at + F.col("__n"))
    low, high = F.floor((F.col("__size") - 1) / 2), F.floor(F.col("__size") / 2)
    two = below.join(F.broadcast(sizes), same).filter(lies(low) | lies(high)).groupBy(*within)
    return two.agg(((F.min("__v") + F.max("__v")) / 2).alias("median"))


def carried(held: DataFrame, within: list[str], **values: Column) -> DataFrame:
    """held, of ranged() or placed(), with each value's last one that is not null at or before the row in its group.

    Within a range it is the last of the rows before; what a range begins with is the last value of all earlier ranges,
    taken from a table with a row a range. It counts only if it is of the same group.
    """
    kept = {n: F.when(v.isNotNull(), F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(within)), v.alias("value"))) for n, v in values.items()}
    marked = held.select("*", *(v.alias(f"__own_{n}") for n, v in kept.items()))
    ends = marked.groupBy("__part").agg(*(F.max_by(f"__own_{n}", F.when(F.col(f"__own_{n}").isNotNull(), F.col("__at"))).alias(f"__end_{n}") for n in values))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.select("__part", *(F.last(f"__end_{n}", ignorenulls=True).over(before).alias(f"__before_{n}") for n in values))
    inside = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    joined = marked.join(F.broadcast(starts), "__part")
    found = {n: F.coalesce(F.last(f"__own_{n}", ignorenulls=True).over(inside), F.col(f"__before_{n}")) for n in values}
    out = joined.select(*held.columns, *(c.alias(f"__found_{n}") for n, c in found.items()))
    same = lambda n: reduce(lambda a, b: a & b, (F.col(f"__found_{n}.k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(within)), F.lit(True))
    return out.select(*held.columns, *(F.when(same(n), F.col(f"__found_{n}.value")).alias(n) for n in values))
