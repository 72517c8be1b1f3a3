"""Distinct users over trailing windows, by a heavy-light split.

Time is cut into tiles as long as the longest window, and every tile is counted by itself: a minute's windows reach into
the tile before and no further. A user is heavy in a kind if it has HEAVY minutes with clicks there.

Heavy users are rows of dense matrices, one column a minute of the tile and of the tile before. A running sum along the
rows, less the same sum a window earlier, is the clicks in the window; where it reaches a threshold the user counts, and
the columns are added up. Light users are sparse: a click counts from its minute until the next click or until it
expires, so a +1 stands where a user comes in, a -1 where it goes out, and a +1 at a tile's start where it stays over.
Both give changes by kind and minute, which are added and summed up within a tile.

No key gathers what grows with the input: a matrix has a fixed size, a light user has fewer minutes than HEAVY, a sum
within a tile has a row a minute, and heavy users' rows are told from the others by (kind, user, tile).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscope.llm.common import read, settle

#: A user with so many minutes of clicks in a kind is heavy there.
HEAVY = 1_000
#: Rows of a dense matrix, and minutes that are sent in one row on the way to it.
USERS, PIECE = 64, 512

#: Measure -> (minutes of its window, clicks that a user must have in it).
MEASURES = {"users_short": (5, 1), "users_middle": (30, 1), "users_long": (10_080, 1), "hot_users": (10_080, 3)}


def floored(value: Column, by: int) -> Column:
    """A long divided by `by` and floored; what is left of it is a multiple, so the quotient is a whole number."""
    return F.round((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("bigint")


def minute_of(rows: DataFrame, ts: str) -> Column:
    """Minutes since 1970 in UTC, floored; a timestamp without a zone is read as UTC, whatever the session's zone."""
    if rows.schema[ts].dataType.typeName() == "timestamp_ntz":
        day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        return day * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return floored(F.unix_micros(ts), 60_000_000)


def minutes(clicks: DataFrame, key: str = "click_id", user: str = "client_id", kind: str = "kind", ts: str = "ts", most: int = 3) -> DataFrame:
    """(kind, user, minute, n): clicks of a user in a minute, `most` at most; clicks of no user are those of user null.

    Rows of equal key are one click: of rows that differ the one with the least minute, kind, user (null first). A row
    without a key is a click of its own. Rows without time or kind take no part.
    """
    whole = clicks.filter(F.col(ts).isNotNull() & F.col(kind).isNotNull())
    held = whole.select(
        F.col(key).alias("id"),
        F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("own"),
        F.struct(minute_of(clicks, ts).alias("minute"), F.col(kind).alias("kind"), F.col(user).alias("user")).alias("click"),
    )
    each = held.repartition("id", "own").groupBy("id", "own").agg(F.min("click").alias("click"))
    return each.groupBy("click.kind", "click.user", "click.minute").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("n"))


def reached(threshold: int, within: W) -> Column:
    """The minute of the click `threshold` clicks back, this minute's last click being the first; null if there is none."""
    out = F.when(F.col("n") >= threshold, F.col("minute"))
    seen = F.col("n")
    for back in range(1, threshold):
        seen = seen + F.coalesce(F.lag("n", back).over(within), F.lit(0))
        out = out.when(seen >= threshold, F.lag("minute", back).over(within))
    return out


def sparse(light: DataFrame, measures: dict[str, tuple[int, int]], tile: int) -> DataFrame:
    """(kind, minute, held, measures): changes that the minutes (kind, user, minute, n) of light users bring.

    From a minute on, until the user's next minute with clicks, a measure counts as long as its click `threshold` clicks
    back is in the window. Where it counts from the last stretch into this one, the two changes are left out.
    """
    within = W.partitionBy("kind", "user").orderBy("minute")
    rows = light.select(
        "kind",
        "minute",
        (F.lit(tile) * (floored(F.col("minute"), tile) + 1)).alias("border"),
        F.lag("minute", 1).over(within).alias("before"),
        F.lead("minute", 1).over(within).alias("after"),
        *(reached(t, within).alias(f"from_{m}") for m, (_, t) in measures.items()),
    )
    starts = F.col("minute") == F.col("border") - tile
    ends = {m: F.least(F.col("after"), F.col(f"from_{m}") + w) for m, (w, _) in measures.items()}
    rows = rows.select("*", *(F.when(F.col(f"from_{m}") + w > F.col("minute"), ends[m]).alias(f"to_{m}") for m, (w, _) in measures.items()))
    zero, one = F.lit(0), F.lit(1)
    joins = {m: (F.coalesce(F.col("before") + w >= F.col("minute"), F.lit(False)) & ~starts) if t == 1 else F.lit(False) for m, (w, t) in measures.items()}
    leaves = {m: (F.col(f"to_{m}") != F.col("border")) & (F.coalesce(F.col(f"to_{m}") != F.col("after"), F.lit(True)) if t == 1 else F.lit(True)) for m, (_, t) in measures.items()}
    changes = [F.col("minute"), one, *(F.when(F.col(f"to_{m}").isNotNull() & ~joins[m], one).otherwise(zero) for m in measures)]
    over = [F.coalesce(F.col(f"to_{m}") > F.col("border"), F.lit(False)) for m in measures]
    some = over[0]
    for o in over[1:]:
        some = some | o
    changes += [F.when(some, F.col("border")), zero, *(F.when(o, one).otherwise(zero) for o in over)]
    for m in measures:
        changes += [F.when(leaves[m], F.col(f"to_{m}")), zero, *(F.lit(-1) if other == m else zero for other in measures)]
    return rows.select("kind", F.stack(F.lit(2 + len(measures)), *changes).alias("minute", "held", *measures)).filter("minute is not null")


def dense(heavy: DataFrame, measures: dict[str, tuple[int, int]], tile: int, users: int = USERS) -> DataFrame:
    """(kind, minute, held, measures): changes that the minutes (kind, user, minute, n) of heavy users bring.

    Minutes are packed, PIECE of a user's next to each other in a row, and go to the tile that holds them and to the next
    one. Rows come in the order of kind, tile and user; `users` of them make a matrix, and a task holds one at a time.
    """
    own = floored(F.col("minute"), tile)
    at = (F.col("minute") - F.col("tile") * tile).cast("int")
    packed = heavy.withColumn("tile", own).withColumn("at", at).groupBy("kind", "user", "tile", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.collect_list(F.struct("at", "n")).alias("clicks"))
    dealt = packed.select("kind", "user", "clicks", "tile", F.explode(F.array(F.lit(0), F.lit(1))).alias("late")).withColumn("tile", F.col("tile") + F.col("late"))
    together = dealt.repartition("kind", "tile", "user").sortWithinPartitions("kind", "tile", F.xxhash64("user"), "user").select("kind", "tile", "user", "late", "clicks")
    names = list(measures)
    kind_type = heavy.schema["kind"].dataType.simpleString()

    def counted(sums: np.ndarray, kind: object, at_tile: int, form: pa.DataType) -> pa.RecordBatch:
        np.cumsum(sums, axis=1, out=sums)
        levels = [((sums[:, tile:] - sums[:, tile - w : 2 * tile - w]) >= t).sum(axis=0) for w, t in measures.values()]
        steps = np.diff(np.array(levels), axis=1, prepend=0)
        minute = np.flatnonzero(steps.any(axis=0))
        none = np.zeros(len(minute), np.int32)
        return pa.RecordBatch.from_arrays([pa.array([kind], form).take(pa.array(none)), pa.array(minute + at_tile * tile), pa.array(none), *(pa.array(s[minute].astype(np.int32)) for s in steps)], ["kind", "minute", "held", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((users, 2 * tile), np.int32)
        last, rows, form = None, 0, None
        for batch in batches:
            form = batch.schema.field(0).type
            lists = batch.column(4)
            ends, whole = lists.offsets.to_numpy(), lists.values
            places, counts = whole.field(0).to_numpy(), whole.field(1).to_numpy()
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for k, (kind, at_tile, user, late) in enumerate(keys):
                if last != (kind, at_tile, user):
                    if last is not None and (last[:2] != (kind, at_tile) or rows == users):
                        yield counted(matrix[:rows], *last[:2], form)
                        matrix[:rows] = 0
                        rows = 0
                    last, rows = (kind, at_tile, user), rows + 1
                part = slice(ends[k], ends[k + 1])
                matrix[rows - 1, places[part] + (0 if late else tile)] = counts[part]
        if last is not None:
            yield counted(matrix[:rows], *last[:2], form)

    return together.mapInArrow(run, ", ".join([f"kind {kind_type}", "minute bigint", "held int", *(f"`{m}` int" for m in names)]))


def rolling_users(clicks: DataFrame, measures: dict[str, tuple[int, int]] = MEASURES, key: str = "click_id", user: str = "client_id", kind: str = "kind", ts: str = "ts", heavy: int = HEAVY) -> DataFrame:
    """(kind, minute, measures): for every kind and minute with a click the users with so many clicks in each window.

    A window of L minutes at minute m holds the kind's clicks from m-L+1 to m. Clicks without a user make a row, but no
    user; columns beside the four named are not read; an empty table gives an empty result. See minutes() for repeated
    rows, nulls and clicks without a key.
    """
    tile = max(w for w, _ in measures.values())
    most = max(t for _, t in measures.values())
    per = settle(minutes(clicks, key, user, kind, ts, most))
    known = per.filter("user is not null").withColumn("tile", floored(F.col("minute"), tile))
    tiles = known.groupBy("kind", "user", "tile").agg(F.count("*").alias("rows"))
    told = tiles.select("kind", "user", "tile", (F.sum("rows").over(W.partitionBy("kind", "user")) >= heavy).alias("heavy"))
    split = settle(known.join(told.hint("merge"), ["kind", "user", "tile"]).select("kind", "user", "minute", "n", "heavy"))
    none = [F.lit(0).alias(m) for m in measures]
    changes = sparse(split.filter("not heavy"), measures, tile).unionByName(dense(split.filter("heavy"), measures, tile))
    seen = per.filter("user is null").select("kind", "minute").unionByName(split.filter("heavy").select("kind", "minute"))
    changes = changes.unionByName(seen.select("kind", "minute", F.lit(1).alias("held"), *none))
    added = changes.groupBy("kind", "minute").agg(F.max("held").alias("held"), *(F.sum(m).alias(m) for m in measures))
    along = W.partitionBy("kind", "tile").orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    summed = added.withColumn("tile", floored(F.col("minute"), tile)).select("kind", "minute", "held", *(F.sum(m).over(along).cast("bigint").alias(m) for m in measures))
    return summed.filter("held = 1").drop("held")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_users(read(spark, sf_dir, "clicks", "click_id", "ts", "client_id", "kind"))


def _sql() -> str:
    """A user's stretches in each window by the click `threshold` clicks back, cut at the next click, and their changes
    summed up along each kind's minutes."""
    parts = []
    for m, (w, t) in MEASURES.items():
        others = ", ".join(f"{{v}} AS {o}" if o == m else f"0 AS {o}" for o in MEASURES)
        stretch = f"(SELECT kind, minute AS a, CASE WHEN lag(minute, {t - 1}) OVER u IS NOT NULL THEN least(coalesce(lead(minute) OVER u, 9223372036854775807), lag(minute, {t - 1}) OVER u + {w}) END AS b FROM clicked WHERE client_id IS NOT NULL WINDOW u AS (PARTITION BY kind, client_id ORDER BY minute))"
        parts += [f"SELECT kind, a AS minute, 0 AS held, {others.format(v=1)} FROM {stretch} x WHERE b > a", f"SELECT kind, b AS minute, 0 AS held, {others.format(v=-1)} FROM {stretch} x WHERE b > a"]
    zeros = ", ".join(f"0 AS {m}" for m in MEASURES)
    return f"""
WITH clicked AS (
  SELECT kind, client_id, epoch_us(ts) // 60000000 - CASE WHEN epoch_us(ts) % 60000000 < 0 THEN 1 ELSE 0 END AS minute FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL
  QUALIFY click_id IS NULL OR row_number() OVER (PARTITION BY click_id ORDER BY ts, kind, client_id NULLS FIRST) = 1
), changed AS (
  SELECT kind, minute, 1 AS held, {zeros} FROM clicked
  UNION ALL {" UNION ALL ".join(parts)}
), added AS (SELECT kind, minute, max(held) AS held, {", ".join(f"sum({m}) AS {m}" for m in MEASURES)} FROM changed GROUP BY kind, minute
), summed AS (SELECT kind, minute, held, {", ".join(f"(sum({m}) OVER (PARTITION BY kind ORDER BY minute))::bigint AS {m}" for m in MEASURES)} FROM added)
SELECT kind, minute, {", ".join(MEASURES)} FROM summed WHERE held = 1
"""


OP11_SQL = _sql()
