"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, but at most MOST times its own words, and what is over goes to the
others by weight. A document's expected copies are target / words of its source (or follow a preference within the source);
their whole part is certain, and the fraction is the probability that it goes in once more. For that a document gets
a random number; documents are ranked by its odds divided by the odds of inclusion (Pareto sampling), and the first of
each source are taken until the words that are wanted are reached. A document too long for what is left is passed over,
and the ranking goes on with those that fit, for ROUNDS rounds; at last one more is taken, the one whose length is nearest to
what is left, if the source then is nearer to its target.

Nothing is sorted: the rank, 53 bits, is searched digit by digit. A pass adds up words by source and digit and finds in
which digit the limit lies; the next pass looks at the documents of that digit alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairscope.llm.common import read, settle
from pairscope.operators.ranks import placed

#: Weights of the sources in order, repeating, and the times that a source may be repeated.
WEIGHTS = [1, 2, 3]
MOST = 3
SEED = 42
#: Rounds of filling what is left of a source's words.
ROUNDS = 3
#: Bits of a digit, and of a rank and of a row number.
DIGIT, RANK_BITS, ROW_BITS = 12, 53, 63
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle, where adaptive execution splits hot sources.
BROADCAST_SOURCES = 50_000
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def uniform(*of: Column) -> Column:
    """A draw in (0, 1) with 52 bits, from the md5 of a text of the columns."""
    text = F.concat_ws("|", F.lit(str(SEED)), *(F.coalesce(c.cast("string"), F.lit("")) for c in of))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def pareto_rank(draw: Column, inclusion: Column) -> Column:
    """Odds of the draw by odds of inclusion, turned from 0..infinity to whole numbers of RANK_BITS bits in the same order."""
    odds = (draw / (F.lit(1.0) - draw)) / (inclusion / (F.lit(1.0) - inclusion))
    return F.floor(odds / (F.lit(1.0) + odds) * F.lit(float(2**RANK_BITS - 1))).cast("bigint")


def _few(sources: DataFrame) -> bool:
    return sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def _with(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows joined with a table of sources by their number."""
    return rows.join(F.broadcast(sources) if few else sources, "no", how)


def targets(sizes: DataFrame, weights: list[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, get the weights in turn. The level is the words a unit of weight gets; sources at
    their limit leave it, and it rises for the rest until none is above its limit. A source without words has target 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = placed(sources, [], [F.col("source").isNull(), F.col("source")])
    weighed = settle(ordered.select("source", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight")))
    limit = F.col("source_size") * float(most)
    level, at_limit = None, -1
    while True:
        open_ = F.lit(True) if level is None else limit >= F.col("weight") * level
        found = weighed.agg(F.sum("source_size").alias("whole"), F.sum(F.when(~open_, limit).otherwise(0.0)).alias("held"), F.sum(F.when(open_, F.col("weight")).otherwise(0.0)).alias("open"), F.count_if(~open_).alias("n")).first()
        if found["n"] == at_limit or not found["open"]:
            break
        at_limit, level = found["n"], (float(found["whole"]) - found["held"]) / found["open"]
    return weighed.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target") if level is not None else limit.alias("target"))


def preferred(rows: DataFrame, few: bool, most: float = MOST) -> DataFrame:
    """rows (no, size, target, favour) with expected copies in proportion to favour within a source, `most` at most.

    Documents at the limit leave the source's level, and it rises for the rest, as with sources; every pass is one sum by
    source. A null or negative favour is none.
    """
    rows = rows.withColumn("favour", F.greatest(F.coalesce(F.col("favour"), F.lit(0.0)), F.lit(0.0)))
    levels, before = None, None
    while True:
        held = rows.withColumn("level", F.lit(0.0)) if levels is None else _with(rows, levels, few)
        above = F.col("favour") * F.col("level") > float(most)
        sums = settle(
            held.groupBy("no").agg(
                F.first("target").alias("target"),
                F.sum(F.when(above, F.col("size") * float(most)).otherwise(0.0)).alias("held"),
                F.sum(F.when(~above, F.col("size") * F.col("favour")).otherwise(0.0)).alias("open"),
                F.count_if(above).alias("n"),
            )
        )
        now = sums.agg(F.sum("n").alias("n")).first()["n"]
        if now is None or (levels is not None and now == before):
            return held.withColumn("copies", F.least(F.lit(float(most)), F.col("favour") * F.col("level"))).drop("level")
        before, levels = now, settle(sums.select("no", F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("held")) / F.col("open")).otherwise(0.0).alias("level")))


def _limit(pool: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """(no, rank, row, taken): in each source the first row, by rank and row number, with which the words go beyond
    `wanted`, and the words of the rows before it. Sources all of whose rows fit have no row here.

    Digit by digit: words by source and digit, summed up over at most 2**DIGIT digits; the digit in which the limit lies
    is looked into by the next pass. Rows of equal rank, repeated rows, are told apart by the row number in the end.
    """
    left = _with(pool.select("no", "rank", "row", "size"), wanted.select("no", F.col("wanted").alias("room"), F.lit(0).cast("bigint").alias("taken")), few)
    for column, bits in (("rank", RANK_BITS), ("row", ROW_BITS)):
        for high in range(bits, 0, -DIGIT):
            low = max(0, high - DIGIT)
            digit = F.shiftright(F.col(column), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
            by_digit = left.withColumn("digit", digit).groupBy("no", "digit").agg(F.sum("size").alias("words"), F.first("room").alias("room"), F.first("taken").alias("taken"), F.count("*").alias("n"))
            along = W.partitionBy("no").orderBy("digit").rowsBetween(W.unboundedPreceding, 0)
            beyond = by_digit.withColumn("before", F.sum("words").over(along) - F.col("words")).filter(F.col("before") + F.col("words") > F.col("room"))
            at = settle(beyond.groupBy("no").agg(F.min(F.struct("digit", "before", "room", "taken", "n")).alias("at")).select("no", "at.*"))
            found = at.select("no", F.col("digit").alias("at_digit"), (F.col("room") - F.col("before")).alias("room"), (F.col("taken") + F.col("before")).alias("taken"))
            left = settle(_with(left.drop("room", "taken").withColumn("digit", digit), found, few).filter(F.col("digit") == F.col("at_digit")).select("no", "rank", "row", "size", "room", "taken"))
            if (at.agg(F.max("n").alias("n")).first()["n"] or 0) <= 1:
                return left.select("no", "rank", "row", "taken")
    return left.select("no", "rank", "row", "taken")


def _beyond(rank: str, row: str) -> Column:
    """Whether a document comes after the one of this rank and row number."""
    return (F.col("rank") > F.col(rank)) | ((F.col("rank") == F.col(rank)) & (F.col("row") > F.col(row)))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: list[float] = WEIGHTS, most: int = MOST, favour: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(key, size, source_size, target, copies, taken), a row a document: the copies and words that the mix takes of it.

    Copies are whole, `most` at most. A null text has no words and is never taken; a null source is a source of its own, the
    last; null or repeated ids and repeated rows count one by one. The draw depends on id, source and size alone, so reruns
    agree. Other columns are not read. An empty table gives an empty result.
    """
    liking = F.lit(None).cast("double") if favour is None else favour.cast("double")
    sizes = settle(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), liking.alias("favour")).withColumn("row", F.monotonically_increasing_id()))
    aims = settle(targets(sizes, weights, most).withColumn("no", F.monotonically_increasing_id()))
    few = _few(aims)
    named = aims.withColumnRenamed("source", "of")
    rows = sizes.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    if favour is None:
        rows = rows.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0))
    else:
        rows = preferred(settle(rows), few, most)
    rows = rows.withColumn("sure", F.floor("copies")).withColumn("inclusion", F.col("copies") - F.col("sure"))
    rank = F.when((F.col("inclusion") > 0) & (F.col("size") > 0), pareto_rank(uniform(F.col("key"), F.col("source"), F.col("size")), F.col("inclusion")))
    held = settle(rows.select("key", "row", "no", "size", "source_size", "target", "sure", rank.alias("rank")))
    rest = held.groupBy("no").agg(F.floor(F.first("target") - F.sum(F.col("sure") * F.col("size"))).cast("bigint").alias("wanted"))
    wanted = settle(rest.filter("wanted > 0"))
    pool, joined, taken, open_ = held.filter("rank is not null"), held, F.lit(False), F.lit(True)
    for k in range(rounds):
        limit = settle(_limit(pool, wanted, few))
        cut = settle(wanted.join(limit, "no", "left").select("no", F.col("wanted").alias(f"fits{k}"), F.col("rank").alias(f"rank{k}"), F.col("row").alias(f"row{k}"), (F.col("wanted") - F.col("taken")).alias("left")))
        joined = _with(joined, cut.drop("left"), few, "left")
        later = F.coalesce(_beyond(f"rank{k}", f"row{k}"), F.lit(False))
        # in this round's pool; fitted if not at or beyond the row that did not fit, and all fit where there is none.
        pooled = open_ & F.col(f"fits{k}").isNotNull() & ((F.col("size") <= F.col(f"fits{k}")) if k else F.lit(True))
        at = F.coalesce((F.col("rank") == F.col(f"rank{k}")) & (F.col("row") == F.col(f"row{k}")), F.lit(False))
        taken, open_ = taken | (pooled & ~later & ~at), pooled & later
        wanted = settle(cut.filter("left > 0").select("no", F.col("left").alias("wanted")))
        if not wanted.limit(1).count():
            break
        if k + 1 < rounds:
            room = cut.filter("left > 0").select("no", f"rank{k}", f"row{k}", "left")
            pool = settle(_with(pool, room, few).filter(later & (F.col("size") <= F.col("left"))).select(*held.columns))
    taken = F.col("rank").isNotNull() & taken
    joined = settle(joined.select("key", "row", "no", "size", "source_size", "target", "sure", "rank", "fits0", taken.alias("drawn")))
    short = joined.groupBy("no").agg((F.first("fits0") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("short")).filter("short > 0")
    off = F.abs(F.col("size") - F.col("short"))
    spare = _with(joined.filter("rank is not null and not drawn"), settle(short), few).filter(off < F.col("short"))
    last = settle(spare.groupBy("no").agg(F.min(F.struct(off.alias("off"), F.col("rank").alias("last_rank"), F.col("row").alias("last_row"))).alias("of")).select("no", "of.last_rank", "of.last_row"))
    joined = _with(joined, last, few, "left")
    closes = F.coalesce((F.col("rank") == F.col("last_rank")) & (F.col("row") == F.col("last_row")), F.lit(False))
    copies = F.col("sure") + F.when(F.col("drawn") | closes, 1).otherwise(0)
    return joined.select(F.col("key").alias(key), "size", "source_size", "target", copies.cast("bigint").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def _sql() -> str:
    """The same shares, draws and rounds, each round a running sum over its own sorted pool."""
    rounds = []
    for k in range(ROUNDS):
        pool = "ranked WHERE rank IS NOT NULL AND wanted > 0" if k == 0 else f"p{k - 1} JOIN c{k - 1} USING (no) WHERE pos > c{k - 1}.cut AND size <= c{k - 1}.rest"
        carried = "no, pos, size, wanted AS room" if k == 0 else f"no, pos, size, c{k - 1}.rest AS room"
        rounds.append(f"p{k} AS (SELECT *, sum(size) OVER (PARTITION BY no ORDER BY pos) AS upto FROM (SELECT {carried} FROM {pool}) x)")
        rounds.append(f"c{k} AS (SELECT no, min(pos) FILTER (upto > room) AS cut, any_value(room) - coalesce(max(upto) FILTER (upto <= room AND pos < coalesce(f, 9223372036854775807)), 0) AS rest FROM p{k} LEFT JOIN (SELECT no, min(pos) FILTER (upto > room) AS f FROM p{k} GROUP BY no) y USING (no) GROUP BY no)")
    chosen = " UNION ALL ".join(f"SELECT p{k}.no, pos FROM p{k} JOIN c{k} USING (no) WHERE pos < coalesce(cut, 9223372036854775807)" for k in range(ROUNDS))
    return rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::bigint AS size FROM documents
), summed AS (SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source
), weighed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS no FROM summed
), rated AS (SELECT *, ([{", ".join(f"{w}.0" for w in WEIGHTS)}])[(no - 1) % {len(WEIGHTS)} + 1]::double AS weight, {MOST} * source_size::double AS top FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY top / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM rated
), aims AS (SELECT no, source, source_size, least(top, weight * coalesce((SELECT level FROM levels l WHERE l.top >= l.weight * l.level ORDER BY l.top / l.weight, l.no LIMIT 1), 'inf'::double)) AS target FROM rated
), shared AS (
  SELECT doc_id, size, source_size, target, no, CASE WHEN source_size > 0 THEN least({MOST}.0, target / source_size) ELSE 0.0 END::double AS copies,
    (('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::varchar, ''), coalesce(a.source, ''), size::varchar)), 1, 13))::bigint + 0.5::double) / {float(2**52)!r}::double AS draw
  FROM sized d JOIN aims a ON a.source IS NOT DISTINCT FROM d.source
), odds AS (SELECT *, floor(copies)::bigint AS sure, copies - floor(copies) AS inclusion FROM shared
), drawn AS (SELECT *, CASE WHEN inclusion > 0 AND size > 0 THEN (draw / (1 - draw)) / (inclusion / (1 - inclusion)) END AS by_odds FROM odds
), ranked AS (
  SELECT doc_id, size, source_size, target, no, sure, floor(by_odds / (1 + by_odds) * {float(2**RANK_BITS - 1)!r}::double)::bigint AS rank, row_number() OVER (ORDER BY rank, doc_id) AS pos, floor(target - sum(sure * size) OVER (PARTITION BY no))::bigint AS wanted FROM drawn
), {", ".join(rounds)}, chosen AS ({chosen}
), short AS (SELECT no, any_value(wanted) - coalesce(sum(size) FILTER (c.pos IS NOT NULL), 0) AS short FROM ranked r LEFT JOIN chosen c USING (no, pos) WHERE wanted > 0 GROUP BY no
), last AS (
  SELECT no, pos FROM ranked JOIN short USING (no) WHERE rank IS NOT NULL AND abs(size - short) < short AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.no = ranked.no AND c.pos = ranked.pos)
  QUALIFY row_number() OVER (PARTITION BY no ORDER BY abs(size - short), pos) = 1
), both_ AS (SELECT no, pos FROM chosen UNION ALL SELECT no, pos FROM last)
SELECT doc_id, size, source_size, target, (size * (sure + CASE WHEN c.pos IS NULL THEN 0 ELSE 1 END))::bigint AS taken FROM ranked r LEFT JOIN both_ c ON c.no = r.no AND c.pos = r.pos
"""


OP13_SQL = _sql()
