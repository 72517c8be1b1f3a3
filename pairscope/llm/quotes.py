"""Quotation linking: quoted passages are joined to the messages they came from.

A line's quote level is the number of `>` marks before it. A run of lines of one level, up to a blank line, is a
passage: a quoted one, or at level 0 a paragraph of the message's own. Passages are normalised as a whole (white space,
line ends included, and case) and hashed. A quoted passage links to the earliest message of its conversation that has
the same passage of its own; only if there is none, its single lines link to the earliest message with that line. The
message's parent is the latest message that its outermost quotes link to. Threads are followed to their roots by
doubling, and messages are ordered root, depth, turn, without their quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import read, settle

MARK = r"^(?:[ \t]*>)+"


def _marks(line: Column) -> Column:
    head = F.regexp_extract(line, MARK, 0)
    return (F.length(head) - F.length(F.replace(head, F.lit(">"), F.lit("")))).cast("int")


def normalised(line: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _passages(lines: Column) -> Column:
    """The runs of lines of one level without a blank line: (level, hash of the whole, hashes of the lines)."""
    at = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))

    def edge(step: int) -> Column:
        """Places whose neighbour at step is not of the same run."""

        def is_edge(i: Column) -> Column:
            here, other = F.get(lines, i), F.get(lines, i + step)
            return here["hash"].isNotNull() & (other["hash"].isNull() | (other["level"] != here["level"]))

        return F.filter(at, is_edge)

    def passage(run: Column) -> Column:
        held = F.slice(lines, run["first"] + 1, run["last"] - run["first"] + 1)
        whole = normalised(F.array_join(F.transform(held, lambda x: x["body"]), " "))
        return F.struct(F.get(lines, run["first"])["level"].alias("level"), F.xxhash64(whole).alias("hash"), F.transform(held, lambda x: x["hash"]).alias("lines"))

    return F.transform(F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last")), passage)


def parsed(messages: DataFrame) -> DataFrame:
    """messages with lines: an array of (level, body, hash of the normalised body or null where that is empty), passages of
    them, and clean."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(_marks(x).alias("level"), F.when(_marks(x) > 0, F.ltrim(F.regexp_replace(x, MARK, ""))).otherwise(x).alias("body")))
    hashed = F.transform("__lines", lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body"), F.when(normalised(x["body"]) != "", F.xxhash64(normalised(x["body"]))).alias("hash")))
    return messages.withColumn("__lines", lines).withColumn("lines", hashed).drop("__lines").withColumn("passages", _passages(F.col("lines"))).withColumn("clean", F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_depth: int = 40) -> DataFrame:
    """One row a message: conv_id, turn, role, n_quoted_lines, max_level, n_linked_lines, parent_turn, root_turn, depth,
    clean_text, clean_sha256, n_clean_chars.

    parent_turn is null, and root_turn the message's own turn, where no quote links. A quote links only to an earlier
    turn. A null text is empty. A null conversation or turn is grouped with no other message and links to none. Repeated
    rows each get a row. Of quotes of one level the one from the latest turn names the parent; texts of any length are
    read whole. Empty in, empty out; other columns are not read. Ordering a conversation by (root_turn, depth,
    turn) puts every reply after what it replies to.
    """
    base = messages.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    held = settle(parsed(base))
    passage = held.select("conv_id", "turn", F.explode("passages").alias("x")).select("conv_id", "turn", "x.*").filter("conv_id is not null and turn is not null")
    # each quoted passage once a message, and only where the conversation has quotes at all, before anything is joined
    quoted = settle(passage.filter("level > 0").groupBy("conv_id", "turn", "hash").agg(F.min("level").alias("level"), F.sum(F.size("lines")).alias("n")))
    own = passage.filter("level = 0")

    def linked_to(quotes: DataFrame, source: DataFrame) -> DataFrame:
        """quotes and origin: the earliest turn with the same hash of its own, null where there is none before."""
        origin = source.join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
        return quotes.join(origin, ["conv_id", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))

    whole = settle(linked_to(quoted, own))
    lost = passage.filter("level > 0").join(whole.filter("origin is null").select("conv_id", "turn", "hash"), ["conv_id", "turn", "hash"], "left_semi")
    single = lost.select("conv_id", "turn", "level", F.explode("lines").alias("hash")).groupBy("conv_id", "turn", "hash").agg(F.min("level").alias("level"), F.count("*").alias("n"))
    by_line = linked_to(single, own.select("conv_id", "turn", F.explode("lines").alias("hash")))
    linked = whole.select("conv_id", "turn", "level", "origin", "n").unionByName(by_line.select("conv_id", "turn", "level", "origin", "n")).filter("origin is not null")
    parent = linked.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "origin")).alias("parent_turn"), F.sum("n").alias("n_linked_lines"))
    parent = settle(parent)
    # roots: every linked message points up; pointers double until none moves
    up = parent.select("conv_id", "turn", F.col("parent_turn").alias("to"), F.lit(1).cast("bigint").alias("steps"))
    up = settle(up)
    for _ in range(most_depth):
        further = up.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        joined = up.join(further, ["conv_id", "to"], "left")
        if not joined.filter("next is not null").limit(1).count():
            break
        up = settle(joined.select("conv_id", "turn", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    tree = parent.join(up.select("conv_id", "turn", F.col("to").alias("root"), "steps"), ["conv_id", "turn"])
    out = held.join(tree, ["conv_id", "turn"], "left")
    level = F.transform("lines", lambda x: x["level"])
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.size(F.filter(level, lambda x: x > 0)).cast("bigint").alias("n_quoted_lines"),
        F.coalesce(F.array_max(level), F.lit(0)).cast("bigint").alias("max_level"),
        F.coalesce("n_linked_lines", F.lit(0)).cast("bigint").alias("n_linked_lines"),
        "parent_turn",
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("steps", F.lit(0)).cast("bigint").alias("depth"),
        F.col("clean").alias("clean_text"),
        F.sha2("clean", 256).alias("clean_sha256"),
        F.length("clean").cast("bigint").alias("n_clean_chars"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "conversations")).drop("clean_text")


#: The same rows in SQL.
OP4_SQL = r"""
WITH RECURSIVE m AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, row_number() OVER () AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), l AS (
  SELECT id, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM m
), p AS (
  SELECT id, conv_id, turn, k, len(regexp_extract(line, '^([ \t]*>)+')) - len(replace(regexp_extract(line, '^([ \t]*>)+'), '>', '')) AS level,
    CASE WHEN regexp_matches(line, '^([ \t]*>)+') THEN ltrim(regexp_replace(line, '^([ \t]*>)+', ''), ' ') ELSE line END AS body FROM l
), h AS (SELECT *, trim(regexp_replace(lower(body), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS norm FROM p
), r AS (
  SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY k) AS run FROM (SELECT *, CASE WHEN norm <> '' AND (coalesce(lag(norm) OVER w, '') = '' OR lag(level) OVER w <> level) THEN 1 ELSE 0 END AS begins FROM h WINDOW w AS (PARTITION BY id ORDER BY k)) x
), ps AS (
  SELECT id, conv_id, turn, run, min(level) AS level, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY k)), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS whole, count(*) AS n
  FROM r WHERE norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY id, conv_id, turn, run
), q AS (SELECT conv_id, turn, whole, min(level) AS level, sum(n) AS n FROM ps WHERE level > 0 GROUP BY ALL
), o AS (SELECT conv_id, whole, min(turn) AS origin FROM ps WHERE level = 0 GROUP BY ALL
), w AS (SELECT q.*, CASE WHEN origin < turn THEN origin END AS origin FROM q LEFT JOIN o USING (conv_id, whole)
), s AS (
  SELECT r.conv_id, r.turn, r.norm, min(r.level) AS level, count(*) AS n FROM r JOIN ps USING (id, run) JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn AND w.whole = ps.whole
  WHERE r.norm <> '' AND r.level > 0 AND w.origin IS NULL GROUP BY ALL
), ol AS (SELECT conv_id, norm, min(turn) AS origin FROM r WHERE level = 0 AND norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), links AS (
  SELECT conv_id, turn, level, origin, n FROM w WHERE origin IS NOT NULL UNION ALL SELECT conv_id, turn, level, origin, n FROM s JOIN ol USING (conv_id, norm) WHERE origin < turn
), pa AS (
  SELECT conv_id, turn, arg_max(origin, (-level) * 1e9 + origin) AS parent_turn, sum(n) AS n_linked_lines FROM links GROUP BY ALL
), up AS (
  SELECT conv_id, turn, parent_turn AS top, 1 AS steps FROM pa
  UNION ALL SELECT up.conv_id, up.turn, pa.parent_turn, steps + 1 FROM up JOIN pa ON pa.conv_id = up.conv_id AND pa.turn = up.top
), t AS (SELECT conv_id, turn, arg_max(top, steps) AS root, max(steps) AS steps FROM up GROUP BY ALL
), c AS (
  SELECT id, count(*) FILTER (level > 0) AS n_quoted_lines, max(level) AS max_level, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (level = 0), '') AS clean FROM h GROUP BY id
)
SELECT m.conv_id, m.turn, role, CAST(n_quoted_lines AS BIGINT) AS n_quoted_lines, CAST(max_level AS BIGINT) AS max_level, CAST(coalesce(n_linked_lines, 0) AS BIGINT) AS n_linked_lines, parent_turn,
  coalesce(root, m.turn) AS root_turn, CAST(coalesce(steps, 0) AS BIGINT) AS depth, sha256(clean) AS clean_sha256, CAST(len(clean) AS BIGINT) AS n_clean_chars
FROM m JOIN c USING (id) LEFT JOIN pa ON pa.conv_id = m.conv_id AND pa.turn = m.turn LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
