"""Strict checks of delivered batches: ids in exactly the order asked for, records against a schema, broken lines, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators.ranks import placed
from pairscope.storage import settle

#: What a judgment may say.
VERDICTS = ["Supported", "Refuted", "Ambiguous"]
SUFFICIENCY = ["clearly_sufficient", "probably_sufficient", "partial_or_ambiguous", "probably_insufficient", "clearly_insufficient"]
FLAGS = ["none", "possible_missing_title_context", "possible_coreference_or_entity_resolution", "possible_missing_surrounding_context", "multi_sentence_integration", "numerical_or_temporal_reasoning", "negation_or_scope", "entity_or_attribute_confusion", "partial_warrant", "apparent_internal_contradiction", "other"]


def order_errors(expected: DataFrame, delivered: DataFrame, job: str, place: str, item: str) -> DataFrame:
    """(job, position, asked, got, error): the first position of each job at which what was delivered is not what was asked.

    Positions count from 1 by `place` in either table, and are joined one by one: no batch is ever in one list. Errors:
    missing (nothing delivered there any more), extra (nothing asked there any more), repeated (the id stood earlier in the
    batch), unexpected (the id is not in the job), misplaced. A job that was asked and delivered in order has no row.
    """
    return _order_errors(settle(expected.select(job, place, item)), settle(delivered.select(job, place, item)), job, place, item)


def _order_errors(expected: DataFrame, delivered: DataFrame, job: str, place: str, item: str) -> DataFrame:
    """order_errors() of settled tables, which are read several times: to find ranges, to be ordered, to look ids up."""
    asked = placed(expected.select(job, place, F.col(item).alias("asked")), [job], [place, "asked"]).select(F.col(job).alias("j"), "position", "asked")
    came = placed(delivered.select(job, place, F.col(item).alias("got")), [job], [place, "got"]).select(F.col(job).alias("j"), "position", "got")
    both = asked.join(came, ["j", "position"], "full_outer").filter(~F.col("asked").eqNullSafe(F.col("got")) | F.col("asked").isNull())
    wrong = settle(both)
    first_of = came.join(wrong.select("j").distinct(), "j", "left_semi").groupBy("j", "got").agg(F.min("position").alias("first"))
    known = expected.select(F.col(job).alias("j"), F.col(item).alias("got"), F.lit(True).alias("known")).distinct()
    held = wrong.join(first_of, ["j", "got"], "left").join(known, ["j", "got"], "left")
    error = (
        F.when(F.col("got").isNull() & F.col("first").isNull() & F.col("asked").isNotNull(), "missing")
        .when(F.col("first") < F.col("position"), "repeated")
        .when(F.col("known").isNull(), F.when(F.col("asked").isNull(), "extra").otherwise("unexpected"))
        .when(F.col("asked").isNull(), "extra")
        .otherwise("misplaced")
    )
    first = held.groupBy("j").agg(F.min(F.struct("position", "asked", "got", error.alias("error"))).alias("at"))
    return first.select(F.col("j").alias(job), "at.*")


def record_error(judge: Column, stage: Column) -> Column:
    """The first field of a record that breaks the schema, or null; the record has the columns of a judgment, flags a list."""
    text = lambda c: F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    flags = F.col("issue_flags")
    rules = [
        ("judge_id", F.coalesce(F.col("judge_id") == judge, F.lit(False))),
        ("stage", F.coalesce(F.col("stage") == stage, F.lit(False))),
        ("verdict", F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False))),
        ("evidence_sufficiency", F.coalesce(F.col("evidence_sufficiency").isin(SUFFICIENCY), F.lit(False))),
        ("confidence", F.coalesce(F.col("confidence").between(0, 100), F.lit(False))),
        ("issue_flags", F.coalesce((F.size(flags) > 0) & F.forall(flags, lambda f: F.coalesce(f.isin(FLAGS), F.lit(False))), F.lit(False))),
        ("brief_reason", text("brief_reason")),
    ]
    out = F.when(~rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(~holds, name)
    return out


def batch_verdicts(expected: DataFrame, delivered: DataFrame, job: str, place: str, item: str, error: Column) -> DataFrame:
    """(job, status, reason) of every job asked for: missing, wrong_items with the first position, invalid_record with the
    first record, or valid. A job that was not asked for is unexpected_job."""
    expected, delivered = settle(expected.select(job, place, item)), settle(delivered.select(job, place, item, error.alias("__field")))
    error = F.col("__field")
    asked = expected.groupBy(job).agg(F.count("*").alias("n"))
    there = delivered.groupBy(job).agg(F.count("*").alias("came"), F.min(F.when(error.isNotNull(), F.struct(F.col(place).alias("place"), F.col(item).cast("string").alias("item"), error.alias("field")))).alias("bad"))
    order = _order_errors(expected, delivered, job, place, item).select(job, F.concat_ws(":", "error", F.col("position").cast("string")).alias("wrong"))
    held = asked.join(there, job, "full_outer").join(order, job, "left")
    status = F.when(F.col("n").isNull(), "unexpected_job").when(F.col("came").isNull(), "missing").when(F.col("wrong").isNotNull(), "wrong_items").when(F.col("bad").isNotNull(), "invalid_record").otherwise("valid")
    reason = F.when(F.col("n").isNull() | F.col("came").isNull(), "").when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("bad").isNotNull(), F.concat_ws(":", "bad.item", "bad.field")).otherwise("")
    return held.select(job, status.alias("status"), reason.alias("reason"))


def parsed(lines: DataFrame, line: str, schema: str, *more: str) -> DataFrame:
    """(more, raw, record): each line as a record, null where it is not the JSON of one; blank lines have no row."""
    body = F.btrim(F.col("raw"), F.lit(" \t\n\x0b\f\r"))
    record = F.from_json(body, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    held = lines.select(*more, F.col(line).alias("raw")).filter(body != "")
    # a generator, so that a line is parsed once; else each field that is used would parse it anew
    fields = held.select(*more, "raw", body.startswith("{").alias("object"), F.inline(F.array(record)))
    whole = F.struct(*(c for c in fields.columns[len(more) + 2 :] if c != "_corrupt"))
    return fields.select(*more, "raw", F.when(F.col("object") & F.col("_corrupt").isNull(), whole).alias("record"))


def parsed_lines(lines: DataFrame, group: str, place: str, line: str, schema: str) -> DataFrame:
    """(group, line_number, raw, record) of parsed(); blank lines have no row, but count. Numbers are from 1 within the
    group, whatever its size."""
    held = placed(lines.select(group, place, line), [group], [place])
    return parsed(held, line, schema, group, "position").withColumnRenamed("position", "line_number")


def missing_ids(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The expected keys that were not found, a row each, and never a list; a key with a null is never found. Both sides go
    through one aggregate. Where a key is a whole number, what is moved is a row for 64 neighbours of it, a bit each."""
    rank = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4}
    kind = lambda k: [df.schema[k].dataType.simpleString() for df in (expected, found)]
    whole = next((k for k in reversed(keys) if all(t in rank for t in kind(k))), None)
    near = F.lit(0).cast("bigint") if whole is None else F.col(whole).cast("bigint").bitwiseAND(F.lit(63))
    tile = [] if whole is None else [F.shiftright(F.col(whole).cast("bigint"), 6).alias("__tile")]
    rest = [k for k in keys if k != whole]
    bit = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("bigint"), near.cast("int")), F.lit(1).cast("bigint"))
    none = F.lit(0).cast("bigint")
    asked = expected.select(*rest, *tile, bit.alias("__asked"), none.alias("__found"))
    both = asked.unionByName(found.dropna(subset=keys).select(*rest, *tile, none.alias("__asked"), bit.alias("__found")))
    held = both.groupBy(*rest, *(["__tile"] if tile else [])).agg(F.bit_or("__asked").alias("__asked"), F.bit_or("__found").alias("__found"))
    left = held.withColumn("__left", F.col("__asked").bitwiseAND(F.bitwise_not("__found"))).filter("__left <> 0")
    if whole is None:
        return left.select(*keys)
    each = left.withColumn("__at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("__left", i) == 1)))
    return each.withColumn(whole, (F.col("__tile") * 64 + F.col("__at")).cast(max(kind(whole), key=rank.get))).select(*keys)


def key_paths(rows: DataFrame, key: str, json: str, most: int = 100) -> DataFrame:
    """(key, path, depth): every object key of a JSON text, at any depth, by its path; [] stands for the elements of an array.

    A level of all texts is taken apart at a time, until none is left that holds another. Text that is no JSON gives the
    path `!not_json`; null gives none. Deeper than `most` levels is an error, not an omission.
    """
    spark = rows.sparkSession
    held = settle(rows.filter(F.col(json).isNotNull()).select(F.col(key).alias("key"), F.try_parse_json(F.col(json)).alias("v")).select("key", F.lit("").alias("path"), F.lit(0).alias("depth"), F.to_json("v").alias("v"), F.col("v").isNull().alias("broken")))
    found = held.filter("broken").select("key", F.lit("!not_json").alias("path"), "depth")
    level = held.filter("not broken").drop("broken")
    for _ in range(most + 1):
        nested = level.filter("startswith(v, '{') or startswith(v, '[')")
        each = spark.sql("SELECT n.key AS key, n.path AS path, n.depth AS depth, e.key AS name, to_json(e.value) AS v FROM (SELECT key, path, depth, parse_json(v) AS v FROM {nested}) n, LATERAL variant_explode(n.v) e", nested=nested)
        inside = F.col("name").isNotNull()
        path = F.when(inside, F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))).otherwise(F.concat("path", F.lit("[]")))
        level = settle(each.select("key", path.alias("path"), F.when(inside, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), "v", inside.alias("named")))
        if level.isEmpty():
            return found.select(F.col("key").alias(key), "path", "depth").distinct()
        found = found.unionByName(level.filter("named").select("key", "path", "depth"))
        level = level.drop("named")
    raise ValueError(f"JSON deeper than {most} levels")


def not_allowed(rows: DataFrame, key: str, json: str, allowed: list[str]) -> DataFrame:
    """(key, path, depth) of the keys that are not in the list of allowed paths."""
    return key_paths(rows, key, json).filter(~F.col("path").isin(allowed) if allowed else F.lit(True))
