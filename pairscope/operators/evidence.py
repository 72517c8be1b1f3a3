"""Evidence sets: parsing, resolution against pages, identity, repair audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prefix of a set's id and the codes of what is missing.
SET_PREFIX = "fever_set_"
NO_PAGE, NO_SENTENCE = "missing_wiki_page:", "missing_sentence:"
NO_SET, NO_SETS, BAD_RAW = "no_complete_evidence_set", "no_evidence_sets", "bad_raw_evidence:"


def sentence(lines: Column, index: Column) -> Column:
    """Field 1 of the first line whose field 0 is the index, without a trailing CR; null if missing or empty."""
    found = F.get(F.filter(F.split(lines, "\n"), lambda x: F.split(x, "\t")[0] == index.cast("string")), F.lit(0))
    return F.nullif(F.regexp_replace(F.get(F.split(found, "\t"), F.lit(1)), r"\r$", ""), F.lit(""))


def parsed_sets(raw: DataFrame, key: str, column: str) -> DataFrame:
    """A row a set and pointer from nested JSON [[[a, b, page, index], ...], ...]: key, set_index, n, position, page, sent_idx.

    Empty sets are left out but keep their place in the numbering; a pointer without page or whole index has nulls.
    """
    sets = F.from_json(column, "array<array<array<string>>>")
    outer = raw.select(key, F.posexplode(sets).alias("set_index", "pointers")).filter(F.size("pointers") > 0)
    inner = outer.select(key, "set_index", F.size("pointers").alias("n"), F.posexplode("pointers").alias("position", "p"))
    return inner.select(key, "set_index", "n", "position", F.nullif(F.get("p", F.lit(2)), F.lit("")).alias("page"), F.get("p", F.lit(3)).try_cast("int").alias("sent_idx"))


def set_id(set_index: Column, pointers: Column) -> Column:
    """SET_PREFIX and twelve hex digits of the SHA-1 of the set's compact JSON."""
    body = F.to_json(F.struct(set_index.cast("int").alias("set_index"), pointers.alias("pointers")))
    return F.concat(F.lit(SET_PREFIX), F.substring(F.sha1(body), 1, 12))


def resolved(pointers: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """pointers joined with sentences(page, sent_idx, sentence): the sentence or why there is none."""
    pages = sentences.select("page").distinct().withColumn("known", F.lit(True))
    out = pointers.join(sentences, ["page", "sent_idx"], "left").join(pages, "page", "left")
    reason = F.when(F.col("page").isNull() | F.col("sent_idx").isNull(), "bad_pointer").when(F.col("known").isNull(), F.concat(F.lit(NO_PAGE), "page")).when(F.col("sentence").isNull(), F.concat(F.lit(NO_SENTENCE), "page", F.lit(":"), F.col("sent_idx").cast("string")))
    return out.withColumn("failure", reason).drop("known")


def shortest(rows: DataFrame, key: str) -> DataFrame:
    """The complete set with fewest pointers (least index on ties), else the first failure of the least set index."""
    sets = rows.groupBy(key, "set_index").agg(F.max("n").alias("n"), F.count_if(F.col("failure").isNotNull()).alias("bad"), F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("position"))).alias("failure"))
    best = sets.groupBy(key).agg(F.min(F.when(F.col("bad") == 0, F.struct("n", "set_index"))).alias("best"), F.min_by("failure", F.when(F.col("bad") > 0, F.col("set_index"))).alias("failure"), F.count("*").alias("n_sets"))
    return best.select(key, "n_sets", F.col("best.set_index").alias("set_index"), F.col("best.n").alias("size"), F.when(F.col("best").isNull(), F.col("failure")).alias("failure"))


def audit(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stored text against resolved text of the chosen sets: match, and the cause where it differs."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("sentence", F.lit("")).alias("s")))), lambda x: x["s"]), " ")
    now = rows.groupBy(key).agg(text.alias("text"), F.count_if(F.col("failure").isNotNull()).alias("bad"))
    cause = F.when(F.col("stored") == F.col("text"), "match").when(F.col("bad") > 0, "unresolved_pointer").when(F.col("stored").contains(F.col("text")), "stored_adds_text").when(F.col("text").contains(F.col("stored")), "stored_lacks_text").otherwise("different")
    return now.join(stored, key).select(key, cause.alias("cause"))


def pointer_error(pointer: Column) -> Column:
    """Why an array of strings is no pointer: fewer than four items, a blank title, an index that is no whole number; null if it is one."""
    title = F.trim(F.coalesce(F.get(pointer, F.lit(2)), F.lit("")))
    return F.when(pointer.isNull() | (F.size(pointer) < 4), "invalid_evidence_pointer").when(title == "", "invalid_evidence_pointer_title").when(F.get(pointer, F.lit(3)).try_cast("int").isNull(), "invalid_evidence_pointer_sentence_index")


def raw_error(raw: Column) -> Column:
    """Why raw evidence cannot be parsed: not nested JSON, a bad pointer (the first), or no set; null if it can."""
    sets = F.from_json(raw, "array<array<array<string>>>")
    errors = F.filter(F.transform(F.flatten(F.filter(sets, lambda s: s.isNotNull())), pointer_error), lambda e: e.isNotNull())
    return F.when(sets.isNull(), F.concat(F.lit(BAD_RAW), F.lit("ValueError"))).when(F.size(errors) > 0, F.concat(F.lit(BAD_RAW), F.get(errors, F.lit(0)))).when(F.size(F.filter(sets, lambda s: F.size(s) > 0)) == 0, F.concat(F.lit(BAD_RAW), F.lit(NO_SETS)))


def failure_code(rows: DataFrame, key: str) -> DataFrame:
    """(key, failure) of resolved(): null where some set is whole, else the last set's first failure, else NO_SET."""
    sets = rows.groupBy(key, "set_index").agg(F.count_if(F.col("failure").isNotNull()).alias("bad"), F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("position"))).alias("first"))
    held = sets.groupBy(key).agg(F.min("bad").alias("least"), F.max_by("first", F.when(F.col("bad") > 0, F.col("set_index"))).alias("last"))
    return held.select(key, F.when(F.col("least") > 0, F.coalesce("last", F.lit(NO_SET))).alias("failure"))


def selected(sets: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The set whose id a claim stored: (key, set_index, error). Exactly one must match, with its pages in the stored order.

    sets: (key, set_index, set_id, pages); wanted: (key, set_id, pages). No other set ever stands in for one that is missing.
    """
    held = wanted.select(key, "set_id", F.col("pages").alias("stored")).join(sets.select(key, "set_id", "set_index", "pages"), [key, "set_id"], "left")
    one = held.groupBy(key, "set_id").agg(F.count("set_index").alias("n"), F.max("set_index").alias("set_index"), F.max(F.array_join("pages", "|")).alias("pages"), F.max(F.array_join("stored", "|")).alias("stored"))
    error = F.when(F.col("n") != 1, F.concat(F.lit("selected_set_identity_unavailable:"), "set_id")).when(F.col("pages") != F.col("stored"), "selected_set_order_or_length_mismatch")
    return one.select(key, F.when(error.isNull(), F.col("set_index")).alias("set_index"), error.alias("error"))


def json_length(raw: Column) -> Column:
    """The length of a JSON array, 0 for anything else."""
    return F.coalesce(F.when(F.ltrim(raw).startswith("["), F.json_array_length(raw)), F.lit(0))
