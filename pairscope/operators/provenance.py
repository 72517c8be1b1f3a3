"""Manifests, attempts, gates and freezes: what must hold before a table of results may be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators.integrity import _verdicts
from pairscope.operators.panel import CATEGORIES

#: Outcomes and kinds of disagreement a resolver may give.
OUTCOMES = ["Supported", "Refuted", "Ambiguous", "Unresolved"]
DISAGREEMENTS = ["judge_error", "partial_warrant", "representation_sensitive", "semantic_conflict", "unresolved"]
#: Settings an accepted attempt must have run with.
SETTINGS = {"fresh_context": True, "inherited_context": False, "web_browse": False, "external_retrieval": False}


def first_error(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks (a rule is true where it is broken; null counts as broken), else null."""
    broken = lambda c: F.coalesce(c, F.lit(True))
    name, rule = rules[0]
    return reduce(lambda out, r: out.when(broken(r[1]), r[0]), rules[1:], F.when(broken(rule), name))


def resolver_valid(stage: str = "C") -> Column:
    """Whether a resolver's row keeps to the schema: stage, outcome, kind, a whole confidence of 0 to 100, a reason."""
    reason = F.trim(F.coalesce("brief_reason", F.lit("")))
    sound = (F.col("stage") == stage) & F.col("resolver_outcome").isin(OUTCOMES) & F.col("disagreement_type").isin(DISAGREEMENTS) & F.col("confidence").between(0, 100)
    return F.coalesce(sound, F.lit(False)) & (reason != "")


def prohibited(text: Column, tokens: list[str]) -> Column:
    """The tokens that a text holds anywhere, whatever its case, in the order of the list, joined by semicolons."""
    low = F.lower(text)
    return F.array_join(F.filter(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in tokens)), lambda x: x.isNotNull()), ";")


def record_error(last: Column, locked: str, frozen: Column) -> Column:
    """The first rule an execution record breaks, failed attempts and accepted ones by their own rules; null where sound."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    failed = [
        ("status_or_reason", ~F.col("status").isin("invalid", "error", "blocked") | F.col("reason").isNull()),
        ("session_id", blank("session_id")),
        ("raw_response_unexplained", ~F.col("has_raw") & ((F.col("status") == "invalid") | ~F.col("explained"))),
        ("evidence_changed", F.col("has_raw") & ~F.col("raw_intact")),
        ("valid_response_discarded", F.col("has_raw") & F.col("raw_valid")),
    ]
    accepted = [
        ("followed_by_another_attempt", F.col("attempt") != last),
        ("routing_not_attested", (F.col("requested_model") != locked) | (F.col("resolved_model") != locked)),
        *((f"setting_{k}", F.col(k) != F.lit(v)) for k, v in SETTINGS.items()),
        ("temperature_or_isolation", F.col("temperature") != "provider_default"),
        *((f"missing_{k}", blank(k)) for k in ("session_id", "reviewer")),
        ("not_reviewed", ~F.col("reviewed")),
        ("dates", ~((frozen <= F.col("started")) & (F.col("started") <= F.col("completed")))),
        ("version", F.when(F.col("version_status") == "available", blank("version")).otherwise((F.col("version_status") != "not_exposed") | F.col("version").isNotNull())),
        ("hash_mismatch", ~F.col("packet_intact") | ~F.col("output_intact")),
        ("attachment", ~F.col("raw_intact")),
    ]
    return F.when(F.col("status") == "accepted", first_error(accepted)).otherwise(first_error(failed))


def record_errors(records: DataFrame, locked: str, frozen: Column) -> DataFrame:
    """records with error: the first rule broken. The last attempt of a job comes from one aggregate."""
    last = records.groupBy(F.col("job_id").alias("__job")).agg(F.max("attempt").alias("__last"))
    joined = records.join(last, F.col("job_id") == F.col("__job"))
    return joined.withColumn("error", record_error(F.col("__last"), locked, frozen)).drop("__job", "__last")


def job_errors(records: DataFrame, locked: str, frozen: Column, most: int = 3) -> DataFrame:
    """(job_id, attempts, error): the first fault of a job: too many attempts, a gap, a record's, or not one accepted."""
    held = record_errors(records, locked, frozen).groupBy("job_id").agg(F.count("*").alias("attempts"), F.max("attempt").alias("last"), F.count_distinct("attempt").alias("kinds"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.min(F.when(F.col("error").isNotNull(), F.struct("attempt", "error")))["error"].alias("first"))
    rules = F.when(F.col("attempts") > most, "retry_limit").when((F.col("kinds") != F.col("attempts")) | (F.col("last") != F.col("attempts")), "not_contiguous").when(F.col("first").isNotNull(), F.col("first")).when(F.col("accepted") != 1, "not_one_accepted")
    return held.select("job_id", "attempts", rules.alias("error"))


def manifest_checks(items: DataFrame, judges: int = 5) -> DataFrame:
    """Five checks of (job_id, panel, judge_id, model, n_judgments, item_id) rows, each with its number of violations."""
    slots = items.groupBy("panel", "item_id").agg(F.count("*").alias("n"), F.count_distinct("judge_id").alias("judges"))
    jobs = items.groupBy("job_id").agg(F.count("*").alias("n"), F.max("n_judgments").alias("said"), F.count_distinct("judge_id", "panel").alias("owners"), F.count_distinct("item_id").alias("kinds"))
    models = items.groupBy("panel").agg(F.count_distinct("model").alias("models"))
    sums = (
        slots.agg(F.count_if((F.col("n") != judges) | (F.col("judges") != judges)).alias("judge_slots"))
        .crossJoin(F.broadcast(jobs.agg(F.count_if(F.col("n") != F.col("said")).alias("judgment_count"), F.count_if(F.col("owners") > 1).alias("duplicate_job"), F.count_if(F.col("kinds") != F.col("n")).alias("repeated_item"))))
        .crossJoin(F.broadcast(models.agg(F.count_if(F.col("models") > 1).alias("model_lock"))))
    )
    return _verdicts(sums, ["judge_slots", "judgment_count", "duplicate_job", "repeated_item", "model_lock"])


def gates(stages: DataFrame, order: list[str], stage: str = "stage", whole: str = "complete") -> DataFrame:
    """(stage, position, complete, frozen, reason): a stage freezes only if it is whole and all before it are frozen."""
    held = stages.groupBy().agg(*(F.coalesce(F.bool_and(F.when(F.col(stage) == s, F.col(whole))), F.lit(False)).alias(f"w{i}") for i, s in enumerate(order)))
    rows = []
    for i, s in enumerate(order):
        before = reduce(lambda a, b: a & b, (F.col(f"w{k}") for k in range(i)), F.lit(True))
        rows.append(F.struct(F.lit(s).alias("stage"), F.lit(i).alias("position"), F.col(f"w{i}").alias("complete"), (before & F.col(f"w{i}")).alias("frozen"), F.when(~before, "predecessor_not_frozen").when(~F.col(f"w{i}"), "incomplete").otherwise("").alias("reason")))
    return held.select(F.inline(F.array(*rows)))


def row_digest(*columns: str) -> Column:
    """120 bits of a row's SHA-256 in four numbers: sums of them do not depend on the order of rows. Each value is written
    with its length, a null as `-`, so that nulls, empty texts and values cut elsewhere are told apart."""
    said = F.concat(*(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns))
    hashed = F.sha2(said, 256)
    return F.array(*(F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))


def manifest(rows: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """(names, n, digest) of each part of a table: sums of row digests, so no part is ever put in order."""
    held = rows.select(*names, row_digest(*columns).alias("__digest"))
    sums = F.concat_ws(":", *(F.sum(F.col("__digest")[i]).cast("string") for i in range(4)))
    return held.groupBy(*names).agg(F.count("*").alias("n"), sums.alias("digest"))


def drift(frozen: DataFrame, now: DataFrame, names: list[str]) -> DataFrame:
    """(names, status): unchanged, changed, missing or new, of manifests; a freeze may only be added to."""
    held = frozen.withColumnsRenamed({"n": "__n", "digest": "__digest"}).join(now, names, "full_outer")
    same = (F.col("n") == F.col("__n")) & (F.col("digest") == F.col("__digest"))
    return held.select(*names, F.when(F.col("__n").isNull(), "new").when(F.col("n").isNull(), "missing").when(same, "unchanged").otherwise("changed").alias("status"))


def consensus_again(judgments: DataFrame, high: int = 4, weak: list[str] | None = None) -> DataFrame:
    """Consensus by another way than panel.consensus: each panel's votes as a list in judge order (panels are small)."""
    weak = weak or ["partial_or_ambiguous", "probably_insufficient", "clearly_insufficient"]
    votes = judgments.groupBy("item_id", "stage").agg(F.array_sort(F.collect_list(F.struct("judge_no", "verdict", "sufficiency"))).alias("v"))
    times = lambda word: F.size(F.filter("v", lambda x: x["verdict"] == word))
    most = F.array_max(F.transform("v", lambda x: F.size(F.filter("v", lambda y: y["verdict"] == x["verdict"]))))
    modal = F.get(F.filter("v", lambda x: F.size(F.filter("v", lambda y: y["verdict"] == x["verdict"])) == most), F.lit(0))["verdict"]
    weakly = F.size(F.filter("v", lambda x: x["sufficiency"].isin(weak)))
    label = F.when(times("Supported") >= high, "Supported").when(times("Refuted") >= high, "Refuted").when((modal == "Ambiguous") & (most >= 2), "Ambiguous").when(weakly >= 3, "Ambiguous").otherwise("Unresolved")
    return votes.select("item_id", "stage", label.alias("again"))


#: The category of a path, a letter a stage: g as the reference, w against it, n not decisive. An entry ending in one letter
#: stands for all paths with that end that are not listed before it.
PATHS = {"ggg": 0, "ngg": 1, "nng": 2, "g": 4, "w": 5, "n": 6}


def categories_again(judgments: DataFrame, adds_text: Column | None = None) -> DataFrame:
    """(item_id, path, category) from raw judgments by another way than panel.taxonomy: the votes of consensus_again() make
    a path of three letters, which is looked up. adds_text: whether an item's last stage showed sentences the others did
    not. An item that lacks a stage has a null path and category."""
    gold = judgments.groupBy("item_id").agg(F.min("gold").alias("gold"))
    letter = F.when(F.col("again") == F.col("gold"), "g").when(F.col("again").isin("Supported", "Refuted"), "w").otherwise("n")
    told = consensus_again(judgments).join(gold, "item_id").withColumn("letter", letter)
    cell = lambda s: F.max(F.when(F.col("stage") == s, F.col("letter")))
    paths = told.groupBy("item_id").agg(F.concat(cell("A"), cell("B"), cell("C")).alias("path"))
    place = reduce(lambda c, p: c.when(F.endswith("path", F.lit(p)), PATHS[p]), PATHS, F.when(F.lit(False), -1))
    if adds_text is not None:
        place = F.when((F.col("path") == "nng") & adds_text, 3).otherwise(place)
    return paths.select("item_id", "path", F.get(F.array(*(F.lit(c) for c in CATEGORIES)), place).alias("category"))


def label_edits(stored: DataFrame, again: DataFrame, key: str, label: str, derived: str) -> DataFrame:
    """(key, stored, derived, kind): rows whose stored label is not the derived one: edited, or on one side only."""
    a, b = stored.select(key, F.col(label).alias("stored"), F.lit(True).alias("has_a")), again.select(key, F.col(derived).alias("derived"), F.lit(True).alias("has_b"))
    kind = F.when(F.col("has_a").isNull(), "not_stored").when(F.col("has_b").isNull(), "not_derived").when(~F.col("stored").eqNullSafe(F.col("derived")), "edited")
    return a.join(b, key, "full").select(key, "stored", "derived", kind.alias("kind")).filter("kind is not null")
