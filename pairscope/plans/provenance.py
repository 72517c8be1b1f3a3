"""Queries on checked joins, sets, manifests, attempts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.operators import cohort as C
from pairscope.operators import integrity as V
from pairscope.operators import intake as I
from pairscope.operators import joins as J
from pairscope.operators import paired as P
from pairscope.operators import panel as N
from pairscope.operators import provenance as Q
from pairscope.operators import ranks as R
from pairscope.plans.book import Book
from pairscope.plans.panel import _C, _CB, _CW, _D, _TAX, classified, wide
from pairscope.plans.quality import _SC, scored
from pairscope.plans.studies import _CC, _GAP, _OP, L, S, blinded, classed

book = Book()
add = book.add

# joins

_PIV = ["large_claim_only", "large_with_evidence", "small_claim_only", "small_with_evidence"]
add("J01_one_to_one_left", "predictions", lambda p: J.one_to_one(p.select("claim_id", "gold").distinct(), P.pivoted(P.judged(p)).select("claim_id", *_PIV), ["claim_id"]), f"SELECT claim_id, gold, {', '.join(_PIV)} FROM paired", views="paired")


def by_opaque(j, o):
    ids = blinded(o)
    votes = N.consensus(j).filter("stage = 'C'").select(F.col("item_id").alias("o_orderkey"), "consensus", "rule").join(ids, "o_orderkey").select("opaque", "consensus", "rule")
    return J.one_to_one(votes, ids, ["opaque"], "inner")


add("J02_one_to_one_inner", "judgments", by_opaque, f"{_C}, {_OP} SELECT opaque, consensus, rule, o_orderkey FROM op JOIN cons ON item_id = o_orderkey AND stage = 'C'", tables="orders")
add("J03_suffixed_join", "judgments judgments_b", lambda j, b: (lambda one, two: J.suffixed(one, two, ["item_id"]))(*(N.consensus(x).filter("stage = 'A'").select("item_id", "consensus", "rule", "n_weak") for x in (j, b))), f"{_CB} SELECT cons.item_id, cons.consensus AS consensus_1, cons.rule AS rule_1, cons.n_weak AS n_weak_1, consb.consensus AS consensus_2, consb.rule AS rule_2, consb.n_weak AS n_weak_2 FROM cons JOIN consb USING (item_id, stage) WHERE stage = 'A'")
add("J04_lookup_join", "", lambda c, n, r: J.lookup(J.lookup(c.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), n, "n_nationkey", "n_name", required=True), r.select(F.col("r_regionkey").alias("n_nationkey"), "r_name"), "n_nationkey", "r_name").select("c_custkey", "n_name", "r_name"), "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = c_nationkey", tables="customer nation region")


def stars(p, j, o):
    ids = blinded(o).withColumnRenamed("o_orderkey", "claim_id")
    stage = wide(j).select(F.col("item_id").alias("claim_id"), "a", "b", "c")
    return J.star(ids, [(classed(p).select("claim_id", "cohort"), "claim_id"), (scored(p).select("claim_id", "top", "weak"), "claim_id"), (stage, "claim_id")])


add("J05_star_join", "predictions judgments", stars, f"{_CW}, {_OP}, {_SC} SELECT o_orderkey AS claim_id, opaque, {_CC} AS cohort, top, weak, wide.a, wide.b, wide.c FROM op JOIN sc ON sc.claim_id = o_orderkey JOIN wide ON wide.item_id = o_orderkey", views="paired", tables="orders")


def two_hops(o):
    ids = o.select(F.concat(F.lit("CF-"), (3 * F.col("o_orderkey")).cast("string")).alias("cf_id"))
    first = o.select(F.concat(F.lit("CF-"), (3 * F.col("o_orderkey")).cast("string")).alias("cf_id"), F.concat(F.lit("SA-"), F.col("o_orderkey").cast("string")).alias("sa_id"))
    second = o.filter("o_orderstatus <> 'P'").select(F.concat(F.lit("SA-"), F.col("o_orderkey").cast("string")).alias("sa_id"), F.col("o_orderkey").alias("claim_id"))
    return J.translated(ids, first, second, ("cf_id", "sa_id", "claim_id"))


add("J06_two_hop_ids", "", two_hops, "SELECT 'CF-' || 3 * o_orderkey AS cf_id, 'SA-' || o_orderkey AS sa_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS claim_id FROM orders", tables="orders")
add("J13_panels_both_ways", "judgments judgments_b", lambda j, b: J.both_ways(*(N.consensus(x).filter("stage = 'C'").select("item_id", "consensus") for x in (j, b)), "item_id"), f"{_CB} SELECT item_id, one AS consensus_1, two AS consensus_2 FROM both_ WHERE stage = 'C'")


def lineage(items, p):
    """Every judgment a job owes, with its claim, source and the claim's class."""
    audit = classed(p).select(F.concat(F.lit("SA-"), F.col("claim_id").cast("string")).alias("source_id"), "claim_id", "cohort")
    rows = items.groupBy("job_id", "panel").agg(F.collect_list(F.struct("item_id", "judge_no", "source_id")).alias("items"))
    links = rows.select("job_id", "panel", F.inline("items"))
    return J.lookup(links, audit.select("source_id", F.struct("claim_id", "cohort").alias("claim")), "source_id", "claim", required=True).select("job_id", "source_id", F.concat(F.col("item_id").cast("string"), F.lit(":j"), F.col("judge_no").cast("string")).alias("judgment_key"), "claim.claim_id", "claim.cohort")


add("J18_item_lineage", "job_items predictions", lineage, f"SELECT job_id, source_id, item_id || ':j' || judge_no AS judgment_key, claim_id, {_CC} AS cohort FROM job_items JOIN paired ON claim_id = item_id", views="paired")
add("U01_union_all", "judgments", lambda j: V.union_all([N.consensus(j).filter(f"stage = '{s}'").select("item_id", "stage", "consensus") for s in "ABC"]).groupBy("stage", "consensus").agg(F.count("*").alias("n")), f"{_C} SELECT stage, consensus, count(*) AS n FROM cons GROUP BY ALL")
add("U03_missing_keys", "", lambda c, o: J.missing(c.select(F.col("c_custkey").alias("key")), o.select(F.col("o_custkey").alias("key")), ["key"]), "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders", tables="customer orders")
add("U04_membership", "", lambda o, li: J.membership(o.select(F.col("o_custkey").alias("key")), li.select(F.col("l_partkey").alias("key")), ["key"]), "SELECT key, 'missing' AS which FROM (SELECT o_custkey AS key FROM orders EXCEPT SELECT l_partkey FROM lineitem) UNION ALL SELECT key, 'unexpected' FROM (SELECT l_partkey AS key FROM lineitem EXCEPT SELECT o_custkey FROM orders)", tables="orders lineitem")

# predicates and small aggregates

_RESOLVED = {"stage": "stage", "resolver_outcome": "CASE WHEN confidence % 10 = 9 THEN 'Maybe' ELSE verdict END", "disagreement_type": "CASE confidence % 6 WHEN 0 THEN 'judge_error' WHEN 1 THEN 'partial_warrant' WHEN 2 THEN 'representation_sensitive' WHEN 3 THEN 'semantic_conflict' WHEN 4 THEN 'unresolved' ELSE 'other' END", "confidence": "CASE WHEN confidence = 7 THEN 101 ELSE confidence END", "brief_reason": "CASE WHEN confidence % 11 = 0 THEN ' ' WHEN confidence % 13 = 0 THEN NULL ELSE 'why' END"}
add("P32_resolver_schema", "judgments", lambda j: j.select("item_id", F.col("stage").alias("asked"), "judge_no", *(F.expr(e).alias(n) for n, e in _RESOLVED.items())).select("item_id", "asked", "judge_no", Q.resolver_valid().alias("valid")), f"SELECT item_id, asked, judge_no, coalesce(stage = 'C' AND resolver_outcome IN ('Supported', 'Refuted', 'Ambiguous', 'Unresolved') AND disagreement_type <> 'other' AND confidence BETWEEN 0 AND 100 AND trim(coalesce(brief_reason, '')) <> '', false) AS valid FROM (SELECT item_id, stage AS asked, judge_no, {', '.join(f'{e} AS {n}' for n, e in _RESOLVED.items())} FROM judgments) x")
#: Words that metadata shown to a judge may not hold.
TOKENS = [
    "cursor", "grok", "glm", "residual", "silver_taxonomy", "fever gold", "gpt-5.4", "gpt-5.4-mini",
    "regression", "resistant", "rescue", "robust", "nli", "difficult subset", "prior judge", "utilization failure",
]


def with_tokens(d):
    """Texts as metadata, one in two with a token of the list after it, in capitals."""
    token = F.element_at(F.array(*map(F.lit, TOKENS)), (1 + F.pmod(F.floor(F.col("doc_id") / 2), F.lit(len(TOKENS)))).cast("int"))
    return d.select("doc_id", F.concat_ws(" ", "text", F.when(F.col("doc_id") % 2 == 0, F.upper(token))).alias("text"))


add(
    "P35_prohibited_tokens",
    "",
    lambda d: with_tokens(d).select("doc_id", Q.prohibited(F.col("text"), TOKENS).alias("found")),
    "WITH m AS (SELECT doc_id, concat_ws(' ', text, CASE WHEN doc_id % 2 = 0 THEN upper((" + repr(TOKENS) + f")[1 + (doc_id // 2) % {len(TOKENS)}]) END) AS text FROM documents) SELECT doc_id, concat_ws(';', " + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in TOKENS) + ") AS found FROM m",
    tables="documents",
)
_FAIL = """CASE WHEN NOT status IN ('invalid', 'error', 'blocked') OR reason IS NULL THEN 'status_or_reason' WHEN trim(session_id) = '' THEN 'session_id' WHEN NOT has_raw AND (status = 'invalid' OR NOT explained) THEN 'raw_response_unexplained' WHEN has_raw AND NOT raw_intact THEN 'evidence_changed' WHEN has_raw AND raw_valid THEN 'valid_response_discarded' END"""
_ACC = """CASE WHEN attempt <> last THEN 'followed_by_another_attempt' WHEN resolved_model <> 'locked' THEN 'routing_not_attested' WHEN NOT fresh_context THEN 'setting_fresh_context' WHEN inherited_context THEN 'setting_inherited_context' WHEN web_browse THEN 'setting_web_browse' WHEN external_retrieval THEN 'setting_external_retrieval'
  WHEN temperature <> 'provider_default' THEN 'temperature_or_isolation' WHEN trim(session_id) = '' THEN 'missing_session_id' WHEN trim(reviewer) = '' THEN 'missing_reviewer' WHEN NOT reviewed THEN 'not_reviewed' WHEN started < 20 OR completed < started THEN 'dates'
  WHEN (version_status = 'available') = (version IS NULL) THEN 'version' WHEN NOT packet_intact OR NOT output_intact THEN 'hash_mismatch' WHEN NOT raw_intact THEN 'attachment' END"""
_RE = f"re AS (SELECT *, CASE WHEN status = 'accepted' THEN {_ACC} ELSE {_FAIL} END AS error FROM (SELECT *, max(attempt) OVER (PARTITION BY job_id) AS last FROM records) x)"
add("P37_execution_record", "records", lambda r: Q.record_errors(r, "locked", F.lit(20)).select("event_id", "error"), f"WITH {_RE} SELECT event_id, error FROM re")
add("P37_job_error", "records", lambda r: Q.job_errors(r, "locked", F.lit(20), most=40), f"WITH {_RE}, g AS (SELECT job_id, count(*) AS attempts, max(attempt) AS last, count(DISTINCT attempt) AS kinds, count(*) FILTER (status = 'accepted') AS accepted, arg_min(error, attempt) FILTER (error IS NOT NULL) AS first FROM re GROUP BY job_id) SELECT job_id, attempts, CASE WHEN attempts > 40 THEN 'retry_limit' WHEN kinds <> attempts OR last <> attempts THEN 'not_contiguous' WHEN first IS NOT NULL THEN first WHEN accepted <> 1 THEN 'not_one_accepted' END AS error FROM g")
add("P38_filtered_items", "", lambda o: I.remaining(o.select("o_orderkey"), o.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"]), "SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')", tables="orders")
add("A14_pivot_by_judge", "judgments", lambda j: j.groupBy("item_id", "stage").pivot("judge_id", [f"judge_{i}" for i in range(1, 6)]).agg(F.min("verdict")), "SELECT item_id, stage, " + ", ".join(f"min(verdict) FILTER (judge_id = 'judge_{i}') AS judge_{i}" for i in range(1, 6)) + " FROM judgments GROUP BY ALL")


def selections(j, b):
    """Labels at the last stage under two selections of attempts: counts of each, and of items whose label differs."""
    rows = J.both_ways(*(N.consensus(x).filter("stage = 'C'").select("item_id", "consensus") for x in (j, b)), "item_id")
    one = rows.select(F.inline(F.array(F.struct(F.lit("accepted").alias("kind"), F.col("consensus_1").alias("label")), F.struct(F.lit("first_valid").alias("kind"), F.col("consensus_2").alias("label")), F.struct(F.when(F.col("consensus_1") != F.col("consensus_2"), "changed").alias("kind"), F.col("consensus_1").alias("label")))))
    return one.filter("kind is not null").groupBy("kind", "label").agg(F.count("*").alias("n"))


add("A44_headline_difference", "judgments judgments_b", selections, f"{_CB}, c AS (SELECT * FROM both_ WHERE stage = 'C') SELECT 'accepted' AS kind, one AS label, count(*) AS n FROM c GROUP BY one UNION ALL SELECT 'first_valid', two, count(*) FROM c GROUP BY two UNION ALL SELECT 'changed', one, count(*) FROM c WHERE one <> two GROUP BY one")
add("A44_changed_items", "judgments judgments_b", lambda j, b: J.both_ways(*(N.consensus(x).filter("stage = 'C'").select("item_id", "consensus") for x in (j, b)), "item_id").filter("consensus_1 <> consensus_2"), f"{_CB} SELECT item_id, one AS consensus_1, two AS consensus_2 FROM both_ WHERE stage = 'C' AND one <> two")
_TIMES = {"routing": "CASE WHEN d % 3 = 0 THEN started END", "events": "CASE WHEN d % 5 > 0 THEN completed END", "record": "d % 1000"}


def chronological(r):
    """Attempts in the order of the best time there is: the routing record's, the event log's, the execution record's."""
    at = [F.expr(e) for e in _TIMES.values()]
    source = F.when(at[0].isNotNull(), "routing").when(at[1].isNotNull(), "events").otherwise("record")
    rows = r.select("event_id", F.coalesce(*at).cast("bigint").alias("at"), source.alias("source"))
    return R.placed(rows, [], ["at", "event_id"]).select("event_id", "at", "source", "position")


_AT = f"coalesce({', '.join(_TIMES.values())})"
add("A48_attempt_chronology", "records", chronological, f"SELECT event_id, {_AT} AS at, CASE WHEN {_TIMES['routing']} IS NOT NULL THEN 'routing' WHEN {_TIMES['events']} IS NOT NULL THEN 'events' ELSE 'record' END AS source, row_number() OVER (ORDER BY {_AT}, event_id) AS position FROM records")
add("W07_contiguous_attempts", "attempts", lambda a: V.rollup(a).select("job_id", "contiguous"), "SELECT job_id, count(*) = max(attempt) AS contiguous FROM attempts GROUP BY job_id")
add("W09_first_unique", "", lambda o: o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")).orderBy("first").limit(1000), "SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1 ORDER BY first LIMIT 1000", tables="orders")

# gates, freezes, manifests

_ST = f"st AS (SELECT stage, count(*) FILTER ({_GAP}) = 0 AS complete FROM judgments GROUP BY stage)"
add("V03_stage_gates", "judgments", lambda j: Q.gates(j.groupBy("stage").agg((F.count_if(F.expr(_GAP)) == 0).alias("complete")), ["A", "B", "C"]), f"WITH {_ST} SELECT stage, CASE stage WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS position, complete, bool_and(complete) OVER w AS frozen, CASE WHEN NOT coalesce(bool_and(complete) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 'predecessor_not_frozen' WHEN NOT complete THEN 'incomplete' ELSE '' END AS reason FROM st WINDOW w AS (ORDER BY stage)")
_KEYS = ["stage", "judge_id"]
_CHANGED = "CASE WHEN stage = 'B' AND judge_no = 2 AND item_id % 2 = 0 THEN 'Ambiguous' ELSE verdict END"


def frozen_and_now(j):
    """A freeze of stages A and B against the tables now: one part edited, one gone, one stage new."""
    digest = ["item_id", "stage", "judge_no", "verdict"]
    before = Q.manifest(j.filter("stage <> 'C'"), _KEYS, digest)
    now = Q.manifest(j.filter("NOT (stage = 'A' AND judge_no = 5)").withColumn("verdict", F.expr(_CHANGED)), _KEYS, digest)
    return Q.drift(before, now, _KEYS)


add("V04_freeze_drift", "judgments", frozen_and_now, f"SELECT stage, judge_id, CASE WHEN stage = 'C' THEN 'new' WHEN stage = 'A' AND judge_id = 'judge_5' THEN 'missing' WHEN edited THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT stage, judge_id, bool_or({_CHANGED} <> verdict) AS edited FROM judgments GROUP BY stage, judge_id) x")
_JI = "ji AS (SELECT *, count(*) OVER (PARTITION BY job_id) + CASE WHEN job_id = 'p01_j1_b0' THEN 1 ELSE 0 END AS n_judgments FROM job_items)"


def manifest_rows(items):
    """Manifest rows with the number of judgments a job says it has; one job says one too many."""
    said = items.groupBy("job_id").agg((F.count("*") + F.max(F.when(F.col("job_id") == "p01_j1_b0", 1).otherwise(0))).alias("n_judgments"))
    return items.join(said, "job_id")


_CHECKS = {
    "judge_slots": "(SELECT count(*) FROM (SELECT panel, item_id FROM ji GROUP BY ALL HAVING count(*) <> 5 OR count(DISTINCT judge_id) <> 5) x)",
    "judgment_count": "(SELECT count(*) FROM (SELECT job_id FROM ji GROUP BY 1 HAVING count(*) <> max(n_judgments)) x)",
    "duplicate_job": "(SELECT count(*) FROM (SELECT job_id FROM ji GROUP BY 1 HAVING count(DISTINCT judge_id || panel) > 1) x)",
    "repeated_item": "(SELECT count(*) FROM (SELECT job_id FROM ji GROUP BY 1 HAVING count(DISTINCT item_id) <> count(*)) x)",
    "model_lock": "(SELECT count(*) FROM (SELECT panel FROM ji GROUP BY 1 HAVING count(DISTINCT model) > 1) x)",
}
add("V05_manifest_integrity", "job_items", lambda i: Q.manifest_checks(manifest_rows(i)), f"WITH {_JI} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {q} AS violations, CASE WHEN {q} = 0 THEN 'PASS' ELSE 'FAIL' END AS status" for k, q in _CHECKS.items()))
add("V13_second_derivation", "judgments", lambda j: N.consensus(j).select("item_id", "stage", "consensus").join(Q.consensus_again(j), ["item_id", "stage"]).groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("consensus") != F.col("again")).alias("different")), "SELECT stage, count(DISTINCT item_id) AS n, 0 AS different FROM judgments GROUP BY stage")


# stored labels against labels derived anew from raw judgments

_STORED = "CASE WHEN item_id % 89 <> 0 THEN category WHEN category = 'final_nondecisive' THEN 'nonmonotonic_judge_path' ELSE 'final_nondecisive' END"


def relabelled(j):
    """Stored categories, some edited and some gone, and one item that was never judged, against a second derivation."""
    kept = classified(j).filter("item_id % 83 <> 5").select("item_id", F.expr(_STORED).alias("category"))
    stray = j.agg((F.max("item_id") + 1).alias("item_id")).select("item_id", F.lit("final_nondecisive").alias("category"))
    return Q.label_edits(kept.unionByName(stray), Q.categories_again(j, F.col("item_id") % 3 == 0), "item_id", "category", "category")


add(
    "V13_label_edits",
    "judgments",
    relabelled,
    f"""{_CW}, x AS (SELECT item_id, {_TAX} AS category FROM wide), y AS (SELECT item_id, CASE WHEN item_id % 83 <> 5 THEN {_STORED} END AS stored, category AS derived FROM x)
    SELECT item_id, stored, derived, CASE WHEN stored IS NULL THEN 'not_stored' ELSE 'edited' END AS kind FROM y WHERE stored IS DISTINCT FROM derived
    UNION ALL SELECT max(item_id) + 1, 'final_nondecisive', NULL, 'not_derived' FROM x""",
)
