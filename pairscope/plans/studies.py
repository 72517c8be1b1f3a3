"""Queries on evidence sets, cohorts, integrity and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.operators import cohort as C
from pairscope.operators import evidence as E
from pairscope.operators import integrity as V
from pairscope.operators import models as M
from pairscope.operators import paired as P
from pairscope.plans.book import Book

book = Book()
add = book.add


def pages(conv):
    """conversations as wiki pages: (page, sent_idx, sentence) through the tab-and-newline form of a page's lines."""
    lines = conv.select(F.concat(F.lit("page_"), F.col("conv_id").cast("string")).alias("page"), F.col("turn").cast("int").alias("sent_idx"), F.concat(F.col("turn").cast("string"), F.lit("\t"), F.regexp_replace("text", r"[\t\n]", " "), F.lit("\tlink")).alias("lines"))
    return lines.select("page", "sent_idx", E.sentence(F.col("lines"), F.col("sent_idx")).alias("sentence")).filter("sentence is not null")


def claims(conv):
    """Nested evidence of a claim a conversation: the first two turns, a lone later turn, an empty set, one that dangles."""
    c = F.col("conv_id").cast("string")
    ids = conv.select("conv_id").distinct()
    one = lambda t: F.concat(F.lit('["0","0","page_'), c, F.lit(f'","{t}"]'))
    raw = F.concat(F.lit("[["), one(0), F.lit(","), one(1), F.lit("],[],["), F.when(F.col("conv_id") % 3 == 0, one(7)).otherwise(one(2)), F.lit('],[["0","0","page_none","1"]]]'))
    return ids.select("conv_id", raw.alias("raw"))


def found(conv):
    return E.resolved(E.parsed_sets(claims(conv), "conv_id", "raw"), pages(conv), "conv_id")


_EV = """pg AS (SELECT 'page_' || conv_id AS page, turn::int AS sent_idx, nullif(regexp_replace(text, '[\\t\\n]', ' ', 'g'), '') AS sentence FROM conversations),
  cl AS (SELECT DISTINCT conv_id FROM conversations), pt AS (SELECT conv_id, 0 AS set_index, 2 AS n, 0 AS position, 'page_' || conv_id AS page, 0 AS sent_idx FROM cl UNION ALL SELECT conv_id, 0, 2, 1, 'page_' || conv_id, 1 FROM cl
  UNION ALL SELECT conv_id, 2, 1, 0, 'page_' || conv_id, CASE WHEN conv_id % 3 = 0 THEN 7 ELSE 2 END FROM cl UNION ALL SELECT conv_id, 3, 1, 0, 'page_none', 1 FROM cl),
  rs AS (SELECT pt.*, s.sentence, CASE WHEN k.page IS NULL THEN 'missing_wiki_page:' || pt.page WHEN s.sentence IS NULL THEN 'missing_sentence:' || pt.page || ':' || pt.sent_idx END AS failure FROM pt LEFT JOIN (SELECT DISTINCT page FROM pg WHERE sentence IS NOT NULL) k USING (page) LEFT JOIN pg s ON s.page = pt.page AND s.sent_idx = pt.sent_idx)"""
add("F03_sentence", "", lambda c: pages(c).select("page", "sent_idx", F.md5("sentence").alias("digest")), f"WITH {_EV} SELECT page, sent_idx, md5(sentence) AS digest FROM pg WHERE sentence IS NOT NULL", tables="conversations")
add("F07_parse_sets", "", lambda c: E.parsed_sets(claims(c), "conv_id", "raw"), f"WITH {_EV} SELECT conv_id, set_index, n, position, page, sent_idx FROM pt", tables="conversations")
add("J17_resolve_pointers", "", lambda c: found(c).select("conv_id", "set_index", "position", F.md5("sentence").alias("digest"), "failure"), f"WITH {_EV} SELECT conv_id, set_index, position, md5(sentence) AS digest, failure FROM rs", tables="conversations")
add("W13_shortest_set", "", lambda c: E.shortest(found(c), "conv_id"), f"WITH {_EV}, st AS (SELECT conv_id, set_index, max(n) AS n, count(failure) AS bad, arg_min(failure, position) FILTER (failure IS NOT NULL) AS failure FROM rs GROUP BY ALL) SELECT conv_id, count(*) AS n_sets, arg_min(set_index, n * 1000 + set_index) FILTER (bad = 0) AS set_index, arg_min(n, n * 1000 + set_index) FILTER (bad = 0) AS size, CASE WHEN count(*) FILTER (bad = 0) = 0 THEN arg_min(failure, set_index) FILTER (bad > 0) END AS failure FROM st GROUP BY conv_id", tables="conversations")


def set_ids(conv):
    rows = E.parsed_sets(claims(conv), "conv_id", "raw")
    packed = F.transform(F.array_sort(F.collect_list(F.struct("position", "page", "sent_idx"))), lambda x: F.struct(x["page"].alias("page"), x["sent_idx"].alias("sent_idx")))
    return rows.groupBy("conv_id", "set_index").agg(packed.alias("pointers")).select("conv_id", "set_index", E.set_id(F.col("set_index"), F.col("pointers")).alias("set_id"))


add("F04_set_id", "", set_ids, f"""WITH {_EV} SELECT conv_id, set_index, 'fever_set_' || substr(sha1('{{"set_index":' || set_index || ',"pointers":[' || string_agg('{{"page":"' || page || '","sent_idx":' || sent_idx || '}}', ',' ORDER BY position) || ']}}'), 1, 12) AS set_id FROM pt GROUP BY conv_id, set_index""", tables="conversations")


def rebuilt(conv):
    """Per claim: sentences of the chosen set, number of alternatives and which are whole."""
    rows = found(conv)
    best = E.shortest(rows, "conv_id").select("conv_id", F.col("set_index").alias("chosen"))
    sets = rows.groupBy("conv_id", "set_index").agg((F.count_if(F.col("failure").isNotNull()) == 0).alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("sentence", F.lit("")).alias("s")))), lambda x: x["s"]), "|").alias("text"))
    return sets.join(best, "conv_id").groupBy("conv_id", "chosen").agg(F.md5(F.max(F.when(F.col("set_index") == F.col("chosen"), F.col("text")))).alias("chosen_text"), F.count_if(~F.col("set_index").eqNullSafe(F.col("chosen"))).alias("alternatives"), F.count_if(~F.col("set_index").eqNullSafe(F.col("chosen")) & F.col("whole")).alias("whole_alternatives"))


add("F28_rebuild", "", rebuilt, f"WITH {_EV}, st AS (SELECT conv_id, set_index, max(n) AS n, count(failure) = 0 AS whole, string_agg(coalesce(sentence, ''), '|' ORDER BY position) AS text FROM rs GROUP BY ALL), ch AS (SELECT conv_id, arg_min(set_index, n * 1000 + set_index) FILTER (whole) AS chosen FROM st GROUP BY conv_id) SELECT conv_id, chosen, md5(max(text) FILTER (set_index = chosen)) AS chosen_text, count(*) FILTER (set_index IS DISTINCT FROM chosen) AS alternatives, count(*) FILTER (set_index IS DISTINCT FROM chosen AND whole) AS whole_alternatives FROM st JOIN ch USING (conv_id) GROUP BY conv_id, chosen", tables="conversations")


def audited(conv):
    """Stored texts that are right, lack the last sentence, or add a word, by conversation."""
    rows = found(conv).filter("set_index = 0")
    first = pages(conv).filter("sent_idx <= 1").groupBy(F.regexp_extract("page", r"(\d+)$", 1).cast("bigint").alias("conv_id")).agg(F.max(F.when(F.col("sent_idx") == 0, F.col("sentence"))).alias("s0"), F.max(F.when(F.col("sent_idx") == 1, F.col("sentence"))).alias("s1"))
    stored = first.select("conv_id", F.when(F.col("conv_id") % 4 == 0, F.coalesce("s0", F.lit(""))).when(F.col("conv_id") % 4 == 1, F.concat(F.coalesce("s0", F.lit("")), F.lit(" "), F.coalesce("s1", F.lit("")), F.lit(" more"))).otherwise(F.concat(F.coalesce("s0", F.lit("")), F.lit(" "), F.coalesce("s1", F.lit("")))).alias("stored"))
    return E.audit(rows, stored, "conv_id")


_AU = f"{_EV}, nw AS (SELECT conv_id, string_agg(coalesce(sentence, ''), ' ' ORDER BY position) AS text, count(failure) AS bad FROM rs WHERE set_index = 0 GROUP BY conv_id), so AS (SELECT regexp_extract(page, '(\\d+)$', 1)::bigint AS conv_id, coalesce(max(sentence) FILTER (sent_idx = 0), '') AS s0, coalesce(max(sentence) FILTER (sent_idx = 1), '') AS s1 FROM pg WHERE sent_idx <= 1 AND sentence IS NOT NULL GROUP BY 1), sd AS (SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN s0 WHEN 1 THEN s0 || ' ' || s1 || ' more' ELSE s0 || ' ' || s1 END AS stored FROM so), au AS (SELECT conv_id, CASE WHEN stored = text THEN 'match' WHEN bad > 0 THEN 'unresolved_pointer' WHEN contains(stored, text) THEN 'stored_adds_text' WHEN contains(text, stored) THEN 'stored_lacks_text' ELSE 'different' END AS cause FROM nw JOIN sd USING (conv_id))"
add("F29_repair_audit", "", audited, f"WITH {_AU} SELECT * FROM au", tables="conversations")
add("A39_cause_counts", "", lambda c: audited(c).groupBy("cause").agg(F.count("*").alias("n")), f"WITH {_AU} SELECT cause, count(*) AS n FROM au GROUP BY cause", tables="conversations")
add("S06_selective_page_scan", "", lambda c: pages(c).join(claims(c).select(F.concat(F.lit("page_"), F.col("conv_id").cast("string")).alias("page")), "page", "left_semi").groupBy("page").agg(F.min_by(F.md5("sentence"), "sent_idx").alias("first")), "SELECT 'page_' || conv_id AS page, arg_min(md5(regexp_replace(text, '[\\t\\n]', ' ', 'g')), turn) AS first FROM conversations GROUP BY conv_id", tables="conversations")

L, S = "large_transition", "small_transition"
_CC = f"CASE WHEN {L} = 'regression' OR {S} = 'regression' THEN 'regression' WHEN {L} = 'resistant' OR {S} = 'resistant' THEN 'resistant' WHEN {L} = 'rescue' OR {S} = 'rescue' THEN 'rescue' ELSE 'robust' END"
classed = lambda p: P.paired(P.judged(p)).withColumn("cohort", C.cohort_class(F.col(L), F.col(S)))
add("P21_cohort", "predictions", lambda p: classed(p).select("claim_id", "cohort"), f"SELECT claim_id, {_CC} AS cohort FROM paired", views="paired")
add("P22_regression_type", "predictions", lambda p: classed(p).filter("cohort = 'regression'").groupBy(C.regression_type(F.col(L), F.col(S)).alias("kind")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN {L} = 'regression' AND {S} = 'regression' THEN 'both' WHEN {L} = 'regression' THEN 'first_only' ELSE 'second_only' END AS kind, count(*) AS n FROM paired WHERE {L} = 'regression' OR {S} = 'regression' GROUP BY 1", views="paired")
add("A35_balance", "predictions", lambda p: classed(p).groupBy("cohort").agg(F.count("*").alias("n"), F.avg(F.col("n_sets").cast("double")).alias("mean_sets"), F.avg((F.col("gold") == "Supported").cast("double")).alias("supported")), f"SELECT {_CC} AS cohort, count(*) AS n, avg(n_sets) AS mean_sets, avg((gold = 'Supported')::int) AS supported FROM paired GROUP BY 1", views="paired")
add("W01_tercile", "", lambda o: C.terciles(o, "o_totalprice", "o_orderkey", "o_orderpriority").select("o_orderkey", "tercile"), "SELECT o_orderkey, CASE WHEN 3 * (r - 1) < n - 1 THEN 1 WHEN 3 * (r - 1) < 2 * (n - 1) THEN 2 ELSE 3 END AS tercile FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) x", tables="orders")
_OP = "op AS (SELECT o_orderkey, 'SA-' || lpad((row_number() OVER (ORDER BY md5('salt' || o_orderkey), o_orderkey))::varchar, greatest(6, length((count(*) OVER ())::varchar))::int, '0') AS opaque FROM orders)"
blinded = lambda o: C.opaque_ids(o.select("o_orderkey"), "o_orderkey", "salt")
add("W04_opaque_ids", "", blinded, f"WITH {_OP} SELECT * FROM op", tables="orders")
add("P34_opaque_format", "", lambda o: V.id_checks(blinded(o), "opaque", r"^SA-\d{6,}$"), f"WITH {_OP}, u AS (SELECT opaque, count(*) AS n FROM op GROUP BY 1), v AS (SELECT coalesce(sum(n) FILTER (NOT regexp_matches(opaque, '^SA-\\d{{6,}}$')), 0) AS bad, coalesce(sum(n - 1), 0) AS repeated FROM u) SELECT 'bad_format' AS \"check\", bad::bigint AS violations, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v UNION ALL SELECT 'repeated', repeated::bigint, CASE WHEN repeated = 0 THEN 'PASS' ELSE 'FAIL' END FROM v", tables="orders")


def strata(p):
    """Claims with what controls are matched on: label, sets, pages and the terciles of two lengths."""
    number = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("claim_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    rows = classed(p).select("claim_id", "gold", "n_sets", "cohort", (1 + F.pmod(number("pages"), F.lit(3))).alias("n_pages"), F.pmod(number("claim"), F.lit(40)).alias("claim_words"), F.pmod(number("text"), F.lit(300)).alias("evidence_words"))
    return C.terciles(C.terciles(rows, "claim_words", "claim_id", name="claim_tercile"), "evidence_words", "claim_id", name="evidence_tercile")


MATCH_ON = ["gold", "n_sets", "n_pages", "claim_tercile", "evidence_tercile"]
_M = ", ".join(MATCH_ON)
_TER = lambda c: f"CASE WHEN 3 * (row_number() OVER (ORDER BY {c}, claim_id) - 1) < n - 1 THEN 1 WHEN 3 * (row_number() OVER (ORDER BY {c}, claim_id) - 1) < 2 * (n - 1) THEN 2 ELSE 3 END"
add(
    "T32_matched_controls",
    "predictions",
    lambda p: (lambda c: C.matched(c.filter("cohort IN ('regression', 'resistant')"), c.filter("cohort = 'robust'"), MATCH_ON, "claim_id", "match:"))(strata(p)).select("claim_id", *MATCH_ON, "pick"),
    f"""WITH c0 AS (SELECT claim_id, gold, n_sets, {_CC} AS cohort, 1 + @H['pages' || claim_id] % 3 AS n_pages, @H['claim' || claim_id] % 40 AS cw, @H['text' || claim_id] % 300 AS ew, count(*) OVER () AS n FROM paired),
    c AS (SELECT *, {_TER('cw')} AS claim_tercile, {_TER('ew')} AS evidence_tercile FROM c0), w AS (SELECT {_M}, count(*) AS wanted FROM c WHERE cohort IN ('regression', 'resistant') GROUP BY ALL),
    d AS (SELECT c.*, coalesce(row_number() OVER (PARTITION BY {_M} ORDER BY md5('match:' || claim_id), claim_id) <= wanted, false) AS inside FROM c LEFT JOIN w USING ({_M}) WHERE cohort = 'robust')
    SELECT claim_id, {_M}, CASE WHEN inside THEN 'stratum' ELSE 'top_up' END AS pick FROM d ORDER BY NOT inside, md5('match:' || claim_id), claim_id LIMIT 250""",
    views="paired",
)

add("S11_event_summary", "attempts", lambda a: V.event_summary(a, "job_id"), "SELECT job_id, " + ", ".join(f"count(*) FILTER (status = '{k}') AS n_{k}" for k in ("accepted", "error", "invalid", "blocked")) + ", count(DISTINCT agent) AS agents, arg_max(event_id, (ts, event_id)) FILTER (status = 'error') AS last_error FROM attempts GROUP BY job_id")
add("S12_log_carry", "attempts", lambda a: V.carried(a, F.when(F.col("status") == "accepted", F.col("event_id")), "job_id", ["attempt"]).select("event_id", "job"), "SELECT event_id, last_value(CASE WHEN status = 'accepted' THEN event_id END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS job FROM attempts")
add("A45_session_reuse", "attempts", V.reuse, "SELECT agent, count(DISTINCT job_id) AS jobs, count(*) AS attempts FROM attempts GROUP BY agent HAVING count(DISTINCT job_id) > 1")
add("A47_attempt_rollup", "attempts", V.rollup, "SELECT job_id, count(*) AS n, count(*) = max(attempt) AS contiguous, min(attempt) FILTER (status IN ('accepted', 'error')) AS first_valid, min(attempt) FILTER (status = 'accepted') AS first_accepted, min(attempt) FILTER (status IN ('accepted', 'error')) < min(attempt) FILTER (status = 'accepted') AS earlier_valid FROM attempts GROUP BY job_id")
add("V08_selection_policy", "attempts", lambda a: V.selected(a).withColumnRenamed("attempt", "accepted").join(V.selected(a, "first_valid").withColumnRenamed("attempt", "first_valid"), "job_id", "full_outer"), "SELECT coalesce(x.job_id, y.job_id) AS job_id, accepted, first_valid FROM (SELECT job_id, max(attempt) AS accepted FROM attempts WHERE status = 'accepted' GROUP BY 1) x FULL JOIN (SELECT job_id, min(attempt) AS first_valid FROM attempts WHERE status IN ('accepted', 'error') GROUP BY 1) y ON x.job_id = y.job_id")
add("P36_attempt_class", "attempts", lambda a: a.select("event_id", F.when(F.col("status") == "accepted", "own").when(F.col("status") == "error", "collision").otherwise("not_launched").alias("kind"), F.forall(F.array(F.col("attempt") > 0, F.col("value").isNotNull(), F.col("agent") >= 0), lambda x: x).alias("established")), "SELECT event_id, CASE status WHEN 'accepted' THEN 'own' WHEN 'error' THEN 'collision' ELSE 'not_launched' END AS kind, attempt > 0 AND value IS NOT NULL AND agent >= 0 AS established FROM attempts")
add("V07_quarantine", "attempts", lambda a: a.join(V.selected(a).select("job_id").distinct(), "job_id", "left_anti").groupBy("status").agg(F.count("*").alias("n")), "SELECT status, count(*) AS n FROM attempts WHERE job_id NOT IN (SELECT job_id FROM attempts WHERE status = 'accepted') GROUP BY status")
add("P31_batch_order", "judgments", lambda j: V.exact_order(j.withColumn("grp", F.concat_ws(":", "item_id", "stage")), "grp", "judge_no", "judge_id", "confidence").drop("misplaced").groupBy("in_order").agg(F.count("*").alias("n")), "SELECT in_order, count(*) AS n FROM (SELECT item_id, stage, bool_and(a = b) AS in_order FROM (SELECT item_id, stage, row_number() OVER (PARTITION BY item_id, stage ORDER BY judge_no) AS a, row_number() OVER (PARTITION BY item_id, stage ORDER BY confidence, judge_no) AS b FROM judgments) x GROUP BY ALL) y GROUP BY in_order")
_OK = "verdict IN ('Supported', 'Refuted', 'Ambiguous') AND confidence BETWEEN 0 AND 90 AND len(flags) > 0"
add("P30_schema_valid", "judgments", lambda j: j.select("item_id", "stage", "judge_no", (F.col("verdict").isin("Supported", "Refuted", "Ambiguous") & F.col("confidence").between(0, 90) & F.forall(F.split("flags", ";"), lambda x: F.length(x) > 0)).alias("valid")), f"SELECT item_id, stage, judge_no, {_OK} AS valid FROM judgments")
add("P33_blinding", "", lambda e: V.checks(e, {"model_name_in_value": F.lower("props").contains("gpt"), "prohibited_key": F.exists(F.json_object_keys("props"), lambda k: k.isin("k", "model")), "not_an_object": F.json_object_keys("props").isNull()}), "WITH x AS (SELECT count(*) FILTER (contains(lower(props), 'gpt')) AS a, count(*) FILTER (len(list_intersect(json_keys(props), ['k', 'model'])) > 0) AS b FROM events) SELECT 'model_name_in_value' AS \"check\", a AS violations, CASE WHEN a = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM x UNION ALL SELECT 'prohibited_key', b, CASE WHEN b = 0 THEN 'PASS' ELSE 'FAIL' END FROM x UNION ALL SELECT 'not_an_object', 0, 'PASS'", tables="events")
_GAP = "item_id % 97 = 0 AND judge_no = 2 AND stage = 'B'"
add("A36_completeness", "judgments", lambda j: j.groupBy("judge_id", "stage").agg(F.count("*").alias("expected"), F.count_if(~F.expr(_GAP)).alias("valid")).withColumn("missing", F.col("expected") - F.col("valid")), f"SELECT judge_id, stage, count(*) AS expected, count(*) FILTER (NOT ({_GAP})) AS valid, count(*) FILTER ({_GAP}) AS missing FROM judgments GROUP BY ALL")
add("A37_missing_manifest", "judgments", lambda j: j.join(j.filter(f"NOT ({_GAP})"), ["item_id", "stage", "judge_no"], "left_anti").select("item_id", "stage", "judge_no"), f"SELECT item_id, stage, judge_no FROM judgments WHERE {_GAP}")
add("A38_completion", "judgments", lambda j: j.groupBy(F.when(F.col("stage") == "C", "required").otherwise("optional").alias("scope")).agg(F.count("*").alias("expected"), F.count_if(~F.expr(_GAP)).alias("done")).withColumn("complete", F.col("expected") == F.col("done")), f"SELECT CASE WHEN stage = 'C' THEN 'required' ELSE 'optional' END AS scope, count(*) AS expected, count(*) FILTER (NOT ({_GAP})) AS done, count(*) = count(*) FILTER (NOT ({_GAP})) AS complete FROM judgments GROUP BY 1")
_V01 = {"no_id": "claim_id IS NULL", "unknown_gold": "gold NOT IN ('Supported', 'Refuted')", "unknown_model": "model NOT IN ('large', 'small')", "invalid_output": "model_output NOT IN ('Supported', 'Refuted')", "no_sets": "n_sets < 1"}
add("V01_source_checks", "predictions", lambda p: V.checks(p, {n: F.expr(e) for n, e in _V01.items()}), " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER ({e}) AS violations, CASE WHEN count(*) FILTER ({e}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM predictions" for n, e in _V01.items()))
add("V02_headlines", "predictions", lambda p: V.headlines(P.accuracy(P.judged(p), "model", "cond").select(F.concat_ws("/", "model", "cond").alias("id"), F.col("accuracy").alias("value")), [("large/claim_only", 0.88, 0.05), ("small/with_evidence", 0.94, 0.05), ("tiny/claim_only", 0.5, 0.05)]), "WITH m AS (SELECT model || '/' || cond AS id, count(*) FILTER (correct) / count(correct) AS value FROM judged GROUP BY model, cond) SELECT r.id, expected, value, coalesce(abs(value - expected) <= tol, false) AS ok FROM (VALUES ('large/claim_only', 0.88::double, 0.05::double), ('small/with_evidence', 0.94, 0.05), ('tiny/claim_only', 0.5, 0.05)) AS r(id, expected, tol) LEFT JOIN m USING (id)", views="judged")
add("V06_recompute_diff", "", lambda o: V.difference(o.select("o_orderkey", "o_orderstatus"), o.filter("o_orderkey % 50 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 40 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))), "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 50 <> 1), l AS (SELECT o_orderkey, o_orderstatus FROM orders) SELECT *, 'left' AS side, 1 AS times FROM (FROM l EXCEPT ALL FROM r) UNION ALL SELECT *, 'right', 1 FROM (FROM r EXCEPT ALL FROM l)", tables="orders")
add("U02_set_operations", "predictions", lambda p: (lambda w: w.filter(f"{L} = 'regression'").select("claim_id").union(w.filter(f"{S} = 'regression'").select("claim_id")).distinct().withColumn("op", F.lit("union")).union(w.filter(f"{L} = 'regression'").select("claim_id").intersect(w.filter(f"{S} = 'regression'").select("claim_id")).withColumn("op", F.lit("intersect"))))(P.paired(P.judged(p))).groupBy("op").agg(F.count("*").alias("n")), f"SELECT 'union' AS op, count(*) FILTER ({L} = 'regression' OR {S} = 'regression') AS n FROM paired UNION ALL SELECT 'intersect', count(*) FILTER ({L} = 'regression' AND {S} = 'regression') FROM paired", views="paired")
add("A42_representative_cases", "predictions", lambda p: classed(p).groupBy("cohort").agg(F.min("claim_id").alias("claim_id")), f"SELECT {_CC} AS cohort, min(claim_id) AS claim_id FROM paired GROUP BY 1", views="paired")
add("A43_first_three", "predictions", lambda p: classed(p).withColumn("r", F.expr("row_number() over (partition by cohort order by claim_id)")).filter("r <= 3").select("cohort", "claim_id", "r"), f"SELECT * FROM (SELECT {_CC} AS cohort, claim_id, row_number() OVER (PARTITION BY {_CC} ORDER BY claim_id) AS r FROM paired) x WHERE r <= 3", views="paired")
add("T23_logit_wald", "predictions", lambda p: M.logit(classed(p).select((F.col("cohort") == "regression").cast("double").alias("y"), F.col("n_sets").cast("double").alias("sets"), (F.col("gold") == "Supported").cast("double").alias("supported")), "y", ["sets", "supported"]))
add("T24_l2_logistic", "predictions", lambda p: M.l2_logistic(classed(p).select("claim_id", (F.col("cohort") == "regression").cast("double").alias("y"), F.col("n_sets").cast("double").alias("sets"), (F.col("gold") == "Supported").cast("double").alias("supported")), "y", ["sets", "supported"]))
add("T26_group_kfold", "", lambda o: M.folds(o, "o_custkey").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups")), "SELECT @H[o_custkey::varchar] % 5 AS fold, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY 1", tables="orders")
add("T30_leakage_audit", "texts", lambda t: M.leakage(t, "claim_id", "text"), "WITH g AS (SELECT trim(regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS k, count(*) AS n, count(DISTINCT @H[claim_id::varchar] % 5) AS folds FROM texts GROUP BY 1) SELECT sum(n) AS total_rows, count(*) AS groups, count(*) FILTER (n > 1) AS duplicate_groups, count(*) FILTER (folds > 1) AS groups_across_folds FROM g")
