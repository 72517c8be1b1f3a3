"""Queries on single predicates, scalar functions, evidence parsing, models and the two batteries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.functions import text as T
from pairscope.operators import batteries as B
from pairscope.operators import cohort as C
from pairscope.operators import evidence as E
from pairscope.operators import models as M
from pairscope.operators import paired as P
from pairscope.operators import panel as N
from pairscope.operators import ranks as R
from pairscope.operators import stats as S
from pairscope.plans.book import Book
from pairscope.plans.panel import _C, _CW, _D, _TAX, CATEGORIES, _consensus, classified
from pairscope.plans.quality import _CON, _PLAIN, _SC, scored
from pairscope.plans.statistics import _LC
from pairscope.plans.studies import _CC, _EV, L, claims, classed, found, set_ids
from pairscope.plans.studies import S as SMALL

book = Book()
add = book.add
_H = lambda salt, key: F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")

# predicates

#: Labels as the source writes them.
RAW_LABELS = {"SUPPORTS": "Supported", "REFUTES": "Refuted"}
_RAW = "CASE WHEN claim_id % 13 = 0 THEN 'NOT ENOUGH INFO' WHEN gold = 'Supported' THEN 'SUPPORTS' ELSE 'REFUTES' END"
add("P01_label_remap", "predictions", lambda p: p.select("claim_id", F.expr(_RAW).alias("raw")).distinct().select("claim_id", "raw", F.create_map(*(F.lit(x) for pair in RAW_LABELS.items() for x in pair))[F.col("raw")].alias("label")), f"SELECT DISTINCT claim_id, {_RAW} AS raw, CASE WHEN claim_id % 13 = 0 THEN NULL ELSE gold END AS label FROM predictions")
_EVID = "CASE WHEN claim_id % 17 = 0 THEN '  ' WHEN claim_id % 19 = 0 THEN NULL ELSE 'evidence' END"
add("P05_preflight", "predictions", lambda p: p.groupBy("model", "cond").agg(F.count("*").alias("n"), F.count_if((F.col("cond") == "with_evidence") & (F.trim(F.coalesce(F.expr(_EVID), F.lit(""))) == "")).alias("empty_evidence")), f"SELECT model, cond, count(*) AS n, count(*) FILTER (cond = 'with_evidence' AND trim(coalesce({_EVID}, '')) = '') AS empty_evidence FROM predictions GROUP BY ALL")


def error_kinds(p):
    """The recorded kind of an error, else one worked out; some kinds are blanked and some outputs spoilt."""
    rows = P.judged(p).withColumn("error_type", F.when(F.col("claim_id") % 3 == 0, " ").otherwise(F.col("error_type")))
    return rows.select("claim_id", "model", "cond", P.error_kind(F.col("error_type"), F.col("prediction"), F.col("gold")).alias("kind"))


add("P09_error_kind", "predictions", error_kinds, "SELECT claim_id, model, cond, CASE WHEN claim_id % 3 > 0 AND error_type <> '' THEN error_type WHEN prediction IS NULL THEN 'invalid_or_missing_output' WHEN gold = 'Supported' AND prediction = 'Refuted' THEN 'supported_to_refuted' WHEN gold = 'Refuted' AND prediction = 'Supported' THEN 'refuted_to_supported' ELSE 'other_error' END AS kind FROM judged", views="judged")
add("P11_valid_prediction", "predictions", lambda p: p.select("claim_id", "model", "cond", F.col("model_output").isin(P.LABELS).alias("valid")), "SELECT claim_id, model, cond, model_output IN ('Supported', 'Refuted') AS valid FROM predictions")
add("P13_agreement_flags", "predictions", lambda p: P.paired(P.judged(p)).select("claim_id", "agree_co", "agree_ev", "agree_transition"), "SELECT claim_id, agree_co, agree_ev, agree_transition FROM paired", views="paired")
add("P14_ambiguity", "judgments", lambda j: N.consensus(j).select("item_id", "stage", F.col("consensus").isin("Ambiguous", "Unresolved").alias("ambiguous")), f"{_C} SELECT item_id, stage, consensus IN ('Ambiguous', 'Unresolved') AS ambiguous FROM cons")
add("P40_category_order", "judgments", lambda j: N.proportions(classified(j), "category", CATEGORIES).select(F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category")).alias("position"), "category", "n"), f"{_CW} SELECT position::bigint AS position, d.category, count(x.category) AS n FROM (VALUES {', '.join(f'''({i}, '{c}')''' for i, c in enumerate(CATEGORIES, 1))}) AS d(position, category) LEFT JOIN (SELECT {_TAX} AS category FROM wide) x ON x.category = d.category GROUP BY ALL")
add("P39_report_format", "predictions", lambda p: P.accuracy(P.judged(p), "model", "cond").select("model", "cond", F.format_string("%.2f%%", 100 * F.col("accuracy")).alias("shown"), F.when(F.col("accuracy") < 0.001, "<0.001").otherwise(F.format_string("%.3f", "accuracy")).alias("share")), "SELECT model, cond, printf('%.2f%%', 100 * count(*) FILTER (correct) / count(correct)) AS shown, printf('%.3f', count(*) FILTER (correct) / count(correct)) AS share FROM judged GROUP BY ALL", views="judged")

# order

_COEF = "avg(l_quantity) - 25.5"
add("W12_by_size_of_coefficient", "", lambda li: R.placed(li.groupBy("l_linenumber").agg((F.avg("l_quantity") - 25.5).alias("coefficient")), [], [F.abs("coefficient").desc(), F.col("l_linenumber")]).select("position", "l_linenumber", F.round("coefficient", 6).alias("coefficient")), f"SELECT row_number() OVER (ORDER BY abs({_COEF}) DESC, l_linenumber) AS position, l_linenumber, round({_COEF}, 6) AS coefficient FROM lineitem GROUP BY l_linenumber", tables="lineitem")
add("W14_most_common_first", "judgments", lambda j: R.placed(N.flag_counts(j).groupBy("flag").agg(F.sum("n").alias("n")), [], [F.col("n").desc(), F.col("flag")]).select("position", "flag", "n"), "SELECT row_number() OVER (ORDER BY count(*) DESC, flag) AS position, flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM judgments) x WHERE flag <> 'none' GROUP BY flag")

# text and hashes

_SETS = f"SELECT claim_id, {_CON('claim')} AS a, {_CON('evidence')} AS b FROM texts"
add("U05_token_sets", "texts", lambda t: t.select("claim_id", T.content(F.col("claim")).alias("a"), T.content(F.col("evidence")).alias("b")).select("claim_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("any"), F.size(F.array_except("a", "b")).alias("claim_only")), f"SELECT claim_id, len(list_intersect(a, b)) AS both, len(list_distinct(a || b)) AS \"any\", len(a) - len(list_intersect(a, b)) AS claim_only FROM ({_SETS}) x")
add("F02_page_key", "", lambda p: p.select("p_partkey", T.page_key(F.concat(F.lit("  "), "p_name", F.lit(" é x"))).alias("key")), "SELECT p_partkey, replace(nfc_normalize(trim(p_name || ' é x')), ' ', '_') AS key FROM part", tables="part")
add("F14_date_missing", "texts", lambda t: t.select("claim_id", T.overlap(F.col("claim"), F.col("evidence"))["date_missing"].alias("date_missing")), f"SELECT claim_id, regexp_matches({_PLAIN('claim')}, '{T.PATTERNS['date']}') AND NOT regexp_matches({_PLAIN('evidence')}, '{T.PATTERNS['date']}') AS date_missing FROM texts")
_ENT = lambda c: f"list_distinct(regexp_extract_all({_PLAIN(c)}, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*'))"
add("F15_entity_overlap", "texts", lambda t: t.select("claim_id", T.entities(F.col("claim")).alias("a"), T.entities(F.col("evidence")).alias("b")).select("claim_id", F.size("a").alias("claim_entities"), F.size("b").alias("evidence_entities"), F.size(F.array_intersect("a", "b")).alias("shared")), f"SELECT claim_id, len(a) AS claim_entities, len(b) AS evidence_entities, len(list_intersect(a, b)) AS shared FROM (SELECT claim_id, {_ENT('claim')} AS a, {_ENT('evidence')} AS b FROM texts) x")


#: The order in which each of two models reports its classes.
CLASS_ORDER = {"first": ["contradiction", "neutral", "entailment"], "second": ["entailment", "neutral", "contradiction"]}


def class_probabilities(p):
    """Two models' class scores, each in its own order, under the classes' names."""
    rows = p.select("claim_id").distinct().withColumn("w", F.array(*(_H(s, "claim_id").cast("double") for s in "xyz")))
    share = F.transform("w", lambda v: v / F.aggregate("w", F.lit(0.0), lambda s, x: s + x))
    return rows.select("claim_id", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), *(F.round(F.get(share, F.lit(order.index(k))), 6).alias(k) for k in sorted(order))) for m, order in CLASS_ORDER.items()))))


add("F18_class_order", "predictions", class_probabilities, "WITH x AS (SELECT claim_id, x / (x + y + z) AS p0, y / (x + y + z) AS p1, z / (x + y + z) AS p2 FROM (SELECT DISTINCT claim_id, @H['x' || claim_id]::double AS x, @H['y' || claim_id]::double AS y, @H['z' || claim_id]::double AS z FROM predictions) w) SELECT claim_id, 'first' AS model, round(p0, 6) AS contradiction, round(p2, 6) AS entailment, round(p1, 6) AS neutral FROM x UNION ALL SELECT claim_id, 'second', round(p2, 6), round(p0, 6), round(p1, 6) FROM x")
_N = "trim(regexp_replace(lower(claim), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_GRAMS = f"SELECT claim_id, CASE WHEN len(n) < 3 THEN [n] ELSE list_distinct([n[i : i + 2] FOR i IN generate_series(1, len(n) - 2)]) END AS g FROM (SELECT claim_id, {_N} AS n FROM texts) x"
add("F20_minhash", "texts", lambda t: t.select("claim_id", F.md5(F.array_join(T.minhash(T.shingles(F.col("claim"))).cast("array<string>"), ",")).alias("signature")), f"SELECT claim_id, md5(list_aggregate([list_min([xor(x, s) FOR x IN h]) FOR s IN {T.seeds(200)}::bigint[]], 'string_agg', ',')) AS signature FROM (SELECT claim_id, [('0x' || substr(md5(x), 1, 8))::bigint FOR x IN g] AS h FROM ({_GRAMS}) y) z")
add("F21_jaccard", "texts", lambda t: t.select("claim_id", F.round(T.overlap(F.col("claim"), F.col("evidence"))["jaccard"], 6).alias("jaccard")), f"SELECT claim_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b))), 6) AS jaccard FROM ({_SETS}) x")
add("F22_multi_part_digest", "judgments", lambda j: j.groupBy("item_id", "stage").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("judge_no", F.concat_ws("|", "verdict", "sufficiency", "flags").alias("v")))), lambda x: F.sha2(x["v"], 256)), ""), 256).alias("digest")), "SELECT item_id, stage, sha256(string_agg(sha256(verdict || '|' || sufficiency || '|' || flags), '' ORDER BY judge_no)) AS digest FROM judgments GROUP BY ALL")
_NOW = "CASE WHEN conv_id % 3 = 0 THEN replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) WHEN conv_id % 3 = 1 THEN coalesce(text, '') ELSE 'x' || coalesce(text, '') END"
add("F23_line_end_digest", "", lambda c: c.select("conv_id", "turn", T.digest_status(F.expr(_NOW), F.sha2(F.coalesce("text", F.lit("")), 256), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("status")), f"SELECT conv_id, turn, CASE WHEN sha256(n) = sha256(t) THEN 'exact_recorded_bytes' WHEN sha256(replace(n, chr(13) || chr(10), chr(10))) = sha256(t) THEN 'eol_only_equivalent' ELSE 'changed' END AS status FROM (SELECT conv_id, turn, {_NOW} AS n, coalesce(text, '') AS t FROM conversations) x", tables="conversations")


def cache_key(o):
    """A key of a model, the number of rows and the first 200 ids."""
    first = o.select("o_orderkey").orderBy("o_orderkey").limit(200).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("ids"))
    return o.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first)).select(F.sha2(F.concat_ws("|", F.lit("model"), "n", "ids"), 256).alias("key"))


add("F24_cache_key", "", cache_key, "SELECT sha256('model|' || (SELECT count(*) FROM orders) || '|' || string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey)) AS key FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 200) x", tables="orders")
_PATH = "CASE WHEN p_partkey % 5 = 0 THEN '../' || p_name WHEN p_partkey % 7 = 0 THEN '/' || p_name ELSE 'tables/' || p_name END"
_VER = "lower(replace(p_name, ' ', '_'))"
add("F30_names_and_paths", "", lambda p: p.select("p_partkey", F.expr(_VER).rlike("^[a-z0-9][a-z0-9_-]{0,63}$").alias("version_name"), (~F.expr(_PATH).rlike(r"(^/)|(^|/)\.\.(/|$)")).alias("inside")), f"SELECT p_partkey, regexp_matches({_VER}, '^[a-z0-9][a-z0-9_-]{{0,63}}$') AS version_name, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS inside FROM part", tables="part")

# evidence


def stored_sets(conv):
    """Sets with ids and pages, and what claims stored: the id of their first set, an unknown id, or pages the wrong way round."""
    rows = E.parsed_sets(claims(conv), "conv_id", "raw")
    pages = rows.groupBy("conv_id", "set_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "page", "sent_idx"))), lambda x: x["page"]).alias("pages"))
    sets = set_ids(conv).join(pages, ["conv_id", "set_index"])
    kind = F.col("conv_id") % 3
    wanted = sets.filter("set_index = 0").select("conv_id", F.when(kind == 0, "fever_set_none").otherwise(F.col("set_id")).alias("set_id"), F.when(kind == 1, F.concat(F.array(F.lit("page_x")), "pages")).otherwise(F.col("pages")).alias("pages"))
    return E.selected(sets, wanted, "conv_id")


add("F05_selected_set", "", stored_sets, f"""WITH {_EV}, si AS (SELECT conv_id, 'fever_set_' || substr(sha1('{{"set_index":0,"pointers":[' || string_agg('{{"page":"' || page || '","sent_idx":' || sent_idx || '}}', ',' ORDER BY position) || ']}}'), 1, 12) AS set_id FROM pt WHERE set_index = 0 GROUP BY conv_id)
  SELECT conv_id, CASE WHEN conv_id % 3 = 2 THEN 0 END AS set_index, CASE conv_id % 3 WHEN 0 THEN 'selected_set_identity_unavailable:fever_set_none' WHEN 1 THEN 'selected_set_order_or_length_mismatch' END AS error FROM si""", tables="conversations")
_PTR = {"short": "array('a', 'b', 'c')", "blank": "array('a', 'b', ' ', '1')", "word": "array('a', 'b', 'page', 'x')", "sound": "array('a', 'b', 'page', cast(turn AS string))", "more": "array('a', 'b', 'page', '2', 'z')"}
_KIND = "CASE conv_id % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'blank' WHEN 2 THEN 'word' WHEN 3 THEN 'sound' ELSE 'more' END"
add("F06_pointer_errors", "", lambda c: c.select("conv_id", "turn", E.pointer_error(F.expr("CASE " + " ".join(f"WHEN {_KIND} = '{k}' THEN {a}" for k, a in _PTR.items()) + " END")).alias("error")), "SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'invalid_evidence_pointer' WHEN 1 THEN 'invalid_evidence_pointer_title' WHEN 2 THEN 'invalid_evidence_pointer_sentence_index' END AS error FROM conversations", tables="conversations")
_BAD = """CASE conv_id % 5 WHEN 0 THEN 'no json' WHEN 1 THEN '[[], []]' WHEN 2 THEN '[[["a", "b", "p"]]]' WHEN 3 THEN '[[["a", "b", "p", "x"]]]' ELSE '[[["a", "b", "p", "1"]], []]' END"""
add("F08_raw_errors", "", lambda c: c.select("conv_id", "turn", E.raw_error(F.expr(_BAD)).alias("error")), "SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'bad_raw_evidence:ValueError' WHEN 1 THEN 'bad_raw_evidence:no_evidence_sets' WHEN 2 THEN 'bad_raw_evidence:invalid_evidence_pointer' WHEN 3 THEN 'bad_raw_evidence:invalid_evidence_pointer_sentence_index' END AS error FROM conversations", tables="conversations")
add("F08_failure_codes", "", lambda c: E.failure_code(found(c).filter("set_index > 1"), "conv_id"), f"WITH {_EV}, s AS (SELECT conv_id, set_index, count(failure) AS bad, arg_min(failure, position) FILTER (failure IS NOT NULL) AS first FROM rs WHERE set_index > 1 GROUP BY ALL) SELECT conv_id, CASE WHEN min(bad) > 0 THEN arg_max(first, set_index) FILTER (bad > 0) END AS failure FROM s GROUP BY conv_id", tables="conversations")
_JSON = "CASE event_id % 4 WHEN 0 THEN '[1, [2, 3], \"x\"]' WHEN 1 THEN '[' WHEN 2 THEN props ELSE NULL END"
add("F09_json_length", "", lambda e: e.select("event_id", E.json_length(F.expr(_JSON)).cast("bigint").alias("n")), "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END::bigint AS n FROM events", tables="events")

# models


def learned(p):
    """Claims with the measures a model learns from; some are missing and take the median."""
    rows = scored(p).withColumn("regression", ((F.col(L) == "regression") | (F.col(SMALL) == "regression")).cast("double"))
    held = rows.select("claim_id", "regression", F.col("n_sets").cast("double").alias("sets"), (F.col("gold") == "Supported").cast("double").alias("supported"), F.when(_H("gap", "claim_id") % 7 > 0, F.col("margin")).alias("margin"), F.col("weak").cast("double").alias("weak"))
    return M.imputed(held, ["margin"])


add("T28_median_imputation", "predictions", lambda p: learned(p).select("claim_id", F.round("margin", 6).alias("margin")), f"WITH {_SC}, x AS (SELECT claim_id, CASE WHEN @H['gap' || claim_id] % 7 > 0 THEN margin END AS margin FROM sc) SELECT claim_id, round(coalesce(margin, (SELECT median(margin) FROM x)), 6) AS margin FROM x", views="paired")
add("T25_boosted_trees", "predictions", lambda p: (lambda r: S.curves(r.select("score", (F.col("y") == 1).alias("pos")), "score", "pos"))(M.boosted(M.folds(learned(p), "claim_id"), "regression", ["sets", "supported", "margin", "weak"], "claim_id", "fold")))
add("T29_cluster_stability", "", lambda e: M.clusters(e, "embedding", 8, [1, 2, 3]), tables="embeddings")

# batteries


def battery_rows(p, j):
    """Claims with class, stage labels, category and two diagnostics."""
    kinds = C.regression_type(F.col(L), F.col(SMALL))
    own = classed(p).select("claim_id", "cohort", F.when(F.col("cohort") == "regression", kinds).otherwise("").alias("regression_type"))
    more = scored(p).select("claim_id", F.col("disagrees").alias("nli_disagrees"), (_H("nli2", "claim_id") % 3 == 0).alias("nli2_disagrees"))
    rule = N.consensus(j).filter("stage = 'C'").select(F.col("item_id").alias("claim_id"), F.col("rule").alias("rule_c"))
    wide = B.trajectories(classified(j).select(F.col("item_id").alias("claim_id"), "gold", "a", "b", "c", "category"))
    return wide.join(own, "claim_id").join(more, "claim_id").join(rule, "claim_id")


_AMB = {f"ambiguous_{s}": f"NOT ({_D(s.lower())})" for s in "ABC"}
_MOVES = _AMB | {"resolved_by_titles": f"NOT ({_D('a')}) AND {_D('b')}", "resolved_at_C": f"NOT ({_D('b')}) AND {_D('c')}", "reversed_after_titles": f"{_D('a')} AND {_D('b')} AND a <> b", "reversed_at_C": f"{_D('b')} AND {_D('c')} AND b <> c", "change_A_B": "a <> b", "change_B_C": "b <> c"}
_FEATURES = _MOVES | {"nli_disagrees": "nli_disagrees", "nli2_disagrees": "nli2_disagrees", "high_decisive_C": f"({_D('c')}) AND rule_c = 'high_consensus'", "gold_agreeing_C": "c = gold", "gold_disagreeing_C": f"({_D('c')}) AND rule_c = 'high_consensus' AND c <> gold"} | {k: f"category = '{k}'" for k in CATEGORIES}
_GROUPS = {"all": "true", "shared": "cohort = 'regression' AND regression_type = 'both'", "specific": "cohort = 'regression' AND regression_type <> 'both'"} | {c: f"cohort = '{c}'" for c in B.COHORTS}


def _cells_sql(kind: str, group: str, other: str, feature: str) -> list[str]:
    hit = f"({_FEATURES[feature]})"
    if kind in ("rate", "odds"):
        mine, rest = f"({_GROUPS[group]})", f"({_GROUPS[other]})" if kind == "odds" else "false"
        return [f"{mine} AND {hit}", f"{mine} AND NOT {hit}", f"{rest} AND {hit}", f"{rest} AND NOT {hit}"]
    before = f"({_FEATURES[other]})"
    return [f"{before} AND {hit}", f"{before} AND NOT {hit}", f"NOT {before} AND {hit}", f"NOT {before} AND NOT {hit}"]


_FISHER = f"""least(1.0, (SELECT sum(w) FROM (SELECT exp({_LC('(a + c)', 'x')} + {_LC('(b + d)', '(a + b - x)')} - {_LC('(a + b + c + d)', '(a + b)')}) AS w FROM (SELECT unnest(generate_series(greatest(0, a - d)::bigint, least(a + b, a + c)::bigint)) AS x) s) t
    WHERE w <= exp({_LC('(a + c)', 'a')} + {_LC('(b + d)', 'b')} - {_LC('(a + b + c + d)', '(a + b)')}) * (1 + 1e-7)))"""
_BINOMIAL = "least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM (SELECT unnest(generate_series(0, least(b, c)::bigint)) AS i) s))"
# the upper tail of chi squared with one degree of freedom, by the series of the error function
_TAIL = "CASE WHEN statistic > 60 THEN 0 WHEN statistic = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-statistic / 2) * (SELECT sum(exp((2 * i + 1) * ln(sqrt(statistic / 2)) - ln(2) - lgamma(i + 1.5) + 0.5 * ln(pi()))) FROM (SELECT unnest(generate_series(0, 200)) AS i) s) END"


def _tested_sql(counts: str, floor_all: bool = False) -> str:
    """Figures and p of rows (family, analysis, kind, a, b, c, d), adjusted by family."""
    z = S.Z95
    one, two = ("greatest(a, 0.5)", "greatest(c, 0.5)") if floor_all else ("a", "c")
    no_ratio = "a + b = 0 OR c + d = 0" + ("" if floor_all else " OR a = 0 OR c = 0")
    half = f"{z} * sqrt(a / (a + b) * (b / (a + b)) / (a + b) + {z * z} / (4 * (a + b) * (a + b)))"
    return f"""k AS (SELECT family, analysis, kind, a::double AS a, b::double AS b, c::double AS c, d::double AS d FROM ({counts}) q),
  f AS (SELECT *, a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 AS flat, {no_ratio} AS no_ratio, abs(a * d - b * c) / (a + b + c + d) AS gap FROM k),
  g AS (SELECT *, CASE WHEN kind = 'rate' AND a + b = 0 THEN 'not_estimable_empty_denominator' WHEN kind = 'odds' AND (a + b = 0 OR c + d = 0) THEN 'not_estimable_empty_group' WHEN kind = 'odds' AND no_ratio THEN 'undefined_historical_OR_zero_event_cell'
      WHEN kind = 'paired' AND a + b + c + d = 0 THEN 'not_estimable_empty_or_unpaired' WHEN kind = 'paired' AND b + c = 0 THEN 'undefined_no_discordant_pairs' WHEN kind = 'table' AND flat THEN 'not_estimable_constant_margin' ELSE 'estimated' END AS status,
    CASE WHEN kind = 'odds' AND NOT no_ratio THEN {one} / greatest(b, 0.5) / ({two} / greatest(d, 0.5)) END AS odds_ratio, 1.96 * sqrt(1 / greatest(a, 0.5) + 1 / greatest(b, 0.5) + 1 / greatest(c, 0.5) + 1 / greatest(d, 0.5)) AS spread,
    CASE WHEN kind = 'paired' AND b + c > 0 THEN greatest(abs(b - c) - 1, 0) ** 2 / (b + c) WHEN kind = 'table' AND NOT flat THEN (gap - least(0.5, gap)) ** 2 * (a + b + c + d) * (1 / (a + b) + 1 / (c + d)) * (1 / (a + c) + 1 / (b + d)) END AS statistic FROM f),
  p AS (SELECT *, CASE WHEN kind = 'odds' AND a + b > 0 AND c + d > 0 THEN {_FISHER} WHEN statistic IS NOT NULL THEN {_TAIL} WHEN kind = 'exact' AND a + b + c + d > 0 THEN {_BINOMIAL} END AS p FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, analysis) AS rank, count(p) OVER (PARTITION BY family) AS size FROM p)
  SELECT analysis, kind, a::bigint AS a, b::bigint AS b, c::bigint AS c, d::bigint AS d, status, CASE WHEN kind = 'rate' AND a + b > 0 THEN 100 * a / (a + b) END AS rate_pct,
    CASE WHEN kind = 'rate' AND a + b > 0 THEN 100 * greatest(0, (a / (a + b) + {z * z} / (2 * (a + b)) - {half}) / (1 + {z * z} / (a + b))) END AS wilson_low, CASE WHEN kind = 'rate' AND a + b > 0 THEN 100 * least(1, (a / (a + b) + {z * z} / (2 * (a + b)) + {half}) / (1 + {z * z} / (a + b))) END AS wilson_high,
    odds_ratio, exp(ln(odds_ratio) - spread) AS ci_low, exp(ln(odds_ratio) + spread) AS ci_high, CASE WHEN kind IN ('paired', 'exact') THEN 100 * (c - b) / (a + b + c + d) END AS delta_pp, statistic, p, family,
    CASE WHEN p IS NOT NULL THEN least(1.0, min(p * size / rank) OVER (PARTITION BY family, p IS NULL ORDER BY rank DESC)) END AS p_bh, CASE WHEN p IS NULL THEN 0 ELSE size END::bigint AS family_size FROM r"""


_counts = lambda rows: " UNION ALL ".join(f"SELECT '{fam}' AS family, '{name}' AS analysis, '{kind}' AS kind, " + ", ".join(f"count(*) FILTER ({cell}) AS {n}" for n, cell in zip("abcd", cells, strict=True)) + " FROM base" for fam, name, kind, cells in rows)
_BASE = f"""{_CW}, cc AS (SELECT item_id, rule AS rule_c FROM cons WHERE stage = 'C'), {_SC},
  base AS (SELECT w.*, {_TAX.replace('item_id', 'w.item_id')} AS category, rule_c, disagrees AS nli_disagrees, @H['nli2' || w.item_id] % 3 = 0 AS nli2_disagrees, {_CC} AS cohort, CASE WHEN {L} = 'regression' AND {SMALL} = 'regression' THEN 'both' WHEN {L} = 'regression' OR {SMALL} = 'regression' THEN 'one' ELSE '' END AS regression_type
    FROM (SELECT item_id, gold, a, b, c FROM wide) w JOIN cc ON cc.item_id = w.item_id JOIN (SELECT claim_id, {L}, {SMALL}, disagrees FROM sc) s ON s.claim_id = w.item_id)"""
add("T20_endpoint_battery", "predictions judgments", lambda p, j: B.cohort_battery(battery_rows(p, j)), f"{_BASE}, {_tested_sql(_counts([(B.FAMILY, name, kind, _cells_sql(kind, *rest)) for name, kind, *rest in B.endpoints()]))}", views="paired")


def two_trajectories(p, j, b):
    """Regression claims with both panels' trajectories, and whether both models regressed."""
    def side(rows, i):
        held = B.trajectories(classified(rows).select("item_id", "gold", "a", "b", "c", "category"))
        return held.select(F.col("item_id").alias("claim_id"), *(F.col(c).alias(f"{c}_{i}") for c in ("category", *B.MEASURES)))

    own = classed(p).filter("cohort = 'regression'").select("claim_id", (C.regression_type(F.col(L), F.col(SMALL)) == "both").alias("shared"))
    return own.join(side(j, 1), "claim_id").join(side(b, 2), "claim_id")


_pair = lambda e, i: "(" + e.replace("a IN", f"a{i} IN").replace("b IN", f"b{i} IN").replace("c IN", f"c{i} IN").replace("a <> b", f"a{i} <> b{i}").replace("b <> c", f"b{i} <> c{i}") + ")"
_CROSS = [(m, _pair(_MOVES[m], 1), _pair(_MOVES[m], 2)) for m in B.MEASURES] + [(f"category_{k}", f"(category1 = '{k}')", f"(category2 = '{k}')") for k in CATEGORIES]
_CROSSED = [(B.CROSS, m, "exact", [f"{x} AND {y}", f"{x} AND NOT {y}", f"NOT {x} AND {y}", f"NOT {x} AND NOT {y}"]) for m, x, y in _CROSS] + [(B.SUBGROUP, f"panel_{i}_nondecisive_shared_vs_specific_OR", "odds", [f"{s} AND {o}" for s in ("shared", "NOT shared") for o in (_pair(_AMB["ambiguous_C"], i), "NOT " + _pair(_AMB["ambiguous_C"], i))]) for i in (1, 2)]
_WB = "wideb AS (SELECT item_id, min(gold) AS gold, min(consensus) FILTER (stage = 'A') AS a, min(consensus) FILTER (stage = 'B') AS b, min(consensus) FILTER (stage = 'C') AS c FROM consb GROUP BY item_id)"
_TWO = f"""{_CW}, {_consensus('judgments_b', 'consb')}, {_WB}, x1 AS (SELECT item_id, a AS a1, b AS b1, c AS c1, {_TAX} AS category1 FROM wide), x2 AS (SELECT item_id, a AS a2, b AS b2, c AS c2, {_TAX} AS category2 FROM wideb),
  base AS (SELECT *, {L} = 'regression' AND {SMALL} = 'regression' AS shared FROM x1 JOIN x2 USING (item_id) JOIN (SELECT claim_id AS item_id, {L}, {SMALL} FROM paired WHERE {L} = 'regression' OR {SMALL} = 'regression') r USING (item_id))"""
add("T21_cross_family_battery", "predictions judgments judgments_b", lambda p, j, b: B.cross_battery(two_trajectories(p, j, b)), f"{_TWO}, {_tested_sql(_counts(_CROSSED), floor_all=True)}", views="paired")
