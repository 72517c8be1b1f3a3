"""Queries on paired predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.operators import intake as I
from pairscope.operators import paired as P
from pairscope.operators import ranks as R
from pairscope.plans.book import Book

book = Book()
add = book.add

_ACC = "count(*) AS total_rows, count(correct) AS valid_predictions, count(*) FILTER (correct) AS correct_yes, count(*) FILTER (NOT correct) AS incorrect_no, coalesce(count(*) FILTER (correct) / nullif(count(correct), 0), 0.0) AS accuracy"
add("A01_accuracy_summary", "predictions", lambda p: P.accuracy(P.judged(p), "model", "cond"), f"SELECT model, cond, {_ACC} FROM judged GROUP BY model, cond", views="judged")
add(
    "A02_grouping_sets_summary",
    "predictions",
    lambda p: P.accuracy_levels(P.judged(p)),
    f"""SELECT CASE WHEN model IS NULL AND cond IS NULL THEN 'overall' WHEN cond IS NULL THEN 'model' WHEN model IS NULL THEN 'condition' ELSE 'model_x_condition' END AS group_type,
    CASE WHEN model IS NULL AND cond IS NULL THEN 'all' ELSE concat_ws('|', model, cond) END AS group_value, {_ACC} FROM judged GROUP BY GROUPING SETS ((), (model), (cond), (model, cond))""",
    views="judged",
)
add(
    "A03_metrics_long",
    "predictions",
    lambda p: P.metrics_long(P.judged(p)),
    """WITH w AS (SELECT model, count(*) FILTER (correct AND cond = 'claim_only') AS a, count(correct) FILTER (cond = 'claim_only') AS n, count(*) FILTER (correct AND cond = 'with_evidence') AS b, count(correct) FILTER (cond = 'with_evidence') AS m FROM judged GROUP BY model)
    SELECT model, 'accuracy' AS metric_name, 'claim_only' AS cond, a / n AS value, a AS numerator, n AS denominator FROM w UNION ALL SELECT model, 'accuracy', 'with_evidence', b / m, b, m FROM w
    UNION ALL SELECT model, 'evidence_gain_pp', 'both', (b / m - a / n) * 100, NULL, NULL FROM w UNION ALL SELECT model, 'failure_rate', 'with_evidence', 1 - b / m, m - b, m FROM w""",
    views="judged",
)
add("A04_error_counts", "predictions", lambda p: P.error_counts(P.judged(p)), "SELECT model, error_type AS taxonomy, count(*) AS n FROM judged WHERE error_type <> '' GROUP BY ALL", views="judged")
add(
    "A05_label_rollup",
    "predictions",
    lambda p: P.label_rollup(P.judged(p), "prediction", [*P.LABELS, "Other"]),
    """WITH g AS (SELECT coalesce(model, 'overall') AS model, prediction, count(*) AS n FROM judged WHERE prediction IS NOT NULL GROUP BY GROUPING SETS ((prediction), (model, prediction))),
    t AS (SELECT model, sum(n) AS labeled FROM g GROUP BY model)
    SELECT t.model, l.label, coalesce(g.n, 0) AS n, 100 * coalesce(g.n, 0) / labeled AS pct_of_labeled FROM t CROSS JOIN (VALUES ('Supported'), ('Refuted'), ('Other')) AS l(label) LEFT JOIN g ON g.model = t.model AND g.prediction = l.label""",
    views="judged",
)
_T = "count(*) AS n, count(*) FILTER (transition = 'robust') AS robust, count(*) FILTER (transition = 'rescue') AS rescue, count(*) FILTER (transition = 'resistant') AS resistant, count(*) FILTER (transition = 'regression') AS regression, count(*) FILTER (transition = 'rescue') / nullif(count(*) FILTER (NOT co), 0) AS rescue_rate, count(*) FILTER (transition = 'regression') / nullif(count(*) FILTER (co), 0) AS regression_rate"
long = lambda p: P.by_model(P.paired(P.judged(p)))
add("A06_transition_summary", "predictions", lambda p: P.transition_summary(long(p)), f"SELECT model, {_T} FROM transitions GROUP BY model", views="transitions")
add("A07_transition_by_label", "predictions", lambda p: P.transition_summary(long(p), "gold"), f"SELECT model, gold, {_T} FROM transitions GROUP BY model, gold", views="transitions")
add("A08_error_asymmetry", "predictions", lambda p: long(p).groupBy("model", "gold").agg(F.count_if(~F.col("ev")).alias("errors"), F.count("*").alias("n"), P.share(F.count_if(~F.col("ev")), F.count("*")).alias("error_rate")), "SELECT model, gold, count(*) FILTER (NOT ev) AS errors, count(*) AS n, count(*) FILTER (NOT ev) / count(*) AS error_rate FROM transitions GROUP BY ALL", views="transitions")
_FW = "count(*) FILTER (co AND ev) AS both, count(*) FILTER (co AND NOT ev) AS co_only, count(*) FILTER (NOT co AND ev) AS ev_only, count(*) FILTER (NOT co AND NOT ev) AS neither, count(*) FILTER (co) AS co_total, count(*) FILTER (ev) AS ev_total, count(*) AS n"
add("A09_four_way", "predictions", lambda p: P.four_way(long(p)), f"SELECT model, coalesce(gold, 'ALL') AS gold, {_FW} FROM transitions GROUP BY GROUPING SETS ((model), (model, gold))", views="transitions")
_ORDER = "(VALUES ('robust', 0), ('rescue', 1), ('resistant', 2), ('regression', 3)) AS o(large_transition, position)"
add(
    "A10_transition_matrix",
    "predictions",
    lambda p: P.crosstab(P.paired(P.judged(p)), "large_transition", "small_transition", P.TRANSITIONS),
    f"SELECT o.position, o.large_transition, {', '.join(f'''count(*) FILTER (small_transition = '{t}') AS small_transition_{t}''' for t in P.TRANSITIONS)} FROM {_ORDER} LEFT JOIN paired p ON p.large_transition = o.large_transition GROUP BY ALL",
    views="paired",
)
_both = lambda op: ", ".join(f"count(*) FILTER ((large_transition = '{t}') {op} (small_transition = '{t}')) AS {'both' if op == 'AND' else 'one'}_{t}" for t in P.TRANSITIONS)
add("A11_concordance", "predictions", lambda p: P.concordance(P.paired(P.judged(p))), f"SELECT count(*) AS n, {_both('AND')}, {_both('<>')}, avg(agree_transition::int) AS transition_agreement, avg(agree_co::int) AS agreement_claim_only, avg(agree_ev::int) AS agreement_with_evidence FROM paired", views="paired")
_u = ", ".join(f"count(*) FILTER (large_transition = '{t}' {op} small_transition = '{t}') AS {t}_{n}" for t in P.TRANSITIONS for n, op in (("any", "OR"), ("both", "AND"))) + ", " + ", ".join(f"count(*) FILTER ((large_transition = '{t}') <> (small_transition = '{t}')) AS {t}_one" for t in P.TRANSITIONS)
add("A12_union_counts", "predictions", lambda p: P.union_counts(P.paired(P.judged(p))), f"SELECT {_u} FROM paired", views="paired")
add(
    "A13_pivot_predictions",
    "predictions",
    lambda p: P.pivoted(P.judged(p)).select("claim_id", "gold", "large_claim_only", "large_with_evidence", "small_claim_only", "small_with_evidence"),
    "SELECT claim_id, gold, large_claim_only, large_with_evidence, small_claim_only, small_with_evidence FROM paired",
    views="paired",
)
add("A15_size_crosstab", "predictions", lambda p: p.groupBy("n_sets").pivot("gold", P.LABELS).count().na.fill(0), "SELECT n_sets, count(*) FILTER (gold = 'Supported') AS \"Supported\", count(*) FILTER (gold = 'Refuted') AS \"Refuted\" FROM predictions GROUP BY n_sets")
add("A24_set_size_rates", "predictions", lambda p: long(p).filter("n_sets <= 3").groupBy("model", "n_sets").agg(*(P.share(F.count_if(F.col("transition") == t), F.count("*")).alias(t) for t in P.TRANSITIONS)), f"SELECT model, n_sets, {', '.join(f'''count(*) FILTER (transition = '{t}') / count(*) AS {t}''' for t in P.TRANSITIONS)} FROM transitions WHERE n_sets <= 3 GROUP BY ALL", views="transitions")
add("P12_transition_class", "predictions", lambda p: P.paired(P.judged(p)).select("claim_id", "gold", "large_transition", "small_transition", P.path(F.col("large_transition")).alias("large_path"), "agree_co", "agree_ev", "agree_transition"), "SELECT claim_id, gold, large_transition, small_transition, CASE large_transition WHEN 'robust' THEN 'correct_to_correct' WHEN 'rescue' THEN 'wrong_to_correct' WHEN 'resistant' THEN 'wrong_to_wrong' ELSE 'correct_to_wrong' END AS large_path, agree_co, agree_ev, agree_transition FROM paired", views="paired")
add("P07_output_normalization", "predictions", lambda p: p.select("claim_id", "model", "cond", P.normalized_output(F.concat(F.lit("the claim is **"), F.upper("model_output"), F.lit("**."))).alias("prediction")), "SELECT claim_id, model, cond, prediction FROM judged", views="judged")
add("P08_error_type", "predictions", lambda p: P.judged(p).select("claim_id", "model", "cond", F.when(F.col("correct"), "Yes").otherwise("No").alias("correct"), "error_type", "notes"), "SELECT claim_id, model, cond, CASE WHEN correct THEN 'Yes' ELSE 'No' END AS correct, error_type, notes FROM judged", views="judged")
add(
    "P10_raw_output_coalesce",
    "predictions",
    lambda p: P.judged(p).select("claim_id", "model", "cond", I.filled(F.when(F.col("claim_id") % 2 == 0, "  "), F.when(F.col("claim_id") % 3 == 0, F.concat(F.lit(" "), "model_output")), F.regexp_replace("notes", "^invalid_model_output:", "")).alias("raw")),
    "SELECT claim_id, model, cond, coalesce(nullif(trim(CASE WHEN claim_id % 3 = 0 THEN model_output END), ''), nullif(trim(regexp_replace(notes, '^invalid_model_output:', '')), '')) AS raw FROM judged",
    views="judged",
)


def _tracker(p):
    """Rows with missing ids, repeats, blank texts, unknown labels and lacking evidence, made from predictions."""
    n = F.col("claim_id")
    draw = F.expr("cast(conv(substr(md5(cast(claim_id AS string) || model || cond), 1, 8), 16, 10) AS bigint)")
    rows = p.select(draw.alias("d"), n, "model", "cond", "gold")
    order = F.when((F.col("model") == "large") & (F.col("cond") == "claim_only"), 0).when(F.col("model") == "large", 1).when(F.col("cond") == "claim_only", 2).otherwise(3)
    return rows.select(
        F.when(F.col("d") % 11 == 0, F.lit(" ")).otherwise(n.cast("string")).alias("id"),
        order.cast("bigint").alias("position"),
        F.when(F.col("d") % 5 == 0, F.lit("")).otherwise(F.lit("text")).alias("text"),
        F.when(F.col("d") % 7 == 0, F.lit("Unsure")).otherwise(F.col("gold")).alias("label"),
        F.when(F.col("d") % 3 == 0, F.lit(None)).otherwise(F.lit("e")).alias("evidence"),
        n,
    )


_TRACKER = """WITH t AS (SELECT CASE WHEN d % 11 = 0 THEN NULL ELSE claim_id END AS id, position, CASE WHEN d % 5 = 0 THEN 'missing_claim_text' WHEN d % 7 = 0 THEN 'invalid_true_label:Unsure' WHEN d % 3 = 0 THEN 'missing_gold_evidence' END AS own, claim_id
  FROM (SELECT claim_id, CASE WHEN model = 'large' THEN 0 ELSE 2 END + CASE WHEN cond = 'claim_only' THEN 0 ELSE 1 END AS position, @H[cast(claim_id AS varchar) || model || cond] AS d FROM predictions) x),
  f AS (SELECT id, min(position) AS first FROM t WHERE own IS NULL AND id IS NOT NULL GROUP BY id)
  SELECT t.claim_id, t.position, CASE WHEN t.id IS NULL THEN 'missing_claim_id' WHEN t.position > f.first THEN 'duplicate_claim_id' ELSE own END AS reason FROM t LEFT JOIN f ON t.id = f.id"""
add("P03_usability_gate", "predictions", lambda p: I.usability(_tracker(p), "id", "position", "text", "label", "evidence", P.LABELS).select("claim_id", "position", "reason"), _TRACKER)
add("P02_alias_fallback", "", lambda c: c.select("c_custkey", I.filled(F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))), F.col("c_mktsegment")).alias("name")), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN trim(c_name) ELSE trim(c_mktsegment) END AS name FROM customer", tables="customer")
add("P04_balance_gate", "predictions", lambda p: p.groupBy("model", "cond").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == "Supported").alias("n_supported"), F.count_distinct("claim_id").alias("claims")).withColumn("one_row_a_claim", F.col("n") == F.col("claims")), "SELECT model, cond, count(*) AS n, count(*) FILTER (gold = 'Supported') AS n_supported, count(DISTINCT claim_id) AS claims, count(*) = count(DISTINCT claim_id) AS one_row_a_claim FROM predictions GROUP BY ALL")
add("P06_prompt_template", "predictions", lambda p: p.select("claim_id", "model", "cond", F.when(F.col("cond") == "claim_only", F.concat(F.lit("Claim: "), F.col("claim_id").cast("string"))).when(F.col("cond") == "with_evidence", F.concat(F.lit("Evidence: "), F.col("n_sets").cast("string"), F.lit("\nClaim: "), F.col("claim_id").cast("string"))).otherwise(F.raise_error(F.lit("unknown condition"))).alias("prompt")), "SELECT claim_id, model, cond, CASE WHEN cond = 'claim_only' THEN 'Claim: ' || claim_id ELSE 'Evidence: ' || n_sets || chr(10) || 'Claim: ' || claim_id END AS prompt FROM predictions")
_valid = lambda: F.col("model_output").isin(P.LABELS)
add("J07_remaining_anti_join", "predictions", lambda p: I.remaining(p.select("claim_id", "model", "cond"), p.filter(_valid()), ["claim_id", "model", "cond"]), "SELECT claim_id, model, cond FROM predictions WHERE model_output NOT IN ('Supported', 'Refuted')")
add("J08_semi_join", "", lambda o, c: c.join(o.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", tables="orders customer")
add(
    "J09_upsert_merge",
    "predictions",
    lambda p: I.upsert(p, [p.filter("n_sets <> 2"), p.filter("claim_id % 4 = 0").withColumn("model_output", F.when(F.col("claim_id") % 8 == 0, "Refuted").otherwise("broken"))], ["claim_id", "model", "cond"], "model_output", _valid()),
    """SELECT claim_id, model, cond, CASE WHEN claim_id % 8 = 0 THEN 'Refuted' WHEN n_sets <> 2 AND model_output IN ('Supported', 'Refuted') THEN model_output END AS model_output FROM predictions""",
)
add("J10_resume_join", "predictions", lambda p: p.select("claim_id", "model", "cond", F.when(_valid(), F.lit("reused")).otherwise("recompute").alias("action")), "SELECT claim_id, model, cond, CASE WHEN model_output IN ('Supported', 'Refuted') THEN 'reused' ELSE 'recompute' END AS action FROM predictions")
add("J12_set_equality", "", lambda c, o: I.key_difference(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), "k"), "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS left_only, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS right_only, (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS in_both", tables="customer orders")
add("J14_cross_grid", "", lambda c: c.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(k).alias("cond")) for m in ("large", "small") for k in ("claim_only", "with_evidence")))).alias("g")).select("c_custkey", "g.model", "g.cond"), "SELECT c_custkey, model, cond FROM customer CROSS JOIN (VALUES ('large'), ('small')) AS m(model) CROSS JOIN (VALUES ('claim_only'), ('with_evidence')) AS k(cond)", tables="customer")
add("W05_batching", "", lambda o: I.batches(o, "o_orderpriority", ["o_orderkey"], 100).select("o_orderkey", "position", "batch"), "SELECT o_orderkey, row_number() OVER w AS position, (row_number() OVER w - 1) // 100 + 1 AS batch FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)", tables="orders")
add("W06_shards", "", lambda o: I.shards(o, "o_orderpriority", ["o_orderkey"], 7).select("o_orderkey", "position", "shard"), "SELECT o_orderkey, row_number() OVER w AS position, CAST((row_number() OVER w - 1) // CAST(ceil(count(*) OVER (PARTITION BY o_orderpriority) / 7) AS BIGINT) + 1 AS BIGINT) AS shard FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)", tables="orders")
add("W08_natural_sort", "", lambda c: R.placed(c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("key")), [], [*I.natural_order(F.col("key")), "c_custkey"]).select("position", "key"), "WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE cast(c_custkey AS varchar) END AS key FROM customer) SELECT row_number() OVER (ORDER BY try_cast(key AS bigint) IS NULL, try_cast(key AS bigint), key, c_custkey) AS position, key FROM x", tables="customer")
add("W11_examples", "predictions", lambda p: P.judged(p).filter(~F.col("correct")).orderBy("claim_id", "model", "cond").limit(max(2, min(4, 9))).select("claim_id", "model", "cond"), "SELECT claim_id, model, cond FROM judged WHERE NOT correct ORDER BY claim_id, model, cond LIMIT 4", views="judged")
add("T33_balanced_sample", "predictions", lambda p: I.balanced_sample(p.select("claim_id", "gold").distinct(), "gold", "claim_id", 200, "seed42:").select("claim_id", "gold", "pick"), "SELECT claim_id, gold, row_number() OVER (PARTITION BY gold ORDER BY md5('seed42:' || claim_id), claim_id) AS pick FROM (SELECT DISTINCT claim_id, gold FROM predictions) QUALIFY pick <= 200")
