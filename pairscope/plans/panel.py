"""Queries on panels of judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.operators import agreement as G
from pairscope.operators import panel as N
from pairscope.operators import paired as P
from pairscope.plans.book import Book

book = Book()
add = book.add
LABELS = [*N.VERDICTS, "Unresolved"]
CATEGORIES = N.CATEGORIES


def _consensus(source: str = "judgments", name: str = "cons") -> str:
    """The consensus in SQL, by another way: a list of votes in judge order."""
    return f"""{name}0 AS (SELECT item_id, stage, min(gold) AS gold, list(verdict ORDER BY judge_no) AS vs, list(sufficiency ORDER BY judge_no) AS ss, avg(confidence) AS mean_confidence, stddev_pop(confidence) AS sd_confidence FROM {source} GROUP BY item_id, stage),
    {name}1 AS (SELECT *, len(list_filter(vs, lambda x: x = 'Supported')) AS n_supported, len(list_filter(vs, lambda x: x = 'Refuted')) AS n_refuted, len(list_filter(vs, lambda x: x = 'Ambiguous')) AS n_ambiguous, len(list_filter(ss, lambda x: x IN ('partial_or_ambiguous', 'probably_insufficient', 'clearly_insufficient'))) AS n_weak FROM {name}0),
    {name}2 AS (SELECT *, list_filter(vs, lambda x: len(list_filter(vs, lambda y: y = x)) = greatest(n_supported, n_refuted, n_ambiguous))[1] AS modal_verdict,
      list_filter(ss, lambda x: len(list_filter(ss, lambda y: y = x)) = list_max([len(list_filter(ss, lambda y: y = z)) FOR z IN ss]))[1] AS modal_sufficiency,
      len(list_distinct(list_filter(vs, lambda x: len(list_filter(vs, lambda y: y = x)) = greatest(n_supported, n_refuted, n_ambiguous)))) > 1 AS tied FROM {name}1),
    {name} AS (SELECT *, CASE rule WHEN 'high_consensus' THEN CASE WHEN n_supported >= 4 THEN 'Supported' ELSE 'Refuted' END WHEN 'unresolved' THEN 'Unresolved' ELSE 'Ambiguous' END AS consensus FROM
      (SELECT *, CASE WHEN greatest(n_supported, n_refuted) >= 4 THEN 'high_consensus' WHEN modal_verdict = 'Ambiguous' AND n_ambiguous >= 2 THEN 'ambiguous_majority' WHEN n_weak >= 3 THEN 'ambiguous_weak_sufficiency' ELSE 'unresolved' END AS rule FROM {name}2) z)"""


_WIDE = "wide AS (SELECT item_id, min(gold) AS gold, min(consensus) FILTER (stage = 'A') AS a, min(consensus) FILTER (stage = 'B') AS b, min(consensus) FILTER (stage = 'C') AS c FROM cons GROUP BY item_id)"
_D = lambda x: f"{x} IN ('Supported', 'Refuted')"
_TAX = f"""CASE WHEN NOT ({_D('c')}) THEN 'final_nondecisive' WHEN c <> gold THEN 'decisive_judge_fever_disagreement' WHEN ({_D('a')} AND a <> b) OR ({_D('b')} AND b <> c) THEN 'nonmonotonic_judge_path' WHEN a = gold THEN 'sentence_only_gold_agreeing' WHEN NOT ({_D('a')}) AND {_D('b')} THEN 'title_disclosure_gold_agreeing' WHEN item_id % 3 = 0 THEN 'additional_evidence_gold_agreeing' ELSE 'structured_disclosure_gold_agreeing' END"""
_C = "WITH " + _consensus()
_CW = f"{_C}, {_WIDE}"


def wide(j):
    gold = j.groupBy("item_id").agg(F.min("gold").alias("gold"))
    return N.flags(N.stages(N.consensus(j))).join(gold, "item_id")


def classified(j):
    gold, a, b, c = F.col("gold"), F.col("a"), F.col("b"), F.col("c")
    return wide(j).withColumn("category", N.taxonomy(gold, a, b, c, F.col("item_id") % 3 == 0)).withColumn("legacy", N.taxonomy_legacy(a, b, c, F.when(F.col("item_id") % 2 == 0, "regression").otherwise("robust")))


add("A17_consensus", "judgments", lambda j: N.consensus(j, slots=5).select("item_id", "stage", "n_supported", "n_refuted", "n_ambiguous", "n_weak", "rule", "consensus"), f"{_C} SELECT item_id, stage, n_supported, n_refuted, n_ambiguous, n_weak, rule, consensus FROM cons")
add("A18_tie_diagnostics", "judgments", lambda j: N.consensus(j).select("item_id", "stage", "modal_verdict", "tied", "order_sensitive"), f"{_C} SELECT item_id, stage, modal_verdict, tied, greatest(n_supported, n_refuted) < 4 AND tied AND n_ambiguous = greatest(n_supported, n_refuted, n_ambiguous) AND n_ambiguous >= 2 AND n_weak < 3 AS order_sensitive FROM cons")
add("A19_confidence_stats", "judgments", lambda j: N.consensus(j).select("item_id", "stage", "mean_confidence", F.round("sd_confidence", 6).alias("sd_confidence"), "modal_sufficiency"), f"{_C} SELECT item_id, stage, mean_confidence, round(sd_confidence, 6) AS sd_confidence, modal_sufficiency FROM cons")
add("A20_panel_completeness", "judgments", N.complete, "SELECT item_id, stage, count(*) AS n, count(DISTINCT judge_no) AS judges, count(*) = 5 AND count(DISTINCT judge_no) = 5 AS complete FROM judgments GROUP BY ALL")
_pct = ", ".join(f"100 * avg((verdict = '{v}')::int) AS pct_{v.lower()}" for v in N.VERDICTS)
add("A21_judge_behavior", "judgments", N.judge_behavior, f"SELECT stage, judge_id, count(*) AS n, {_pct}, avg(confidence) AS mean_confidence FROM judgments GROUP BY ALL")
add("A22_flag_counts", "judgments", N.flag_counts, "SELECT stage, flag, count(*) AS n FROM (SELECT stage, unnest(string_split(flags, ';')) AS flag FROM judgments) x WHERE flag <> 'none' GROUP BY ALL")


def flag_scope(j):
    """Flags at the last stage by scope: all items, those still open there, those decided; a share of the scope's judgments."""
    labels = N.consensus(j).filter("stage = 'C'").select("item_id", N.decisive(F.col("consensus")).alias("settled"))
    rows = j.filter("stage = 'C'").join(labels, "item_id").select("flags", F.explode(F.array(F.lit("all"), F.when(F.col("settled"), "resolved").otherwise("persistent"))).alias("scope"))
    sums = rows.groupBy("scope").agg(F.count("*").alias("size"))
    counts = rows.select("scope", F.explode(F.split("flags", ";")).alias("flag")).filter("flag <> 'none'").groupBy("scope", "flag").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(sums), "scope").select("scope", "flag", "n", (100 * P.share(F.col("n"), F.col("size"))).alias("pct"))


add(
    "A23_flag_scope",
    "judgments",
    flag_scope,
    f"""{_C}, r AS (SELECT flags, unnest(['all', CASE WHEN {_D('consensus')} THEN 'resolved' ELSE 'persistent' END]) AS scope FROM judgments JOIN cons USING (item_id, stage) WHERE stage = 'C'), s AS (SELECT scope, count(*) AS size FROM r GROUP BY scope)
    SELECT scope, flag, count(*) AS n, 100 * count(*) / min(size) AS pct FROM (SELECT scope, unnest(string_split(flags, ';')) AS flag FROM r) x JOIN s USING (scope) WHERE flag <> 'none' GROUP BY ALL""",
)
_AL = "al AS (SELECT item_id, judge_no, min(verdict) FILTER (stage = 'A') AS v_a, min(verdict) FILTER (stage = 'B') AS v_b, min(verdict) FILTER (stage = 'C') AS v_c, min(sufficiency) FILTER (stage = 'A') AS s_a, min(sufficiency) FILTER (stage = 'B') AS s_b, min(sufficiency) FILTER (stage = 'C') AS s_c FROM judgments GROUP BY ALL), al2 AS (SELECT *, list_position(o, s_b) < list_position(o, s_a) AS improved_ab, list_position(o, s_c) < list_position(o, s_b) AS improved_bc FROM (SELECT *, ['clearly_sufficient', 'probably_sufficient', 'partial_or_ambiguous', 'probably_insufficient', 'clearly_insufficient'] AS o FROM al) x)"
add("J11_judge_alignment", "judgments", lambda j: N.aligned(j).select("item_id", "judge_no", "v_a", "v_b", "v_c"), f"WITH {_AL} SELECT item_id, judge_no, v_a, v_b, v_c FROM al2")
add("F26_sufficiency_improved", "judgments", lambda j: N.aligned(j).select("item_id", "judge_no", "improved_ab", "improved_bc"), f"WITH {_AL} SELECT item_id, judge_no, improved_ab, improved_bc FROM al2")
add("F25_judge_suffix", "judgments", lambda j: j.select(F.concat(F.lit("panel_"), "judge_no").alias("raw")).distinct().select("raw", F.concat(F.lit("judge_"), F.regexp_extract("raw", r"_(\d+)$", 1)).alias("judge_id")), "SELECT DISTINCT 'panel_' || judge_no AS raw, judge_id FROM judgments")
add("F27_flag_union", "judgments", N.flag_union, "SELECT item_id, stage, coalesce(string_agg(DISTINCT flag, ';' ORDER BY flag) FILTER (flag <> 'none'), '') AS flag_union FROM (SELECT item_id, stage, unnest(string_split(flags, ';')) AS flag FROM judgments) x GROUP BY ALL")
add(
    "A28_verdict_change",
    "judgments",
    lambda j: N.change_rates(N.aligned(j)),
    f"""WITH {_AL} SELECT count(*) AS n, avg((v_a <> v_b)::int) AS changed_ab, avg((v_b <> v_c)::int) AS changed_bc, avg((v_a <> v_c)::int) AS changed_ac, avg((NOT ({_D('v_a')}) AND {_D('v_c')})::int) AS became_decisive, avg(({_D('v_a')} AND NOT ({_D('v_c')}))::int) AS became_nondecisive, avg(improved_ab::int) AS improved_ab, avg(improved_bc::int) AS improved_bc FROM al2""",
)
add(
    "P15_transition_flags",
    "judgments",
    lambda j: wide(j).drop("gold"),
    f"""{_CW} SELECT item_id, a, b, c, {_D('a')} AS a_decisive, {_D('b')} AS b_decisive, {_D('c')} AS c_decisive, NOT ({_D('a')}) AND {_D('b')} AS title_resolved, NOT ({_D('a')}) AND NOT ({_D('b')}) AND {_D('c')} AS structure_resolved,
    {_D('a')} AND {_D('b')} AND a <> b AS reversed_ab, {_D('b')} AND {_D('c')} AND b <> c AS reversed_bc, {_D('a')} AND {_D('c')} AND a <> c AS reversed_ac, {_D('a')} AND NOT ({_D('b')}) AS lost_ab, {_D('b')} AND NOT ({_D('c')}) AS lost_bc, a <> b AS changed_ab, b <> c AS changed_bc, NOT ({_D('a')}) AND NOT ({_D('b')}) AND NOT ({_D('c')}) AS never_decisive FROM wide""",
)
add("P16_legacy_flags", "judgments", lambda j: wide(j).select("item_id", (~F.col("a_decisive") & F.col("c_decisive")).alias("resolved_only_by_structure"), F.col("reversed_ac").alias("reversed_after_structure")), f"{_CW} SELECT item_id, NOT ({_D('a')}) AND {_D('c')} AS resolved_only_by_structure, {_D('a')} AND {_D('c')} AND a <> c AS reversed_after_structure FROM wide")
add("A29_resolution_rates", "judgments", lambda j: wide(j).agg(*((100 * F.avg(F.col(x).cast("double"))).alias(x) for x in ("title_resolved", "structure_resolved", "reversed_ac", "lost_ab", "never_decisive"))), f"{_CW} SELECT 100 * avg((NOT ({_D('a')}) AND {_D('b')})::int) AS title_resolved, 100 * avg((NOT ({_D('a')}) AND NOT ({_D('b')}) AND {_D('c')})::int) AS structure_resolved, 100 * avg(({_D('a')} AND {_D('c')} AND a <> c)::int) AS reversed_ac, 100 * avg(({_D('a')} AND NOT ({_D('b')}))::int) AS lost_ab, 100 * avg((NOT ({_D('a')}) AND NOT ({_D('b')}) AND NOT ({_D('c')}))::int) AS never_decisive FROM wide")
add("P17_taxonomy_v2", "judgments", lambda j: classified(j).select("item_id", "gold", "category", F.when(F.col("a_decisive"), "A").when(F.col("b_decisive"), "B").when(F.col("c_decisive"), "C").alias("first_decisive_stage"), F.when(F.col("a") == F.col("gold"), "A").when(F.col("b") == F.col("gold"), "B").when(F.col("c") == F.col("gold"), "C").alias("first_agreeing_stage")), f"{_CW} SELECT item_id, gold, {_TAX} AS category, CASE WHEN {_D('a')} THEN 'A' WHEN {_D('b')} THEN 'B' WHEN {_D('c')} THEN 'C' END AS first_decisive_stage, CASE WHEN a = gold THEN 'A' WHEN b = gold THEN 'B' WHEN c = gold THEN 'C' END AS first_agreeing_stage FROM wide")
_LEG = f"CASE WHEN NOT ({_D('c')}) THEN 'silver_partial_or_ambiguous_warrant' WHEN NOT ({_D('a')}) OR a <> c THEN 'silver_structured_evidence_sensitive' WHEN {_D('b')} AND a <> b THEN 'silver_title_context_sensitive' WHEN item_id % 2 = 0 THEN 'silver_clear_evidence_utilization_failure' ELSE 'silver_unresolved' END"
add("P18_taxonomy_v1", "judgments", lambda j: classified(j).select("item_id", "legacy"), f"{_CW} SELECT item_id, {_LEG} AS legacy FROM wide")
_BROAD = f"CASE {' '.join(f"WHEN legacy = '{k}' THEN '{v}'" for k, v in N.BROAD.items())} END"
add("P19_broad_class", "judgments", lambda j: classified(j).groupBy(N.broad(F.col("legacy")).alias("broad")).agg(F.count("*").alias("n")), f"{_CW} SELECT {_BROAD} AS broad, count(*) AS n FROM (SELECT {_LEG} AS legacy FROM wide) x GROUP BY ALL")
add("A30_mechanism_proportions", "judgments", lambda j: N.proportions(classified(j), "category", CATEGORIES), f"{_CW}, x AS (SELECT {_TAX} AS category FROM wide), t AS (SELECT count(*) AS total FROM x) SELECT total, d.category, count(x.category) AS n, count(x.category) / total AS share FROM t CROSS JOIN (VALUES {', '.join(f'''('{c}')''' for c in CATEGORIES)}) AS d(category) LEFT JOIN x ON x.category = d.category GROUP BY total, d.category")
add("A31_moves", "judgments", lambda j: wide(j).filter("a <> c").groupBy("a", "c").agg(F.count("*").alias("n")), f"{_CW} SELECT a, c, count(*) AS n FROM wide WHERE a <> c GROUP BY ALL")
add("A16_stage_crosstab", "judgments", lambda j: P.crosstab(wide(j), "a", "c", LABELS), f"{_CW} SELECT o.position, o.a, {', '.join(f'''count(*) FILTER (w.c = '{v}') AS c_{v}''' for v in LABELS)} FROM (VALUES {', '.join(f'''('{v}', {i})''' for i, v in enumerate(LABELS))}) AS o(a, position) LEFT JOIN wide w ON w.a = o.a GROUP BY o.position, o.a")
_CB = f"WITH {_consensus()}, {_consensus('judgments_b', 'consb')}, both_ AS (SELECT item_id, stage, cons.gold, cons.consensus AS one, consb.consensus AS two, consb.rule AS two_rule FROM cons JOIN consb USING (item_id, stage))"


def two_panels(j, b):
    """Both panels' consensus an item and stage."""
    one = N.consensus(j).select("item_id", "stage", F.col("consensus").alias("one"))
    two = N.consensus(b).select("item_id", "stage", F.col("consensus").alias("two"), F.col("rule").alias("two_rule"))
    return one.join(two, ["item_id", "stage"])


def with_reference(rows, j):
    """rows of two_panels() with the reference label of their item."""
    return rows.join(j.groupBy("item_id").agg(F.min("gold").alias("gold")), "item_id")


def cross_family(j, b):
    """Both panels' labels at the last stage as a category, plain and split by the reference."""
    rows = with_reference(two_panels(j, b).filter("stage = 'C'"), j).withColumn("category", N.taxonomy_residual(F.col("one"), F.col("two"), F.col("two_rule")))
    return rows.select("item_id", "category", N.taxonomy_residual_by_reference(F.col("category"), F.col("two"), F.col("gold")).alias("by_reference"), F.when(N.decisive(F.col("two")), F.col("two") == F.col("gold")).alias("agrees"))


_CODES = N.residual_codes()
_RES = f"CASE WHEN NOT ({_D('one')}) AND NOT ({_D('two')}) THEN '{_CODES[0]}' WHEN {_D('two')} AND two_rule = 'high_consensus' THEN '{_CODES[1]}' ELSE '{_CODES[2]}' END"
add("P20_cross_family_taxonomy", "judgments judgments_b", cross_family, f"{_CB} SELECT item_id, category, CASE WHEN category <> '{_CODES[1]}' THEN category WHEN two = gold THEN '{N.AGREEING}' ELSE '{N.DIFFERING}' END AS by_reference, CASE WHEN {_D('two')} THEN two = gold END AS agrees FROM (SELECT *, {_RES} AS category FROM both_ WHERE stage = 'C') x")
add("T35_residual", "judgments judgments_b", lambda j, b: with_reference(two_panels(j, b).filter("stage = 'C'").filter(~N.decisive(F.col("one"))), j).groupBy("two").agg(F.count("*").alias("n"), P.n_if(F.col("two") == F.col("gold")).alias("as_reference")), f"{_CB} SELECT two, count(*) AS n, count(*) FILTER (two = gold) AS as_reference FROM both_ WHERE stage = 'C' AND NOT ({_D('one')}) GROUP BY two")
add("A32_stage_comparison", "judgments judgments_b", lambda j, b: two_panels(j, b).groupBy("stage").agg(F.count("*").alias("n"), P.n_if(~N.decisive(F.col("one"))).alias("open_one"), P.n_if(~N.decisive(F.col("two"))).alias("open_two"), P.n_if(~N.decisive(F.col("one")) & N.decisive(F.col("two"))).alias("one_only"), P.n_if(N.decisive(F.col("one")) & ~N.decisive(F.col("two"))).alias("two_only")).withColumn("delta_pp", 100 * (F.col("open_two") - F.col("open_one")) / F.col("n")), f"{_CB} SELECT stage, count(*) AS n, count(*) FILTER (NOT ({_D('one')})) AS open_one, count(*) FILTER (NOT ({_D('two')})) AS open_two, count(*) FILTER (NOT ({_D('one')}) AND {_D('two')}) AS one_only, count(*) FILTER ({_D('one')} AND NOT ({_D('two')})) AS two_only, 100 * (count(*) FILTER (NOT ({_D('two')})) - count(*) FILTER (NOT ({_D('one')}))) / count(*) AS delta_pp FROM both_ GROUP BY stage")
add("A33_overlap_subgroups", "predictions", lambda p: N.overlapping(P.paired(P.judged(p)), {"either": (F.col("large_transition") == "regression") | (F.col("small_transition") == "regression"), "shared": (F.col("large_transition") == "regression") & (F.col("small_transition") == "regression"), "large": F.col("large_transition") == "regression", "small": F.col("small_transition") == "regression"}, {"supported": F.col("gold") == "Supported", "many_sets": F.col("n_sets") > 2}), "SELECT g AS \"group\", m AS measure, count(*) FILTER (inside) AS n, count(*) FILTER (inside AND hit) AS hits, count(*) FILTER (inside AND hit) / nullif(count(*) FILTER (inside), 0) AS rate FROM (SELECT unnest([{g: 'either', inside: l OR s}, {g: 'shared', inside: l AND s}, {g: 'large', inside: l}, {g: 'small', inside: s}], recursive := true), gold, n_sets FROM (SELECT gold, n_sets, large_transition = 'regression' AS l, small_transition = 'regression' AS s FROM paired) y) x, (VALUES ('supported'), ('many_sets')) AS k(m), LATERAL (SELECT CASE WHEN m = 'supported' THEN gold = 'Supported' ELSE n_sets > 2 END AS hit) h GROUP BY ALL", views="paired")
add("A34_descriptive_rates", "judgments", lambda j: N.overlapping(wide(j), {"all": F.lit(True), "open_at_a": ~F.col("a_decisive"), "decided_at_a": F.col("a_decisive"), "gold_supported": F.col("gold") == "Supported"}, {"decided_at_c": F.col("c_decisive"), "changed": F.col("a") != F.col("c"), "as_reference": F.col("c") == F.col("gold")}), f"{_CW} SELECT g AS \"group\", m AS measure, count(*) FILTER (inside) AS n, count(*) FILTER (inside AND hit) AS hits, count(*) FILTER (inside AND hit) / nullif(count(*) FILTER (inside), 0) AS rate FROM (SELECT unnest([{{g: 'all', inside: true}}, {{g: 'open_at_a', inside: NOT ({_D('a')})}}, {{g: 'decided_at_a', inside: {_D('a')}}}, {{g: 'gold_supported', inside: gold = 'Supported'}}], recursive := true), a, c, gold FROM wide) x, (VALUES ('decided_at_c'), ('changed'), ('as_reference')) AS k(m), LATERAL (SELECT CASE m WHEN 'decided_at_c' THEN {_D('c')} WHEN 'changed' THEN a <> c ELSE c = gold END AS hit) h GROUP BY ALL")
_PAIRS = "pairs AS (SELECT l.stage, l.judge_no AS judge_1, r.judge_no AS judge_2, count(*) FILTER (l.verdict = r.verdict) AS same, count(*) AS n FROM judgments l JOIN judgments r ON l.item_id = r.item_id AND l.stage = r.stage AND l.judge_no < r.judge_no GROUP BY ALL)"
add("J16_judge_pairs", "judgments", lambda j: G.judge_pairs(j, 5, "stage"), f"WITH {_PAIRS} SELECT *, same / n AS agreement FROM pairs")
add("T01_pairwise_agreement", "judgments", lambda j: G.pairwise(j, 5, "stage"), f"WITH {_PAIRS} SELECT stage, avg(same / n) AS mean_agreement, min(same / n) AS min_agreement FROM pairs GROUP BY stage")
add("T02_decisive_agreement", "judgments", lambda j: G.pairwise(j, 5, "stage", without="Ambiguous"), f"WITH d AS (SELECT item_id, stage FROM judgments GROUP BY ALL HAVING count(*) FILTER (verdict = 'Ambiguous') = 0), dj AS (SELECT j.* FROM judgments j JOIN d USING (item_id, stage)), {_PAIRS.replace('FROM judgments l JOIN judgments r', 'FROM dj l JOIN dj r')} SELECT stage, avg(same / n) AS mean_agreement, min(same / n) AS min_agreement FROM pairs GROUP BY stage")
_IC = "ic AS (SELECT stage, item_id, count(*) FILTER (verdict = 'Supported') AS s, count(*) FILTER (verdict = 'Refuted') AS r, count(*) FILTER (verdict = 'Ambiguous') AS a, count(*) AS m FROM judgments GROUP BY ALL)"
add("T03_fleiss", "judgments", lambda j: G.fleiss(G.item_counts(j, N.VERDICTS, "stage"), 3, "stage"), f"WITH {_IC}, f AS (SELECT stage, count(*) AS items, avg((s * (s - 1) + r * (r - 1) + a * (a - 1)) / (m * (m - 1))) AS observed, (sum(s) / sum(m)) ** 2 + (sum(r) / sum(m)) ** 2 + (sum(a) / sum(m)) ** 2 AS expected FROM ic GROUP BY stage) SELECT *, (observed - expected) / (1 - expected) AS kappa FROM f")
add("T04_krippendorff", "judgments", lambda j: G.krippendorff(G.item_counts(j, N.VERDICTS, "stage"), 3, "stage"), f"WITH {_IC}, f AS (SELECT stage, sum(m) AS n, sum((s * (m - s) + r * (m - r) + a * (m - a)) / (m - 1)) AS o, sum(s) AS ts, sum(r) AS tr, sum(a) AS ta FROM ic WHERE m >= 2 GROUP BY stage) SELECT stage, n AS votes, 1 - o / ((n * n - ts * ts - tr * tr - ta * ta) / (n - 1)) AS alpha FROM f")
_K = "count(*) AS n, count(*) FILTER (one = two) / count(*) AS observed, ({e}) / (count(*) * count(*)) AS expected"
_e = " + ".join(f"count(*) FILTER (one = '{v}') * count(*) FILTER (two = '{v}')" for v in LABELS)
add("T05_cohen_kappa", "judgments judgments_b", lambda j, b: G.cohen(two_panels(j, b), "one", "two", LABELS, "stage"), f"{_CB}, k AS (SELECT stage, {_K.format(e=_e)} FROM both_ GROUP BY stage) SELECT *, CASE WHEN expected < 1 THEN (observed - expected) / (1 - expected) END AS kappa FROM k")
add("T22_replication", "judgments judgments_b", lambda j, b: two_panels(j, b).groupBy("stage").agg(F.count("*").alias("n"), F.avg((F.col("one") == F.col("two")).cast("double")).alias("agreement"), F.avg((N.decisive(F.col("one")) == N.decisive(F.col("two"))).cast("double")).alias("decisive_agreement"), P.share(P.n_if(N.decisive(F.col("one")) & N.decisive(F.col("two")) & (F.col("one") == F.col("two"))), P.n_if(N.decisive(F.col("one")) & N.decisive(F.col("two")))).alias("agreement_if_decisive")), f"{_CB} SELECT stage, count(*) AS n, avg((one = two)::int) AS agreement, avg((({_D('one')}) = ({_D('two')}))::int) AS decisive_agreement, count(*) FILTER ({_D('one')} AND {_D('two')} AND one = two) / nullif(count(*) FILTER ({_D('one')} AND {_D('two')}), 0) AS agreement_if_decisive FROM both_ GROUP BY stage")
add("T34_anonymize", "judgments", lambda j: j.select("item_id", "stage", "judge_no", F.concat(F.lit("r"), F.expr("row_number() over (partition by item_id, stage order by md5(concat('anon', cast(item_id as string), stage, judge_id)))")).alias("alias")), "SELECT item_id, stage, judge_no, 'r' || row_number() OVER (PARTITION BY item_id, stage ORDER BY md5('anon' || item_id || stage || judge_id)) AS alias FROM judgments")
add(
    "J19_slot_combinations",
    "judgments",
    lambda j: N.slot_combinations(j),
    f"""WITH c AS (SELECT i || '-' || k AS combo, i, k FROM (VALUES (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)) AS t(i, k)), cj AS (SELECT item_id, stage || combo AS stage, judge_no, gold, verdict, sufficiency, confidence FROM judgments, c WHERE judge_no <> i AND judge_no <> k), {_consensus('cj').replace('>= 4', '>= 3').replace('n_weak >= 3', 'n_weak >= 2')}
    SELECT substr(stage, 2) AS combo, consensus, count(*) AS n FROM cons GROUP BY ALL""",
)
