"""Queries on texts, duplicates, model outputs and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.functions import text as T
from pairscope.operators import dedup as D
from pairscope.operators import flags as X
from pairscope.operators import paired as P
from pairscope.operators import ranks as R
from pairscope.operators.neardup import near_classes
from pairscope.plans.book import Book
from pairscope.storage import settle

book = Book()
add = book.add
_WS = r"[ \t\n\x0b\f\r]"
_NORM = lambda c: f"trim(regexp_replace(lower({c}), '{_WS}+', ' ', 'g'))"
_PLAIN = lambda c: f"regexp_replace({c}, '[^\\x00-\\x7F]', ' ', 'g')"
_TOK = lambda c: f"regexp_extract_all(lower({c}), '[A-Za-z0-9'']+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"
_CON = lambda c: f"list_distinct(list_filter({_TOK(c)}, lambda x: NOT list_contains({_STOP}, x)))"
_NUM = lambda c: f"list_distinct(regexp_extract_all({c}, '{T.PATTERNS['number']}'))"

add("F10_normalize", "", lambda d: d.select("doc_id", F.md5(T.normalized(F.col("text"))).alias("digest")), f"SELECT doc_id, md5({_NORM('text')}) AS digest FROM documents", tables="documents")
add("F11_tokens", "texts", lambda t: t.select("claim_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n_distinct")), f"SELECT claim_id, len({_TOK('text')}) AS n_tokens, len(list_distinct({_TOK('text')})) AS n_distinct FROM texts")
add("F12_regex_counts", "texts", lambda t: t.select("claim_id", *(F.regexp_count(T.plain(F.col("text")), F.lit(p)).alias(n) for n, p in T.PATTERNS.items())), "SELECT claim_id, " + ", ".join(f"""len(regexp_extract_all({_PLAIN('text')}, '{p.replace("'", "''")}')) AS {n}""" for n, p in T.PATTERNS.items()) + " FROM texts")
add(
    "F13_overlap",
    "texts",
    lambda t: t.select("claim_id", *(c.alias(n) for n, c in T.overlap(F.col("claim"), F.col("evidence")).items())),
    f"""SELECT claim_id, len(list_intersect(a, b)) / greatest(1, len(a)) AS lexical_overlap, len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b))) AS jaccard, CASE WHEN len(na) = 0 THEN 1.0 ELSE len(list_intersect(na, nb)) / greatest(1, len(na)) END AS numeric_overlap,
    ta / greatest(1, tb) AS length_ratio, regexp_matches({_PLAIN('claim')}, '{T.PATTERNS['date']}') AND NOT regexp_matches({_PLAIN('evidence')}, '{T.PATTERNS['date']}') AS date_missing FROM (SELECT claim_id, claim, evidence, {_CON('claim')} AS a, {_CON('evidence')} AS b, {_NUM('claim')} AS na, {_NUM('evidence')} AS nb, len({_TOK('claim')}) AS ta, len({_TOK('evidence')}) AS tb FROM texts) x""",
)
add("F01_title_nfc", "", lambda p: p.select("p_partkey", T.page_key(F.concat("p_name", F.lit(" é "))).alias("key")), "SELECT p_partkey, replace(nfc_normalize(trim(p_name || ' é ')), ' ', '_') AS key FROM part", tables="part")


def lagged_cosine(e):
    """Cosine of each vector with the one before it of its label: numbered by ranges, joined with its neighbour's number."""
    held = R.placed(e.select("vec_id", "label", "embedding"), ["label"], ["vec_id"]).select("vec_id", "label", "embedding", "position")
    before = held.select("label", (F.col("position") + 1).alias("position"), F.col("embedding").alias("before"))
    return held.join(before, ["label", "position"]).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("before")), 6).alias("cosine"))


_COS = "WITH x AS (SELECT vec_id, label, embedding::double[] AS e, lag(embedding::double[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), c AS (SELECT vec_id, label, list_inner_product(e, b) / nullif(sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(b, b)), 0) AS cosine FROM x WHERE b IS NOT NULL)"
add("F16_cosine", "", lagged_cosine, f"{_COS} SELECT vec_id, round(cosine, 6) AS cosine FROM c", tables="embeddings")


def mad_outliers(li):
    """Rows far under the median of their group, by the median of absolute deviations."""
    held = settle(li.filter("l_returnflag is not null").groupBy("l_returnflag", "l_discount").agg(F.count("*").alias("n")))
    near = held.join(F.broadcast(R.medians(held, ["l_returnflag"], "l_discount", "n").withColumnRenamed("median", "med")), "l_returnflag")
    apart = near.withColumn("apart", F.abs(F.col("l_discount") - F.col("med")))
    out = near.join(F.broadcast(R.medians(apart, ["l_returnflag"], "apart", "n").withColumnRenamed("median", "mad")), "l_returnflag")
    low = F.col("med") - F.col("l_discount") > 1.2 * F.col("mad") + 1e-9
    return out.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum(F.when(low, F.col("n")).otherwise(0)).alias("low"), F.max("med").alias("med"), F.max("mad").alias("mad"))


add("F17_mad_outlier", "", mad_outliers, "WITH m AS (SELECT l_returnflag, median(l_discount) AS med FROM lineitem GROUP BY 1), s AS (SELECT l_returnflag, median(abs(l_discount - med)) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1) SELECT l_returnflag, count(*) AS n, count(*) FILTER (med - l_discount > 1.2 * mad + 1e-9) AS low, max(med) AS med, max(mad) AS mad FROM lineitem JOIN m USING (l_returnflag) JOIN s USING (l_returnflag) GROUP BY 1", tables="lineitem")
add("F19_shingles", "texts", lambda t: t.select("claim_id", F.size(T.shingles(F.col("claim"))).alias("n_shingles")), f"SELECT claim_id, CASE WHEN len(n) < 3 THEN 1 ELSE len(list_distinct([n[i : i + 2] FOR i IN generate_series(1, len(n) - 2)])) END AS n_shingles FROM (SELECT claim_id, {_NORM('claim')} AS n FROM texts) x")
add("A40_exact_duplicates", "texts", lambda t: D.exact_groups(t, "text", "claim_id", "quality"), f"SELECT min(claim_id) AS first, count(*) AS size, count(DISTINCT quality) = 1 AS same_label FROM texts GROUP BY {_NORM('text')} HAVING count(*) > 1")
add("A41_duplicate_keys", "", lambda li: li.groupBy("l_partkey", "l_suppkey", "l_quantity").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_rows"), (F.sum("n") - F.count("*")).alias("duplicates")), "SELECT count(*) AS total_rows, count(*) - count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS duplicates FROM lineitem", tables="lineitem")

_ALIKE = f"""
x AS (SELECT claim_id, {_NORM('text')} AS t FROM texts), o AS (SELECT t, min(claim_id) AS id FROM x WHERE t IS NOT NULL GROUP BY t),
g AS (SELECT DISTINCT id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE [substring(t, i, 3) FOR i IN generate_series(1, length(t) - 2)] END) AS s FROM o), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
l AS (SELECT a, b FROM (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL) p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c >= 0.85 * (na.n + nb.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT id, id AS m FROM o UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m), c AS (SELECT id, min(m) AS class_id FROM r GROUP BY id)"""
add("J15_near_duplicates", "texts", lambda t: D.near_texts(t, "text", "claim_id"), f"WITH RECURSIVE {_ALIKE} SELECT claim_id, id AS copy_of, class_id FROM x JOIN o USING (t) JOIN c USING (id)")

_NEAR = f"""
x AS (SELECT claim_id, {_NORM('text')} AS t FROM texts), o AS (SELECT t, min(claim_id) AS id FROM x WHERE t IS NOT NULL GROUP BY t),
w AS (SELECT id, list_filter(string_split(t, ' '), lambda v: v <> '') AS ws FROM o), g AS (SELECT DISTINCT id, unnest([array_to_string(ws[i : i + 4], ' ') FOR i IN generate_series(1, greatest(len(ws) - 4, 1))]) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS m FROM o UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m), c AS (SELECT id, min(m) AS class_id FROM r GROUP BY id)"""


def near_claims(documents, labels):
    """Classes of the texts adapter's rows: labels only repeat a row, so they meet rows without texts."""
    found = near_classes(documents.withColumnRenamed("doc_id", "claim_id"), "text", "claim_id")
    return found.join(labels.select(F.col("doc_id").alias("claim_id")), "claim_id", "left")


add("J15_near_duplicate_classes", "", near_claims, f"WITH RECURSIVE {_NEAR} SELECT claim_id, id AS copy_of, class_id FROM x JOIN o USING (t) JOIN c USING (id)", tables="documents labels", views="texts")


def scored(p):
    """Three class probabilities a claim, from md5 draws, with margin and disagreement."""
    u = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(k), F.col("claim_id").cast("string"))), 1, 8), 16, 10).cast("double")
    rows = P.paired(P.judged(p)).withColumn("w", F.array(u("e"), u("n"), u("c")))
    total = F.aggregate("w", F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("p", F.transform("w", lambda v: v / total))
    down = F.sort_array("p", asc=False)
    rows = rows.withColumn("top", (F.array_position("p", F.array_max("p")) - 1).cast("int")).withColumn("margin", down[0] - down[1])
    expected = F.when(F.col("gold") == "Supported", 0).otherwise(2)
    return rows.withColumn("disagrees", F.col("top") != expected).withColumn("weak", F.get("p", expected) < 0.35)


_SC = """sc AS (SELECT *, top <> CASE WHEN gold = 'Supported' THEN 0 ELSE 2 END AS disagrees, (CASE WHEN gold = 'Supported' THEN p[1] ELSE p[3] END) < 0.35 AS weak FROM (SELECT *, list_position(p, list_max(p)) - 1 AS top, list_reverse_sort(p)[1] - list_reverse_sort(p)[2] AS margin FROM
  (SELECT *, [e / (e + n + c), n / (e + n + c), c / (e + n + c)] AS p FROM (SELECT *, @H['e' || claim_id]::double AS e, @H['n' || claim_id]::double AS n, @H['c' || claim_id]::double AS c FROM paired) x) y) z)"""
add("P24_argmax_margin", "predictions", lambda p: scored(p).select("claim_id", "top", "margin", "disagrees"), f"WITH {_SC} SELECT claim_id, top, margin, disagrees FROM sc", views="paired")
add("P23_weak_warrant", "predictions", lambda p: scored(p).groupBy("gold").agg(F.count_if("weak").alias("weak"), F.count("*").alias("n")), f"WITH {_SC} SELECT gold, count(*) FILTER (weak) AS weak, count(*) AS n FROM sc GROUP BY gold", views="paired")
add("A25_disagreement_by_transition", "predictions", lambda p: scored(p).groupBy("large_transition").agg(F.avg(F.col("disagrees").cast("double")).alias("rate"), F.count("*").alias("n")), f"WITH {_SC} SELECT large_transition, avg(disagrees::int) AS rate, count(*) AS n FROM sc GROUP BY 1", views="paired")
add("A26_two_diagnostics", "predictions", lambda p: scored(p).select("disagrees", "weak", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"{m}_transition").alias("transition")) for m in ("large", "small"))))).groupBy("model", "transition").agg(F.avg(F.col("disagrees").cast("double")).alias("disagrees"), F.avg(F.col("weak").cast("double")).alias("weak"), F.count("*").alias("n")), f"WITH {_SC}, u AS (SELECT 'large' AS model, large_transition AS transition, disagrees, weak FROM sc UNION ALL SELECT 'small', small_transition, disagrees, weak FROM sc) SELECT model, transition, avg(disagrees::int) AS disagrees, avg(weak::int) AS weak, count(*) AS n FROM u GROUP BY ALL", views="paired")
add("A27_agreement_bucket", "predictions", lambda p: scored(p).groupBy(F.when(F.col("disagrees") & F.col("weak"), "both").when(F.col("disagrees") | F.col("weak"), "one").otherwise("none").alias("bucket")).agg(F.avg((~F.col("agree_ev")).cast("double")).alias("rate"), F.count("*").alias("n")), f"WITH {_SC} SELECT CASE WHEN disagrees AND weak THEN 'both' WHEN disagrees OR weak THEN 'one' ELSE 'none' END AS bucket, avg((NOT agree_ev)::int) AS rate, count(*) AS n FROM sc GROUP BY 1", views="paired")


def quality_flags(t):
    """Low overlap, low similarity (Jaccard here), and a diagnostic that disagrees by a small margin, a text."""
    o = T.overlap(F.col("claim"), F.col("evidence"))
    u = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(k), F.col("claim_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = t.select("claim_id", o["lexical_overlap"].alias("overlap"), o["jaccard"].alias("similarity"), (u("q") < 0.5).alias("disagrees"), u("m").alias("margin"))
    return X.with_quality_flags(rows, "overlap", "similarity", "disagrees", "margin").select("claim_id", "low_overlap", "low_similarity", "diagnostic_disagreement")


_QF = f"""qx AS (SELECT claim_id, len(list_intersect(a, b)) / greatest(1, len(a)) AS overlap, len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b))) AS similarity, @H['q' || claim_id] / 4294967296.0 < 0.5 AS disagrees, @H['m' || claim_id] / 4294967296.0 AS margin FROM (SELECT claim_id, {_CON('claim')} AS a, {_CON('evidence')} AS b FROM texts) y),
  qf AS (SELECT claim_id, overlap < 0.2 AS low_overlap, similarity < (SELECT quantile_cont(similarity, 0.02) FROM qx) AS low_similarity, disagrees AND margin < 0.3 AS diagnostic_disagreement FROM qx)"""
add("P25_quality_flags", "texts", quality_flags, f"WITH {_QF} SELECT * FROM qf")
add("P26_shared_failure", "predictions", lambda p: P.paired(P.judged(p)).select("claim_id", F.coalesce((F.col("large_with_evidence") == F.col("small_with_evidence")) & (F.col("large_with_evidence") != F.col("gold")), F.lit(False)).alias("shared_failure")), "SELECT claim_id, coalesce(large_with_evidence = small_with_evidence AND large_with_evidence <> gold, false) AS shared_failure FROM paired", views="paired")


def _same_failure():
    return F.coalesce((F.col("large_with_evidence") == F.col("small_with_evidence")) & (F.col("large_with_evidence") != F.col("gold")), F.lit(False))


def priority(p):
    rows = scored(p)
    a, b = F.col("large_transition"), F.col("small_transition")
    terms = [(8, (a == "regression") & (b == "regression")), (6, (a == "regression") != (b == "regression")), (4, (a == "resistant") & (b == "resistant")), (3, F.col("disagrees")), (2, F.col("weak")), (2, _same_failure()), (1, F.col("n_sets") >= 2), (1, ~F.col("agree_co"))]
    return rows.withColumn("score", sum((n * c.cast("int") for n, c in terms), F.lit(0)))


_PR = "8 * (large_transition = 'regression' AND small_transition = 'regression')::int + 6 * ((large_transition = 'regression') <> (small_transition = 'regression'))::int + 4 * (large_transition = 'resistant' AND small_transition = 'resistant')::int + 3 * disagrees::int + 2 * weak::int + 2 * coalesce(large_with_evidence = small_with_evidence AND large_with_evidence <> gold, false)::int + (n_sets >= 2)::int + (NOT agree_co)::int"
add("P27_priority_topk", "predictions", lambda p: priority(p).orderBy(F.desc("score"), "claim_id").limit(100).select("claim_id", "score"), f"WITH {_SC} SELECT claim_id, {_PR} AS score FROM sc ORDER BY score DESC, claim_id LIMIT 100", views="paired")
add("W10_topk_top_up", "predictions", lambda p: priority(p).orderBy((F.col("score") == 0).asc(), F.when(F.col("score") > 0, -F.col("score")).asc(), F.when(F.col("score") > 0, F.col("claim_id")), F.md5(F.concat(F.lit("top"), F.col("claim_id").cast("string")))).limit(300).select("claim_id", "score"), f"WITH {_SC} SELECT claim_id, score FROM (SELECT claim_id, {_PR} AS score FROM sc) x ORDER BY score = 0, CASE WHEN score > 0 THEN -score END, CASE WHEN score > 0 THEN claim_id END, md5('top' || claim_id) LIMIT 300", views="paired")


def categories(p, t):
    """All eight predicates over claims and, where there is one, the text of their id."""
    a, b = F.col("large_transition"), F.col("small_transition")
    counted = lambda n: F.regexp_count(T.plain(F.col("claim")), F.lit(T.PATTERNS[n]))
    marks = quality_flags(t).select("claim_id", (F.col("low_overlap") | F.col("low_similarity")).alias("poor"))
    texts = t.select("claim_id", (counted("pronoun") >= 1).alias("pronouns"), ((counted("number") > 0) | (counted("comparative") > 0)).alias("figures"), (counted("negation") >= 1).alias("negated")).join(marks, "claim_id")
    rows = scored(p).join(texts, "claim_id", "left")
    predicates = [(a == "regression") & (b == "regression"), F.col("disagrees") & (F.col("margin") < 0.3), F.col("n_sets") >= 2, F.col("pronouns"), F.col("figures"), F.col("negated"), F.col("poor"), _same_failure()]
    return rows.select("claim_id", X.listed(predicates).alias("category"))


_COUNTED = lambda n: f"""len(regexp_extract_all({_PLAIN('claim')}, '{T.PATTERNS[n].replace("'", "''")}'))"""
_HOLDS = ["large_transition = 'regression' AND small_transition = 'regression'", "disagrees AND margin < 0.3", "n_sets >= 2", "pronouns", "figures", "negated", "poor", "large_with_evidence = small_with_evidence AND large_with_evidence <> gold"]
add(
    "P28_category_string",
    "predictions texts",
    categories,
    f"""WITH {_SC}, {_QF}, tx AS (SELECT claim_id, {_COUNTED('pronoun')} >= 1 AS pronouns, {_COUNTED('number')} > 0 OR {_COUNTED('comparative')} > 0 AS figures, {_COUNTED('negation')} >= 1 AS negated, low_overlap OR low_similarity AS poor FROM texts JOIN qf USING (claim_id))
    SELECT claim_id, coalesce(nullif(concat_ws(';', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in zip(X.REVIEW, _HOLDS, strict=True))}), ''), '{X.UNEXPLAINED}') AS category FROM sc LEFT JOIN tx USING (claim_id)""",
    views="paired",
)
add("P29_linguistic_flags", "texts", lambda t: t.select("claim_id", F.array_join(F.filter(F.array(*(F.when(T.plain(F.col("claim")).rlike(p), F.lit(n)) for n, p in T.PATTERNS.items())), lambda x: x.isNotNull()), ";").alias("flags")), "SELECT claim_id, concat_ws(';', " + ", ".join(f"""CASE WHEN regexp_matches({_PLAIN('claim')}, '{p.replace("'", "''")}') THEN '{n}' END""" for n, p in T.PATTERNS.items()) + ") AS flags FROM texts")
