"""Queries on statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.functions import special
from pairscope.operators import paired as P
from pairscope.operators import stats as S
from pairscope.plans.behavioral import long
from pairscope.plans.book import Book
from pairscope.plans.panel import _CB, two_panels

book = Book()
add = book.add
_Z = S.Z95


def _w(h: str, n: str) -> str:
    p = f"({h} / {n})"
    half = f"({_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z * _Z} / (4 * {n} * {n})))"
    return f"greatest(0, ({p} + {_Z * _Z} / (2 * {n}) - {half}) / (1 + {_Z * _Z} / {n})) AS ci_low, least(1, ({p} + {_Z * _Z} / (2 * {n}) + {half}) / (1 + {_Z * _Z} / {n})) AS ci_high"


add("T07_wilson", "predictions", lambda p: S.rate(P.judged(p), F.col("correct"), "model", "cond").drop("status"), f"SELECT model, cond, n, hits, hits / n AS rate, {_w('hits', 'n')} FROM (SELECT model, cond, count(correct) AS n, count(*) FILTER (correct) AS hits FROM judged GROUP BY ALL) x", views="judged")
add("T08_rate_contract", "predictions", lambda p: S.rate(P.judged(p).withColumn("correct", F.when(F.col("n_sets") > 1, F.col("correct"))), F.col("correct"), "n_sets", status=S.REPORTED), f"SELECT n_sets, n, hits, CASE WHEN n = 0 THEN 'not_estimable_empty_denominator' ELSE 'estimated' END AS status, hits / nullif(n, 0) AS rate, CASE WHEN n > 0 THEN ci_low END AS ci_low, CASE WHEN n > 0 THEN ci_high END AS ci_high FROM (SELECT *, {_w('hits', 'nullif(n, 0)')} FROM (SELECT n_sets, count(correct) FILTER (n_sets > 1) AS n, count(*) FILTER (correct AND n_sets > 1) AS hits FROM judged GROUP BY ALL) x) y", views="judged")
_BC = "SELECT model, gold, count(*) AS n, count(*) FILTER (co AND NOT ev) AS b, count(*) FILTER (NOT co AND ev) AS c FROM transitions GROUP BY ALL"
add("T09_mcnemar_cc", "predictions", lambda p: S.discordant(long(p), F.col("co"), F.col("ev"), "model", "gold"), f"SELECT *, greatest(abs(b - c) - 1, 0) ** 2 / nullif(b + c, 0) AS chi2 FROM ({_BC}) x", views="transitions")
_EX = "least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM (SELECT unnest(generate_series(0, least(b, c))) AS i) s))"
add("T10_mcnemar_exact", "predictions", lambda p: S.with_p(S.discordant(long(p), F.col("co"), F.col("ev"), "model", "gold")).select("model", "gold", "b", "c", F.round("p_exact", 9).alias("p_exact")), f"SELECT model, gold, b, c, round({_EX}, 9) AS p_exact FROM ({_BC}) x", views="transitions")
add("T11_binomial", "predictions", lambda p: long(p).filter("NOT ev").groupBy("model").agg(F.count_if(F.col("gold") == "Supported").alias("b"), F.count_if(F.col("gold") == "Refuted").alias("c")).withColumn("p", F.round(special.apply(special.binomial_half, F.col("b"), F.col("c")), 9)), f"SELECT model, b, c, round({_EX}, 9) AS p FROM (SELECT model, count(*) FILTER (gold = 'Supported') AS b, count(*) FILTER (gold = 'Refuted') AS c FROM transitions WHERE NOT ev GROUP BY model) x", views="transitions")
_CELLS = "SELECT model, count(*) FILTER (n_sets > 2 AND NOT ev) AS a, count(*) FILTER (n_sets > 2 AND ev) AS b, count(*) FILTER (n_sets <= 2 AND NOT ev) AS c, count(*) FILTER (n_sets <= 2 AND ev) AS d FROM transitions GROUP BY model"


def _cells(p):
    many, wrong = F.col("n_sets") > 2, ~F.col("ev")
    return long(p).groupBy("model").agg(F.count_if(many & wrong).alias("a"), F.count_if(many & ~wrong).alias("b"), F.count_if(~many & wrong).alias("c"), F.count_if(~many & ~wrong).alias("d"))


_LC = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
add(
    "T12_fisher",
    "predictions",
    lambda p: _cells(p).withColumn("p", F.round(special.apply(special.fisher, *(F.col(x) for x in "abcd")), 6)),
    f"""SELECT model, a, b, c, d, round(least(1.0, (SELECT sum(w) FROM (SELECT exp({_LC('(a + c)', 'x')} + {_LC('(b + d)', '(a + b - x)')} - {_LC('(a + b + c + d)', '(a + b)')}) AS w FROM (SELECT unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) AS x) s) t
    WHERE w <= exp({_LC('(a + c)', 'a')} + {_LC('(b + d)', 'b')} - {_LC('(a + b + c + d)', '(a + b)')}) * (1 + 1e-7))), 6) AS p FROM ({_CELLS}) q""",
    views="transitions",
)


def _or(p):
    rows = _cells(p)
    names = ("odds_ratio", "ci_low", "ci_high")
    strict = S.odds_ratio(*(F.col(x) for x in "abcd"))
    floor = S.odds_ratio(F.lit(0), F.col("b"), F.col("c"), F.col("d"), "floor")
    return rows.select("model", *(x.alias(n) for x, n in zip(strict, names, strict=True)), *(x.alias(f"{n}_floor") for x, n in zip(floor, names, strict=True)))


_ors = lambda a, s: f"{a} * d / (b * c) AS odds_ratio{s}, exp(ln({a} * d / (b * c)) - {_Z} * sqrt(1 / {a} + 1 / b + 1 / c + 1 / d)) AS ci_low{s}, exp(ln({a} * d / (b * c)) + {_Z} * sqrt(1 / {a} + 1 / b + 1 / c + 1 / d)) AS ci_high{s}"
add("T13_odds_ratio", "predictions", _or, f"SELECT model, {_ors('a', '')}, {_ors('0.5::double', '_floor')} FROM ({_CELLS}) x", views="transitions")
_CHI = """cells AS (SELECT l, r, count(*) AS o FROM src GROUP BY ALL), g AS (SELECT a.l, b.r, coalesce(o, 0) AS o, lt * rt / n AS e, n, kl, kr FROM (SELECT l, sum(o) AS lt FROM cells GROUP BY l) a CROSS JOIN (SELECT r, sum(o) AS rt FROM cells GROUP BY r) b
  CROSS JOIN (SELECT sum(o) AS n, count(DISTINCT l) AS kl, count(DISTINCT r) AS kr FROM cells) t LEFT JOIN cells c ON c.l = a.l AND c.r = b.r)
  SELECT min(n) AS n, min(kl) AS k_left, min(kr) AS k_right, sum((abs(o - e) - CASE WHEN kl = 2 AND kr = 2 THEN least(0.5, abs(o - e)) ELSE 0 END) ** 2 / e) AS chi2, sqrt(sum((o - e) ** 2 / e) / min(n)) AS phi, sqrt(sum((o - e) ** 2 / e) / (min(n) * (least(min(kl), min(kr)) - 1))) AS cramers_v FROM g"""
add("T14_chi2", "predictions", lambda p: S.chi_squared(long(p), "gold", "ev"), f"WITH src AS (SELECT gold AS l, ev AS r FROM transitions), {_CHI}", views="transitions")
add("T15_cramers_v", "judgments judgments_b", lambda j, b: S.chi_squared(two_panels(j, b), "one", "two"), f"{_CB}, src AS (SELECT one AS l, two AS r FROM both_), {_CHI}")
add("T16_constant_margin", "predictions", lambda p: S.chi_squared(long(p).withColumn("same", F.lit(1)), "gold", "same").select("n", "k_left", "k_right", "chi2"), "SELECT count(*) AS n, count(DISTINCT gold) AS k_left, 1 AS k_right, NULL::double AS chi2 FROM transitions", views="transitions")
_RK = "rk AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM src)"
add("W03_avg_rank", "", lambda p: S.value_ranks(p, "p_size").select("p_size", "times", "avg_rank"), "SELECT DISTINCT p_size, count(*) OVER (PARTITION BY p_size) AS times, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS avg_rank FROM part", tables="part")
_TIES = "(SELECT sum(t * t * t - t) FROM (SELECT count(*)::double AS t FROM src GROUP BY v) x)"
add("T17_kruskal", "", lambda li: S.kruskal(li, "l_quantity", "l_returnflag"), f"WITH src AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem WHERE l_returnflag IN (SELECT l_returnflag FROM lineitem GROUP BY 1 HAVING count(*) >= 20)), {_RK}, s AS (SELECT sum(r) AS r, count(*)::double AS c FROM rk GROUP BY g), n AS (SELECT count(*)::double AS n FROM src) SELECT n::bigint AS n, count(*) AS groups, (12 / (n * (n + 1)) * sum(r * r / c) - 3 * (n + 1)) / (1 - {_TIES} / (n * n * n - n)) AS h FROM s, n GROUP BY n", tables="lineitem")
_MW = f"m AS (SELECT count(*)::double AS n, count(*) FILTER (pos)::double AS n1, sum(r) FILTER (pos) AS r1 FROM rk), u AS (SELECT *, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u FROM m)"
add("T18_mann_whitney", "", lambda li: S.mann_whitney(li.withColumn("returned", F.col("l_returnflag") == "R"), "l_quantity", "returned"), f"WITH src AS (SELECT l_quantity AS v, l_returnflag = 'R' AS pos FROM lineitem), {_RK}, {_MW} SELECT n::bigint AS n, n1::bigint AS n1, u, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n + 1) - {_TIES} / (n * (n - 1)))) AS z, u / (n1 * n2) AS auc FROM u", tables="lineitem")
add("T27_auc_ap_brier", "", lambda li: S.curves(li.select((F.col("l_quantity") / 50).alias("score"), (F.col("l_returnflag") == "R").alias("pos")), "score", "pos"), f"WITH src AS (SELECT l_quantity / 50 AS v, l_returnflag = 'R' AS pos FROM lineitem), {_RK}, {_MW}, h AS (SELECT v, count(*) AS n, count(*) FILTER (pos) AS p FROM src GROUP BY v), c AS (SELECT p, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM h WINDOW w AS (ORDER BY v DESC)) SELECT u / (n1 * n2) AS auc, (SELECT sum(p * cp / cn) / sum(p) FROM c) AS average_precision, (SELECT avg((v - pos::int) ** 2) FROM src) AS brier FROM u", tables="lineitem")
_DRAWN = " ".join(f"WHEN u < {b!r} THEN {k}" for k, b in enumerate([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]))
add(
    "T06_bootstrap",
    "predictions",
    lambda p: S.bootstrap(long(p), "claim_id", "ev", "model"),
    f"""WITH b AS (SELECT model, @H[claim_id::varchar] % 1024 AS b, count(*) AS n, count(*) FILTER (ev) AS h FROM transitions GROUP BY ALL), d AS (SELECT model, i, n, h, CASE {_DRAWN} ELSE 8 END AS w FROM (SELECT model, i, n, h, @H[i || ':' || b] / 4294967296.0 AS u FROM b CROSS JOIN (SELECT unnest(generate_series(1, 2000)) AS i) g) x),
    m AS (SELECT model, i, sum(w * h) / sum(w * n) AS m FROM d GROUP BY model, i) SELECT model, count(m) AS replicates, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY model""",
    views="transitions",
)


def _family(o):
    """A table of tests: a p made of an order's md5, some undefined, by priority."""
    return o.select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("test"), F.when(F.col("o_orderkey") % 10 != 0, F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("p"))


_BH = "b AS (SELECT family, test, p, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS r FROM f WHERE p IS NOT NULL)"
add("W02_bh", "", lambda o: S.adjusted(_family(o)), f"WITH f AS (SELECT o_orderpriority AS family, o_orderkey AS test, CASE WHEN o_orderkey % 10 <> 0 THEN @H[o_orderkey::varchar] / 4294967296.0 END AS p FROM orders), {_BH} SELECT f.*, CASE WHEN f.p IS NOT NULL THEN least(1.0, min(b.p * m / r) OVER (PARTITION BY f.family, f.p IS NULL ORDER BY r DESC)) END AS p_bh, coalesce(m, 0) AS family_size FROM f LEFT JOIN b USING (family, test)", tables="orders")
add("T19_bh_family", "", lambda o: S.adjusted(_family(o)).groupBy("family").agg(F.count("p").alias("defined"), F.max("family_size").alias("family_size"), F.count_if(F.col("p_bh") < 0.05).alias("found")), f"WITH f AS (SELECT o_orderpriority AS family, o_orderkey AS test, CASE WHEN o_orderkey % 10 <> 0 THEN @H[o_orderkey::varchar] / 4294967296.0 END AS p FROM orders), {_BH}, x AS (SELECT family, m, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC) AS q FROM b) SELECT family, count(*) AS defined, max(m) AS family_size, count(*) FILTER (q < 0.05) AS found FROM x GROUP BY family", tables="orders")
add("T31_id_neutrality", "predictions", lambda p: S.chi_squared(p.select("claim_id", "gold").distinct().withColumn("half", F.ascii(F.md5(F.concat(F.lit("blind"), "claim_id"))) < 56), "half", "gold"), f"WITH src AS (SELECT DISTINCT ascii(md5('blind' || claim_id)) < 56 AS l, gold AS r, claim_id FROM predictions), {_CHI}")
