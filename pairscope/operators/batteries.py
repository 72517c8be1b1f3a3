"""Batteries of named endpoints: every count of a battery comes from one aggregate, then tests and one adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.functions import special
from pairscope.operators import stats as S
from pairscope.operators.panel import CATEGORIES, decisive

#: Classes of claims, and the families of the two batteries.
COHORTS = ["regression", "resistant", "rescue", "robust"]
FAMILY, CROSS, SUBGROUP = "post_hoc_Q1_Q12", "post_hoc_cross_family", "post_hoc_subgroup"
#: Fixed value: the quantile of odds-ratio intervals.
WALD = 1.96


def trajectories(wide: DataFrame) -> DataFrame:
    """Stage labels a, b, c with the changes that batteries ask for."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return wide.withColumns(
        {
            "ambiguous_A": ~decisive(a),
            "ambiguous_B": ~decisive(b),
            "ambiguous_C": ~decisive(c),
            "resolved_by_titles": ~decisive(a) & decisive(b),
            "resolved_at_C": ~decisive(b) & decisive(c),
            "reversed_after_titles": decisive(a) & decisive(b) & (a != b),
            "reversed_at_C": decisive(b) & decisive(c) & (b != c),
            "change_A_B": a != b,
            "change_B_C": b != c,
        }
    )


def endpoints() -> list[tuple[str, str, str, str, str]]:
    """(analysis, kind, group, other group or stage, feature) of the cohort battery; kinds: rate, odds, paired, table."""
    out = []
    for tag, feature in (("Q1_stageA_nondecisive", "ambiguous_A"), ("Q2_title_resolution", "resolved_by_titles"), ("Q3_C_resolution", "resolved_at_C")):
        out += [(f"{tag}_{c}", "rate", c, "", feature) for c in COHORTS]
        out.append((f"{tag}_reg_vs_robust_OR", "odds", "regression", "robust", feature))
    for tag, feature in (("Q4a_stageA_nondecisive", "ambiguous_A"), ("Q4b_stageC_nondecisive", "ambiguous_C")):
        out += [(f"{tag}_resistant_vs_{c}_OR", "odds", "resistant", c, feature) for c in ("robust", "regression")]
    out += [(f"Q5_{f}_shared_vs_specific_OR", "odds", "shared", "specific", f) for f in ("resolved_by_titles", "resolved_at_C", "ambiguous_C")]
    out += [(f"Q6_stage_{s}_{c}", "rate", c, "", f"ambiguous_{s}") for s in "ABC" for c in ("all", "regression")]
    out += [(f"Q6_{x}_{y}_McNemar", "paired", "all", f"ambiguous_{x}", f"ambiguous_{y}") for x, y in ("AB", "BC", "AC")]
    out += [(f"{tag}_{f}_{c}", "rate", c, "", f) for tag, f in (("Q7", "change_A_B"), ("Q8", "change_B_C"), ("Q11", "ambiguous_C")) for c in ("all", "regression")]
    out += [(f"Q9_{f}_{c}", "rate", c, "", f) for f in ("high_decisive_C", "gold_agreeing_C", "gold_disagreeing_C") for c in ("regression", "robust")]
    out += [(f"Q10_{k}_{c}", "rate", c, "", k) for k in CATEGORIES[1:4] for c in ("regression", "resistant", "robust")]
    out += [(f"Q12_{m}_stage_{s}", "table", "all", f"ambiguous_{s}", m) for m in ("nli_disagrees", "nli2_disagrees") for s in "AC"]
    return out


def _inside(group: str) -> Column:
    shared = F.col("regression_type") == "both"
    return {"all": F.lit(True), "shared": (F.col("cohort") == "regression") & shared, "specific": (F.col("cohort") == "regression") & ~shared}.get(group, F.col("cohort") == group)


def _feature(name: str) -> Column:
    high = decisive(F.col("c")) & (F.col("rule_c") == "high_consensus")
    agrees = F.col("c") == F.col("gold")
    made = {"high_decisive_C": high, "gold_agreeing_C": agrees, "gold_disagreeing_C": high & ~agrees} | {k: F.col("category") == k for k in CATEGORIES}
    return made.get(name, F.col(name))


def _cells(kind: str, group: str, other: str, feature: str) -> tuple[Column, Column, Column, Column]:
    """Four counts: hits and misses of a group and of another, or of a feature by another one."""
    hit = _feature(feature)
    if kind in ("rate", "odds"):
        mine = _inside(group)
        rest = _inside(other) if kind == "odds" else F.lit(False)
        return mine & hit, mine & ~hit, rest & hit, rest & ~hit
    before = _feature(other)
    return before & hit, before & ~hit, ~before & hit, ~before & ~hit


def counted(rows: DataFrame, battery: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """(analysis, kind, a, b, c, d): all counts of a battery in one aggregate."""
    sums, out = [], []
    for i, (analysis, kind, *rest) in enumerate(battery):
        sums += [F.count_if(cell).alias(f"{n}{i}") for n, cell in zip("abcd", _cells(kind, *rest), strict=True)]
        out.append(F.struct(F.lit(analysis).alias("analysis"), F.lit(kind).alias("kind"), *(F.col(f"{n}{i}").alias(n) for n in "abcd")))
    return rows.agg(*sums).select(F.inline(F.array(*out)))


def _tested(counts: DataFrame, floor_all: bool = False) -> DataFrame:
    """Statuses, rates, odds ratios, statistics and p of counted() rows, each kind by its own rules."""
    a, b, c, d = (F.col(x) for x in "abcd")
    n, kind = a + b + c + d, F.col("kind")
    low, high = S.wilson(a, a + b)
    half = lambda x: F.greatest(x.cast("double"), F.lit(0.5))
    one, two = (half(a), half(c)) if floor_all else (a.cast("double"), c.cast("double"))
    ratio = one / half(b) / (two / half(d))
    spread = WALD * F.sqrt(1 / half(a) + 1 / half(b) + 1 / half(c) + 1 / half(d))
    empty_group = (a + b == 0) | (c + d == 0)
    no_ratio = empty_group | (F.lit(not floor_all) & ((a == 0) | (c == 0)))
    flat = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    gap = F.abs(a * d - b * c).cast("double") / n
    yates = F.pow(gap - F.least(F.lit(0.5), gap), 2) * n * (1 / (a + b) + 1 / (c + d)) * (1 / (a + c) + 1 / (b + d))
    status = (
        F.when((kind == "rate") & (a + b == 0), S.REPORTED[1])
        .when((kind == "odds") & empty_group, "not_estimable_empty_group")
        .when((kind == "odds") & no_ratio, "undefined_historical_OR_zero_event_cell")
        .when((kind == "paired") & (n == 0), "not_estimable_empty_or_unpaired")
        .when((kind == "paired") & (b + c == 0), "undefined_no_discordant_pairs")
        .when((kind == "table") & flat, "not_estimable_constant_margin")
        .otherwise(S.REPORTED[0])
    )
    statistic = F.when(kind == "paired", S.mcnemar(b, c)).when((kind == "table") & ~flat, yates)
    p = F.when((kind == "odds") & ~empty_group, special.apply(special.fisher, a, b, c, d)).when(kind.isin("paired", "table"), special.apply(lambda x: special.chi2_tail(x, 1), statistic)).when((kind == "exact") & (n > 0), special.apply(special.binomial_half, b, c))
    odds = F.when((kind == "odds") & ~no_ratio, ratio)
    return counts.select(
        "analysis", "kind", *"abcd", status.alias("status"),
        F.when((kind == "rate") & (a + b > 0), 100 * a / (a + b)).alias("rate_pct"), F.when(kind == "rate", 100 * low).alias("wilson_low"), F.when(kind == "rate", 100 * high).alias("wilson_high"),
        odds.alias("odds_ratio"), F.exp(F.ln(odds) - spread).alias("ci_low"), F.exp(F.ln(odds) + spread).alias("ci_high"), F.when(kind.isin("paired", "exact"), 100 * (c - b) / n).alias("delta_pp"), statistic.alias("statistic"), p.alias("p"),
    )


def cohort_battery(rows: DataFrame) -> DataFrame:
    """The endpoints Q1 to Q12 over claims with cohort, regression_type, stage labels, category and two diagnostics,
    adjusted as one family."""
    tests = _tested(counted(rows, endpoints())).withColumn("family", F.lit(FAMILY)).withColumn("test", F.col("analysis"))
    return S.adjusted(tests).drop("test")


MEASURES = ["ambiguous_A", "ambiguous_B", "ambiguous_C", "resolved_by_titles", "resolved_at_C", "reversed_after_titles", "reversed_at_C"]


def cross_battery(rows: DataFrame) -> DataFrame:
    """Seven measures and seven categories of two panels by exact paired tests, one family; and for each panel how often
    shared regressions stay open against specific ones, another. rows: both panels' columns with suffixes _1 and _2, and
    shared."""
    names = MEASURES + [f"category_{k}" for k in CATEGORIES]
    side = lambda m, i: F.col(f"category_{i}") == m.removeprefix("category_") if m.startswith("category_") else F.col(f"{m}_{i}")
    sums, out = [], []
    for k, m in enumerate(names):
        x, y = side(m, 1), side(m, 2)
        sums += [F.count_if(z).alias(f"{n}{k}") for n, z in zip("abcd", (x & y, x & ~y, ~x & y, ~x & ~y), strict=True)]
        out.append(F.struct(F.lit(m).alias("analysis"), F.lit("exact").alias("kind"), *(F.col(f"{n}{k}").alias(n) for n in "abcd")))
    for k, panel in enumerate(("panel_1", "panel_2"), len(names)):
        open_ = F.col(f"ambiguous_C_{k - len(names) + 1}")
        sums += [F.count_if(z).alias(f"{n}{k}") for n, z in zip("abcd", (F.col("shared") & open_, F.col("shared") & ~open_, ~F.col("shared") & open_, ~F.col("shared") & ~open_), strict=True)]
        out.append(F.struct(F.lit(f"{panel}_nondecisive_shared_vs_specific_OR").alias("analysis"), F.lit("odds").alias("kind"), *(F.col(f"{n}{k}").alias(n) for n in "abcd")))
    tests = _tested(rows.agg(*sums).select(F.inline(F.array(*out))), floor_all=True)
    return S.adjusted(tests.withColumn("family", F.when(F.col("kind") == "odds", SUBGROUP).otherwise(CROSS)).withColumn("test", F.col("analysis"))).drop("test")
