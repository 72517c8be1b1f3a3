"""Panels of judges: consensus, diagnostics, stages, taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators.paired import n_if, share

#: Verdicts, sufficiency from most to least (the last three count as weak), current and legacy categories.
VERDICTS = ["Supported", "Refuted", "Ambiguous"]
SUFFICIENCY = ["clearly_sufficient", "probably_sufficient", "partial_or_ambiguous", "probably_insufficient", "clearly_insufficient"]
WEAK = SUFFICIENCY[2:]
CATEGORIES = [
    "sentence_only_gold_agreeing",
    "title_disclosure_gold_agreeing",
    "structured_disclosure_gold_agreeing",
    "additional_evidence_gold_agreeing",
    "nonmonotonic_judge_path",
    "decisive_judge_fever_disagreement",
    "final_nondecisive",
]
LEGACY = [
    "silver_partial_or_ambiguous_warrant",
    "silver_structured_evidence_sensitive",
    "silver_title_context_sensitive",
    "silver_clear_evidence_utilization_failure",
    "silver_unresolved",
]
#: The broad classes of the legacy categories.
BROAD = dict(zip(LEGACY, ["residual_ambiguity", "representation_sensitive", "representation_sensitive", "evidence_utilization_failure", "other"], strict=True))
DECISIVE = ["Supported", "Refuted"]


def complete(judgments: DataFrame, judges: int = 5, *keys: str) -> DataFrame:
    """Per item and stage: rows, distinct judges, whether the panel is complete and without repeats."""
    return judgments.groupBy("item_id", "stage", *keys).agg(F.count("*").alias("n"), F.count_distinct("judge_no").alias("judges")).withColumn("complete", (F.col("n") == judges) & (F.col("judges") == judges))


def deduplicated(judgments: DataFrame, policy: str = "first") -> DataFrame:
    """One row an item, stage and judge. policy: first (least position), collapse (identical rows only) or fail."""
    keys = ["item_id", "stage", "judge_no"]
    rest = [c for c in judgments.columns if c not in keys]
    held = judgments.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("position") if "position" in rest else F.lit(0)).alias("r"), F.count("*").alias("n"), F.count_distinct(*rest).alias("kinds"))
    if policy == "first":
        return held.select(*keys, "r.*")
    bad = F.col("n") > 1 if policy == "fail" else F.col("kinds") > 1
    return held.select(*keys, F.when(bad, F.raise_error(F.lit("conflicting judgments"))).otherwise(F.col("r")).alias("r")).select(*keys, "r.*")


def consensus(judgments: DataFrame, *keys: str, high: int = 4, weak_needed: int = 3, slots: int | None = None) -> DataFrame:
    """Consensus by four rules, in order, with diagnostics; one aggregate, any order of rows.

    With slots, a panel that lacks a slot or holds one twice is an error.

    A label with `high` votes wins; else Ambiguous if it is the modal verdict (ties go to the verdict of the least judge
    number) with two votes or more; else Ambiguous if enough ratings are weak; else Unresolved.
    """
    keys = keys or ("item_id", "stage")
    counts = [n_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in VERDICTS]
    firsts = [F.min(F.when(F.col("verdict") == v, F.col("judge_no"))).alias(f"first_{v.lower()}") for v in VERDICTS]
    rated = [F.struct(n_if(F.col("sufficiency") == s).alias("n"), (-F.min(F.when(F.col("sufficiency") == s, F.col("judge_no")))).alias("at"), F.lit(s).alias("v")) for s in SUFFICIENCY]
    held = judgments.groupBy(*keys).agg(*counts, *firsts, n_if(F.col("sufficiency").isin(WEAK)).alias("n_weak"), F.avg("confidence").alias("mean_confidence"), F.stddev_pop("confidence").alias("sd_confidence"), F.array_max(F.array(*rated))["v"].alias("modal_sufficiency"), F.count("*").alias("n_rows"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(judge_no AS int))"))).alias("n_slots"))
    if slots is not None:
        broken = (F.col("n_rows") != slots) | (F.col("n_slots") != slots)
        held = held.withColumn("n_supported", F.when(broken, F.raise_error(F.lit("consensus needs each judge slot once"))).otherwise(F.col("n_supported")))
    held = held.drop("n_rows", "n_slots")
    modal = F.array_max(F.array(*(F.struct(F.col(f"n_{v.lower()}").alias("n"), (-F.coalesce(F.col(f"first_{v.lower()}"), F.lit(99))).alias("at"), F.lit(v).alias("v")) for v in VERDICTS)))
    most = F.greatest("n_supported", "n_refuted")
    top = F.greatest("n_supported", "n_refuted", "n_ambiguous")
    rule = (
        F.when(most >= high, "high_consensus")
        .when((modal["v"] == "Ambiguous") & (modal["n"] >= 2), "ambiguous_majority")
        .when(F.col("n_weak") >= weak_needed, "ambiguous_weak_sufficiency")
        .otherwise("unresolved")
    )
    label = F.when(rule == "high_consensus", F.when(F.col("n_supported") >= high, "Supported").otherwise("Refuted")).when(rule == "unresolved", "Unresolved").otherwise("Ambiguous")
    tied = (F.col("n_supported") == top).cast("int") + (F.col("n_refuted") == top).cast("int") + (F.col("n_ambiguous") == top).cast("int")
    sensitive = (most < high) & (tied > 1) & (F.col("n_ambiguous") == top) & (top >= 2) & (F.col("n_weak") < weak_needed)
    return held.withColumn("modal_verdict", modal["v"]).withColumn("rule", rule).withColumn("consensus", label).withColumn("tied", tied > 1).withColumn("order_sensitive", sensitive).drop(*(f"first_{v.lower()}" for v in VERDICTS))


def stages(labels: DataFrame, value: str = "consensus", names: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """One row an item with the label of each stage; raises where a stage is missing."""
    out = labels.groupBy("item_id").agg(*(F.min(F.when(F.col("stage") == s, F.col(value))).alias(s.lower()) for s in names))
    whole = F.lit(True)
    for s in names:
        whole = whole & F.col(s.lower()).isNotNull()
    return out.withColumn("a", F.when(whole, F.col("a")).otherwise(F.raise_error(F.lit("an item lacks a stage"))))


def decisive(c: Column) -> Column:
    return c.isin(DECISIVE)


def flags(wide: DataFrame) -> DataFrame:
    """Changes between stages, from stages(): resolution, reversal, loss of decisiveness."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return wide.withColumns(
        {
            "a_decisive": decisive(a),
            "b_decisive": decisive(b),
            "c_decisive": decisive(c),
            "title_resolved": ~decisive(a) & decisive(b),
            "structure_resolved": ~decisive(a) & ~decisive(b) & decisive(c),
            "reversed_ab": decisive(a) & decisive(b) & (a != b),
            "reversed_bc": decisive(b) & decisive(c) & (b != c),
            "reversed_ac": decisive(a) & decisive(c) & (a != c),
            "lost_ab": decisive(a) & ~decisive(b),
            "lost_bc": decisive(b) & ~decisive(c),
            "changed_ab": a != b,
            "changed_bc": b != c,
            "never_decisive": ~decisive(a) & ~decisive(b) & ~decisive(c),
        }
    )


def taxonomy(gold: Column, a: Column, b: Column, c: Column, adds_text: Column | None = None) -> Column:
    """The current category of an item: open at the end, against the reference, by a path that turned back, or by the
    stage whose disclosure settled it. adds_text: whether the last stage showed sentences the others did not."""
    bad = ~a.isin([*DECISIVE, "Ambiguous", "Unresolved"]) | ~b.isin([*DECISIVE, "Ambiguous", "Unresolved"]) | ~c.isin([*DECISIVE, "Ambiguous", "Unresolved"]) | ~gold.isin(DECISIVE)
    turned = lambda x, y: decisive(x) & (x != y)  # noqa: E731  reversed, or decisive no more
    last = F.when(adds_text, CATEGORIES[3]).otherwise(CATEGORIES[2]) if adds_text is not None else F.lit(CATEGORIES[2])
    return (
        F.when(bad, F.raise_error(F.lit("unknown label")))
        .when(~decisive(c), CATEGORIES[6])
        .when(c != gold, CATEGORIES[5])
        .when(turned(a, b) | turned(b, c), CATEGORIES[4])
        .when(a == gold, CATEGORIES[0])
        .when(~decisive(a) & decisive(b), CATEGORIES[1])
        .otherwise(last)
    )


def taxonomy_legacy(a: Column, b: Column, c: Column, cohort: Column) -> Column:
    """The withdrawn classes, kept for comparison; the second takes in what titles resolved."""
    return (
        F.when(~decisive(c), LEGACY[0])
        .when(~decisive(a) | (decisive(a) & (a != c)), LEGACY[1])
        .when(decisive(b) & (a != b), LEGACY[2])
        .when(cohort.isin("regression", "resistant"), LEGACY[3])
        .otherwise(LEGACY[4])
    )


#: What a second panel makes of an item (the panels' names fill the gaps), and how a decisive one stands to the reference.
RESIDUAL = ["cross_family_persistent_ambiguity", "{first}_only_ambiguity", "{second}_internal_disagreement"]
AGREEING, DIFFERING = "cross_family_decisive_feversame", "cross_family_decisive_feverdifferent"


def residual_codes(panels: tuple[str, str] = ("first_panel", "second_panel")) -> list[str]:
    return [code.format(first=panels[0], second=panels[1]) for code in RESIDUAL]


def taxonomy_residual(first: Column, second: Column, second_rule: Column, panels: tuple[str, str] = ("first_panel", "second_panel")) -> Column:
    """What a second panel says of an item the first left open."""
    codes = residual_codes(panels)
    return F.when(~decisive(second) & ~decisive(first), codes[0]).when(decisive(second) & (second_rule == "high_consensus"), codes[1]).otherwise(codes[2])


def taxonomy_residual_by_reference(category: Column, second: Column, gold: Column, panels: tuple[str, str] = ("first_panel", "second_panel")) -> Column:
    """taxonomy_residual() with what only the first panel left open split by whether the second agrees with the reference."""
    return F.when(category != residual_codes(panels)[1], category).when(second == gold, AGREEING).when(second != gold, DIFFERING).otherwise(category)


def broad(category: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in BROAD.items() for x in pair))[category]


def judge_behavior(judgments: DataFrame) -> DataFrame:
    return judgments.groupBy("stage", "judge_id").agg(F.count("*").alias("n"), *((100 * F.avg((F.col("verdict") == v).cast("double"))).alias(f"pct_{v.lower()}") for v in VERDICTS), F.avg("confidence").alias("mean_confidence"))


def flag_counts(judgments: DataFrame, column: str = "flags") -> DataFrame:
    return judgments.select("stage", F.explode(F.split(column, ";")).alias("flag")).filter("flag <> 'none'").groupBy("stage", "flag").agg(F.count("*").alias("n"))


def flag_union(judgments: DataFrame) -> DataFrame:
    """Per item and stage the sorted distinct flags, without none, joined by semicolons."""
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("flags", ";")))))
    return judgments.groupBy("item_id", "stage").agg(F.array_join(F.filter(kinds, lambda x: x != "none"), ";").alias("flag_union"))


def aligned(judgments: DataFrame) -> DataFrame:
    """A row an item and judge with the verdicts and sufficiency of the three stages; a missing stage is null."""
    cell = lambda c, s: F.min(F.when(F.col("stage") == s, F.col(c)))
    place = lambda c: F.array_position(F.array(*(F.lit(s) for s in SUFFICIENCY)), c)
    held = judgments.groupBy("item_id", "judge_no").agg(*(cell("verdict", s).alias(f"v_{s.lower()}") for s in "ABC"), *(cell("sufficiency", s).alias(f"s_{s.lower()}") for s in "ABC"))
    return held.withColumn("improved_ab", place(F.col("s_b")) < place(F.col("s_a"))).withColumn("improved_bc", place(F.col("s_c")) < place(F.col("s_b")))


def change_rates(rows: DataFrame) -> DataFrame:
    """Means of seven changes over aligned()."""
    a, b, c = F.col("v_a"), F.col("v_b"), F.col("v_c")
    rate = lambda x: F.avg(x.cast("double"))
    return rows.agg(
        F.count("*").alias("n"),
        rate(a != b).alias("changed_ab"),
        rate(b != c).alias("changed_bc"),
        rate(a != c).alias("changed_ac"),
        rate(~decisive(a) & decisive(c)).alias("became_decisive"),
        rate(decisive(a) & ~decisive(c)).alias("became_nondecisive"),
        rate(F.col("improved_ab")).alias("improved_ab"),
        rate(F.col("improved_bc")).alias("improved_bc"),
    )


def proportions(rows: DataFrame, category: str, names: list[str], *keys: str) -> DataFrame:
    """Counts of every category, zeros included, with its share of the group."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total"), *(n_if(F.col(category) == v).alias(v) for v in names))
    return counts.select(*keys, "total", F.inline(F.array(*(F.struct(F.lit(v).alias("category"), F.col(v).alias("n")) for v in names)))).withColumn("share", share(F.col("n"), F.col("total")))


def overlapping(rows: DataFrame, groups: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Rates of every measure over groups that may overlap, in one scan: n, hits and rate (null for an empty group)."""
    sums = [x for g, inside in groups.items() for x in (n_if(inside).alias(f"n|{g}"), *(n_if(inside & m).alias(f"{k}|{g}") for k, m in measures.items()))]
    cells = [F.struct(F.lit(g).alias("group"), F.lit(k).alias("measure"), F.col(f"n|{g}").alias("n"), F.col(f"{k}|{g}").alias("hits")) for g in groups for k in measures]
    return rows.agg(*sums).select(F.inline(F.array(*cells))).withColumn("rate", share(F.col("hits"), F.col("n")))


def slot_combinations(judgments: DataFrame, slots: int = 3) -> DataFrame:
    """Consensus under every choice of judges kept: the panel without each pair of its first `slots` judges."""
    pairs = [(i, j) for i in range(1, slots + 1) for j in range(i, slots + 1)]
    copies = judgments.select("*", F.explode(F.array(*(F.struct(F.lit(f"{i}-{j}").alias("combo"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs))).alias("c"))
    kept = copies.filter((F.col("judge_no") != F.col("c.i")) & (F.col("judge_no") != F.col("c.j"))).withColumn("combo", F.col("c.combo"))
    return consensus(kept, "item_id", "stage", "combo", high=3, weak_needed=2).groupBy("combo", "consensus").agg(F.count("*").alias("n"))
