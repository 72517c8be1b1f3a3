"""Paired predictions: accuracy, transitions between conditions, agreement between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ["Supported", "Refuted"]
TRANSITIONS = ["robust", "rescue", "resistant", "regression"]
#: The classes' names as paths of correctness.
PATHS = {"robust": "correct_to_correct", "rescue": "wrong_to_correct", "resistant": "wrong_to_wrong", "regression": "correct_to_wrong"}


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where whole is 0."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def normalized_output(raw: Column) -> Column:
    """The first label word anywhere in the output, in title case; null if there is none."""
    found = F.regexp_extract(raw, r"(?i)\b(supported|refuted)\b", 1)
    return F.when(found != "", F.initcap(found))


def judged(predictions: DataFrame, output: str = "model_output", gold: str = "gold") -> DataFrame:
    """predictions with prediction and correct (both null if the output is invalid), error_type and notes."""
    prediction = normalized_output(F.col(output))
    return (
        predictions.withColumn("prediction", prediction)
        .withColumn("correct", F.col("prediction") == F.col(gold))
        .withColumn("error_type", F.when(F.col("prediction").isNull(), "invalid_model_output").when(~F.col("correct"), F.concat_ws("_", F.lower(gold), F.lit("to"), F.lower("prediction"))).otherwise(F.lit("")))
        .withColumn("notes", F.when(F.col("prediction").isNull(), F.concat(F.lit("invalid_model_output:"), F.col(output))).otherwise(F.lit("")))
    )


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """total, valid, yes, no and accuracy over valid rows (0.0 where none is valid), by keys."""
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("total_rows"), F.count("correct").alias("valid_predictions"), n_if(F.col("correct")).alias("correct_yes"), n_if(~F.col("correct")).alias("incorrect_no"))
        .withColumn("accuracy", F.coalesce(share(F.col("correct_yes"), F.col("valid_predictions")), F.lit(0.0)))
    )


def accuracy_levels(rows: DataFrame) -> DataFrame:
    """accuracy() overall, by model, by condition and by both, in one pass of grouping sets."""
    sets = rows.groupingSets([[], [F.col("model")], [F.col("cond")], [F.col("model"), F.col("cond")]], F.col("model"), F.col("cond")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("total_rows"), F.count("correct").alias("valid_predictions"), n_if(F.col("correct")).alias("correct_yes"), n_if(~F.col("correct")).alias("incorrect_no")
    )
    kind = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "model").when(F.col("g") == 2, "condition").otherwise("model_x_condition")
    return sets.select(
        kind.alias("group_type"),
        F.when(F.col("g") == 3, "all").otherwise(F.concat_ws("|", "model", "cond")).alias("group_value"),
        "total_rows",
        "valid_predictions",
        "correct_yes",
        "incorrect_no",
        F.coalesce(share(F.col("correct_yes"), F.col("valid_predictions")), F.lit(0.0)).alias("accuracy"),
    )


def metrics_long(rows: DataFrame) -> DataFrame:
    """Accuracy by condition, gain in points and failure rate with evidence, a row a metric."""
    wide = rows.groupBy("model").agg(
        *(n_if(F.col("correct") & (F.col("cond") == c)).alias(f"yes_{c}") for c in ("claim_only", "with_evidence")),
        *(n_if(F.col("correct").isNotNull() & (F.col("cond") == c)).alias(f"n_{c}") for c in ("claim_only", "with_evidence")),
    )
    a, b = share(F.col("yes_claim_only"), F.col("n_claim_only")), share(F.col("yes_with_evidence"), F.col("n_with_evidence"))
    none = F.lit(None).cast("bigint")

    def metric(name: str, condition: str, value: Column, part: Column, whole: Column) -> Column:
        return F.struct(F.lit(name).alias("metric_name"), F.lit(condition).alias("cond"), value.alias("value"), part.alias("numerator"), whole.alias("denominator"))

    return wide.select(
        "model",
        F.inline(
            F.array(
                metric("accuracy", "claim_only", a, F.col("yes_claim_only"), F.col("n_claim_only")),
                metric("accuracy", "with_evidence", b, F.col("yes_with_evidence"), F.col("n_with_evidence")),
                metric("evidence_gain_pp", "both", (b - a) * 100, none, none),
                metric("failure_rate", "with_evidence", 1 - b, F.col("n_with_evidence") - F.col("yes_with_evidence"), F.col("n_with_evidence")),
            )
        ),
    )


def error_kind(recorded: Column, prediction: Column, gold: Column) -> Column:
    """The recorded kind of an error, else one worked out from output and label; for rows known to be wrong."""
    turned = F.when((gold == "Supported") & (prediction == "Refuted"), "supported_to_refuted").when((gold == "Refuted") & (prediction == "Supported"), "refuted_to_supported").otherwise("other_error")
    return F.coalesce(F.nullif(F.trim(recorded), F.lit("")), F.when(prediction.isNull(), "invalid_or_missing_output").otherwise(turned))


def error_counts(rows: DataFrame) -> DataFrame:
    """Errors by model and kind; right rows are left out."""
    wrong = rows.filter(~F.coalesce(F.col("correct"), F.lit(False)))
    return wrong.select("model", error_kind(F.col("error_type"), F.col("prediction"), F.col("gold")).alias("taxonomy")).groupBy("model", "taxonomy").agg(F.count("*").alias("n"))


def label_rollup(rows: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """Counts of every label, overall and by model, zeros included, with the percentage of its group."""
    counts = rows.filter(F.col(value).isin(labels)).rollup("model").agg(*(n_if(F.col(value) == x).alias(x) for x in labels), F.count("*").alias("labeled"))
    pairs = F.inline(F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"`{x}`").alias("n")) for x in labels)))
    return counts.select(F.coalesce("model", F.lit("overall")).alias("model"), "labeled", pairs).select("model", "label", "n", (100 * share(F.col("n"), F.col("labeled"))).alias("pct_of_labeled"))


def pivoted(rows: DataFrame, models: list[str] = ["large", "small"], conditions: list[str] = ["claim_only", "with_evidence"]) -> DataFrame:  # noqa: B006
    """A row a claim: gold, and prediction and correctness of each model and condition. One aggregate, no pivot scan."""
    cell = lambda c, m, k: F.min(F.when((F.col("model") == m) & (F.col("cond") == k), F.col(c)))
    return rows.groupBy("claim_id").agg(
        F.min("gold").alias("gold"),
        F.min("n_sets").alias("n_sets"),
        *(cell("prediction", m, k).alias(f"{m}_{k}") for m in models for k in conditions),
        *(cell("correct", m, k).alias(f"{m}_{k}_correct") for m in models for k in conditions),
    )


def transition(before: Column, after: Column) -> Column:
    return F.when(before & after, "robust").when(~before & after, "rescue").when(~before & ~after, "resistant").when(before & ~after, "regression")


def path(transition: Column) -> Column:
    """A transition class as the path of correctness it stands for."""
    return F.create_map(*(F.lit(x) for pair in PATHS.items() for x in pair))[transition]


def paired(rows: DataFrame, models: list[str] = ["large", "small"]) -> DataFrame:  # noqa: B006
    """pivoted() with a transition a model and agreement of the first two; an invalid output counts as not correct."""
    wide = pivoted(rows, models)
    ok = lambda m, c: F.coalesce(F.col(f"{m}_{c}_correct"), F.lit(False))
    a, b = models[0], models[1]
    return wide.select(
        "claim_id",
        "gold",
        "n_sets",
        *(ok(m, c).alias(f"{m}_{c}_correct") for m in models for c in ("claim_only", "with_evidence")),
        *(F.col(f"{m}_{c}") for m in models for c in ("claim_only", "with_evidence")),
        *(transition(ok(m, "claim_only"), ok(m, "with_evidence")).alias(f"{m}_transition") for m in models),
        F.col(f"{a}_claim_only").eqNullSafe(F.col(f"{b}_claim_only")).alias("agree_co"),
        F.col(f"{a}_with_evidence").eqNullSafe(F.col(f"{b}_with_evidence")).alias("agree_ev"),
        (transition(ok(a, "claim_only"), ok(a, "with_evidence")) == transition(ok(b, "claim_only"), ok(b, "with_evidence"))).alias("agree_transition"),
    )


def by_model(wide: DataFrame, models: list[str] = ["large", "small"]) -> DataFrame:  # noqa: B006
    """A row a claim and model from paired()."""
    return wide.select("claim_id", "gold", "n_sets", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"{m}_transition").alias("transition"), F.col(f"{m}_claim_only_correct").alias("co"), F.col(f"{m}_with_evidence_correct").alias("ev"), F.col(f"{m}_with_evidence").alias("ev_output")) for m in models))))


def transition_summary(long: DataFrame, *keys: str) -> DataFrame:
    out = long.groupBy("model", *keys).agg(F.count("*").alias("n"), *(n_if(F.col("transition") == t).alias(t) for t in TRANSITIONS), n_if(~F.col("co")).alias("co_wrong"), n_if(F.col("co")).alias("co_right"))
    return out.select("model", *keys, "n", *TRANSITIONS, share(F.col("rescue"), F.col("co_wrong")).alias("rescue_rate"), share(F.col("regression"), F.col("co_right")).alias("regression_rate"))


def four_way(long: DataFrame) -> DataFrame:
    """2x2 counts of correctness by condition with margins, over all rows and by gold label."""
    cells = long.groupingSets([[F.col("model")], [F.col("model"), F.col("gold")]], F.col("model"), F.col("gold")).agg(
        n_if(F.col("co") & F.col("ev")).alias("both"), n_if(F.col("co") & ~F.col("ev")).alias("co_only"), n_if(~F.col("co") & F.col("ev")).alias("ev_only"), n_if(~F.col("co") & ~F.col("ev")).alias("neither"), F.count("*").alias("n")
    )
    return cells.select("model", F.coalesce("gold", F.lit("ALL")).alias("gold"), "both", "co_only", "ev_only", "neither", (F.col("both") + F.col("co_only")).alias("co_total"), (F.col("both") + F.col("ev_only")).alias("ev_total"), "n")


def crosstab(rows: DataFrame, left: str, right: str, values: list[str]) -> DataFrame:
    """Counts of left by right over fixed values in a fixed order, zeros included."""
    spark = rows.sparkSession
    order = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, position int")
    counts = rows.groupBy(F.col(left).alias("value")).agg(*(n_if(F.col(right) == v).alias(f"{right}_{v}") for v in values))
    return order.join(counts, "value", "left").select("position", F.col("value").alias(left), *(F.coalesce(f"{right}_{v}", F.lit(0)).cast("bigint").alias(f"{right}_{v}") for v in values))


def concordance(wide: DataFrame) -> DataFrame:
    a, b = F.col("large_transition"), F.col("small_transition")
    return wide.agg(
        F.count("*").alias("n"),
        *(n_if((a == t) & (b == t)).alias(f"both_{t}") for t in TRANSITIONS),
        *(n_if((a == t) != (b == t)).alias(f"one_{t}") for t in TRANSITIONS),
        F.avg(F.col("agree_transition").cast("double")).alias("transition_agreement"),
        F.avg(F.col("agree_co").cast("double")).alias("agreement_claim_only"),
        F.avg(F.col("agree_ev").cast("double")).alias("agreement_with_evidence"),
    )


def union_counts(wide: DataFrame) -> DataFrame:
    """Claims in a transition under either model, both, or exactly one."""
    a, b = F.col("large_transition"), F.col("small_transition")
    return wide.agg(*(x for t in TRANSITIONS for x in (n_if((a == t) | (b == t)).alias(f"{t}_any"), n_if((a == t) & (b == t)).alias(f"{t}_both"), n_if((a == t) != (b == t)).alias(f"{t}_one"))))
