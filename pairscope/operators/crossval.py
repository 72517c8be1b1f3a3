"""Cross-validated logistic regression: every target, way of grouping and left-out fold is fitted in the same passes.

A pass of Newton's method goes over the rows once. Each task adds up, for every model (a target, a way of grouping, a
fold that is left out), gradient and information over the rows it has; what is shuffled is a few numbers a model and task,
whatever the number of rows. Groups are never torn apart: a row's fold is a function of its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators.models import fold_of
from pairscope.operators.ranks import cumulated
from pairscope.storage import settle

#: Names of features that are made from what is to be predicted.
OUTCOME_PREFIXES = ("gpt54_", "gpt54mini_", "agree_")
OUTCOME_NAMES = {
    "gpt-5.4_claim_only_correct", "gpt-5.4_evidence_correct", "gpt-5.4_transition", "gpt-5.4-mini_claim_only_correct", "gpt-5.4-mini_evidence_correct", "gpt-5.4-mini_transition",
    "agree_transition", "review_priority_score", "both_regress", "one_regress", "shared_resistant", "both_models_fail_same_direction", "exact_duplicate_claim", "near_duplicate_claim",
    "flag_low_lexical_overlap", "flag_low_semantic_sim", "flag_nli_disagreement", "semantic_outlier",
}


def outcome_derived(features: list[str], prefixes: tuple[str, ...] = OUTCOME_PREFIXES, names: set[str] = OUTCOME_NAMES) -> list[str]:
    """Those of the features whose names say that they come from the outcome."""
    return [f for f in features if f.startswith(prefixes) or f in names]


def prepared(rows: DataFrame, key: str, targets: dict[str, Column], features: list[str], groups: dict[str, Column], k: int = 5) -> DataFrame:
    """(key, x: features as doubles, y: targets as 0 or 1, fold: by way of grouping), settled; rows with a null among them go.

    All rows of a group are in one fold, from the md5 of the group; a null group is a group of its own. Rows go after they are
    settled: a filter before would be moved to where features are made, and would make them a second time to look at them.
    """
    x = F.array(*(F.col(f).cast("double") for f in features))
    y = F.array(*(t.cast("int") for t in targets.values()))
    fold = F.array(*(fold_of(F.coalesce(g.cast("string"), F.lit("")), k).cast("int") for g in groups.values()))
    held = settle(rows.select(F.col(key).alias("key"), x.alias("x"), y.alias("y"), fold.alias("fold")))
    return held.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & ~F.exists("y", lambda v: v.isNull()))


def _matrices(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in names]


def _sigmoid(eta: np.ndarray) -> np.ndarray:
    return np.where(eta >= 0, 1 / (1 + np.exp(-np.abs(eta))), np.exp(-np.abs(eta)) / (1 + np.exp(-np.abs(eta))))


def fit_folds(held: DataFrame, n_targets: int, n_groups: int, n_features: int, k: int = 5, c: float = 1.0, balanced: bool = True, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) by target, way of grouping and left-out fold; k stands for no fold left out.

    The penalty is 1/c on all but the intercept. balanced: the classes weigh the same in each model, as many as its rows
    in all. NaN where a model has one class only, or its information cannot be inverted.
    """
    shape = (n_targets, n_groups, k + 1)
    counts = np.zeros((*shape, 2))
    by = held.select(F.posexplode("y").alias("t", "y"), "fold").select("t", "y", F.posexplode("fold").alias("g", "fold")).groupBy("t", "g", "fold", "y").count()
    for r in by.collect():
        for f in range(k + 1):
            if f != r["fold"]:
                counts[r["t"], r["g"], f, r["y"]] += r["count"]
    fit = (counts > 0).all(axis=3)
    weight = np.where(fit[..., None], counts.sum(axis=3, keepdims=True) / (2 * np.maximum(counts, 1)), 0.0) if balanced else np.ones_like(counts)
    d = n_features + 1
    beta = np.zeros((*shape, d))
    ridge = np.diag([0.0] + [1.0 / c] * n_features)
    upper = np.triu_indices(d)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, information = np.zeros((*shape, d)), np.zeros((*shape, d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = _matrices(batch, ["x", "y", "fold"])
            x = np.c_[np.ones(len(x)), x]
            for t, g, f in zip(*np.nonzero(fit), strict=True):
                mine = fold[:, g] != f
                xs, ys = x[mine], y[mine, t].astype(int)
                p = _sigmoid(xs @ beta[t, g, f])
                w = weight[t, g, f][ys]
                gradient[t, g, f] += xs.T @ (w * (ys - p))
                information[t, g, f] += (xs * (w * p * (1 - p))[:, None]).T @ xs
        model = np.arange(fit.size).repeat(d + len(upper[0]))
        values = np.concatenate([gradient.reshape(-1, d), information.reshape(-1, d, d)[:, upper[0], upper[1]]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(np.tile(np.arange(values.shape[1]), len(values))), pa.array(values.ravel())], ["model", "place", "v"])

    for _ in range(rounds):
        sums = np.zeros((fit.size, d + len(upper[0])))
        for r in held.select("x", "y", "fold").mapInArrow(passed, "model bigint, place bigint, v double").groupBy("model", "place").agg(F.sum("v").alias("v")).collect():
            sums[r["model"], r["place"]] = r["v"]
        most = 0.0
        for m, (t, g, f) in enumerate(np.ndindex(shape)):
            if not fit[t, g, f]:
                continue
            information = np.zeros((d, d))
            information[upper] = sums[m, d:]
            information = information + np.triu(information, 1).T + ridge
            if not np.isfinite(information).all() or np.linalg.matrix_rank(information) < d:
                fit[t, g, f] = False
                continue
            step = np.linalg.solve(information, sums[m, :d] - ridge @ beta[t, g, f])
            beta[t, g, f] += step
            most = max(most, float(np.abs(step).max()))
        if most < 1e-10:
            break
    beta[~fit] = np.nan
    return beta


def out_of_fold(held: DataFrame, beta: np.ndarray, targets: list[str], groups: list[str]) -> DataFrame:
    """(key, target, grouping, fold, y, score): each row scored by the model that its fold was left out of; a null score
    where that model could not be fitted."""
    kind = held.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = _matrices(batch, ["x", "y", "fold"])
            x = np.c_[np.ones(len(x)), x]
            n = len(x)
            for t, target in enumerate(targets):
                for g, group in enumerate(groups):
                    score = _sigmoid((x * beta[t, g][fold[:, g]]).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([target] * n), pa.array([group] * n), pa.array(fold[:, g].astype(np.int32)), pa.array(y[:, t].astype(np.int32)), pa.array(score, mask=np.isnan(score))], ["key", "target", "grouping", "fold", "y", "score"])

    return held.mapInArrow(run, f"key {kind}, target string, grouping string, fold int, y int, score double")


def auc_by(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, n_pos, auc): area under the curve, ties at half, for each key; null where a class is missing.

    The histogram of scores is ordered by key and score over the whole table, in ranges; what lies below a score within
    its key is what lies below it in all, less what lies below the key.
    """
    held = settle(scored.filter("score is not null").groupBy(*keys, "score").agg(F.sum(F.col("y")).cast("bigint").alias("pos"), F.count("*").alias("n")))
    below = cumulated(held, [*keys, "score"], neg_below=F.col("n") - F.col("pos"))
    first = F.min("neg_below")
    won = below.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("neg_below").cast("double") + F.col("pos") * (F.col("n") - F.col("pos")) / 2.0).alias("won"), first.alias("before"))
    neg = F.col("n") - F.col("n_pos")
    return won.select(*keys, "n", "n_pos", F.when((F.col("n_pos") > 0) & (neg > 0), (F.col("won") - F.col("n_pos") * F.col("before").cast("double")) / (F.col("n_pos") * neg.cast("double"))).alias("auc"))


def grouped_auc(rows: DataFrame, key: str, targets: dict[str, Column], features: list[str], groups: dict[str, Column], k: int = 5, c: float = 1.0, balanced: bool = True) -> DataFrame:
    """(target, grouping, n, n_pos, auc) of predictions out of fold, for each target and way of grouping."""
    held = prepared(rows, key, targets, features, groups, k)
    beta = fit_folds(held, len(targets), len(groups), len(features), k, c, balanced)
    return auc_by(out_of_fold(held, beta, list(targets), list(groups)), "target", "grouping")


def fits(rows: DataFrame, key: str, target: Column, features: list[str], settings: dict[str, tuple[float, bool]]) -> DataFrame:
    """(setting, term, coefficient): penalized logistic regressions of one target, a setting being (c, balanced)."""
    held = prepared(rows, key, {"y": target}, features, {"none": F.lit(0)}, 1)
    out = []
    for name, (c, balanced) in settings.items():
        beta = fit_folds(held, 1, 1, len(features), 1, c, balanced)[0, 0, 1]
        out += [(name, term, None if np.isnan(b) else float(b)) for term, b in zip(["intercept", *features], beta, strict=True)]
    return rows.sparkSession.createDataFrame(out, "setting string, term string, coefficient double")
