"""Flags that mark a claim for a person to look at, and the string of categories they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories in the order they are listed, and what stands for none.
REVIEW = [
    "shared_regression",
    "weakly_warranted_or_ambiguous",
    "multi_sentence_integration_or_title_context",
    "possible_coreference_or_title_loss",
    "numerical_or_comparative_reasoning",
    "negation_or_scope",
    "possible_representation_failure",
    "possible_benchmark_annotation_issue",
]
UNEXPLAINED = "unexplained"


def with_quality_flags(rows: DataFrame, overlap: str, similarity: str, disagrees: str, margin: str, least: float = 0.2, quantile: float = 0.02, wide: float = 0.3) -> DataFrame:
    """rows with low_overlap, low_similarity (under the exact quantile of the table) and diagnostic_disagreement."""
    bar = rows.agg(F.percentile(similarity, quantile).alias("__bar"))
    held = rows.crossJoin(F.broadcast(bar))
    return held.withColumns({"low_overlap": F.col(overlap) < least, "low_similarity": F.col(similarity) < F.col("__bar"), "diagnostic_disagreement": F.col(disagrees) & (F.col(margin) < wide)}).drop("__bar")


def listed(predicates: list[Column], names: list[str] = REVIEW, none: str = UNEXPLAINED) -> Column:
    """The names whose predicate holds (null does not), in order, joined by semicolons; `none` where there is none."""
    found = F.array_join(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in zip(names, predicates, strict=True))), lambda x: x.isNotNull()), ";")
    return F.when(found == "", none).otherwise(found)
