"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, personal data, packing.

Every stage takes any table with doc_id and text; other columns of any name pass through (but for packing). Null ids,
repeated ids and null columns are no reason to go; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairscope.llm import decontaminate, packing, pii, quality, simhash
from pairscope.llm.common import read, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by their text alone: a null, empty or wordless text goes, repeated rows all
    stay or all go, a text of any length is read whole."""
    return quality.filter_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the least id, a null id after all others, and of equal ids the least row hash.

    Rows equal in all columns stand for one. Null and empty texts are one class, that of fingerprint zero."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts contain none. An empty benchmark leaves all."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars counted anew; every row stays, a null text as it is."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null text is empty, and every row is a document of its own."""
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: The stages on fingerprints, induced patterns and tokens have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each but the last written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
