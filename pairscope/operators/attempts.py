"""What three sources say of each attempt: execution records, staging folders, an inventory of files; and where they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence(records: DataFrame, staging: DataFrame, inventory: DataFrame) -> DataFrame:
    """A row for each slot (job, attempt) that any source knows.

    records: job, attempt, status, session; staging and inventory: job, attempt, name, sha256, agent (null where a file
    names none), schema_valid (null where it is no output). Returned: in_records, in_staging, in_inventory, status, session,
    agents (of files, in order), has_valid_output, mismatches (names of files whose digests differ between staging and
    inventory, in order) and contradictions, a list of `sources:what`:
    records/staging and records/inventory session (no file there names the record's session), staging/inventory digest,
    records/files missing_record, files/records no_files. An unknown session contradicts nothing.
    """
    none = lambda kind: F.lit(None).cast(kind)
    said = records.select("job", "attempt", F.lit("records").alias("source"), none("string").alias("name"), none("string").alias("sha256"), none("string").alias("agent"), none("boolean").alias("schema_valid"), "status", "session")
    filed = [f.select("job", "attempt", F.lit(s).alias("source"), "name", "sha256", "agent", "schema_valid", none("string").alias("status"), none("string").alias("session")) for s, f in (("staging", staging), ("inventory", inventory))]
    at = lambda s: F.col("source") == s
    # a row a file first, so that a slot of many files is only summed up
    files = said.unionByName(filed[0]).unionByName(filed[1]).groupBy("job", "attempt", "name").agg(
        *(F.max(F.when(at(s), 1).otherwise(0)).alias(s) for s in ("records", "staging", "inventory")),
        *(F.max(F.when(at(s), F.col("sha256"))).alias(f"sha_{s}") for s in ("staging", "inventory")),
        *(F.max(F.when(at(s), F.col("agent"))).alias(f"agent_{s}") for s in ("staging", "inventory")),
        F.max("schema_valid").alias("schema_valid"),
        F.max("status").alias("status"),
        F.max("session").alias("session"),
    )
    slots = files.groupBy("job", "attempt").agg(
        *((F.max(s) == 1).alias(f"in_{s}") for s in ("records", "staging", "inventory")),
        F.max("status").alias("status"),
        F.max("session").alias("session"),
        F.collect_set("agent_staging").alias("staged"),
        F.collect_set("agent_inventory").alias("listed"),
        F.coalesce(F.max("schema_valid"), F.lit(False)).alias("has_valid_output"),
        F.array_sort(F.collect_list(F.when(F.col("sha_staging") != F.col("sha_inventory"), F.col("name")))).alias("mismatches"),
    )
    known = F.col("session").isNotNull() & ~F.col("session").isin("", "unknown")
    other = lambda agents: known & (F.size(agents) > 0) & ~F.array_contains(agents, F.col("session"))
    files_there = F.col("in_staging") | F.col("in_inventory")
    found = [
        F.when(other("staged"), "records/staging:session"),
        F.when(other("listed"), "records/inventory:session"),
        F.when(F.size("mismatches") > 0, "staging/inventory:digest"),
        F.when(files_there & ~F.col("in_records"), "records/files:missing_record"),
        F.when(F.col("in_records") & ~files_there, "files/records:no_files"),
    ]
    return slots.select("job", "attempt", "in_records", "in_staging", "in_inventory", "status", "session", F.array_sort(F.array_union("staged", "listed")).alias("agents"), "has_valid_output", "mismatches", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("contradictions"))


def job_evidence(slots: DataFrame) -> DataFrame:
    """A row a job over evidence(): records, accepted ones, first accepted and first slot with a valid output, whether a
    valid output came before the accepted attempt, and slots with a contradiction."""
    accepted = F.col("status") == "accepted"
    held = slots.groupBy("job").agg(
        F.count("*").alias("slots"),
        F.count_if("in_records").alias("records"),
        F.count_if(accepted).alias("accepted"),
        F.min(F.when(accepted, F.col("attempt"))).alias("first_accepted"),
        F.min(F.when(F.col("has_valid_output"), F.col("attempt"))).alias("first_valid"),
        F.count_if(F.size("contradictions") > 0).alias("contradicted"),
    )
    return held.withColumn("earlier_valid", F.coalesce(F.col("first_valid") < F.col("first_accepted"), F.lit(False)))
