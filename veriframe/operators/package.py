"""Audit packages: what an inspector is handed for each system, as one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Severities in the order of a summary.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM")


def audit_packages(systems: DataFrame, findings: DataFrame, verified: DataFrame, violations: DataFrame, trails: DataFrame) -> DataFrame:
    """(system_id, system_overview, findings, risk_summary, audit_trail_valid, chain_of_custody), one row for each system.

    ``findings`` are those of the checks, so at most one of each check in a list; ``verified`` has their grades, ``trails``
    (system_id, status) the result of each chain. Violations and chains are summed in the map tasks. A system without
    chains has a valid trail; the chain of custody is the records that its findings cite.
    """
    graded = findings.select("finding_id", "system_id", "agent", "claim", "evidence_ids").join(verified.select("finding_id", "system_id", "confidence"), ["finding_id", "system_id"], "left")
    lists = graded.groupBy("system_id").agg(
        F.array_sort(F.collect_list(F.struct("finding_id", "agent", "claim", "confidence"))).alias("findings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("chain_of_custody")
    )
    counts = violations.groupBy("system_id").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    valid = trails.groupBy("system_id").agg(F.bool_and(F.col("status") == "VERIFIED").alias("valid"))
    rows = systems.select(F.col("id").alias("system_id"), F.struct("name", "lifecycle_state", "gxp_impact", "last_backup_test_ns").alias("system_overview"))
    for part in (lists, counts, valid):
        rows = rows.join(part, "system_id", "left")
    nothing = F.array().cast(lists.schema["findings"].dataType)
    return rows.select(
        "system_id", "system_overview", F.coalesce("findings", nothing).alias("findings"),
        F.struct(*[F.coalesce(s.lower(), F.lit(0)).cast("long").alias(s.lower()) for s in SEVERITIES]).alias("risk_summary"),
        F.coalesce("valid", F.lit(True)).alias("audit_trail_valid"), F.coalesce("chain_of_custody", F.array().cast("array<string>")).alias("chain_of_custody"),
    )
