"""The ten policy rules: record tables -> the set of violations (rule_id, severity, system_id, record_id, description).

Rules are filters and semi-joins over long comparisons that reach the scan; the bundle is their union, made a set.
A null time fires no rule; a null status counts as not approved; a null root-cause flag is neither true nor false.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions.clock import elapsed_over
from veriframe.sources.schemas import VIOLATION

#: Fixed values: (rule_id, severity, description) of P1 .. P10.
RULES = [
    ("ANNEX11-S4-DOC-001", "HIGH", "O&M Document is not in APPROVED state"),
    ("ANNEX11-S12-ACC-001", "HIGH", "Access review overdue beyond 30-day grace period"),
    ("ICH-Q9-RSK-001", "MEDIUM", "Risk assessment exceeds 12-month review cycle"),
    ("ANNEX11-S13-INC-001", "HIGH", "P1 Incident open > 7 days without documented Root Cause Analysis"),
    ("ANNEX11-S4-TRC-001", "HIGH", "Requirement lacks executed test case evidence"),
    ("ANNEX11-S3-SUP-001", "MEDIUM", "Supplier reassessment overdue"),
    ("ANNEX11-S11-PE-001", "HIGH", "Periodic evaluation overdue > 12 months"),
    ("ANNEX11-S16-BCK-001", "HIGH", "Backup restore test older than 12 months"),
    ("ANNEX11-S12-ACC-002", "CRITICAL", "Privileged account active but user marked departed"),
    ("ANNEX11-S10-CHG-001", "HIGH", "Change closed but linked actions remain open"),
]
#: The table that holds each rule's evidence.
EVIDENCE = {
    "ANNEX11-S4-DOC-001": "documents",
    "ANNEX11-S12-ACC-001": "access_reviews",
    "ICH-Q9-RSK-001": "risks",
    "ANNEX11-S13-INC-001": "incidents",
    "ANNEX11-S4-TRC-001": "requirements",
    "ANNEX11-S3-SUP-001": "suppliers",
    "ANNEX11-S11-PE-001": "periodic_evaluations",
    "ANNEX11-S16-BCK-001": "gxp_systems",
    "ANNEX11-S12-ACC-002": "access_records",
    "ANNEX11-S10-CHG-001": "changes",
}

Tables = Mapping[str, DataFrame]


def _violations(n: int, rows: DataFrame, system: str = "system_id") -> DataFrame:
    rule, severity, description = RULES[n - 1]
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(system).alias("system_id"), F.col("id").alias("record_id"), F.lit(description).alias("description"))


def p01(t: Tables, now_ns: int) -> DataFrame:
    return _violations(1, t["documents"].where((F.col("doc_type") == "O&M") & ~F.col("status").eqNullSafe("APPROVED")))


def p02(t: Tables, now_ns: int) -> DataFrame:
    return _violations(2, t["access_reviews"].where((F.col("status") == "PENDING") & elapsed_over(F.col("scheduled_date_ns"), now_ns, 30)))


def p03(t: Tables, now_ns: int) -> DataFrame:
    return _violations(3, t["risks"].where(elapsed_over(F.col("last_review_date_ns"), now_ns, 365)))


def p04(t: Tables, now_ns: int) -> DataFrame:
    incidents = t["incidents"]
    if "rca_started" not in incidents.columns:  # a source without the flag has started none
        incidents = incidents.withColumn("rca_started", F.lit(False))
    urgent = (F.col("severity") == "P1") & (F.col("status") == "OPEN") & ~F.col("rca_started")
    return _violations(4, incidents.where(urgent & elapsed_over(F.col("opened_date_ns"), now_ns, 7)))


def p05(t: Tables, now_ns: int) -> DataFrame:
    """By test case only, whatever its system; a link to no test case is no violation here."""
    draft = t["test_cases"].where(F.col("status") == "DRAFT").select(F.col("id").alias("test_case_id"))
    return _violations(5, t["requirements"].join(draft, "test_case_id", "left_semi"))


def p06(t: Tables, now_ns: int) -> DataFrame:
    return _violations(6, t["suppliers"].where(elapsed_over(F.col("reassessment_due_date_ns"), now_ns, 0)))


def p07(t: Tables, now_ns: int) -> DataFrame:
    return _violations(7, t["periodic_evaluations"].where(elapsed_over(F.col("due_date_ns"), now_ns, 0)))


def p08(t: Tables, now_ns: int) -> DataFrame:
    return _violations(8, t["gxp_systems"].where(elapsed_over(F.col("last_backup_test_ns"), now_ns, 365)), system="id")


def p09(t: Tables, now_ns: int) -> DataFrame:
    return _violations(9, t["access_records"].where(F.col("is_privileged") & (F.col("user_status") == "DEPARTED")))


def p10(t: Tables, now_ns: int) -> DataFrame:
    """A closed change counts once, however many of its actions are open."""
    still_open = t["change_actions"].where(F.col("status") == "OPEN").select(F.col("change_id").alias("id"))
    return _violations(10, t["changes"].where(F.col("status") == "CLOSED").join(still_open, "id", "left_semi"))


BUNDLE = (p01, p02, p03, p04, p05, p06, p07, p08, p09, p10)


def evaluate_policies(t: Tables, now_ns: int) -> DataFrame:
    """The violations of all rules, each once."""
    return reduce(DataFrame.unionByName, (rule(t, now_ns) for rule in BUNDLE)).dropDuplicates()


def no_violations(spark: SparkSession) -> DataFrame:
    """What stands in where rules can't be evaluated: nothing is then corroborated."""
    return spark.createDataFrame([], VIOLATION)


def policy_summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("system_id", "rule_id", "severity").agg(F.count("*").alias("n_violations"))
