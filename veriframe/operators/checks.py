"""Checks of each system's worst record, for all systems at once, and the findings of those that fail.

The first record of a system is a minimum over (order, record) summed in the map tasks, so a system of any size is a
row a task in the shuffle, and nothing is sorted. Only the selected record is tested. A null time in it fails closed.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.clock import not_due_yet, whole_days_over
from veriframe.functions.expressions import alcoa_map
from veriframe.operators.policies import RULES

Tables = Mapping[str, DataFrame]
RULE = {f"P{k + 1}": r[0] for k, r in enumerate(RULES)}


def nulls_last(column: str) -> Column:
    return F.struct(F.col(column).isNull(), F.col(column))


def first_of(rows: DataFrame, order: list[Column], *keep: str) -> DataFrame:
    """(system_id, *keep) of each system's first row."""
    return rows.groupBy("system_id").agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_r")).select("system_id", "_r.*")


def _result(rows: DataFrame, check: str, agent: str, rule: str, passed: Column, record: str = "id", detail: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(check).alias("check_id"), F.lit(agent).alias("agent"), F.lit(RULE[rule]).alias("rule_id"), "system_id", F.col(record).alias("record_id"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"), passed.alias("passed"),
    )


def _systems(t: Tables) -> DataFrame:
    return t["gxp_systems"].select(F.col("id").alias("system_id"))


def d1_requirements_approved(t: Tables, now_ns: int) -> DataFrame:
    """The first requirements specification by id is approved; a system without one fails."""
    first = first_of(t["documents"].where(F.col("doc_type") == "URS"), [nulls_last("id")], "id", "status")
    return _result(_systems(t).join(first, "system_id", "left"), "D1", "A2", "P1", F.col("status").eqNullSafe("APPROVED"))


def d2_evaluation_current(t: Tables, now_ns: int) -> DataFrame:
    """The periodic evaluation due last isn't due yet; a null date comes first and fails, as does a system without one."""
    latest = first_of(t["periodic_evaluations"], [F.struct(F.col("due_date_ns").isNotNull(), -F.col("due_date_ns")), nulls_last("id")], "id", "due_date_ns")
    return _result(_systems(t).join(latest, "system_id", "left"), "D2", "A2", "P7", F.coalesce(not_due_yet(F.col("due_date_ns"), now_ns), F.lit(False)))


def d3_traceability(t: Tables, now_ns: int) -> DataFrame:
    """No requirement lacks a test case that is past draft; a system without requirements passes. The first failing one by id is the record."""
    cases = t["test_cases"].select(F.col("id").alias("test_case_id"), F.col("status").alias("case_status"))
    failing = t["requirements"].join(cases, "test_case_id", "left").where(F.col("case_status").isNull() | (F.col("case_status") == "DRAFT"))
    first = first_of(failing, [nulls_last("id")], "id").withColumn("failing", F.lit(True))
    return _result(_systems(t).join(first, "system_id", "left"), "D3", "A2", "P5", F.col("failing").isNull())


def d4_unknown_systems(requested: DataFrame, t: Tables) -> DataFrame:
    """Requested ``system_id`` values that no system has."""
    return requested.select("system_id").distinct().join(_systems(t), "system_id", "left_anti")


def d5_risk_review(t: Tables, now_ns: int) -> DataFrame:
    oldest = first_of(t["risks"], [nulls_last("last_review_date_ns"), nulls_last("id")], "id", "last_review_date_ns")
    return _result(oldest, "D5", "A3", "P3", ~F.coalesce(whole_days_over(F.col("last_review_date_ns"), now_ns, 365), F.lit(False)), detail=F.col("last_review_date_ns"))


def d6_change_completeness(t: Tables, now_ns: int) -> DataFrame:
    actions = t["change_actions"].where(F.col("status") == "OPEN").select(F.col("change_id").alias("id"), F.col("id").alias("action_id"))
    closed = t["changes"].where(F.col("status") == "CLOSED").select("id", "system_id").join(actions, "id")
    return _result(first_of(closed, [nulls_last("id"), nulls_last("action_id")], "id", "action_id"), "D6", "A4", "P10", F.lit(False), detail=F.col("action_id"))


def d7_root_cause(t: Tables, now_ns: int) -> DataFrame:
    open_ = t["incidents"].where((F.col("severity") == "P1") & (F.col("status") == "OPEN") & ~F.col("rca_started"))
    oldest = first_of(open_, [nulls_last("opened_date_ns"), nulls_last("id")], "id", "opened_date_ns")
    return _result(oldest, "D7", "A5", "P4", ~F.coalesce(whole_days_over(F.col("opened_date_ns"), now_ns, 7), F.lit(False)), detail=F.col("opened_date_ns"))


def d8_access_review(t: Tables, now_ns: int) -> DataFrame:
    overdue = t["access_reviews"].where((F.col("status") != "COMPLETED") & (F.col("scheduled_date_ns") < F.lit(now_ns)))
    oldest = first_of(overdue, [nulls_last("scheduled_date_ns"), nulls_last("id")], "id", "scheduled_date_ns")
    return _result(oldest, "D8", "A6", "P2", F.lit(False), detail=F.col("scheduled_date_ns"))


def d9_orphaned_account(t: Tables, now_ns: int) -> DataFrame:
    orphans = t["access_records"].where(F.col("is_privileged") & (F.col("user_status") == "DEPARTED"))
    return _result(first_of(orphans, [nulls_last("id")], "id"), "D9", "A6", "P9", F.lit(False))


CHECKS = (d1_requirements_approved, d2_evaluation_current, d3_traceability, d5_risk_review, d6_change_completeness, d7_root_cause, d8_access_review, d9_orphaned_account)


def run_checks(t: Tables, now_ns: int) -> DataFrame:
    return reduce(DataFrame.unionByName, (check(t, now_ns) for check in CHECKS))


#: The sentence of each check; %1$s is the record, %2$s the rule or detail.
_COMPLIANCE = "Compliance check %s against record '%%1$s' found that %s, citing %%2$s under EU GMP Annex 11, and requires review."
CLAIMS = {
    "D1": _COMPLIANCE % ("verify_urs_approved", "the User Requirements Specification is missing or not in APPROVED state"),
    "D2": _COMPLIANCE % ("verify_periodic_eval_current", "the periodic evaluation is overdue"),
    "D3": _COMPLIANCE % ("verify_test_traceability", "a requirement lacks linked, non-DRAFT test case evidence"),
    "D5": "Risk assessment %1$s exceeds the ICH Q9(R1) 12-month review cycle (last_review_date_ns=%2$s) and requires reassessment of patient safety and business continuity impact.",
    "D6": "Change %1$s is CLOSED but linked action %2$s remains OPEN, a violation of EU GMP Annex 11 Section 10 change-control completeness.",
    "D7": "P1 incident %1$s has been open for more than 7 days (opened_date_ns=%2$s) without a documented Root Cause Analysis, a violation of EU GMP Annex 11 Section 13.",
    "D8": "Access review %1$s is overdue (scheduled_date_ns=%2$s), a violation of EU GMP Annex 11 Section 12 access-control currency.",
    "D9": "Privileged account %1$s remains active for a departed user, a critical violation of EU GMP Annex 11 Section 12 segregation-of-duties controls.",
}
#: Fixed values: (claim, citations, attribution, has flags) of the findings that stand in for a check that can't run.
ERRORS = {
    "A1": ("Unable to verify documentation inventory due to retrieval timeout.", [], "gemini-2.5-flash", False),
    "A2": ("Traceability verification failed.", [], "deterministic-fallback", True),
    "A3": ("A3 deterministic check unavailable: database unreachable.", [RULE["P3"]], "deterministic-fallback", True),
    "A4": ("A4 deterministic check unavailable: database unreachable.", [RULE["P10"]], "deterministic-fallback", True),
    "A5": ("A5 deterministic check unavailable: database unreachable.", [RULE["P4"]], "deterministic-fallback", True),
    "A6": ("A6 deterministic check unavailable: database unreachable.", [RULE["P2"], RULE["P9"]], "deterministic-fallback", True),
}


def findings_of(results: DataFrame) -> DataFrame:
    """A finding for each result that didn't pass; system_id and agent come along."""
    record = F.coalesce("record_id", F.lit("no matching record"))
    claim = F.lit(None).cast("string")
    for check, sentence in CLAIMS.items():
        second = F.col("rule_id") if check in ("D1", "D2", "D3") else F.coalesce("detail", F.lit("None"))
        claim = F.when(F.col("check_id") == check, F.format_string(sentence, record, second)).otherwise(claim)
    none = F.array().cast("array<string>")
    return results.where(~F.col("passed")).select(
        "system_id", "agent",
        F.concat_ws("-", "agent", "rule_id", F.coalesce("record_id", F.lit("NO-RECORD"))).alias("finding_id"),
        claim.alias("claim"), F.array("rule_id").alias("regulatory_citations"), F.lit("UNVERIFIED").alias("confidence_score"),
        F.when(F.col("record_id").isNull(), none).otherwise(F.array("record_id")).alias("evidence_ids"), alcoa_map().alias("alcoa_score"), F.lit("deterministic-fallback").alias("model_attribution"),
    )


def error_findings(requests: DataFrame) -> DataFrame:
    """``requests`` (system_id, agent) whose check can't run -> their stand-in findings."""
    flags = lambda has: alcoa_map() if has else F.create_map().cast("map<string,boolean>")
    parts = [
        requests.where(F.col("agent") == agent).select(
            "system_id", "agent", F.lit(f"ERR-{agent}").alias("finding_id"), F.lit(claim).alias("claim"), F.array(*map(F.lit, citations)).cast("array<string>").alias("regulatory_citations"),
            F.lit("LOW").alias("confidence_score"), F.array().cast("array<string>").alias("evidence_ids"), flags(has).alias("alcoa_score"), F.lit(attribution).alias("model_attribution"),
        )
        for agent, (claim, citations, attribution, has) in ERRORS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def route(findings: DataFrame, active: DataFrame) -> DataFrame:
    """Findings of the agents that a system's ``active`` row (system_id, active_agents) names."""
    return findings.join(active.select("system_id", F.explode("active_agents").alias("agent")).distinct(), ["system_id", "agent"], "left_semi")
