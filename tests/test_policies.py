"""Golden rows, and each rule at its bounds."""

from __future__ import annotations

import pytest

from veriframe.functions.clock import NS_PER_DAY
from veriframe.operators import checks, policies, verify
from veriframe.sources.records import rows_of
from veriframe.sources.seed import seed

NOW = 1_755_648_000_000_000_000
HOUR = 3_600_000_000_000


def ago(days: int, more: int = 0) -> int:
    return NOW - days * NS_PER_DAY - more


def fired(spark, n: int, now: int = NOW, **tables: list[dict]) -> list[str]:
    """Record ids of rule ``n`` over the given rows; tables not given are empty."""
    t = {name: rows_of(spark, name, rows) for name, rows in tables.items()}
    return sorted(r.record_id for r in policies.BUNDLE[n - 1](t, now).collect())


def test_golden_rows(spark):
    rows = policies.evaluate_policies(seed(spark), NOW).collect()
    assert len(rows) == 11
    assert sum(r.system_id == "GXP-MFG-DEMO-01" for r in rows) == 10
    assert {r.rule_id for r in rows} == {r[0] for r in policies.RULES}


def test_empty_tables_have_no_violations(spark):
    t = seed(spark, **{name: [] for name in ("gxp_systems", "documents", "access_reviews", "risks", "incidents", "requirements", "test_cases", "suppliers", "periodic_evaluations", "access_records", "changes", "change_actions")})
    assert policies.evaluate_policies(t, NOW).count() == 0
    assert policies.no_violations(spark).columns == policies.evaluate_policies(t, NOW).columns


@pytest.mark.parametrize(("n", "table", "column", "days", "more"), [(2, "access_reviews", "scheduled_date_ns", 30, {"status": "PENDING"}), (3, "risks", "last_review_date_ns", 365, {}), (4, "incidents", "opened_date_ns", 7, {"severity": "P1", "status": "OPEN", "rca_started": False}), (6, "suppliers", "reassessment_due_date_ns", 0, {}), (7, "periodic_evaluations", "due_date_ns", 0, {}), (8, "gxp_systems", "last_backup_test_ns", 365, {})])
def test_thresholds(spark, n, table, column, days, more):
    rows = [{"id": "at", column: ago(days)}, {"id": "over", column: ago(days, HOUR)}, {"id": "future", column: ago(-30)}, {"id": "null", column: None}, {"id": "ns", column: ago(days, 1)}]
    assert fired(spark, n, **{table: [r | more for r in rows]}) == ["ns", "over"]


def test_status_rules(spark):
    docs = [{"id": "a", "doc_type": "O&M", "status": "DRAFT"}, {"id": "b", "doc_type": "O&M", "status": "APPROVED"}, {"id": "c", "doc_type": "SOP", "status": "DRAFT"}, {"id": "d", "doc_type": "O&M", "status": None}]
    assert fired(spark, 1, documents=docs) == ["a", "d"]
    old = {"severity": "P1", "status": "OPEN", "opened_date_ns": ago(47)}
    incidents = [{"id": "a", "rca_started": False} | old, {"id": "b", "rca_started": True} | old, {"id": "c", "rca_started": None} | old, {"id": "d", "rca_started": False} | old | {"severity": "P2"}, {"id": "e", "rca_started": False} | old | {"status": "CLOSED"}]
    assert fired(spark, 4, incidents=incidents) == ["a"]
    t = {"incidents": rows_of(spark, "incidents", incidents).drop("rca_started")}
    assert sorted(r.record_id for r in policies.p04(t, NOW).collect()) == ["a", "b", "c"]
    accounts = [{"id": "a", "is_privileged": True, "user_status": "DEPARTED"}, {"id": "b", "is_privileged": True, "user_status": "ACTIVE"}, {"id": "c", "is_privileged": False, "user_status": "DEPARTED"}, {"id": "d"}]
    assert fired(spark, 9, access_records=accounts) == ["a"]


def test_linked_rules(spark):
    cases = [{"id": "t1", "status": "DRAFT", "system_id": "other"}, {"id": "t2", "status": "EXECUTED"}]
    requirements = [{"id": "a", "test_case_id": "t1", "system_id": "s"}, {"id": "b", "test_case_id": "t2"}, {"id": "c", "test_case_id": "none"}, {"id": "d", "test_case_id": None}]
    assert fired(spark, 5, requirements=requirements, test_cases=cases) == ["a"]
    changes = [{"id": "a", "status": "CLOSED"}, {"id": "b", "status": "OPEN"}, {"id": "c", "status": "CLOSED"}]
    actions = [{"id": "1", "change_id": "a", "status": "OPEN"}, {"id": "2", "change_id": "a", "status": "OPEN"}, {"id": "3", "change_id": "b", "status": "OPEN"}, {"id": "4", "change_id": "c", "status": "CLOSED"}]
    assert fired(spark, 10, changes=changes, change_actions=actions) == ["a"]


def results(spark, now: int = NOW, **replaced) -> dict:
    return {(r.check_id, r.system_id): r for r in checks.run_checks(seed(spark, **replaced), now).collect()}


def test_checks_on_golden_rows(spark):
    got = results(spark)
    main = "GXP-MFG-DEMO-01"
    failed = {k[0] for k, r in got.items() if k[1] == main and not r.passed}
    assert failed == {"D2", "D3", "D5", "D6", "D7", "D8", "D9"}
    assert got["D1", main].passed and got["D1", main].record_id == "DOC-2026-URS-01"
    other = {k[0]: r.passed for k, r in got.items() if k[1] == "BUS-IT-DEMO-02"}
    assert other == {"D1": False, "D2": False, "D3": True}
    assert got["D1", "BUS-IT-DEMO-02"].record_id is None


def test_only_the_first_record_is_tested(spark):
    s = "GXP-MFG-DEMO-01"
    docs = [{"id": "U1", "system_id": s, "doc_type": "URS", "status": "DRAFT"}, {"id": "U2", "system_id": s, "doc_type": "URS", "status": "APPROVED"}]
    assert not results(spark, documents=docs)["D1", s].passed
    due = [{"id": "x", "system_id": s, "due_date_ns": NOW}, {"id": "y", "system_id": s, "due_date_ns": ago(10)}]
    assert results(spark, periodic_evaluations=due)["D2", s].passed  # due now is not overdue
    assert not results(spark, periodic_evaluations=[*due, {"id": "z", "system_id": s, "due_date_ns": None}])["D2", s].passed
    risks = [{"id": "b", "system_id": s, "last_review_date_ns": ago(365, HOUR)}, {"id": "a", "system_id": s, "last_review_date_ns": ago(365, HOUR)}, {"id": "0", "system_id": s}]
    r = results(spark, risks=risks)["D5", s]
    assert r.passed and r.record_id == "a"  # 365 whole days aren't more than 365, though the rule fires
    assert policies.p03(seed(spark, risks=risks), NOW).count() == 2
    dangling = [{"id": "r", "system_id": s, "test_case_id": "none"}]
    assert not results(spark, requirements=dangling)["D3", s].passed
    done = [{"id": "a", "system_id": s, "scheduled_date_ns": ago(400), "status": "COMPLETED"}, {"id": "b", "system_id": s, "scheduled_date_ns": ago(5), "status": "COMPLETE"}]
    assert results(spark, access_reviews=done)["D8", s].record_id == "b"


def test_verified_findings(spark):
    t = seed(spark)
    found = checks.findings_of(checks.run_checks(t, NOW))
    main = {r.finding_id: r for r in found.where("system_id = 'GXP-MFG-DEMO-01'").collect()}
    assert len(main) == 7
    assert "A2-ANNEX11-S11-PE-001-PE-2024-01" in main and "'PE-2024-01'" in main["A2-ANNEX11-S11-PE-001-PE-2024-01"].claim
    graded = verify.verify_findings(found, policies.evaluate_policies(t, NOW), t)
    assert {r.confidence for r in graded.where("system_id = 'GXP-MFG-DEMO-01'").collect()} == {"MEDIUM"}
    out = verify.verify_findings(found, policies.no_violations(spark), t).collect()
    assert len(out) == found.count() and {r.confidence for r in out} == {"INSUFFICIENT_EVIDENCE"}
    assert verify.verify_findings(found.limit(0), policies.evaluate_policies(t, NOW), t).count() == 0


def test_finding_edge_cases(spark):
    t = seed(spark)
    schema = "finding_id string, system_id string, claim string, regulatory_citations array<string>, evidence_ids array<string>, alcoa_score map<string,boolean>"
    nine = {f"k{i}": True for i in range(9)}
    rows = [
        ("truth", "s", "c", ["ANNEX11-S11-PE-001"], ["PE-2024-01"], nine), ("not backed", "s", "c", ["ANNEX11-S4-DOC-001"], ["DOC-2026-URS-01"], nine), ("made up", "s", "c", ["ANNEX11-S11-PE-001"], ["PE-9999-FAKE"], nine),
        ("unknown rule", "s", "c", ["UNKNOWN-RULE-ID-999"], ["PE-2024-01"], nine), ("none", "s", "c", ["ANNEX11-S11-PE-001"], [], nine), ("bad first", "s", "c", ["ANNEX11-S11-PE-001"], ["x", "PE-2024-01"], nine),
        ("no flags", "s", "c", ["ANNEX11-S11-PE-001"], ["PE-2024-01"], {}), ("null", "s", None, None, None, None),
    ]
    got = {r.finding_id: (r.db_record_found, r.opa_corroborated, r.confidence) for r in verify.verify_findings(spark.createDataFrame(rows, schema), policies.evaluate_policies(t, NOW), t).collect()}
    bad = (False, False, "INSUFFICIENT_EVIDENCE")
    assert got == {"truth": (True, True, "HIGH"), "not backed": (True, False, "INSUFFICIENT_EVIDENCE"), "made up": bad, "unknown rule": bad, "none": bad, "bad first": bad, "no flags": (True, True, "LOW"), "null": bad}
