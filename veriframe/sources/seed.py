"""The golden rows: two systems and their records. All fixed values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from veriframe.sources.records import empty, rows_of

_MAIN, _OTHER = "GXP-MFG-DEMO-01", "BUS-IT-DEMO-02"
ROWS = {
    "gxp_systems": [
        {"id": _MAIN, "name": "NovaSynth Manufacturing Execution Support System", "system_owner": "Jens Larsen", "lifecycle_state": "OPERATIONAL", "gxp_impact": True, "readiness_score": 61, "last_backup_test_ns": 1709251200000000000},
        {"id": _OTHER, "name": "Argonaut Business Analytics Platform", "system_owner": "Elena Rostova", "lifecycle_state": "OPERATIONAL", "gxp_impact": False, "readiness_score": 94, "last_backup_test_ns": 1722470400000000000},
    ],
    "documents": [
        {"id": "DOC-2026-OM-99", "system_id": _MAIN, "doc_type": "O&M", "title": "NovaSynth Operations Manual", "version": "v1.0", "author": "Sarah Jensen", "created_date": datetime(2026, 8, 1, 10), "status": "DRAFT"},
        {"id": "DOC-2026-URS-01", "system_id": _MAIN, "doc_type": "URS", "title": "NovaSynth User Requirements Specification", "version": "v1.0", "author": "Sarah Jensen", "created_date": datetime(2026, 7, 1, 9), "effective_date": datetime(2026, 7, 15), "status": "APPROVED"},
    ],
    "access_reviews": [{"id": "AR-2026-05", "system_id": _MAIN, "review_type": "QUARTERLY_PRIVILEGED", "scheduled_date_ns": 1715424000000000000, "status": "PENDING", "reviewer": "Marcus Aurelius", "accounts_in_scope": 14}],
    "risks": [{"id": "RSK-2024-11", "system_id": _MAIN, "risk_summary": "Data corruption during LIMS interface sync", "severity": "HIGH", "probability": "OCCASIONAL", "last_review_date_ns": 1723718400000000000, "owner": "Data Integrity Office"}],
    "incidents": [{"id": "INC-849201", "system_id": _MAIN, "title": "Batch release module timeout", "severity": "P1", "status": "OPEN", "opened_date_ns": 1719830400000000000, "rca_started": False, "patient_safety_relevant": True}],
    "requirements": [{"id": "URS-042", "system_id": _MAIN, "req_text": "System shall enforce complex passwords", "test_case_id": "TC-2026-042"}],
    "test_cases": [{"id": "TC-2026-042", "system_id": _MAIN, "status": "DRAFT"}],
    "suppliers": [{"id": "SUP-2026-01", "system_id": _MAIN, "name": "DataSync Solutions", "reassessment_due_date_ns": 1708214400000000000, "status": "APPROVED"}],
    "periodic_evaluations": [{"id": "PE-2024-01", "system_id": _MAIN, "due_date_ns": 1704067200000000000, "status": "PENDING"}],
    "access_records": [{"id": "ACC-2026-99", "system_id": _MAIN, "user_id": "U-9942", "is_privileged": True, "user_status": "DEPARTED"}],
    "changes": [{"id": "CR-2026-089", "system_id": _MAIN, "description": "Database migration", "status": "CLOSED", "qa_approval_date": datetime(2026, 8, 1, 12)}],
    "change_actions": [{"id": "CA-2026-089-1", "change_id": "CR-2026-089", "description": "Update SOPs post-migration", "status": "OPEN"}],
}


def seed(spark: SparkSession, **replaced: list[dict]) -> dict[str, DataFrame]:
    """All live tables with the golden rows; ``replaced`` gives tables other rows."""
    return {name: rows_of(spark, name, rows) if rows else empty(spark, name) for name, rows in (ROWS | replaced).items()}
