"""Schemas of the record tables, their references, and the results' schemas. All fixed values."""

from __future__ import annotations

TABLES = {
    "gxp_systems": "id string, name string, description string, system_owner string, lifecycle_state string, gxp_impact boolean, readiness_score int, last_backup_test_ns bigint",
    "documents": "id string, system_id string, doc_type string, title string, version string, author string, created_date timestamp_ntz, effective_date timestamp_ntz, status string",
    "document_chunks": "chunk_id string, document_id string, content string, embedding_id string",
    "requirements": "id string, system_id string, req_text string, test_case_id string",
    "risks": "id string, system_id string, risk_summary string, severity string, probability string, last_review_date_ns bigint, owner string",
    "design_elements": "id string, system_id string, description string",
    "test_cases": "id string, system_id string, status string",
    "test_results": "id string, test_case_id string, execution_date_ns bigint, pass_fail boolean, tester string",
    "incidents": "id string, system_id string, title string, description string, severity string, status string, opened_date_ns bigint, rca_started boolean, patient_safety_relevant boolean",
    "access_reviews": "id string, system_id string, review_type string, scheduled_date_ns bigint, status string, reviewer string, accounts_in_scope int",
    "access_records": "id string, system_id string, user_id string, is_privileged boolean, user_status string",
    "suppliers": "id string, system_id string, name string, reassessment_due_date_ns bigint, status string",
    "supplier_assessments": "id string, supplier_id string, assessment_date_ns bigint, result string",
    "periodic_evaluations": "id string, system_id string, due_date_ns bigint, status string",
    "changes": "id string, system_id string, description string, status string, qa_approval_date timestamp_ntz",
    "change_actions": "id string, change_id string, description string, status string",
    "findings": "id string, system_id string, agent_id string, severity string, status string, description string",
    "evidence_refs": "id string, finding_id string, reference_type string, reference_id string",
    "action_proposals": "id string, action_type string, target_system string, payload string, status string",
    "audit_events": "event_id string, timestamp_utc timestamp_ntz, session_id string, user_id string, user_role string, agent_id string, action_type string, target_system_id string, "
    "target_record_id string, input_hash string, output_summary string, evidence_ids string, opa_rule_ids string, model_id string, prompt_version string, approval_id string, "
    "previous_event_hash string, event_hash string",
    "agent_messages": "id string, session_id string, agent_id string, message_content string, timestamp_utc timestamp_ntz",
    "graph_nodes": "node_id string, system_id string, node_type string, properties string",
    "graph_edges": "source_id string, target_id string, relation_type string",
    "candidate_memory": "id string, fact_text string, status string",
    "trusted_memory": "id string, fact_text string, approved_by string",
    "users": "id string, username string, role string",
    "sessions": "id string, user_id string, start_time timestamp_ntz, end_time timestamp_ntz",
}

_OF_SYSTEM = "documents requirements risks design_elements test_cases incidents access_reviews access_records suppliers periodic_evaluations changes findings graph_nodes".split()
#: (child, column, parent, parent's key)
REFERENCES = [(t, "system_id", "gxp_systems", "id") for t in _OF_SYSTEM] + [
    ("document_chunks", "document_id", "documents", "id"),
    ("test_results", "test_case_id", "test_cases", "id"),
    ("supplier_assessments", "supplier_id", "suppliers", "id"),
    ("change_actions", "change_id", "changes", "id"),
    ("evidence_refs", "finding_id", "findings", "id"),
    ("graph_edges", "source_id", "graph_nodes", "node_id"),
    ("graph_edges", "target_id", "graph_nodes", "node_id"),
    ("sessions", "user_id", "users", "id"),
]

VIOLATION = "rule_id string, severity string, system_id string, record_id string, description string"
FINDING = (
    "finding_id string, claim string, regulatory_citations array<string>, confidence_score string, evidence_ids array<string>, alcoa_score map<string,boolean>, model_attribution string"
)
