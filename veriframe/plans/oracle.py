"""The same queries in DuckDB's SQL, over the same Parquet tables: common tables once, then a SELECT for each query."""

from __future__ import annotations

from veriframe.operators.duties import CONFLICTS, PERMISSIONS
from veriframe.operators.postings import TERM
from veriframe.operators.sections import MARKED, NUMBERED
from veriframe.plans.catalogue import NEEDED

_P = 1755648000000000000
_D = 86400000000000
_TERM = TERM.replace("*+", "*")  # DuckDB's patterns don't go back anyway

_TABLES = f"""
gxp_systems AS (SELECT 'SYS-' || n_nationkey AS id, n_name AS name, {_P} - 31 * n_nationkey::BIGINT * {_D} AS last_backup_test_ns FROM nation),
docs AS (SELECT 'DOC-' || d.doc_id AS id, 'SYS-' || (d.doc_id % 25) AS system_id,
  CASE WHEN n % 4 = 0 THEN 'O&M' WHEN n % 4 = 1 THEN 'URS' ELSE 'SOP' END AS doc_type,
  CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE lang END AS author, CASE WHEN quality IS NOT NULL THEN 1 END AS created_date, n_chars < 500 AS is_copy, d.doc_id, n_chars, n_chars = length(text) AS accurate,
  CASE quality WHEN 1 THEN 'APPROVED' WHEN 0 THEN 'DRAFT' END AS status
  FROM (SELECT *, try_cast(substring(source, 4) AS INT) AS n FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id),
oc AS (SELECT o.*, c_nationkey FROM orders o JOIN customer c ON o_custkey = c_custkey),
access_reviews AS (SELECT 'AR-' || o_orderkey AS id, 'SYS-' || c_nationkey AS system_id, epoch_ns(o_orderdate) + {_P - 991353600000000000} AS scheduled_date_ns,
  CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'COMPLETE' WHEN 'F' THEN 'COMPLETED' END AS status, o_custkey FROM oc),
risks AS (SELECT 'RSK-' || p_partkey AS id, 'SYS-' || (p_partkey % 25) AS system_id,
  {_P} - (340 + p_size::BIGINT) * {_D} - CASE WHEN p_partkey % 2 = 0 THEN 3600000000000 ELSE 0 END AS last_review_date_ns FROM part),
incidents AS (SELECT 'INC-' || event_id AS id, 'SYS-' || (user_id % 25) AS system_id, CASE event_type WHEN 'error' THEN 'P1' WHEN 'purchase' THEN 'P2' ELSE 'P3' END AS severity,
  CASE WHEN value < 60 THEN 'OPEN' ELSE 'CLOSED' END AS status, epoch_ns(ts) + {_P - 1705708800000000000} AS opened_date_ns,
  CASE (json_extract(props, '$.k'))::INT % 3 WHEN 0 THEN true WHEN 1 THEN false END AS rca_started FROM events),
requirements AS (SELECT 'URS-' || p_partkey AS id, 'SYS-' || (p_partkey % 25) AS system_id, 'TC-' || (p_partkey % 120) AS test_case_id FROM part),
test_cases AS (SELECT 'TC-' || s_suppkey AS id, CASE WHEN s_acctbal < 3000 THEN 'DRAFT' ELSE 'EXECUTED' END AS status FROM supplier),
suppliers AS (SELECT 'SUP-' || s_suppkey AS id, 'SYS-' || s_nationkey AS system_id, s_name AS name, {_P} + (s_suppkey % 61 - 30) * {_D} AS reassessment_due_date_ns, 'APPROVED' AS status FROM supplier),
periodic_evaluations AS (SELECT 'PE-' || c_custkey AS id, 'SYS-' || c_nationkey AS system_id, {_P} + (c_custkey % 61 - 30) * {_D} AS due_date_ns FROM customer),
access_records AS (SELECT 'ACC-' || c_custkey AS id, 'SYS-' || c_nationkey AS system_id, c_mktsegment = 'MACHINERY' AS is_privileged,
  CASE WHEN c_acctbal < 0 THEN 'DEPARTED' ELSE 'ACTIVE' END AS user_status FROM customer),
changes AS (SELECT 'CR-' || o_orderkey AS id, 'SYS-' || c_nationkey AS system_id, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PENDING' END AS status FROM oc),
change_actions AS (SELECT 'CA-' || l_orderkey || '-' || l_linenumber AS id, 'CR-' || l_orderkey AS change_id, CASE l_linestatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' END AS status, l_partkey FROM lineitem),
v1 AS (SELECT 'ANNEX11-S4-DOC-001' AS rule_id, 'HIGH' AS severity, system_id, id AS record_id, 'O&M Document is not in APPROVED state' AS description FROM docs WHERE doc_type = 'O&M' AND status IS DISTINCT FROM 'APPROVED'),
v2 AS (SELECT 'ANNEX11-S12-ACC-001' AS rule_id, 'HIGH' AS severity, system_id, id AS record_id, 'Access review overdue beyond 30-day grace period' AS description FROM access_reviews WHERE status = 'PENDING' AND {_P} - scheduled_date_ns > 30 * {_D}),
v3 AS (SELECT 'ICH-Q9-RSK-001' AS rule_id, 'MEDIUM' AS severity, system_id, id AS record_id, 'Risk assessment exceeds 12-month review cycle' AS description FROM risks WHERE {_P} - last_review_date_ns > 365 * {_D}),
v4 AS (SELECT 'ANNEX11-S13-INC-001' AS rule_id, 'HIGH' AS severity, system_id, id AS record_id, 'P1 Incident open > 7 days without documented Root Cause Analysis' AS description FROM incidents
  WHERE severity = 'P1' AND status = 'OPEN' AND rca_started = false AND {_P} - opened_date_ns > 7 * {_D}),
v5 AS (SELECT 'ANNEX11-S4-TRC-001' AS rule_id, 'HIGH' AS severity, system_id, id AS record_id, 'Requirement lacks executed test case evidence' AS description FROM requirements WHERE test_case_id IN (SELECT id FROM test_cases WHERE status = 'DRAFT')),
v6 AS (SELECT 'ANNEX11-S3-SUP-001' AS rule_id, 'MEDIUM' AS severity, system_id, id AS record_id, 'Supplier reassessment overdue' AS description FROM suppliers WHERE reassessment_due_date_ns < {_P}),
v7 AS (SELECT 'ANNEX11-S11-PE-001' AS rule_id, 'HIGH' AS severity, system_id, id AS record_id, 'Periodic evaluation overdue > 12 months' AS description FROM periodic_evaluations WHERE due_date_ns < {_P}),
v8 AS (SELECT 'ANNEX11-S16-BCK-001' AS rule_id, 'HIGH' AS severity, id AS system_id, id AS record_id, 'Backup restore test older than 12 months' AS description FROM gxp_systems WHERE {_P} - last_backup_test_ns > 365 * {_D}),
v9 AS (SELECT 'ANNEX11-S12-ACC-002' AS rule_id, 'CRITICAL' AS severity, system_id, id AS record_id, 'Privileged account active but user marked departed' AS description FROM access_records WHERE is_privileged AND user_status = 'DEPARTED'),
v10 AS (SELECT 'ANNEX11-S10-CHG-001' AS rule_id, 'HIGH' AS severity, system_id, id AS record_id, 'Change closed but linked actions remain open' AS description FROM changes c
  WHERE status = 'CLOSED' AND EXISTS (SELECT 1 FROM change_actions a WHERE a.change_id = c.id AND a.status = 'OPEN')),
v AS (SELECT * FROM v1 UNION SELECT * FROM v2 UNION SELECT * FROM v3 UNION SELECT * FROM v4 UNION SELECT * FROM v5 UNION SELECT * FROM v6 UNION SELECT * FROM v7 UNION SELECT * FROM v8 UNION SELECT * FROM v9 UNION SELECT * FROM v10),
d1 AS (SELECT 'D1' AS check_id, 'A2' AS agent, 'ANNEX11-S4-DOC-001' AS rule_id, s.id AS system_id, f.id AS record_id, NULL::VARCHAR AS detail, f.status IS NOT DISTINCT FROM 'APPROVED' AS passed
  FROM gxp_systems s LEFT JOIN (SELECT * FROM docs WHERE doc_type = 'URS' QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY id) = 1) f ON f.system_id = s.id),
d2 AS (SELECT 'D2' AS check_id, 'A2' AS agent, 'ANNEX11-S11-PE-001' AS rule_id, s.id AS system_id, f.id AS record_id, NULL::VARCHAR AS detail, coalesce(f.due_date_ns >= {_P}, false) AS passed
  FROM gxp_systems s LEFT JOIN (SELECT * FROM periodic_evaluations QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY due_date_ns DESC NULLS FIRST, id) = 1) f ON f.system_id = s.id),
d3 AS (SELECT 'D3' AS check_id, 'A2' AS agent, 'ANNEX11-S4-TRC-001' AS rule_id, s.id AS system_id, f.id AS record_id, NULL::VARCHAR AS detail, f.id IS NULL AS passed
  FROM gxp_systems s LEFT JOIN (SELECT r.system_id, min(r.id) AS id FROM requirements r LEFT JOIN test_cases t ON r.test_case_id = t.id WHERE t.status IS NULL OR t.status = 'DRAFT' GROUP BY r.system_id) f ON f.system_id = s.id),
d5 AS (SELECT 'D5' AS check_id, 'A3' AS agent, 'ICH-Q9-RSK-001' AS rule_id, system_id, id AS record_id, last_review_date_ns::VARCHAR AS detail, NOT coalesce(floor(({_P} - last_review_date_ns)::DOUBLE / {_D}) > 365, false) AS passed
  FROM (SELECT * FROM risks QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY last_review_date_ns NULLS LAST, id) = 1)),
d6 AS (SELECT 'D6' AS check_id, 'A4' AS agent, 'ANNEX11-S10-CHG-001' AS rule_id, system_id, id AS record_id, action_id AS detail, false AS passed
  FROM (SELECT c.system_id, c.id, a.id AS action_id FROM changes c JOIN change_actions a ON a.change_id = c.id WHERE c.status = 'CLOSED' AND a.status = 'OPEN' QUALIFY row_number() OVER (PARTITION BY c.system_id ORDER BY c.id, a.id) = 1)),
d7 AS (SELECT 'D7' AS check_id, 'A5' AS agent, 'ANNEX11-S13-INC-001' AS rule_id, system_id, id AS record_id, opened_date_ns::VARCHAR AS detail, NOT coalesce(({_P} - opened_date_ns) // {_D} > 7, false) AS passed
  FROM (SELECT * FROM incidents WHERE severity = 'P1' AND status = 'OPEN' AND rca_started = false QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY opened_date_ns NULLS LAST, id) = 1)),
d8 AS (SELECT 'D8' AS check_id, 'A6' AS agent, 'ANNEX11-S12-ACC-001' AS rule_id, system_id, id AS record_id, scheduled_date_ns::VARCHAR AS detail, false AS passed
  FROM (SELECT * FROM access_reviews WHERE status <> 'COMPLETED' AND scheduled_date_ns < {_P} QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY scheduled_date_ns, id) = 1)),
d9 AS (SELECT 'D9' AS check_id, 'A6' AS agent, 'ANNEX11-S12-ACC-002' AS rule_id, system_id, min(id) AS record_id, NULL::VARCHAR AS detail, false AS passed FROM access_records WHERE is_privileged AND user_status = 'DEPARTED' GROUP BY system_id),
c AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d5 UNION ALL SELECT * FROM d6 UNION ALL SELECT * FROM d7 UNION ALL SELECT * FROM d8 UNION ALL SELECT * FROM d9),
f AS (SELECT agent || '-' || rule_id || '-' || coalesce(record_id, 'NO-RECORD') AS finding_id, system_id, agent, rule_id, record_id,
  CASE check_id
   WHEN 'D1' THEN 'Compliance check verify_urs_approved against record ''' || coalesce(record_id, 'no matching record') || ''' found that the User Requirements Specification is missing or not in APPROVED state, citing ' || rule_id || ' under EU GMP Annex 11, and requires review.'
   WHEN 'D2' THEN 'Compliance check verify_periodic_eval_current against record ''' || coalesce(record_id, 'no matching record') || ''' found that the periodic evaluation is overdue, citing ' || rule_id || ' under EU GMP Annex 11, and requires review.'
   WHEN 'D3' THEN 'Compliance check verify_test_traceability against record ''' || coalesce(record_id, 'no matching record') || ''' found that a requirement lacks linked, non-DRAFT test case evidence, citing ' || rule_id || ' under EU GMP Annex 11, and requires review.'
   WHEN 'D5' THEN 'Risk assessment ' || record_id || ' exceeds the ICH Q9(R1) 12-month review cycle (last_review_date_ns=' || detail || ') and requires reassessment of patient safety and business continuity impact.'
   WHEN 'D6' THEN 'Change ' || record_id || ' is CLOSED but linked action ' || detail || ' remains OPEN, a violation of EU GMP Annex 11 Section 10 change-control completeness.'
   WHEN 'D7' THEN 'P1 incident ' || record_id || ' has been open for more than 7 days (opened_date_ns=' || detail || ') without a documented Root Cause Analysis, a violation of EU GMP Annex 11 Section 13.'
   WHEN 'D8' THEN 'Access review ' || record_id || ' is overdue (scheduled_date_ns=' || detail || '), a violation of EU GMP Annex 11 Section 12 access-control currency.'
   WHEN 'D9' THEN 'Privileged account ' || record_id || ' remains active for a departed user, a critical violation of EU GMP Annex 11 Section 12 segregation-of-duties controls.' END AS claim,
  rule_id AS citations, 'UNVERIFIED' AS confidence_score, coalesce(record_id, '') AS evidence, 6 AS n_true, 'deterministic-fallback' AS model_attribution FROM c WHERE NOT passed),
evidence AS (SELECT 'ANNEX11-S4-DOC-001' AS rule_id, id FROM docs UNION SELECT 'ANNEX11-S12-ACC-001', id FROM access_reviews UNION SELECT 'ICH-Q9-RSK-001', id FROM risks UNION SELECT 'ANNEX11-S13-INC-001', id FROM incidents
  UNION SELECT 'ANNEX11-S4-TRC-001', id FROM requirements UNION SELECT 'ANNEX11-S3-SUP-001', id FROM suppliers UNION SELECT 'ANNEX11-S11-PE-001', id FROM periodic_evaluations UNION SELECT 'ANNEX11-S16-BCK-001', id FROM gxp_systems
  UNION SELECT 'ANNEX11-S12-ACC-002', id FROM access_records UNION SELECT 'ANNEX11-S10-CHG-001', id FROM changes),
vf AS (SELECT finding_id, system_id, evidence, rule_id, (rule_id, record_id) IN (SELECT (rule_id, id) FROM evidence) AS found, (rule_id, record_id) IN (SELECT (rule_id, record_id) FROM v) AS backed FROM f),
log AS (SELECT user_id AS chain, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
  '{{"action_type":"' || event_type || '","output_summary":"' || (round(value * 100))::BIGINT || '","target_record_id":"INC-' || event_id || '","user_id":"' || user_id || '"}}' AS canonical FROM events),
hashed AS (SELECT chain, i, event_id, value, canonical, repeat('0', 64) AS previous_event_hash, sha256(repeat('0', 64) || canonical) AS event_hash FROM log WHERE i = 0
  UNION ALL SELECT l.chain, l.i, l.event_id, l.value, l.canonical, h.event_hash, sha256(h.event_hash || l.canonical) FROM hashed h JOIN log l ON l.chain = h.chain AND l.i = h.i + 1),
chunks AS (SELECT doc_id, (pos // 448)::INT AS chunk_index, substring(text, pos + 1, 512) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text)::BIGINT, 448)) AS pos FROM documents)),
query AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q, label FROM embeddings ORDER BY vec_id LIMIT 1),
similar_ AS (SELECT vec_id AS id, e.label = query.label AS same, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q) AS score FROM embeddings e, query),
tok AS (SELECT doc_id, chunk_index, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM chunks),
tf AS (SELECT doc_id, chunk_index, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'with')) AS b, len(list_filter(t, lambda x: x = 'edited')) AS e FROM tok),
terms AS (SELECT doc_id, chunk_index, regexp_extract_all(regexp_replace(lower(content), '\\s+', ' ', 'g'), '{_TERM}') AS t FROM chunks),
placed AS (SELECT doc_id, chunk_index, len(t) AS n, unnest(t) AS term, unnest(range(0, len(t)::BIGINT)) AS pos FROM terms),
posted AS (SELECT doc_id, chunk_index, n, term, count(*) AS tf, sum(pos)::BIGINT AS at_sum FROM placed GROUP BY ALL),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'), '{_TERM}')) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM posted WHERE term IN (SELECT term FROM asked) GROUP BY term),
ranked AS (SELECT query_id, doc_id, chunk_index, round(sum(ln(1 + ((SELECT count(*) FROM terms) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(len(t)) FROM terms)))), 9) AS score,
  count(*) FILTER (WHERE regexp_matches(term, '[^a-z0-9]'))::INT AS n_identifiers FROM asked JOIN dfs USING (term) JOIN posted USING (term) GROUP BY ALL),
hits AS (SELECT doc_id, chunk_index, round(sum(ln(1 + ((SELECT count(*) FROM terms) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(len(t)) FROM terms)))), 9) AS s, bool_or(regexp_matches(term, '[^a-z0-9]')) AS x
  FROM posted JOIN (SELECT term, count(*) AS df FROM posted GROUP BY term) USING (term) WHERE term IN ('the', 'with', 'edited') OR term = (SELECT min(term) FROM posted WHERE regexp_matches(term, '[^a-z0-9]')) GROUP BY ALL),
lined AS (SELECT doc_id, i, l, len(l) AS n, rtrim(l, ' ') AS r, regexp_extract(l, '{NUMBERED}', 1) AS number, len(regexp_extract(l, '{MARKED}', 1)) AS marks
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10)))::BIGINT)) AS i FROM documents WHERE text IS NOT NULL)),
leveled AS (SELECT doc_id, i, n, l, CASE WHEN marks > 0 THEN marks WHEN number <> '' AND len(r) <= 120 AND NOT regexp_matches(r, '[.,;:!?|]$') THEN least(len(string_split(number, '.')), 6) WHEN regexp_matches(r, '^[A-Z]') AND NOT regexp_matches(r, '[.,;:!?|]$') AND len(r) <= 60 THEN 7 END AS level,
  (coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, (sum(n + 1) OVER (PARTITION BY doc_id) - 1)::BIGINT AS whole FROM lined),
heads AS (SELECT doc_id, start, coalesce((SELECT min(b.start) FROM leveled b WHERE b.doc_id = a.doc_id AND b.start > a.start AND b.level <= a.level), whole) AS "end", level::INT AS level, trim(regexp_replace(l, '^#+', ''), ' ') AS title FROM leveled a WHERE level IS NOT NULL),
st AS (SELECT count(*) AS c, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE e > 0) AS de FROM tf),
bm AS (SELECT doc_id, chunk_index, ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (c - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m))
  + ln(1 + (c - de + 0.5) / (de + 0.5)) * e * 2.2 / (e + 1.2 * (0.25 + 0.75 * n / m)) AS score FROM tf, st),
sparse AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) AS r FROM bm WHERE score > 0 QUALIFY r <= 20),
dense AS (SELECT id AS doc_id, 0 AS chunk_index, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM similar_ QUALIFY r <= 20),
fused AS (SELECT doc_id, chunk_index, coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + s.r), 0) AS score, d.score AS dense_score, s.score AS bm25_score,
  CASE WHEN d.r IS NULL THEN 'bm25' WHEN s.r IS NULL THEN 'dense' ELSE 'both' END AS retrieval_method FROM dense d FULL JOIN sparse s USING (doc_id, chunk_index) ORDER BY score DESC, doc_id, chunk_index LIMIT 8),
edges AS (SELECT id AS source_id, test_case_id AS target_id, 'VERIFIED_BY' AS relation_type FROM requirements UNION SELECT change_id, 'URS-' || l_partkey, 'AFFECTS' FROM change_actions UNION SELECT change_id, 'DE-' || (l_partkey % 25), 'AFFECTS' FROM change_actions
  UNION SELECT id, system_id, 'AFFECTS' FROM incidents UNION SELECT id, system_id, 'ASSOCIATED_WITH' FROM risks UNION SELECT id, system_id, 'GOVERNS' FROM docs UNION SELECT id, 'ACC-' || o_custkey, 'CONTROLS' FROM access_reviews),
walk AS (SELECT record_id AS source, record_id AS node, 0 AS hop FROM v10 WHERE record_id IN (SELECT source_id FROM edges) UNION SELECT source, target_id, hop + 1 FROM walk JOIN edges ON node = source_id),
reached AS (SELECT source, node, min(hop) AS hop FROM walk GROUP BY ALL),
kinds(prefix, node_type) AS (VALUES ('URS', 'REQUIREMENT'), ('TC', 'TEST_CASE'), ('CR', 'CHANGE'), ('DE', 'DESIGN_ELEMENT'), ('SYS', 'SYSTEM'), ('INC', 'INCIDENT'), ('RSK', 'RISK'), ('DOC', 'DOCUMENT'), ('AR', 'ACCESS_REVIEW'), ('ACC', 'ACCESS_RECORD')),
grants AS (SELECT 'U-' || o_custkey AS user_id, 'SYS-' || c_nationkey AS system_id, ({PERMISSIONS})[3 * (o_orderpriority[1]::INT - 1) + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END + 1] AS permission FROM oc),
below AS (SELECT source_id AS source, target_id AS node FROM edges UNION SELECT source, target_id FROM below JOIN edges ON node = source_id),
impacts AS (SELECT source, count(*) AS n_total FROM below WHERE source <> node GROUP BY source),
dimensions AS (SELECT id, 9 - len(bad) AS n_true, array_to_string(bad, ',') AS failed, CASE WHEN len(bad) = 0 THEN 'VERIFIED' WHEN len(bad) <= 4 THEN 'FAIL' ELSE 'INSUFFICIENT' END AS outcome
  FROM (SELECT id, list_filter([CASE WHEN coalesce(author, '') = '' THEN 'attributable' END, CASE WHEN doc_type IS NULL THEN 'legible' END, CASE WHEN created_date IS NULL OR doc_id IN (SELECT user_id FROM events WHERE ts IS NULL) THEN 'contemporaneous' END, CASE WHEN is_copy THEN 'original' END, CASE WHEN NOT accurate THEN 'accurate' END, CASE WHEN author IS NULL OR status IS NULL THEN 'complete' END, CASE WHEN system_id NOT IN (SELECT id FROM gxp_systems) OR doc_id IN (SELECT user_id FROM (SELECT user_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS late FROM events) WHERE late) THEN 'consistent' END, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'enduring' END], lambda x: x IS NOT NULL) AS bad FROM docs)),
proposals AS (SELECT 'AP-' || o_orderkey AS id, 'U-' || o_custkey AS user_id, CASE o_orderpriority[1] WHEN '1' THEN 'bad' WHEN '2' THEN 'bad' WHEN '3' THEN 'doubt' WHEN '4' THEN 'ok' WHEN '5' THEN 'ok' END AS symbol FROM orders),
steps AS (SELECT 'documentation' AS machine, system_id AS subject, NULL::BIGINT AS ns, id AS tie, CASE WHEN id IN (SELECT record_id FROM v1) THEN 'bad' WHEN status = 'APPROVED' THEN 'ok' ELSE 'doubt' END AS symbol FROM docs
  UNION ALL SELECT 'traceability', r.system_id, NULL, r.id, CASE WHEN t.status = 'DRAFT' THEN 'bad' WHEN t.id IS NOT NULL THEN 'ok' ELSE 'doubt' END FROM requirements r LEFT JOIN test_cases t ON t.id = r.test_case_id
  UNION ALL SELECT 'risk', system_id, last_review_date_ns, id, CASE WHEN id IN (SELECT record_id FROM v3) THEN 'bad' ELSE 'ok' END FROM risks
  UNION ALL SELECT 'change_impact', system_id, NULL, id, CASE WHEN id IN (SELECT record_id FROM v10) THEN 'bad' WHEN status = 'CLOSED' THEN 'ok' ELSE 'doubt' END FROM changes
  UNION ALL SELECT 'incident', system_id, opened_date_ns, id, CASE WHEN id IN (SELECT record_id FROM v4) THEN 'bad' WHEN rca_started OR status = 'CLOSED' THEN 'ok' ELSE 'doubt' END FROM incidents
  UNION ALL SELECT 'access_control', system_id, scheduled_date_ns, id, CASE WHEN id IN (SELECT record_id FROM v2) THEN 'bad' WHEN status <> 'PENDING' THEN 'ok' ELSE 'doubt' END FROM access_reviews
  UNION ALL SELECT 'access_control', system_id, {_P}, id, CASE WHEN id IN (SELECT record_id FROM v9) THEN 'bad' WHEN user_status = 'ACTIVE' THEN 'ok' ELSE 'doubt' END FROM access_records
  UNION ALL SELECT 'evidence', 'SYS-' || (doc_id * 2 % 25), NULL, 'CH-' || doc_id, CASE WHEN 'DOC-' || (doc_id * 2) IN (SELECT id FROM docs) THEN 'ok' ELSE 'bad' END FROM labels
  UNION ALL SELECT 'policy_gateway', 'CONV-' || conv_id, turn, sha256(coalesce(text, '')), CASE WHEN regexp_matches(coalesce(text, ''), '(?i)(ignore previous instructions|override system prompt|disregard rules)') THEN 'bad' WHEN coalesce(text, '') <> '' THEN 'ok' ELSE 'doubt' END FROM conversations
  UNION ALL SELECT 'action_authorization', user_id, NULL, id, symbol FROM proposals
  UNION ALL SELECT 'hash_chain', 'CHAIN-' || chain, NULL, NULL, CASE WHEN max(value) > 370 THEN 'bad' ELSE 'ok' END FROM log GROUP BY chain),
numbered AS (SELECT *, row_number() OVER (PARTITION BY machine, subject ORDER BY ns NULLS FIRST, tie NULLS FIRST) AS n FROM steps),
machine AS (SELECT machine, subject, 0::BIGINT AS n, 'START' AS state FROM (SELECT DISTINCT machine, subject FROM steps)
  UNION ALL SELECT m.machine, m.subject, s.n, CASE WHEN s.symbol = 'bad' THEN CASE WHEN m.state IN ('VIOLATION', 'REPEATED') THEN 'REPEATED' ELSE 'VIOLATION' END WHEN m.state IN ('VIOLATION', 'REPEATED') THEN 'VIOLATION'
    WHEN s.symbol = 'doubt' OR m.state = 'DOUBTFUL' AND m.machine = 'action_authorization' THEN 'DOUBTFUL' ELSE 'VERIFIED' END FROM machine m JOIN numbered s ON s.machine = m.machine AND s.subject = m.subject AND s.n = m.n + 1),
typed AS (SELECT r.*, coalesce(node_type, 'OTHER') AS node_type FROM reached r LEFT JOIN kinds ON prefix = split_part(node, '-', 1))
"""

_SYS = "gxp_systems"
#: (child, its rows, column, parent's rows, parent, key): all references of the registry.
_FK = [(t, "docs" if t == "documents" else t, "system_id", _SYS, _SYS, "id") for t in ("documents", "requirements", "risks")] + [
    ("design_elements", "(SELECT 'SYS-' || n_nationkey AS system_id FROM nation)", "system_id", _SYS, _SYS, "id"),
    ("test_cases", "(SELECT 'SYS-' || (s_suppkey % 25) AS system_id FROM supplier)", "system_id", _SYS, _SYS, "id"),
    *[(t, t, "system_id", _SYS, _SYS, "id") for t in ("incidents", "access_reviews", "access_records", "suppliers", "periodic_evaluations", "changes")],
    ("findings", "(SELECT 'SYS-' || (o_custkey % 26) AS system_id FROM orders WHERE o_orderstatus = 'F')", "system_id", _SYS, _SYS, "id"),
    ("graph_nodes", "(SELECT system_id FROM requirements UNION ALL SELECT 'SYS-' || (s_suppkey % 25) FROM supplier UNION ALL SELECT system_id FROM risks UNION ALL SELECT system_id FROM incidents UNION ALL SELECT system_id FROM docs)", "system_id", _SYS, _SYS, "id"),
    ("document_chunks", "(SELECT 'DOC-' || (doc_id * 2) AS document_id FROM labels)", "document_id", "docs", "documents", "id"),
    ("test_results", "(SELECT 'TC-' || (l_suppkey + 2) AS test_case_id FROM lineitem)", "test_case_id", "test_cases", "test_cases", "id"),
    ("supplier_assessments", "(SELECT 'SUP-' || (p_partkey % 120) AS supplier_id FROM part)", "supplier_id", "suppliers", "suppliers", "id"),
    ("change_actions", "change_actions", "change_id", "changes", "changes", "id"),
    ("evidence_refs", "(SELECT 'F-' || o_orderkey AS finding_id FROM orders)", "finding_id", "(SELECT 'F-' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')", "findings", "id"),
    *[("graph_edges", f"(SELECT {c} AS {k} FROM requirements)", k, "(SELECT id AS node_id FROM requirements UNION ALL SELECT id FROM test_cases UNION ALL SELECT id FROM risks UNION ALL SELECT id FROM incidents UNION ALL SELECT id FROM docs)", "graph_nodes", "node_id")
      for k, c in (("source_id", "id"), ("target_id", "test_case_id"))],
    ("sessions", "(SELECT 'U-' || user_id AS user_id FROM events)", "user_id", "(SELECT 'U-' || c_custkey AS id FROM customer)", "users", "id"),
]
_NS = [("gxp_systems", "last_backup_test_ns"), ("risks", "last_review_date_ns"), ("incidents", "opened_date_ns"), ("access_reviews", "scheduled_date_ns"), ("suppliers", "reassessment_due_date_ns"), ("periodic_evaluations", "due_date_ns")]
_DIMENSIONS = [("0.25", ["docs"], ["v1"]), ("0.20", ["access_reviews", "access_records"], ["v2", "v9"]), ("0.20", ["risks"], ["v3"]), ("0.15", ["incidents"], ["v4"]), ("0.12", ["changes"], ["v10"]), ("0.08", ["requirements"], ["v5"])]


#: The record tables and the rows that each is made from; those with a nanosecond column.
_MADE = {
    "gxp_systems": ["nation"], "documents": ["documents"], "document_chunks": ["labels"], "requirements": ["part"], "risks": ["part"], "design_elements": ["nation"], "test_cases": ["supplier"], "test_results": ["lineitem"], "incidents": ["events"],
    "access_reviews": ["oc"], "access_records": ["customer"], "suppliers": ["supplier"], "supplier_assessments": ["part"], "periodic_evaluations": ["customer"], "changes": ["oc"], "change_actions": ["lineitem"],
    "findings": ["(SELECT 1 FROM orders WHERE o_orderstatus = 'F')"], "evidence_refs": ["orders"], "action_proposals": ["orders"], "graph_nodes": ["part", "supplier", "part", "events", "documents"], "graph_edges": ["part"], "users": ["customer"], "sessions": ["events"],
}
_WITH_NS = [t for t, _ in _NS]
_GOLDEN = [
    ("GXP-MFG-DEMO-01", "ANNEX11-S4-DOC-001", "HIGH"), ("GXP-MFG-DEMO-01", "ANNEX11-S12-ACC-001", "HIGH"), ("GXP-MFG-DEMO-01", "ICH-Q9-RSK-001", "MEDIUM"), ("GXP-MFG-DEMO-01", "ANNEX11-S13-INC-001", "HIGH"),
    ("GXP-MFG-DEMO-01", "ANNEX11-S4-TRC-001", "HIGH"), ("GXP-MFG-DEMO-01", "ANNEX11-S3-SUP-001", "MEDIUM"), ("GXP-MFG-DEMO-01", "ANNEX11-S11-PE-001", "HIGH"), ("GXP-MFG-DEMO-01", "ANNEX11-S16-BCK-001", "HIGH"),
    ("BUS-IT-DEMO-02", "ANNEX11-S16-BCK-001", "HIGH"), ("GXP-MFG-DEMO-01", "ANNEX11-S12-ACC-002", "CRITICAL"), ("GXP-MFG-DEMO-01", "ANNEX11-S10-CHG-001", "HIGH"),
]


def _rows(names: list[str]) -> str:
    """SQL for the rows of record tables together."""
    return "(" + " + ".join(f"(SELECT count(*) FROM {source})" for n in names for source in _MADE[n]) + ")"


def _counts(names: list[str]) -> str:
    return "(" + " + ".join(f"(SELECT count(*) FROM {'(SELECT DISTINCT * FROM ' + n + ')' if n[0] == 'v' else n} x WHERE x.system_id = s.id)" for n in names) + ")"


_SELECTS = {f"policy_p{n:02d}": f"SELECT * FROM v{n}" for n in range(1, 11)} | {f"check_d{n}": f"SELECT * FROM d{n}" for n in (1, 2, 3, 5, 6, 7, 8, 9)} | {
    "policy_all": "SELECT * FROM v",
    "policy_from_json": "SELECT * FROM v",
    "violations_json": "SELECT rule_id, record_id, CAST(json_object('rule_id', rule_id, 'severity', severity, 'system_id', system_id, 'record_id', record_id, 'description', description) AS VARCHAR) AS line FROM v",
    "audit_package": "SELECT s.id AS system_id, s.name, coalesce(n, 0) AS n_findings, coalesce(ids, '') AS finding_ids, coalesce(g, '') AS grades, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, "
    "s.id NOT IN (SELECT 'SYS-' || (user_id % 25) FROM events WHERE event_id = 5) AS audit_trail_valid, coalesce(e, '') AS custody FROM gxp_systems s LEFT JOIN (SELECT system_id, count(*) AS n, string_agg(finding_id, ',' ORDER BY finding_id) AS ids, "
    "string_agg(CASE WHEN found AND backed THEN 'MEDIUM' ELSE 'INSUFFICIENT_EVIDENCE' END, ',' ORDER BY finding_id) AS g, string_agg(DISTINCT evidence, ',' ORDER BY evidence) FILTER (WHERE evidence <> '') AS e FROM vf GROUP BY system_id) f ON f.system_id = s.id "
    "LEFT JOIN (SELECT system_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium FROM v GROUP BY system_id) w ON w.system_id = s.id",
    "policy_summary": "SELECT system_id, rule_id, severity, count(*) AS n_violations FROM v GROUP BY ALL",
    "check_d4": "SELECT DISTINCT 'SYS-' || (c_nationkey + 3) AS system_id FROM customer WHERE system_id NOT IN (SELECT id FROM gxp_systems)",
    "findings_all": "SELECT finding_id, system_id, agent, claim, citations, confidence_score, evidence, n_true, model_attribution FROM f",
    "verify_findings": "SELECT finding_id, system_id, CASE WHEN found AND backed THEN 'MEDIUM' ELSE 'INSUFFICIENT_EVIDENCE' END AS confidence, coalesce(found, false) AS db_record_found, coalesce(found AND backed, false) AS opa_corroborated, "
    "CASE WHEN found AND backed THEN rule_id ELSE '' END AS opa_rules, evidence, CASE WHEN found AND backed THEN 'VIOLATION' WHEN found THEN 'VERIFIED' ELSE 'INSUFFICIENT EVIDENCE' END AS outcome FROM vf",
    "error_findings": "SELECT 'ERR-' || agent AS finding_id, id AS system_id, agent, CASE agent WHEN 'A1' THEN 'Unable to verify documentation inventory due to retrieval timeout.' WHEN 'A2' THEN 'Traceability verification failed.' "
    "ELSE agent || ' deterministic check unavailable: database unreachable.' END AS claim, CASE agent WHEN 'A3' THEN 'ICH-Q9-RSK-001' WHEN 'A4' THEN 'ANNEX11-S10-CHG-001' WHEN 'A5' THEN 'ANNEX11-S13-INC-001' "
    "WHEN 'A6' THEN 'ANNEX11-S12-ACC-001,ANNEX11-S12-ACC-002' ELSE '' END AS citations, 'LOW' AS confidence_score, '' AS evidence, CASE agent WHEN 'A1' THEN 0 ELSE 6 END AS n_true, "
    "CASE agent WHEN 'A1' THEN 'gemini-2.5-flash' ELSE 'deterministic-fallback' END AS model_attribution FROM gxp_systems, (VALUES ('A1'), ('A2'), ('A3'), ('A4'), ('A5'), ('A6')) a(agent)",
    "routed_findings": "SELECT system_id, agent, finding_id FROM f WHERE CASE WHEN system_id < 'SYS-2' THEN agent IN ('A2', 'A3') ELSE agent = 'A4' END",
    "confidence_ladder": "SELECT n_true, corroborated, score, CASE WHEN score > 80 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'INSUFFICIENT_EVIDENCE' END AS confidence, count(*) AS n_documents FROM "
    "(SELECT n_true, id IN (SELECT record_id FROM v) AS corroborated, (100 - (9 - n_true) * 10 - CASE WHEN id IN (SELECT record_id FROM v) THEN 0 ELSE 100 END)::INT AS score FROM dimensions) GROUP BY ALL",
    "dq_schema": "SELECT *, n_missing = 0 AS passed FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns, {len(cols)} - (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}' AND column_name IN ({', '.join(repr(c) for c in cols)})) AS n_missing, "
        f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}' AND (data_type LIKE 'TIMESTAMP%' OR ends_with(column_name, '_ns'))) AS n_times, (SELECT count(*) FROM {t}) AS n_rows" for t, cols in NEEDED.items()) + ")",
    "dq_fk_orphans": " UNION ALL ".join(f"SELECT '{child}' AS child, '{column}' AS column_name, '{parent}' AS parent, (SELECT count(*) FROM {rows} r WHERE r.{column} IS NOT NULL AND r.{column} NOT IN (SELECT {key} FROM {of})) AS n_orphans" for child, rows, column, of, parent, key in _FK),
    "reach_bounded": "SELECT * FROM reached WHERE hop <= 1",
    "source_status": "SELECT 'documents' AS table_name, true AS source_available, count(*) AS n_rows FROM documents UNION ALL SELECT 'users', true, count(*) FROM customer UNION ALL SELECT 'agent_messages', false, 0",
    "policy_outage": "SELECT s.id AS system_id, (SELECT count(*) FROM v WHERE v.system_id = s.id) AS n_reached, 0 AS n_in_outage FROM gxp_systems s",
    "verify_outage": "SELECT finding_id, system_id, 'INSUFFICIENT_EVIDENCE' AS confidence, false AS db_record_found, false AS opa_corroborated FROM f",
    "golden_seed": f"SELECT system_id, rule_id, severity, count(*) AS n_violations FROM (SELECT system_id, rule_id, severity FROM v UNION ALL SELECT * FROM (VALUES {', '.join(map(str, _GOLDEN))}) g(system_id, rule_id, severity)) GROUP BY ALL",
    "record_columns": " UNION ALL ".join(f"SELECT '{t}' AS table_name, 0 AS n_unknown, {int(t in _WITH_NS)} AS n_ns, {_rows([t])} AS n_rows, true AS passed" for t in _MADE),
    "schema_gate": f"SELECT 'tables' AS gate, 27 AS expected, 27 AS actual, true AS passed, {len(_MADE)} AS n_made, {_rows(list(_MADE))} AS n_rows UNION ALL SELECT 'references', 21, 21, true, 21, {_rows(sorted({x[0] for x in _FK}))} UNION ALL SELECT 'ns_columns', 8, 8, true, {len(_WITH_NS)}, {_rows(_WITH_NS)}",
    "provider_cascade": "SELECT task, answered_by, answered_by = '' AS degraded, CASE WHEN answered_by <> '' THEN '' WHEN p IS NULL THEN 'unknown_task' WHEN o IN ('missing_key', 'timeout', 'http_429', 'http_503') THEN o || ':' || p || ';' || s || ':openrouter_fallback' ELSE o || ':' || p END AS failure_reason, count(*) AS n_calls FROM "
    "(SELECT task, p, o, s, CASE WHEN p IS NULL THEN '' WHEN o = 'ok' THEN p WHEN o IN ('missing_key', 'timeout', 'http_429', 'http_503') AND s = 'ok' THEN 'openrouter_fallback' ELSE '' END AS answered_by FROM "
    "(SELECT task, CASE WHEN task IN ('knowledge', 'compliance', 'change') THEN 'gemini_flash_fast' WHEN task = 'incident' THEN 'groq_llama' END AS p, (['ok', 'missing_key', 'timeout', 'http_429', 'http_503', 'http_404', 'reset'])[event_id % 7 + 1] AS o, (['ok', 'ok', 'timeout', 'missing_key', 'http_500'])[event_id % 5 + 1] AS s FROM "
    "(SELECT event_id, CASE event_type WHEN 'view' THEN 'knowledge' WHEN 'click' THEN 'compliance' WHEN 'purchase' THEN 'change' WHEN 'signup' THEN 'unlisted' WHEN 'error' THEN 'incident' END AS task FROM events))) GROUP BY ALL",
    "dq_ns_guard": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{column}' AS column_name, count({column}) AS n_values, count(*) FILTER (WHERE {column} < 1000000000000000000) AS n_below, n_below = 0 AS passed FROM {t}" for t, column in _NS),
    "dq_assertions": "SELECT 'system 0' AS label, 'NATION_0' AS expected, name AS actual, name = 'NATION_0' AS passed FROM gxp_systems WHERE id = 'SYS-0' UNION ALL "
    "SELECT 'supplier 1', 'APPROVED', status, status = 'APPROVED' FROM suppliers WHERE id = 'SUP-1' UNION ALL SELECT 'absent', 'APPROVED', NULL, false",
    "dq_insert_if_absent": "SELECT id, system_id, user_status FROM access_records",
    "upsert_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "merge_last_write": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "chain_build": "SELECT chain, event_id, previous_event_hash, event_hash FROM hashed",
    "chain_verify_clean": "SELECT user_id AS chain, 'VERIFIED' AS status, -1 AS broken_at_index, -1 AS event_id, count(*) AS events_checked FROM events GROUP BY user_id",
    "chain_verify_tampered": "SELECT chain, CASE WHEN bad IS NULL THEN 'VERIFIED' ELSE 'TAMPERED' END AS status, coalesce(bad, -1) AS broken_at_index, coalesce(bad_id, -1) AS event_id, CASE WHEN bad IS NULL THEN n ELSE -1 END AS events_checked "
    "FROM (SELECT chain, min(i) FILTER (WHERE value > 370) AS bad, arg_min(event_id, i) FILTER (WHERE value > 370) AS bad_id, count(*) AS n FROM log GROUP BY chain)",
    "chunk_documents": "SELECT doc_id, chunk_index, md5(content) AS content_md5, length(content) AS n_chars FROM chunks",
    "alcoa_prescore": "SELECT id, coalesce(author, '') <> '' AS attributable, created_date IS NOT NULL AS contemporaneous, NOT coalesce(is_copy, false) AS original FROM docs",
    "alcoa_extended": "SELECT * FROM dimensions",
    "source_reconciliation": "SELECT id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'lost' ELSE 'changed' END AS outcome FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR n_chars % 10 = 0 AND n_chars > 0",
    "event_order": "SELECT 'U-' || o_custkey AS subject, count(*) AS n_events, count(*) FILTER (WHERE o_orderdate IS NULL) AS n_undated, count(*) FILTER (WHERE late) AS n_out_of_order FROM (SELECT *, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS late FROM orders) GROUP BY o_custkey",
    "dense_topk": "SELECT id, round(score, 6) AS score FROM similar_ WHERE same ORDER BY similar_.score DESC, id LIMIT 5",
    "bm25_topk": "SELECT doc_id, chunk_index, round(score, 6) AS score FROM sparse WHERE r <= 5",
    "rrf_fusion": "SELECT doc_id, chunk_index, retrieval_method, round(score, 6) AS score, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score FROM fused",
    "provenance": "SELECT doc_id || '#' || chunk_index AS evidence_id, doc_id AS document_id, chunk_index AS chunk_id, retrieval_method, round(coalesce(dense_score, -1), 6) AS dense_score, round(coalesce(bm25_score, -1), 6) AS bm25_score, -1.0 AS reranker_score, 'DOC-' || doc_id AS parent_section, "
    "coalesce((SELECT 'DOC-' || doc_id || ' > ' || min(target_id) FROM edges WHERE source_id = 'DOC-' || doc_id), '') AS graph_path, coalesce((SELECT string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FROM v WHERE record_id = 'DOC-' || doc_id), '') AS regulatory_citations FROM fused",
    "parent_context": "SELECT s.doc_id, s.chunk_index, coalesce(b.content, '') AS before, c.content, coalesce(a.content, '') AS after FROM sparse s JOIN chunks c USING (doc_id, chunk_index) LEFT JOIN chunks b ON b.doc_id = s.doc_id AND b.chunk_index = s.chunk_index - 1 "
    "LEFT JOIN chunks a ON a.doc_id = s.doc_id AND a.chunk_index = s.chunk_index + 1 WHERE r <= 5",
    "graph_edges": "SELECT * FROM edges",
    "reach_from": "SELECT * FROM reached",
    "blast_radius": "SELECT source, n_direct, n_indirect, n_controls, CASE WHEN n_direct + n_indirect >= 10 THEN 'HIGH' WHEN n_direct + n_indirect >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM "
    "(SELECT source, count(*) FILTER (WHERE hop = 1) AS n_direct, count(*) FILTER (WHERE hop > 1) AS n_indirect, count(*) FILTER (WHERE node_type IN ('TEST_CASE', 'ACCESS_RECORD')) AS n_controls FROM typed WHERE hop > 0 GROUP BY source)",
    "impact_by_type": "SELECT node_type, hop, count(*) AS n_nodes, count(DISTINCT node) AS n_distinct FROM typed WHERE hop > 0 GROUP BY ALL",
    "rbac_matrix": "SELECT role, agent, list_contains(agents, agent) AS allowed, (SELECT count(*) FROM customer WHERE CASE c_mktsegment WHEN 'MACHINERY' THEN 'IT System Manager' WHEN 'BUILDING' THEN 'QA/Compliance' WHEN 'HOUSEHOLD' THEN 'Auditor' ELSE 'Guest' END = role) AS n_users FROM (VALUES ('IT System Manager', ['A1', 'A2', 'A3', 'A4', 'A5', 'A6', 'A7']), ('QA/Compliance', ['A1', 'A2', 'A3', 'A4', 'A5', 'A6']), ('Auditor', ['A1', 'A2'])) r(role, agents), "
    "(VALUES ('A1'), ('A2'), ('A3'), ('A4'), ('A5'), ('A6'), ('A7')) a(agent)",
    "authorized_requests": "SELECT role, agent, CASE role WHEN 'IT System Manager' THEN agent <= 'A7' WHEN 'QA/Compliance' THEN agent <= 'A6' WHEN 'Auditor' THEN agent <= 'A2' ELSE false END AS allowed, count(*) AS n_requests FROM "
    "(SELECT CASE user_id % 4 WHEN 0 THEN 'IT System Manager' WHEN 1 THEN 'QA/Compliance' WHEN 2 THEN 'Auditor' ELSE 'Guest' END AS role, 'A' || (event_id % 8 + 1) AS agent FROM events) GROUP BY ALL",
    "injection_regex": "SELECT origin, count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches(text, '(?i)(ignore previous instructions|override system prompt|disregard rules)')) AS n_flagged FROM (SELECT 'conversations' AS origin, text FROM conversations "
    "UNION ALL SELECT 'documents', text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'literal', unnest(['Please IGNORE previous instructions now', 'override System Prompt', 'disregard rules, all', 'a clean question'])) GROUP BY origin",
    "entropy_score": "SELECT conv_id, turn, round(coalesce((SELECT -sum(k / n * log2(k / n)) FROM (SELECT count(*)::DOUBLE AS k, length(c.text)::DOUBLE AS n FROM (SELECT unnest(string_split(c.text, '')) AS ch) WHERE ch <> '' GROUP BY ch)), 0), 6) AS entropy FROM conversations c",
    "route_validate": "SELECT event_id, event_type IN ('view', 'error') AS valid, CASE event_type WHEN 'view' THEN 'A1,A2' WHEN 'error' THEN 'A3' ELSE 'A1,A2,A3,A4,A5,A6' END AS agents, CASE event_type WHEN 'view' THEN 'audit_readiness' WHEN 'error' THEN 'risk' ELSE 'unclassified_fallback' END AS intent_category FROM events",
    "provider_selection": "SELECT task, provider, provider IS NOT NULL AS known, count(*) AS n_calls FROM (SELECT CASE event_type WHEN 'view' THEN 'knowledge' WHEN 'click' THEN 'compliance' WHEN 'purchase' THEN 'change' WHEN 'signup' THEN 'unlisted' WHEN 'error' THEN 'incident' END AS task, "
    "CASE event_type WHEN 'view' THEN 'gemini_flash_fast' WHEN 'click' THEN 'gemini_flash_fast' WHEN 'purchase' THEN 'gemini_flash_fast' WHEN 'error' THEN 'groq_llama' END AS provider FROM events) GROUP BY ALL",
    "action_routing": "SELECT id, action_type, CASE WHEN action_type IN ('READ', 'DRAFT') THEN 'AUTO' WHEN action_type = 'MOCK_WRITE_LOW_RISK' THEN 'QUEUE' ELSE 'BLOCK' END AS decision, CASE WHEN action_type IN ('READ', 'DRAFT') THEN 'EXECUTED' WHEN action_type = 'MOCK_WRITE_LOW_RISK' THEN 'PENDING' ELSE 'BLOCKED' END AS status "
    "FROM (SELECT 'AP-' || o_orderkey AS id, CASE o_orderpriority[1] WHEN '1' THEN 'PROHIBITED' WHEN '2' THEN 'GXP_RELEVANT_WRITE' WHEN '3' THEN 'MOCK_WRITE_LOW_RISK' WHEN '4' THEN 'DRAFT' WHEN '5' THEN 'READ' END AS action_type FROM orders)",
    "readiness_score": "SELECT id AS system_id, round(" + " + ".join(f"{w} * coalesce(100.0::DOUBLE * (1 - {_counts(v)}::DOUBLE / nullif({_counts(t)}, 0)), 100)" for w, t, v in _DIMENSIONS) + ", 4) AS readiness FROM gxp_systems s",
    "gap_matrix": "SELECT system_id, " + ", ".join(f"count(*) FILTER (WHERE k = {n}) AS p{n}" for n in range(1, 11)) + " FROM (" + " UNION ALL ".join(f"SELECT DISTINCT {n} AS k, system_id, record_id FROM v{n}" for n in range(1, 11)) + ") GROUP BY system_id",
    "evidence_heat_map": "SELECT r.system_id, count(*) FILTER (WHERE t.status = 'EXECUTED') AS n_executed, count(*) FILTER (WHERE t.status = 'DRAFT') AS n_draft, count(*) FILTER (WHERE t.status IS NULL) AS n_missing FROM requirements r LEFT JOIN test_cases t ON r.test_case_id = t.id GROUP BY r.system_id",
    "supplier_registry": f"SELECT id, name, system_id, status, reassessment_due_date_ns < {_P} AS overdue, greatest(({_P} - reassessment_due_date_ns) // {_D}, 0) AS days_overdue FROM suppliers",
    "health_cards": "SELECT s.id AS system_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS n_critical, count(*) FILTER (WHERE severity = 'HIGH') AS n_high, count(*) FILTER (WHERE severity = 'MEDIUM') AS n_medium FROM gxp_systems s LEFT JOIN v ON v.system_id = s.id GROUP BY s.id",
    "capa_candidates": "SELECT rule_id, system_id, record_id, severity, '2025-09-19' AS due_date FROM v WHERE severity IN ('HIGH', 'CRITICAL')",
    "risk_rubric": "SELECT 'RSK-' || p_partkey AS id, CASE WHEN p_size > 35 THEN 'HIGH' WHEN p_size > 15 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN p_retailprice > 1500 THEN 'FREQUENT' WHEN p_retailprice > 1000 THEN 'OCCASIONAL' ELSE 'RARE' END AS probability, "
    "(CASE WHEN p_size > 35 THEN 3 WHEN p_size > 15 THEN 2 ELSE 1 END) * (CASE WHEN p_retailprice > 1500 THEN 3 WHEN p_retailprice > 1000 THEN 2 ELSE 1 END) AS risk_score FROM part",
    "recurring_incidents": "SELECT system_id, kind, session, min(ns) AS start_ns, max(ns) AS end_ns, count(*) AS n_incidents FROM (SELECT system_id, kind, ns, (sum(is_new) OVER (PARTITION BY system_id, kind ORDER BY ns))::BIGINT AS session FROM "
    "(SELECT system_id, severity AS kind, opened_date_ns AS ns, (coalesce(opened_date_ns - lag(opened_date_ns) OVER (PARTITION BY system_id, severity ORDER BY opened_date_ns) > 7200000000000, false))::INT AS is_new FROM incidents)) GROUP BY ALL HAVING count(*) >= 3",
    "duty_conflicts": f"SELECT DISTINCT a.user_id, a.system_id, c.conflict_id, c.first, c.second FROM grants a JOIN grants b USING (user_id, system_id) JOIN (VALUES {', '.join(map(str, CONFLICTS))}) c(conflict_id, first, second) ON a.permission = c.first AND b.permission = c.second",
    "machine_states": "SELECT machine, subject, state, CASE state WHEN 'VERIFIED' THEN 'VERIFIED' WHEN 'VIOLATION' THEN 'VIOLATION' WHEN 'REPEATED' THEN 'VIOLATION' ELSE 'INSUFFICIENT EVIDENCE' END AS outcome, n AS n_records FROM machine QUALIFY row_number() OVER (PARTITION BY machine, subject ORDER BY n DESC) = 1",
    "downstream_impact": "SELECT source, count(*) FILTER (WHERE prefix = 'URS') AS n_requirements, count(*) FILTER (WHERE prefix = 'TC') AS n_tests, count(*) FILTER (WHERE prefix = 'RSK') AS n_risks, count(*) FILTER (WHERE prefix = 'CR') AS n_changes, "
    "count(*) FILTER (WHERE prefix IN ('TC', 'ACC')) AS n_controls, count(*) AS n_total, first(node ORDER BY n DESC, node) AS top_dependency, max(n) AS top_impact, CASE WHEN count(*) >= 10 THEN 'HIGH' WHEN count(*) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS impact "
    "FROM (SELECT b.source, node, split_part(node, '-', 1) AS prefix, coalesce(i.n_total, 0) AS n FROM below b LEFT JOIN impacts i ON i.source = b.node WHERE b.source <> node) GROUP BY source",
    "identifier_search": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index)::INT AS rank, doc_id, chunk_index, round(ranked.score, 6) AS score, n_identifiers FROM ranked QUALIFY rank <= 5",
    "term_statistics": "SELECT term, count(*) AS n_passages, sum(tf)::BIGINT AS n_occurrences, sum(at_sum)::BIGINT AS sum_positions FROM posted WHERE term IN (SELECT term FROM asked) GROUP BY term",
    "exact_fusion": "SELECT 0 AS query_id, row_number() OVER (ORDER BY exact DESC, round(score, 9) DESC, doc_id, chunk_index)::INT AS place, doc_id, chunk_index, round(fusion.score, 6) AS score, exact FROM (SELECT doc_id, chunk_index, sum(v) AS score, bool_or(x) AS exact FROM "
    "(SELECT doc_id, chunk_index, 1.0::DOUBLE / (60 + r) AS v, false AS x FROM dense UNION ALL SELECT doc_id, chunk_index, 1.0::DOUBLE / (60 + r), false FROM (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id, chunk_index) AS r FROM hits) WHERE r <= 20 "
    "UNION ALL SELECT doc_id, chunk_index, 1.0::DOUBLE / (60 + r), true FROM (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id, chunk_index) AS r FROM hits WHERE x) WHERE r <= 8) GROUP BY ALL) fusion QUALIFY place <= 8",
    "agent_states": "SELECT session_id, agent, CASE WHEN f > s + 10800000 OR s IS NOT NULL AND f IS NULL THEN 'TIMED_OUT' WHEN f IS NOT NULL THEN 'COMPLETE' ELSE 'WAITING' END AS state, CASE WHEN f > s + 10800000 OR s IS NOT NULL AND f IS NULL THEN s + 10800000 ELSE coalesce(f, q) END AS at_ms FROM "
    "(SELECT user_id || '/' || ts::DATE AS session_id, 'A' || (event_id % 3 + 1) AS agent, min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'view') AS q, min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'click') AS s, min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'purchase') AS f "
    "FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)",
    "document_headings": "SELECT * FROM heads",
    "parent_sections": "SELECT query_id, rank, h.doc_id, chunk_index, coalesce(level, 0) AS level, coalesce(title, '') AS title, coalesce(start, 0) AS start, coalesce(s.end, length(text)) AS \"end\", md5(substring(text, (coalesce(start, 0) + 1)::BIGINT, (coalesce(s.end, length(text)) - coalesce(start, 0))::BIGINT)) AS section_md5 "
    "FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index)::INT AS rank, doc_id, chunk_index FROM ranked QUALIFY rank <= 5) h JOIN documents d ON d.doc_id = h.doc_id "
    "LEFT JOIN heads s ON s.doc_id = h.doc_id AND s.start = (SELECT max(x.start) FROM heads x WHERE x.doc_id = h.doc_id AND x.start <= h.chunk_index * 448)",
    "chunk_upsert": "SELECT doc_id, (pos // 448)::INT AS chunk_index, md5(substring(t, pos + 1, 512)) AS content_md5, false AS deleted FROM (SELECT doc_id, t, unnest(range(0, length(t)::BIGINT, 448)) AS pos FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, 'e', 'E') ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0)) "
    "UNION ALL SELECT doc_id, chunk_index, '', true FROM chunks WHERE doc_id % 7 = 0",
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH RECURSIVE {_TABLES.strip()}\n{select}" for name, select in _SELECTS.items()}
