"""Sinks, quality gates, chains, graph, retrieval, gateway and plans, on small fixtures."""

from __future__ import annotations

import hashlib
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veriframe.functions.expressions import entropy, injected
from veriframe.operators import audit, checks, gateway, graph, package, policies, quality, readiness, retrieval, verify
from veriframe.sources.policy_input import INPUT_TABLES, PolicyInputs, to_json_documents
from veriframe.sources.records import NOW_NS, Records, rows_of
from veriframe.sources.schemas import REFERENCES, TABLES
from veriframe.sources.seed import seed
from veriframe.sources.sinks import insert_if_absent, upsert
from veriframe.streaming.audit_stream import parse_frames, stream_violations

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_registry(spark):
    assert len(TABLES) == 27 and len(REFERENCES) == 21
    assert all(r.passed for r in quality.schema_gate(spark).collect())
    t = seed(spark)
    assert {r.table_name: (r.n_missing, r.n_rows, r.passed) for r in quality.tables_gate(t, {"risks": ["id", "owner"], "changes": ["id", "absent"]}).collect()} == {"risks": (0, 1, True), "changes": (1, 1, False)}
    wrong = {"risks": t["risks"].withColumn("last_review_date_ns", t["risks"]["last_review_date_ns"].cast("int"))}
    assert [(r.n_unknown, r.n_ns, r.passed) for r in quality.record_columns_gate(t | wrong, ["risks", "incidents"]).collect()] == [(1, 0, False), (0, 1, True)]


def test_plans_push_down(spark):
    assert "PushedFilters: [IsNotNull(due_date_ns), LessThan(due_date_ns," in plan_of(policies.p07({"periodic_evaluations": _stored(spark)}, NOW_NS))
    assert "LeftSemi" in plan_of(policies.p10(Records(spark, SF), NOW_NS))
    assert "Python" not in plan_of(policies.evaluate_policies(Records(spark, SF), NOW_NS))


def _stored(spark):
    from veriframe.functions.runtime import checkpointed  # noqa: F401  sets the folder where it is unset

    path = f"{spark.conf.get('spark.checkpoint.dir')}/pe"
    rows_of(spark, "periodic_evaluations", [{"id": "a", "due_date_ns": 1}]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_sinks(spark):
    held = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "id int, v string")
    out = insert_if_absent(held, new, order=F.col("v"))
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c")]
    assert insert_if_absent(out, new).count() == 2
    assert sorted(map(tuple, upsert(held, spark.createDataFrame([(1, "a"), (3, "z")], held.schema), "id", "v").collect())) == [(1, "a"), (3, "z")]


def test_guards(spark):
    t = seed(spark, risks=[{"id": "r", "last_review_date_ns": 1723718400}])
    assert {(r.table_name, r.passed) for r in quality.ns_guard(t).collect() if not r.passed} == {("risks", False)}
    lost = quality.orphans(seed(spark, requirements=[{"id": "a", "test_case_id": "x"}, {"id": "b"}]), [("requirements", "test_case_id", "test_cases", "id")])
    assert lost.first().n_orphans == 1


LOG = [(1, datetime(2024, 1, 1, 0, k), k, '{"output_summary":"%d"}' % k) for k in range(6)] + [(2, datetime(2024, 1, 1), 9, '{"output_summary":"x"}')]
LOG_SCHEMA = "chain long, ts timestamp_ntz, event_id long, canonical string"


def test_chain(spark):
    built = audit.build_chains(spark.createDataFrame(LOG, LOG_SCHEMA)).cache()
    last = audit.GENESIS
    for _, _, k, text in LOG[:6]:
        own = hashlib.sha256((last + text).encode()).hexdigest()
        row = built.where(F.col("event_id") == k).first()
        assert (row.previous_event_hash, row.event_hash) == (last, own)
        last = own
    verdict = lambda df: {r.chain: (r.status, r.broken_at_index, r.event_id, r.events_checked) for r in audit.verify_chains(df).collect()}
    assert verdict(built) == {1: ("VERIFIED", None, None, 6), 2: ("VERIFIED", None, None, 1)}
    for k in range(6):
        assert verdict(audit.tamper(built, F.col("event_id") == k))[1] == ("TAMPERED", k, k, None)
    assert verdict(built.where("event_id <> 2"))[1] == ("TAMPERED", 2, 3, None)  # a row deleted
    swapped = built.withColumn("ts", F.when(F.col("event_id") == 3, F.lit(datetime(2024, 1, 1, 0, 4, 30)).cast("timestamp_ntz")).otherwise(F.col("ts")))
    assert verdict(swapped)[1][:2] == ("TAMPERED", 3)
    assert audit.build_chains(spark.createDataFrame([], LOG_SCHEMA)).count() == 0
    assert verdict(built.limit(0)) == {}
    built.unpersist()


def test_long_chain_is_verified_in_parts(spark):
    """A chain cut into several parts, against a walk over it; rows at every place overwritten, deleted, or with a stored hash that is null."""
    log = [(1, datetime(2024, 1, 1, 0, k), k, str(k)) for k in range(40)] + [(None, datetime(2024, 1, 1), 50, "x"), (2, datetime(2024, 1, 1), 60, None)]
    built = [tuple(r) for r in audit.build_chains(spark.createDataFrame(log, LOG_SCHEMA)).collect()]
    schema = LOG_SCHEMA + ", previous_event_hash string, event_hash string"

    def walk(rows):
        out = {}
        for chain in {r[0] for r in rows}:
            last, bad, mine = audit.GENESIS, None, sorted((r for r in rows if r[0] == chain), key=lambda r: r[1:3])
            for i, (_, _, event, text, before, own) in enumerate(mine):
                if bad is None and (before != last or own != hashlib.sha256((last + (text or "")).encode()).hexdigest()):
                    bad = (i, event)
                last = own or audit.GENESIS
            out[chain] = ("TAMPERED", *bad, None) if bad else ("VERIFIED", None, None, len(mine))
        return out

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        cases = [built]
        for k in (0, 9, 10, 11, 20, 21, 30, 39):
            of = next(r for r in built if r[2] == k)
            rest = [r for r in built if r is not of]
            cases += [[*rest, (*of[:3], "other", *of[4:])], rest, [*rest, (*of[:5], None)], [*rest, (*of[:4], None, of[5])]]
        rows = [(r[0] and r[0] + 10 * i, *r[1:]) for i, case in enumerate(cases) for r in case if i == 0 or r[0]]
        assert {r.chain: tuple(r)[1:] for r in audit.verify_chains(spark.createDataFrame(rows, schema)).collect()} == walk(rows)
        assert {r.chain: tuple(r)[1:] for r in audit.verify_chains(spark.createDataFrame(built, schema)).collect()} == walk(built)
        ranges = spark.createDataFrame(built, schema).repartitionByRange("chain", "ts", "event_id").where("chain = 1")
        assert ranges.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset(key)


def test_reach(spark):
    edge = lambda *e: spark.createDataFrame([(a, b, "R") for a, b in e], "source_id string, target_id string, relation_type string")
    start = spark.createDataFrame([("a",), ("missing",)], "source string")
    got = lambda e: sorted((r.node, r.hop) for r in graph.reach(e, start).collect())
    assert got(edge(("a", "b"), ("b", "c"))) == [("a", 0), ("b", 1), ("c", 2)]
    assert got(edge(("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert got(edge(("a", "b"), ("b", "a"))) == [("a", 0), ("b", 1)]
    assert got(edge(("x", "y"), ("a", "a"))) == [("a", 0)]
    assert got(edge(("x", "y"))) == []


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (1, [1]), (448, [448]), (449, [449, 1]), (512, [512, 64]), (513, [512, 65]), (1000, [512, 512, 104])])
def test_chunks(spark, n, sizes):
    rows = retrieval.chunks(spark.createDataFrame([(1, "é" * n)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [len(r.content) for r in rows] == sizes


def test_null_text_has_no_chunks(spark):
    assert retrieval.chunks(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_rankings(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, embedding array<float>")
    got = [(r.id, round(r.score, 4)) for r in retrieval.dense_topk(vectors, [1.0, 0.0], 5).collect()]
    assert got == [(1, 1.0), (3, 0.7071), (2, 0.0), (4, 0.0), (5, 0.0)]
    passages = spark.createDataFrame([(1, 0, "cat cat dog"), (2, 0, "dog"), (3, 0, "")], "doc_id long, chunk_index int, content string")
    hits = retrieval.bm25_topk(passages, ["cat", "absent"], 5)
    assert [r.doc_id for r in hits.collect()] == [1]
    fused = retrieval.rrf(spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.4)], "doc_id long, chunk_index int, score double"), hits, ["doc_id", "chunk_index"]).collect()
    assert [(r.doc_id, r.retrieval_method) for r in fused] == [(1, "both"), (2, "dense")]


def test_gateway(spark):
    raw = ['{"active_agents": ["A1", "A6"], "intent_category": "x"}', "no", "[]", '{"active_agents": [], "intent_category": "x"}', '{"active_agents": ["A7"], "intent_category": "x"}', '{"active_agents": ["A1"]}', '{"active_agents": ["A1", null], "intent_category": "x"}', None]
    got = gateway.validate_routes(spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")).orderBy("k").collect()
    assert [r.valid for r in got] == [True, *[False] * 7]
    assert got[1].active_agents == gateway.ROUTABLE and got[1].intent_category == "unclassified_fallback"
    allowed = gateway.authorize(spark.createDataFrame([("Auditor", "A2"), ("Auditor", "A3"), ("QA/Compliance", "A7"), (None, "A1"), ("Auditor", None)], "role string, agent string"))
    assert [r.allowed for r in allowed.collect()] == [True, False, False, False, False]
    texts = spark.createDataFrame([("aabb",), ("",), (None,), ("zzz",), ("Disregard RULES",)], "t string").select(entropy(F.col("t")).alias("e"), injected(F.col("t")).alias("i")).collect()
    assert [round(r.e, 6) for r in texts[:4]] == [1.0, 0.0, 0.0, 0.0] and [r.i for r in texts] == [False, False, False, False, True]
    assert math.isclose(sum(w for _, w in readiness.WEIGHTS), 1.0)
    clean = seed(spark)
    assert {r.readiness for r in readiness.readiness(clean, policies.no_violations(spark)).collect()} == {100.0}


def test_streams(spark, tmp_path):
    rows_of(spark, "suppliers", [{"id": "s", "reassessment_due_date_ns": 5}, {"id": "t"}]).write.parquet(str(tmp_path / "s"))
    due = spark.readStream.schema(TABLES["suppliers"]).parquet(str(tmp_path / "s"))
    stream_violations(due, "suppliers", policies.p06, NOW_NS).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.record_id for r in spark.table("late").collect()] == ["s"]
    frames = parse_frames(spark.createDataFrame([('{"type": "echo", "payload": "hi"}',), ("oops",), (None,)], "raw string")).collect()
    assert [(r.type, r.payload, r.error) for r in frames] == [("echo", "hi", None), (None, None, "oops"), (None, None, None)]


def test_policy_inputs_from_json(spark):
    late = NOW_NS - 47 * 86_400_000_000_000
    incident = f'"severity": "P1", "status": "OPEN", "opened_date_ns": {late}, "system_id": "S"'
    raw = [
        '{"documents": [{"id": "D1", "system_id": "S", "doc_type": "O&M", "status": "DRAFT"}, {"id": "D2", "doc_type": "O&M"}, {"id": "D3", "doc_type": "SOP"}]}',
        f'{{"incidents": [{{"id": "I1", {incident}}}, {{"id": "I2", {incident}, "rca_started": null}}, {{"id": "I3", {incident}, "rca_started": true}}, {{"id": "I4", {incident}, "rca_started": false}}]}}',
        '{"requirements": [{"id": "R1", "test_case_id": "T1"}, {"id": "R2", "test_case_id": "T2"}, {"id": "R3", "test_case_id": "T9"}], "test_cases": {"T1": {"status": "DRAFT"}, "T2": {"status": "EXECUTED"}}}',
        "no json", "[]", "{}", None,
    ]
    inputs = PolicyInputs(spark.createDataFrame([(r,) for r in raw], "raw string"))
    assert sorted(r.record_id for r in policies.evaluate_policies(inputs, NOW_NS).collect()) == ["D1", "D2", "I1", "I4", "R1"]


def test_policy_inputs_round_trip(spark):
    tables = seed(spark)
    raw = [to_json_documents(tables[name], name) for name in INPUT_TABLES]
    whole = raw[0]
    for more in raw[1:]:
        whole = whole.unionByName(more)
    inputs = PolicyInputs(whole)
    assert set(policies.evaluate_policies(inputs, NOW_NS).collect()) == set(policies.evaluate_policies(tables, NOW_NS).collect())
    for name in INPUT_TABLES:
        assert sorted(map(repr, inputs[name].select(tables[name].columns).collect())) == sorted(map(repr, tables[name].collect()))


def test_audit_packages(spark):
    t = seed(spark)
    rules, found = policies.evaluate_policies(t, NOW_NS), checks.findings_of(checks.run_checks(t, NOW_NS))
    trails = spark.createDataFrame([("GXP-MFG-DEMO-01", "VERIFIED"), ("GXP-MFG-DEMO-01", "TAMPERED")], "system_id string, status string")
    got = {r.system_id: r for r in package.audit_packages(t["gxp_systems"], found, verify.verify_findings(found, rules, t), rules, trails).collect()}
    one, two = got["GXP-MFG-DEMO-01"], got["BUS-IT-DEMO-02"]
    assert len(one.findings) == 7 and {f.confidence for f in one.findings} == {"MEDIUM"} and not one.audit_trail_valid
    assert one.risk_summary.asDict() == {"critical": 1, "high": 7, "medium": 2} and len(one.chain_of_custody) == 7
    assert two.audit_trail_valid and two.risk_summary.asDict() == {"critical": 0, "high": 1, "medium": 0}
    nothing = package.audit_packages(t["gxp_systems"], found.limit(0), verify.verify_findings(found.limit(0), rules, t), rules.limit(0), trails.limit(0)).collect()
    assert all(r.findings == [] and r.chain_of_custody == [] and r.audit_trail_valid for r in nothing)
