"""Ten verification machines: each subject's records, in order, drive a machine from START to a state that gives the outcome.

What a record does is a function of the state, a table of as many entries as there are states, and such tables compose. So a
subject's records may lie in several ranges: each range is folded to one table by its task as rows stream by, and a
subject's few tables are then composed in order. No subject, however many records it has, is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.expressions import injected
from veriframe.operators import policies

Tables = Mapping[str, DataFrame]

STATES = ["START", "VERIFIED", "DOUBTFUL", "VIOLATION", "REPEATED"]
#: Own definition of the outcome of each state.
OUTCOMES = {"START": "INSUFFICIENT EVIDENCE", "VERIFIED": "VERIFIED", "DOUBTFUL": "INSUFFICIENT EVIDENCE", "VIOLATION": "VIOLATION", "REPEATED": "VIOLATION"}
#: Own definition of the machines: the state after each symbol, for each state in order. A violation stays one; one more on top of it, with nothing good or open between, is repeated.
USUAL = {"ok": [1, 1, 1, 3, 3], "doubt": [2, 2, 2, 3, 3], "bad": [3, 3, 3, 4, 4]}
MACHINES = {
    "documentation": USUAL,
    "traceability": USUAL,
    "risk": USUAL,
    "change_impact": USUAL,
    "incident": USUAL,
    "access_control": USUAL,
    "evidence": USUAL,
    "policy_gateway": USUAL,
    "action_authorization": USUAL | {"ok": [1, 1, 2, 3, 3]},  # what waits for approval stays so, whatever else is done
    "hash_chain": USUAL,
}


def fold_machines(steps: DataFrame, machines: Mapping[str, Mapping[str, list[int]]] = MACHINES) -> DataFrame:
    """``steps`` (machine, subject, at, tie, symbol) -> (machine, subject, state, outcome, n_records).

    Order is by (at, tie), nulls first. A null or unknown symbol leaves the state as it is; rows of an unknown machine and without a subject take no part.
    """
    tables = {(m, s): list(t) for m, own in machines.items() for s, t in own.items()}
    same = list(range(len(STATES)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, n, table = TaskContext.get().partitionId(), None, 0, same
        for batch in batches:
            done = []
            for machine, subject, symbol in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (machine, subject):
                    if at:
                        done.append((*at, part, n, table))
                    at, n, table = (machine, subject), 0, same
                step = tables.get((machine, symbol), same)
                n, table = n + 1, [step[s] for s in table]
            yield rows(done)
        yield rows([(*at, part, n, table)] if at else [])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 5, kinds)], names=["machine", "subject", "part", "n", "table"])

    known = steps.where(F.col("machine").isin(*machines) & F.col("subject").isNotNull())
    order = ["machine", "subject", F.asc_nulls_first("at"), F.asc_nulls_first("tie")]
    folded = known.repartitionByRange(*order).sortWithinPartitions(*order).select("machine", "subject", "symbol").mapInArrow(fold, "machine string, subject string, part long, n long, table array<int>")
    # A row for each range that a subject goes over.
    met = folded.groupBy("machine", "subject").agg(F.sort_array(F.collect_list(F.struct("part", "table"))).alias("_t"), F.sum("n").alias("n_records"))
    state = F.aggregate("_t", F.lit(0), lambda s, t: F.get(t["table"], s))
    name = F.get(F.array(*map(F.lit, STATES)), state)
    outcome = F.get(F.array(*[F.lit(OUTCOMES[s]) for s in STATES]), state)
    return met.select("machine", "subject", name.alias("state"), outcome.alias("outcome"), "n_records")


def _steps(machine: str, rows: DataFrame, subject: Column, at: Column, tie: Column, symbol: Column) -> DataFrame:
    return rows.select(F.lit(machine).alias("machine"), subject.alias("subject"), at.cast("long").alias("at"), tie.cast("string").alias("tie"), symbol.alias("symbol"))


def verification_steps(t: Tables, now_ns: int, conversations: DataFrame, chains: DataFrame) -> DataFrame:
    """The records of all ten machines, each with what its existing check says of it.

    A record is bad if the policy rule of its machine names it; that is the rule itself, joined by record id. What the
    rule leaves open is a doubt: no date, no test, no approval yet. ``conversations`` (conv_id, turn, text) go through the
    gateway's phrases, ``chains`` (chain, status) are as verify_chains gives them.
    """

    def ruled(name: str, *rules) -> DataFrame:
        bad = reduce(DataFrame.unionByName, (r(t, now_ns) for r in rules)).select(F.col("record_id").alias("id"), F.lit(True).alias("_bad")).distinct()
        return t[name].join(bad, "id", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))

    symbol = lambda bad, ok: F.when(bad, "bad").when(F.coalesce(ok, F.lit(False)), "ok").otherwise("doubt")
    system, none, by_id, bad = F.col("system_id"), F.lit(None), F.col("id"), F.col("_bad")
    tests = t["test_cases"].select(F.col("id").alias("test_case_id"), F.col("status").alias("_test"))
    targets = t["documents"].select(F.col("id").alias("document_id"), F.lit(True).alias("_there"))
    chunk_system = F.concat(F.lit("SYS-"), (F.substring("document_id", 5, 20).cast("long") % 25).cast("string"))
    text = F.coalesce("text", F.lit(""))
    parts = [
        _steps("documentation", ruled("documents", policies.p01), system, none, by_id, symbol(bad, F.col("status") == "APPROVED")),
        _steps("traceability", ruled("requirements", policies.p05).join(tests, "test_case_id", "left"), system, none, by_id, symbol(bad, F.col("_test").isNotNull())),
        _steps("risk", ruled("risks", policies.p03), system, F.col("last_review_date_ns"), by_id, symbol(bad, F.col("last_review_date_ns").isNotNull())),
        _steps("change_impact", ruled("changes", policies.p10), system, none, by_id, symbol(bad, F.col("status") == "CLOSED")),
        _steps("incident", ruled("incidents", policies.p04), system, F.col("opened_date_ns"), by_id, symbol(bad, F.col("rca_started") | (F.col("status") == "CLOSED"))),
        _steps("access_control", ruled("access_reviews", policies.p02), system, F.col("scheduled_date_ns"), by_id, symbol(bad, F.col("status") != "PENDING")),
        _steps("access_control", ruled("access_records", policies.p09), system, F.lit(now_ns), by_id, symbol(bad, F.col("user_status") == "ACTIVE")),
        _steps("evidence", t["document_chunks"].join(targets, "document_id", "left"), chunk_system, none, F.col("chunk_id"), symbol(F.col("_there").isNull(), F.lit(True))),
        _steps("policy_gateway", conversations, F.concat(F.lit("CONV-"), "conv_id"), F.col("turn"), F.sha2(text, 256), symbol(injected(F.col("text")), text != "")),
        _steps("action_authorization", t["action_proposals"], F.col("user_id"), none, by_id, symbol(F.col("action_type").isin("GXP_RELEVANT_WRITE", "PROHIBITED"), F.col("action_type").isin("READ", "DRAFT"))),
        _steps("hash_chain", chains, F.concat(F.lit("CHAIN-"), "chain"), none, F.lit(None), symbol(F.col("status") == "TAMPERED", F.lit(True))),
    ]
    return reduce(DataFrame.unionByName, parts)
