"""Agents' states: the stream, with late and repeated events and a restart, against the batch form."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from veriframe.streaming.agent_states import agent_states, stream_agent_states

EVENTS = "session_id string, agent string, action string, ts timestamp"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_batch(spark):
    rows = [("s", "A1", "queued", 1), ("s", "A2", "queued", 1), ("s", "A2", "started", 5), ("s", "A2", "started", 7), ("s", "A3", "started", 5), ("s", "A3", "finished", 9), ("s", "A4", "started", 5), ("s", "A4", "finished", 50), ("s", "A5", "finished", 3), ("s", "A6", "odd", 3), ("s", "A7", "queued", None)]
    events = spark.createDataFrame(rows, "session_id string, agent string, action string, at_ms long")
    got = {r.agent: (r.state, r.at_ms) for r in agent_states(events, 10).collect()}
    assert got == {"A1": ("WAITING", 1), "A2": ("TIMED_OUT", 15), "A3": ("COMPLETE", 9), "A4": ("TIMED_OUT", 15), "A5": ("COMPLETE", 3)}
    assert {r.agent: r.state for r in agent_states(events, 10, horizon_ms=12).collect()} == {"A1": "WAITING", "A2": "RUNNING", "A3": "COMPLETE", "A4": "RUNNING", "A5": "COMPLETE"}


def test_stream_is_the_batch(spark, rocks, tmp_path):
    rng = random.Random(2)
    events = []
    for s in range(12):
        for a in range(3):
            at = rng.uniform(0, 60)
            for action in ("queued", "started", "finished"):
                if rng.random() < 0.85:
                    events += [(f"s{s}", f"A{a}", action, START + timedelta(milliseconds=int(1000 * at)))] * rng.choice([1, 1, 2])
                at += rng.choice([1, 4, 9, 14])
    # Out of order by less than the watermark, in five files, each a micro-batch; then time goes on.
    events.sort(key=lambda e: e[3] + timedelta(seconds=rng.uniform(0, 8)))
    late = ("s0", "A0", "started", START - timedelta(hours=1))
    end = [("end", "A0", "queued", START + timedelta(hours=h)) for h in (1, 2, 3)]
    n = -(-len(events) // 5)
    parts = [events[i : i + n] for i in range(0, len(events), n)] + [[e] for e in end[:2]] + [[late, end[2]]]
    source = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        states = stream_agent_states(stream, 10_000, "30 seconds")

        def keep(batch, batch_id):
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"b{batch_id}"))

        states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination(240)

    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        if k in (2, len(parts) - 1):
            run()  # the second goes on from the checkpoint
    rows = spark.read.parquet(*[str(p) for p in sorted((tmp_path / "out").iterdir())]).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r.session_id, r.agent] = (r.state, r.at_ms)
    flat = spark.createDataFrame(events + end, EVENTS).select("session_id", "agent", "action", F.unix_millis("ts").alias("at_ms"))
    want = {(r.session_id, r.agent): (r.state, r.at_ms) for r in agent_states(flat, 10_000).collect()}
    assert last == want and {s for s, _ in want.values()} == {"WAITING", "COMPLETE", "TIMED_OUT"}
