"""Chains that grow by micro-batches: built and verified from their heads, replayed, and against the batch form."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veriframe.operators import audit
from veriframe.streaming.audit_stream import ChainHeads, chaining, verifying

LOG = "chain long, ts timestamp, event_id long, canonical string"


def log(n, seed=1):
    """Rows of eight chains, one of which has a third of them; one row in ten has no text."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(0 if rng.random() < 0.33 else rng.randrange(1, 8), start + timedelta(seconds=i), i, None if rng.random() < 0.1 else f'{{"output_summary":"{i}"}}') for i in range(n)]


def verdicts(df):
    return {r.chain: (r.status, r.broken_at_index, r.event_id) for r in df.collect()}


@pytest.mark.parametrize("full", [2, 16])
def test_growing_chains(spark, tmp_path, monkeypatch, full):
    monkeypatch.setattr(ChainHeads, "FULL", full)
    rows = log(300)
    whole = audit.build_chains(spark.createDataFrame(rows, LOG).repartition(5))
    want = {tuple(r) for r in whole.select("chain", "event_id", "previous_event_hash", "event_hash").collect()}
    build = chaining(spark, str(tmp_path / "b"))
    cuts = [0, 40, 41, 160, 220, 300]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(rows[a:b], LOG)
        build(batch, i)
        if i in (0, 3):
            build(batch, i)  # a replay
    read = lambda: spark.read.parquet(str(tmp_path / "b" / "chained"))
    assert {tuple(r) for r in read().select("chain", "event_id", "previous_event_hash", "event_hash").collect()} == want and read().count() == 300
    # Verified batch by batch, one row overwritten.
    chained = audit.tamper(whole, F.col("event_id") == 170).collect()
    check, heads = verifying(spark, str(tmp_path / "v")), ChainHeads(spark, str(tmp_path / "v" / "heads"))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame([r for r in chained if a <= r.event_id < b], whole.schema)
        check(batch, i)
        once = heads.before(i + 1).collect()
        check(batch, i)
        assert sorted(heads.before(i + 1).collect()) == sorted(once)
        so_far = spark.createDataFrame([r for r in chained if r.event_id < b], whole.schema)
        assert verdicts(heads.before(i + 1)) == verdicts(audit.verify_chains(so_far))
        assert {r.chain: r.n for r in once} == {r.chain: r["count"] for r in so_far.groupBy("chain").count().collect()}
    assert sum(v[0] == "TAMPERED" for v in verdicts(heads.before(5)).values()) == (rows[170][3] is not None)


def test_stream_restarts_where_it_was(spark, tmp_path):
    rows = log(120, seed=3)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(chaining(spark, folder)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    for n in range(3):
        spark.createDataFrame(rows[40 * n : 40 * n + 40], LOG).coalesce(1).write.mode("append").parquet(source)
        run()
    want = audit.build_chains(spark.createDataFrame(rows, LOG)).select("chain", "event_id", "previous_event_hash", "event_hash")
    got = spark.read.parquet(f"{folder}/chained").select("chain", "event_id", "previous_event_hash", "event_hash")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
