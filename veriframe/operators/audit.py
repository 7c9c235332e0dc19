"""Tamper-evident hash chains: build, verify, tamper.

A hash follows from the one before, so a chain is built in order by one task; it streams through it (rows sorted within
the partition), and no chain is ever held whole. Verifying needs no order of work: row k is bad if its stored previous hash
isn't row k - 1's stored hash or its own hash doesn't follow from its stored one; the first bad row is a minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what the first row of a chain follows.
GENESIS = "0" * 64
TAMPERED = "TAMPERED DATA"


HEADS = "chain long, last_hash string, n long, status string, broken_at_index long, event_id long"


def build_chains(log: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``log`` (chain, ts, event_id, canonical, ...) -> with previous_event_hash and event_hash; order within a chain is (ts, event_id). ``heads`` (chain, last_hash): what chains go on from."""
    width = len(log.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = object(), GENESIS
        for batch in batches:
            previous, own, rows = [], [], []
            for i, (key, canonical, head) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chain", "canonical", "_head")))):
                if key != chain:
                    chain, last = key, GENESIS
                if head is not None:  # the row that says what its chain goes on from
                    last = head
                    continue
                rows.append(i)
                previous.append(last)
                last = hashlib.sha256((last + (canonical or "")).encode()).hexdigest()
                own.append(last)
            kept = batch.select(range(width)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(previous, pa.string()), pa.array(own, pa.string())], names=[*kept.schema.names, "previous_event_hash", "event_hash"])

    rows = log.withColumn("_head", F.lit(None).cast("string"))
    if heads is not None:
        rows = rows.unionByName(heads.select("chain", F.col("last_hash").alias("_head")), allowMissingColumns=True)
    ordered = rows.repartition("chain").sortWithinPartitions("chain", F.col("_head").isNull(), "ts", "event_id")
    more = [T.StructField(c, T.StringType()) for c in ("previous_event_hash", "event_hash")]
    return ordered.mapInArrow(run, T.StructType([*log.schema.fields, *more]))


_PARTS = "chain long, part long, n long, first_previous string, first_event long, last_hash string, bad_at long, bad_event long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chain, event_id, previous_event_hash, event_hash, own) in order -> a row for each chain of the partition: its size, its ends and the first bad row."""
    part, at = TaskContext.get().partitionId(), None

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in _PARTS.split(", "))]))

    for batch in batches:
        done, chains = [], batch.column("chain").to_pylist()
        before, own = batch.column("previous_event_hash"), batch.column("event_hash")
        follows = pc.fill_null(pc.equal(before.slice(1), own.slice(0, max(0, len(own) - 1))), False).to_numpy(zero_copy_only=False)
        sound = pc.fill_null(batch.column("own"), False).to_numpy(zero_copy_only=False)
        starts = [i for i, c in enumerate(chains) if not i or c != chains[i - 1]]
        for start, end in zip(starts, [*starts[1:], len(chains)]):
            good = sound[start:end].copy()
            good[1:] &= follows[start : end - 1]
            if at and at["chain"] == chains[start]:  # goes on from the batch before
                good[0] &= before[start].as_py() is not None and before[start].as_py() == at["last_hash"]
            else:
                done += [at] if at else []
                at = {"chain": chains[start], "part": part, "n": 0, "first_previous": before[start].as_py(), "first_event": batch.column("event_id")[start].as_py(), "bad_at": None, "bad_event": None}
            if at["bad_at"] is None and not good.all():
                first = int(np.argmin(good))
                at |= {"bad_at": at["n"] + first, "bad_event": batch.column("event_id")[start + first].as_py()}
            at |= {"n": at["n"] + end - start, "last_hash": own[end - 1].as_py()}
        yield out(done)
    yield out([at] if at else [])


def chain_heads(chained: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``chained`` rows -> HEADS of the chains that have any: verified rows, the last hash, and where a chain breaks. ``heads``: HEADS of the rows before, which aren't read again; a broken chain stays as it broke.

    Rows are dealt once, by ranges of (chain, ts, event_id), so that a long chain is cut into parts that are checked apart as they stream by; what
    joins a part to the one before is one row a part. Texts are hashed where they lie and don't travel.
    """
    own = F.col("event_hash").eqNullSafe(F.sha2(F.concat("previous_event_hash", F.coalesce("canonical", F.lit(""))), 256))
    rows = chained.select(F.col("chain").cast("long").alias("chain"), "ts", F.col("event_id").cast("long").alias("event_id"), "previous_event_hash", "event_hash", own.alias("own"))
    dealt = rows.repartitionByRange("chain", "ts", "event_id").sortWithinPartitions("chain", "ts", "event_id").select("chain", "event_id", "previous_event_hash", "event_hash", "own")
    parts = dealt.mapInArrow(_summaries, _PARTS)
    known = (heads if heads is not None else chained.sparkSession.createDataFrame([], HEADS)).select("chain", F.struct("last_hash", "n", "status", "broken_at_index", "event_id").alias("_h"))
    v = Window.partitionBy("chain").orderBy("part")
    parts = parts.join(known, "chain", "left").withColumn("_before", F.coalesce(F.lag("last_hash").over(v), "_h.last_hash", F.lit(GENESIS)))
    start = F.coalesce(F.col("_h.n"), F.lit(0))
    parts = parts.withColumn("_from", F.coalesce(F.sum("n").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start)
    bad = F.when(~F.col("first_previous").eqNullSafe(F.col("_before")), F.struct(F.col("_from").alias("i"), F.col("first_event").alias("event_id"))).when(
        F.col("bad_at").isNotNull(), F.struct((F.col("_from") + F.col("bad_at")).alias("i"), F.col("bad_event").alias("event_id"))
    )
    met = parts.groupBy("chain").agg(F.min(bad).alias("_bad"), F.sum("n").alias("_n"), F.max(F.struct("part", "last_hash")).alias("_last"), F.any_value("_h").alias("_h"))
    broken = F.coalesce(F.col("_h.status") == "TAMPERED", F.lit(False))
    return met.select(
        "chain", F.col("_last.last_hash").alias("last_hash"), (F.col("_n") + F.coalesce("_h.n", F.lit(0))).alias("n"), F.when(broken | F.col("_bad").isNotNull(), "TAMPERED").otherwise("VERIFIED").alias("status"),
        F.when(broken, F.col("_h.broken_at_index")).otherwise(F.col("_bad.i")).cast("long").alias("broken_at_index"), F.when(broken, F.col("_h.event_id")).otherwise(F.col("_bad.event_id")).cast("long").alias("event_id"),
    )


def verify_chains(chained: DataFrame) -> DataFrame:
    """(chain, status, broken_at_index, event_id, events_checked): VERIFIED, or TAMPERED with the first bad row (from 0)."""
    return chain_heads(chained).select("chain", "status", "broken_at_index", "event_id", F.when(F.col("status") == "VERIFIED", F.col("n")).alias("events_checked"))


def tamper(chained: DataFrame, which) -> DataFrame:
    """Rows that meet ``which`` with their output_summary overwritten; stored hashes stay."""
    changed = F.regexp_replace("canonical", r'"output_summary":("[^"]*"|null)', f'"output_summary":"{TAMPERED}"')
    return chained.withColumn("canonical", F.when(which, changed).otherwise(F.col("canonical")))
