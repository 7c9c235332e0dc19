"""Streams: rules that need no state, growing hash chains by micro-batch, agents' states with timers, and parsed frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators import audit


def stream_violations(stream: DataFrame, table: str, rule: Callable[[dict, int], DataFrame], now_ns: int) -> DataFrame:
    """One of the filtering policy rules over a stream of its table's rows."""
    return rule({table: stream}, now_ns)


class ChainHeads:
    """The heads of chains (audit.HEADS) in a shared folder, by micro-batch: each batch adds those of its own chains, and every FULL-th writes all of the batches before it together.

    What a batch reads are the heads of the batches before it, and what it writes replaces an earlier try of the same batch; so a batch that is replayed changes nothing.
    """

    FULL = 16

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def before(self, batch_id: int) -> DataFrame:
        """One row a chain, of all batches before."""
        if not batch_id:
            return self.spark.createDataFrame([], audit.HEADS)
        first = (batch_id - 1) // self.FULL * self.FULL
        paths = [f"{self.folder}/delta-{i}" for i in range(first, batch_id)] + ([f"{self.folder}/full-{first}"] if first else [])
        rows = self.spark.read.schema(f"{audit.HEADS}, batch long").parquet(*paths)
        return rows.groupBy("chain").agg(F.max_by(F.struct(*rows.columns[1:-1]), "batch").alias("_h")).select("chain", "_h.*")

    def add(self, batch_id: int, heads: DataFrame) -> None:
        put = lambda rows, name, batch: rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        if batch_id and batch_id % self.FULL == 0:
            put(self.before(batch_id), f"full-{batch_id}", batch_id - 1)
        put(heads, f"delta-{batch_id}", batch_id)


def chaining(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows (chain, ts, event_id, canonical) of a micro-batch are chained by (ts, event_id), following those of earlier batches, into ``folder``/chained/batch=N. No chain is held whole."""
    heads = ChainHeads(spark, f"{folder}/heads")

    def run(batch: DataFrame, batch_id: int) -> None:
        known = heads.before(batch_id).join(batch.select("chain").distinct(), "chain", "left_semi")
        built = audit.build_chains(batch, known)
        path = f"{folder}/chained/batch={batch_id}"
        built.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(built.schema).parquet(path)
        last = rows.groupBy("chain").agg(F.max_by("event_hash", F.struct("ts", "event_id")).alias("last_hash"), F.count("*").alias("_n"))
        none = F.lit(None).cast("long")
        n = F.col("_n") + F.coalesce("_k", F.lit(0))
        heads.add(batch_id, last.join(known.select("chain", F.col("n").alias("_k")), "chain", "left").select("chain", "last_hash", n.alias("n"), F.lit("VERIFIED").alias("status"), none.alias("broken_at_index"), none.alias("event_id")))

    return run


def verifying(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: chained rows of a micro-batch are verified from where their chains' heads stand; only new rows are hashed. Heads, with where a chain broke, are in ``folder``/heads."""
    heads = ChainHeads(spark, f"{folder}/heads")

    def run(batch: DataFrame, batch_id: int) -> None:
        known = heads.before(batch_id).join(batch.select("chain").distinct(), "chain", "left_semi")
        heads.add(batch_id, audit.chain_heads(batch, known))

    return run


def parse_frames(frames: DataFrame) -> DataFrame:
    """``frames`` (raw) with ``type``, ``payload`` and ``error``: what isn't a JSON object keeps its text in ``error``."""
    parsed = F.from_json("raw", "type string, payload string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return frames.withColumn("_p", parsed).select(*frames.columns, F.col("_p.type").alias("type"), F.col("_p.payload").alias("payload"), F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), F.col("raw")).alias("error"))
