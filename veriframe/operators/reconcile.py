"""Two tables held against each other, and records' events held against their expected order.

Reconciling descends a tree of bucket digests, FANOUT buckets below each: a scan of each side sums rows to the digests of the
leaves, in the map tasks; levels above are sums of those. From the root on only the buckets below differing ones are compared, and only rows of
differing leaves are shuffled and met by key. Tables that agree cost two scans and no shuffle of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.runtime import checkpointed

#: Buckets below each, and levels: 4,096 leaves.
FANOUT, LEVELS = 64, 2
#: Events whose numbers share all but the last 4,096 are looked at together.
SPAN = 4_096


def _leaf(key: str, levels: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FANOUT**levels)).cast("long")


def _digests(rows: DataFrame, key: str, columns: Sequence[str], levels: int) -> DataFrame:
    """(leaf, n, d1, d2): rows of each leaf and two sums of their hashes, in which equal rows don't cancel out."""
    sha = F.sha2(F.to_json(F.struct(F.col(key).cast("string").alias("k"), *[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring("_sha", at, 9), 16, 10).cast("long")  # noqa: E731  36 bits: sums stay below 2^63 up to 10^8 rows a leaf
    return rows.select(_leaf(key, levels).alias("leaf"), sha.alias("_sha")).groupBy("leaf").agg(F.count("*").alias("n"), F.sum(part(1)).alias("d1"), F.sum(part(10)).alias("d2"))


def differing_leaves(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """(leaf) of the leaves whose rows differ: level by level, below differing buckets only."""
    sides = [checkpointed(_digests(rows, key, columns, levels)) for rows in (left, right)]  # FANOUT ** levels rows at most
    open_: DataFrame | None = None
    for level in range(1, levels + 1):
        below = FANOUT ** (levels - level)
        bucket = F.floor(F.col("leaf") / below).cast("long")
        a, b = (s.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2")) for s in sides)
        a, b = a.select("bucket", F.struct("n", "d1", "d2").alias("_a")), b.select("bucket", F.struct("n", "d1", "d2").alias("_b"))
        if open_ is not None:
            up = open_.select(F.explode(F.sequence(F.col("bucket") * FANOUT, F.col("bucket") * FANOUT + FANOUT - 1)).alias("bucket"))
            a, b = a.join(up, "bucket", "left_semi"), b.join(up, "bucket", "left_semi")
        open_ = a.join(b, "bucket", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("bucket")
    return checkpointed(open_.withColumnRenamed("bucket", "leaf"))


def reconcile(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """(key, outcome) of the keys on which the tables disagree: ``lost`` (only on the left), ``extra`` (only on the right), ``changed``. A key's rows are held against each other as a bag; null keys take no part."""
    left, right = (rows.select(key, *columns).where(F.col(key).isNotNull()) for rows in (left, right))
    leaves = F.broadcast(differing_leaves(left, right, key, columns, levels).withColumnRenamed("leaf", "_leaf"))  # FANOUT ** levels rows at most

    def near(rows: DataFrame, name: str) -> DataFrame:
        met = rows.withColumn("_leaf", _leaf(key, levels)).join(leaves, "_leaf", "left_semi")
        text = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
        part = F.conv(F.substring(text, 1, 9), 16, 10).cast("long")
        return met.groupBy(key).agg(F.struct(F.count("*"), F.sum(part), F.min(text), F.max(text)).alias(name))

    both = near(left, "_a").join(near(right, "_b"), key, "full")
    outcome = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, outcome.alias("outcome")).where("outcome IS NOT NULL")


def event_sequence(events: DataFrame, span: int = SPAN) -> DataFrame:
    """``events`` (subject, seq, at) -> (subject, n_events, n_undated, n_out_of_order): events whose time is before that of the dated one before them in order of ``seq``.

    Events are looked at in spans of their numbers, and a row a span ties these together, so that a subject's events need not meet in one task.
    Repeated numbers go by time. Events without a subject or number take no part.
    """
    rows = events.where("subject IS NOT NULL AND seq IS NOT NULL").withColumn("_span", F.floor(F.col("seq") / span).cast("long"))
    inside = Window.partitionBy("subject", "_span").orderBy("seq", "at")
    before = F.last("at", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.withColumn("_late", F.col("at") < before).groupBy("subject", "_span").agg(
        F.count("*").alias("_n"), F.count_if(F.col("at").isNull()).alias("_undated"), F.count_if("_late").alias("_late"),
        F.min(F.when(F.col("at").isNotNull(), F.struct("seq", "at"))).alias("_first"), F.max(F.when(F.col("at").isNotNull(), F.struct("seq", "at"))).alias("_last"),
    )
    over = Window.partitionBy("subject").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    met = parts.withColumn("_seam", F.col("_first.at") < F.last("_last.at", ignorenulls=True).over(over))
    return met.groupBy("subject").agg(F.sum("_n").alias("n_events"), F.sum("_undated").alias("n_undated"), (F.sum("_late") + F.count_if("_seam")).alias("n_out_of_order"))
