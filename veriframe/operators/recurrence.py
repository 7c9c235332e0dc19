"""Recurring incidents: incidents of a system and kind that follow each other within a gap form a session.

No window sees an incident. Time is cut into cells as wide as the gap, so that all incidents of a cell are in one session; each
cell is summed to an interval in the map tasks. Intervals merge: within blocks of cells first, then a row a block says how
many sessions it holds, where its first begins and its last ends, and whether its first goes on from the block before. A system with a third of all
rows is thus a few rows a task before anything is shuffled, and its blocks lie in different tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Own definition: incidents at most two hours apart are one session, and three of them recur.
GAP_NS, RECURRING = 2 * 3_600 * 10**9, 3
#: Cells of a block.
CELLS = 256


def sessions(incidents: DataFrame, gap_ns: int = GAP_NS, cells: int = CELLS) -> DataFrame:
    """``incidents`` (system_id, kind, at_ns) -> (system_id, kind, session, start_ns, end_ns, n_incidents); session counts from 0 in order of time. Rows without a time take no part; a null system or kind is a group of its own."""
    group = ["system_id", "kind"]
    cell = F.expr(f"(at_ns - pmod(at_ns, {gap_ns}L)) div {gap_ns}L")
    intervals = incidents.where("at_ns IS NOT NULL").groupBy(*group, cell.alias("_cell")).agg(F.min("at_ns").alias("_from"), F.max("at_ns").alias("_to"), F.count("*").alias("_n"))
    blocks = intervals.withColumn("_block", F.floor(F.col("_cell") / cells).cast("long"))
    inside = Window.partitionBy(*group, "_block").orderBy("_cell")
    new = F.coalesce((F.col("_from") - F.lag("_to").over(inside) > gap_ns).cast("int"), F.lit(0))
    parts = blocks.withColumn("_new", new).withColumn("_k", F.sum("_new").over(inside)).groupBy(*group, "_block", "_k").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n"))
    ends = parts.groupBy(*group, "_block").agg(F.min("_from").alias("_first"), F.max("_to").alias("_last"), F.count("*").alias("_sessions"))
    over = Window.partitionBy(*group).orderBy("_block")
    goes_on = F.coalesce((F.col("_first") - F.lag("_last").over(over) <= gap_ns).cast("long"), F.lit(0))
    ends = ends.withColumn("_on", goes_on).withColumn("_before", F.sum(F.col("_sessions") - F.col("_on")).over(over) - F.col("_sessions"))
    ends = ends.select(*[F.col(c).alias(f"b{c}") for c in (*group, "_block")], "_before")
    same = [parts[c].eqNullSafe(ends[f"b{c}"]) for c in (*group, "_block")]
    numbered = parts.join(ends, same).select(*group, "_from", "_to", "_n", (F.col("_before") + F.col("_k")).alias("session"))
    return numbered.groupBy(*group, "session").agg(F.min("_from").alias("start_ns"), F.max("_to").alias("end_ns"), F.sum("_n").alias("n_incidents"))


def recurring(incidents: DataFrame, gap_ns: int = GAP_NS, least: int = RECURRING) -> DataFrame:
    """The sessions of ``least`` incidents or more."""
    return sessions(incidents, gap_ns).where(F.col("n_incidents") >= least)
