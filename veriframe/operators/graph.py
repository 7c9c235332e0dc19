"""The evidence graph: typed edges, what can be reached from records, and how far a failure reaches."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions.runtime import checkpointed, shared_folder, table_name

Tables = Mapping[str, DataFrame]


def evidence_edges(t: Tables, once: bool = True) -> DataFrame:
    """(source_id, target_id, relation_type), each once, or as often as records give it for callers that reduce edges themselves; edges without a target are left out."""

    def edges(rows: DataFrame, source, target, relation: str) -> DataFrame:
        return rows.select(source.alias("source_id"), target.alias("target_id"), F.lit(relation).alias("relation_type"))

    part = lambda prefix, c: F.concat(F.lit(prefix), c)
    parts = [
        edges(t["requirements"], F.col("id"), F.col("test_case_id"), "VERIFIED_BY"),
        edges(t["change_actions"], F.col("change_id"), part("URS-", F.col("l_partkey")), "AFFECTS"),
        edges(t["change_actions"], F.col("change_id"), part("DE-", F.col("l_partkey") % 25), "AFFECTS"),
        edges(t["incidents"], F.col("id"), F.col("system_id"), "AFFECTS"),
        edges(t["risks"], F.col("id"), F.col("system_id"), "ASSOCIATED_WITH"),
        edges(t["documents"], F.col("id"), F.col("system_id"), "GOVERNS"),
        edges(t["access_reviews"], F.col("id"), part("ACC-", F.col("o_custkey")), "CONTROLS"),
    ]
    whole = reduce(DataFrame.unionByName, parts).where("source_id IS NOT NULL AND target_id IS NOT NULL")
    return whole.distinct() if once else whole


def _links(edges: DataFrame) -> DataFrame:
    """(source_id, target_id), each once, written in buckets of the source: one shuffle, and none of them in joins by source."""
    spark = edges.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), table_name(spark, "links")
    placed = edges.select("source_id", "target_id").repartition(n, "source_id").distinct()
    placed.write.bucketBy(n, "source_id").option("path", shared_folder(spark, "links")).saveAsTable(name)
    return spark.table(name)


def reach(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``sources`` (source) -> (source, node, hop): all nodes reachable from each within ``max_hops`` hops (null: any number), itself included, with the least number of hops.

    Breadth first: each round joins only the newest nodes to the edges and leaves out those seen; rounds are written to
    the shared folder. Cycles end, since a node is new once; sources that no edge has give no rows.
    """
    links = _links(edges)  # read again in every round
    asked, begins = sources.select("source").distinct(), links.select(F.col("source_id").alias("source"))
    known = checkpointed(asked.join(begins, "source", "left_semi"))
    rest = checkpointed(asked.join(known, "source", "left_anti"))
    if not rest.isEmpty():  # targets are looked through for those only that begin no edge
        known = checkpointed(known.unionByName(rest.join(links.select(F.col("target_id").alias("source")), "source", "left_semi")))
    front = known.select("source", F.col("source").alias("node"), F.lit(0).alias("hop"))
    seen, hop = front, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        new = front.join(links, front["node"] == links["source_id"]).select("source", F.col("target_id").alias("node")).distinct()
        front = checkpointed(new.join(seen, ["source", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def node_type() -> F.Column:
    """Of ``node``, by its prefix."""
    kinds = {"URS": "REQUIREMENT", "TC": "TEST_CASE", "CR": "CHANGE", "DE": "DESIGN_ELEMENT", "SYS": "SYSTEM", "INC": "INCIDENT", "RSK": "RISK", "DOC": "DOCUMENT", "AR": "ACCESS_REVIEW", "ACC": "ACCESS_RECORD"}
    prefix = F.substring_index("node", "-", 1)
    out = F.lit("OTHER")
    for k, v in kinds.items():
        out = F.when(prefix == k, v).otherwise(out)
    return out


def blast_radius(reached: DataFrame) -> DataFrame:
    """(source, n_direct, n_indirect, n_controls, impact). Controls are test cases and access records; the impact's bounds (3, 10 nodes) are our own."""
    kind = node_type()
    counts = reached.where("hop > 0").groupBy("source").agg(
        F.count_if(F.col("hop") == 1).alias("n_direct"), F.count_if(F.col("hop") > 1).alias("n_indirect"), F.count_if(kind.isin("TEST_CASE", "ACCESS_RECORD")).alias("n_controls")
    )
    n = F.col("n_direct") + F.col("n_indirect")
    return counts.withColumn("impact", F.when(n >= 10, "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW"))


def impact_by_type(reached: DataFrame) -> DataFrame:
    return reached.where("hop > 0").groupBy(node_type().alias("node_type"), "hop").agg(F.count("*").alias("n_nodes"), F.countDistinct("node").alias("n_distinct"))
