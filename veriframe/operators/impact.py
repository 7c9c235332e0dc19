"""Downstream impact: how many records of each kind a record reaches, and the dependency that itself reaches most.

Cycles are condensed to components first. Then what a component reaches is passed bottom-up, level by level, as bitmaps: a row of
64 records of a kind for each component that reaches any of them, merged by ``bit_or``. Counts are the set bits, so that a diamond counts
once and sources never meet the single nodes that they reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions.runtime import checkpointed
from veriframe.operators import graph
from veriframe.operators.graph import node_type

#: Own definition: bounds of the impact's grades, as of the blast radius.
HIGH, MEDIUM = 10, 3
#: Kinds that are counted by themselves; their places (from 1) are part of a word's number, 0 stands for all others.
COUNTED = ["REQUIREMENT", "TEST_CASE", "RISK", "CHANGE", "ACCESS_RECORD"]
#: Links to a record, from which it is common; rows that common records give, which are broadcast at most; more are joined by a shuffle.
COMMON, BROADCAST_ROWS = 1_000, 500_000


def _core(links: DataFrame) -> DataFrame:
    """Links (u, v) that can lie on a cycle: what begins or ends nowhere is taken off until nothing is."""
    n = links.count()
    while n:
        ends, begins = links.select(F.col("v").alias("u")).distinct(), links.select(F.col("u").alias("v")).distinct()
        links = checkpointed(links.join(ends, "u", "left_semi").join(begins, "v", "left_semi").select("u", "v"))
        left = links.count()
        if left == n:
            break
        n = left
    return links


def cycles(edges: DataFrame) -> DataFrame:
    """``edges`` (source_id, target_id) -> (node, component) of the nodes that lie on cycles with others; a component is named by its greatest node.

    By colours: the greatest node that reaches a node is its colour; those of a colour that reach its node in turn are a component. What is left goes on.
    """
    links = _core(checkpointed(edges.where("source_id <> target_id").select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).distinct()))
    found = edges.sparkSession.createDataFrame([], "node string, component string")
    while not links.isEmpty():
        colour = checkpointed(links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct().withColumn("colour", F.col("node")))
        changed = True
        while changed:
            sent = links.join(colour, links["u"] == colour["node"]).groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("_new"))
            colour = checkpointed(colour.join(sent, "node", "left").select("node", F.greatest("colour", "_new").alias("colour"), (F.coalesce("_new", F.lit("")) > F.col("colour")).alias("_up")))
            changed = not colour.where("_up").isEmpty()
            colour = colour.drop("_up")
        of = lambda name: colour.select(F.col("node").alias(name), F.col("colour").alias(f"c{name}"))
        within = checkpointed(links.join(of("u"), "u").join(of("v"), "v").where("cu = cv").select("u", "v", F.col("cu").alias("component")))
        front = checkpointed(colour.where("node = colour").select("node", F.col("colour").alias("component")))
        members = front
        while not front.isEmpty():
            before = within.join(front.select(F.col("node").alias("v"), "component"), ["v", "component"]).select(F.col("u").alias("node"), "component").distinct()
            front = checkpointed(before.join(members, "node", "left_anti"))
            members = members.unionByName(front)
        members = checkpointed(members)
        found = found.unionByName(members)
        gone = members.select(F.col("node").alias("u"))
        links = _core(checkpointed(links.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v")))
    sizes = found.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
    return checkpointed(found.join(sizes, "component", "left_semi").select("node", "component"))


def _levels(dag: DataFrame) -> list[DataFrame]:
    """Of links (u, v) without cycles: the nodes (c) that have a target, by the longest way down from them, a table for each length from 1."""
    undone = checkpointed(dag.select(F.col("u").alias("c")).distinct())
    done = checkpointed(dag.select(F.col("v").alias("c")).distinct().join(undone, "c", "left_anti"))
    left, levels = dag, []
    while not done.isEmpty():
        left = checkpointed(left.join(done.withColumnRenamed("c", "v"), "v", "left_anti").select("u", "v"))
        still = checkpointed(left.select(F.col("u").alias("c")).distinct())
        done = checkpointed(undone.join(still, "c", "left_anti"))
        undone = still
        levels.append(done)
    return levels[:-1]  # the last is empty


def downstream_impact(edges: DataFrame) -> DataFrame:
    """``edges`` (source_id, target_id, ...) -> for each record that has a dependency: (source, n_requirements, n_tests, n_risks, n_changes, n_controls, n_total, top_dependency, top_impact, impact).

    Counts are of the other records that can be reached, each once. Controls are test cases and access records. The top
    dependency is the one reached that itself reaches most others (top_impact); of equal ones the smallest id. Edges without an end are left out, and
    may be repeated.

    Most records are outer ones: they have dependencies, and nothing depends on them. Levels and cycles are found among the inner ones only, and only
    records that something depends on are numbered. An outer record is then counted from what its direct dependencies give it, in one shuffle.
    """
    links = graph._links(edges.where("source_id <> target_id")).select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    ends = checkpointed(links.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n")))
    inner = checkpointed(links.select("u").distinct().join(ends.select(F.col("node").alias("u")), "u", "left_semi"))
    among = checkpointed(links.join(inner, "u", "left_semi"))
    looped = cycles(among.select(F.col("u").alias("source_id"), F.col("v").alias("target_id")))
    has_cycles = not looped.isEmpty()

    def of(rows: DataFrame, end: str) -> DataFrame:
        """``rows`` with the component of ``end`` in its place; a record without a cycle is one."""
        if not has_cycles:
            return rows
        return rows.join(looped.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")

    nodes = of(ends.withColumn("c", F.col("node")), "c").withColumn("kind", node_type())
    nodes = checkpointed(nodes.repartitionByRange("kind", "node").sortWithinPartitions("kind", "node").withColumn("_id", F.monotonically_increasing_id()))  # numbers without gaps within a partition
    dag = checkpointed(of(of(among, "u"), "v").where("u <> v").distinct())

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_id") % 64).cast("int"))
    kind = F.coalesce(F.array_position(F.lit(COUNTED), F.col("kind")), F.lit(0))
    word = (F.floor(F.col("_id") / 64).cast("long") * 16 + kind).alias("word")  # 64 numbers and their kind
    own = checkpointed(nodes.groupBy("c", word).agg(F.bit_or(bit).alias("bits")))
    below = own.where(F.lit(False))  # what components reach
    for level in _levels(dag):
        ways = dag.join(level.withColumnRenamed("c", "u"), "u", "left_semi").withColumnRenamed("v", "c")
        new = ways.join(own.unionByName(below), "c").groupBy(F.col("u").alias("c"), "word").agg(F.bit_or("bits").alias("bits"))
        below = below.unionByName(checkpointed(new))

    kinds = {"n_requirements": ["REQUIREMENT"], "n_tests": ["TEST_CASE"], "n_risks": ["RISK"], "n_changes": ["CHANGE"], "n_controls": ["TEST_CASE", "ACCESS_RECORD"]}
    n = lambda names: F.coalesce(F.sum(F.when(F.pmod("word", F.lit(16)).isin([COUNTED.index(k) + 1 for k in names]), F.bit_count("bits"))), F.lit(0))
    counts = [*[n(k).alias(name) for name, k in kinds.items()], F.sum(F.bit_count("bits")).alias("n_total")]
    # A cycle's records reach each other too, but not themselves.
    ring = looped.select(F.col("component").alias("c")).distinct()
    reached = below.unionByName(own.join(ring, "c", "left_semi")).groupBy("c").agg(*counts)
    first = nodes.groupBy("c").agg(F.min("node").alias("_first"), F.sum("n").alias("_n"))
    second = nodes.join(looped, "node", "left_semi").join(first, "c").where("node <> _first").groupBy("c").agg(F.min("node").alias("_second"))
    ranked = checkpointed(first.join(second, "c", "left").join(reached, "c", "left").na.fill(0))
    self = F.when(F.col("_second").isNull(), 0).otherwise(1)
    targets = checkpointed(ranked.select("c", F.struct((self - F.col("n_total")).alias("less"), F.col("_first").alias("id")).alias("_t"), "_n"))
    best = dag.join(targets.withColumnRenamed("c", "v"), "v").groupBy(F.col("u").alias("c")).agg(F.min("_t").alias("_t"))
    every = nodes.join(ranked, "c").join(best, "c", "left").where("_t IS NOT NULL OR _second IS NOT NULL")
    less = [(F.col(name) - F.when(F.col("kind").isin(*k), self).otherwise(0)).alias(name) for name, k in kinds.items()]
    other = F.when(F.col("node") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    top = F.when(F.col("_second").isNull(), F.col("_t.id")).otherwise(other)
    most = F.when(F.col("_second").isNull(), -F.col("_t.less")).otherwise(F.col("n_total") - self)
    of_inner = every.select(F.col("node").alias("source"), *less, (F.col("n_total") - self).alias("n_total"), top.alias("top_dependency"), most.alias("top_impact"))

    outer = of(links.join(inner, "u", "left_anti"), "v").withColumnRenamed("v", "c")
    given = own.join(targets, "c").unionByName(below.join(targets.select("c", "_n"), "c"), allowMissingColumns=True)  # a target's rank stands at its own records
    # What many depend on is broadcast: links to it are then summed where they lie, by their source.
    common = checkpointed(given.where(F.col("_n") >= COMMON).drop("_n"))
    given, rows = given.drop("_n"), []
    if common.count() <= BROADCAST_ROWS:
        common = F.broadcast(common)
        rows = [outer.join(common, "c").groupBy("u", "word").agg(F.bit_or("bits").alias("bits"), F.min("_t").alias("_t"))]
        outer = outer.join(F.broadcast(common.select("c").distinct()), "c", "left_anti")
    rows = reduce(DataFrame.unionByName, [outer.join(given, "c").select("u", "word", "bits", "_t"), *rows])
    words = rows.repartition("u").groupBy("u", "word").agg(F.bit_or("bits").alias("bits"), F.min("_t").alias("_t"))
    of_outer = words.groupBy("u").agg(*counts, F.min("_t").alias("_t")).select(F.col("u").alias("source"), *kinds, "n_total", F.col("_t.id").alias("top_dependency"), (-F.col("_t.less")).alias("top_impact"))
    grade = F.when(F.col("n_total") >= HIGH, "HIGH").when(F.col("n_total") >= MEDIUM, "MEDIUM").otherwise("LOW")
    return of_inner.unionByName(of_outer).withColumn("impact", grade)
