"""Near copies by operator 10's anchors, carried on to a similarity of 0.8: what the pipeline's near-duplicate stage calls.

Texts are near copies when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; every link is checked
on the whole sets. Texts with the same set are one node, and copies of a node are never expanded into pairs. Candidates come in four waves, and a pair whose nodes earlier
waves have joined is not looked at again, so that a large group of copies costs a few checks a node, not all its pairs:

1. SimHash fingerprints of the shingles within two bits, found at the anchors of the covering code (simhash.py). At 0.8 about ten of 64
   bits differ, far beyond any radius for which anchors are few, so that this wave finds close copies only;
2. the first of each of the first three bands, of BANDS bands of ROWS min-hashes of the set;
3. the first of each band, and then all pairs of a band that holds WIDE nodes or fewer and several components still;
4. of the nodes in wider bands that still hold several components, all pairs that can be similar, by the rarest shingles of their
   sets: sets of similarity 0.8 share one of the first |s| - 0.8 |s| + 1 when all are put in order of how many sets have them. Pairs
   are made of the nodes of a shingle that WIDE nodes or fewer have among those, where sizes and places allow a similar pair whose
   first common shingle it is; nodes that meet at more common ones are one family, whose sets are held against one another block by block, in tasks of one size, each of which gives a forest and no list of pairs.

Nothing is left out where many texts are alike. Two sets of similarity 0.8 share no band with a chance of (1 - 0.8^5)^24, about 7 in
100,000. The price is paid in families: texts made from one template, most of them alike to 0.75 or so but not to 0.8, are compared
each with each, as nothing short of that tells which are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.llm.common import bucketed, durable, maybe_broadcast, slices, small_batches, with_ids
from veriframe.llm.components import connected_components
from veriframe.llm.simhash import majority, near_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS, WIDE, EARLY = 24, 5, 32, 3
#: Nodes, and shingles, of a block on average; columns of a product at once.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 512, 500_000, 4_096
#: Nodes of candidate pairs, and words of 64 ids, that are broadcast at most; more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Pairs of a node, from which its set is broadcast; shingles that are broadcast so at most. Sets beyond that are sent to the other end of each pair.
HOT, BROADCAST_SHINGLES = 1_000, 4_000_000
_MIX = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles, sorted; a shorter text is one shingle, a blank one has none."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n))


def node_of(hashes: np.ndarray) -> int:
    """A set's number: signed XXH64 of it."""
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), SEED), np.uint64).view(np.int64))


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of a set's bands; none of an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4_096):
        low = np.minimum(low, ((hashes[at : at + 4_096, None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fp, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t or b"") for t in batch.column(1).to_pylist()]
            fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            arrays = [batch.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(fps), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "fp", "bands"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, node long, fp long, bands array<long>")


def with_nodes(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with ``_node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = [node_of(shingles((t or "").encode())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "_node"])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t or b"") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return small_batches(docs).select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, shingles array<long>")


def _pairs(rows: DataFrame, one: Column | str, other: Column | str) -> DataFrame:
    """(u, v), u below v."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (one, other))
    return rows.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def anchored(nodes: DataFrame) -> DataFrame:
    """Wave 1: pairs (u, v) of nodes that fingerprints within two bits join, one for each fingerprint, and one for each further node of a fingerprint."""
    first = durable(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fps")
    same = _pairs(nodes.join(first, "fp"), "node", "first")
    one, other = (first.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in "uv")
    close = _pairs(near_links(first.select("fp")).join(one, "u").join(other, "v").select("nu", "nv"), "nu", "nv")
    return same.unionByName(close)


def pivoted(places: DataFrame) -> DataFrame:
    """Rows of ``divided`` -> pairs (u, v) of each node and the first of its band, if that is of another component."""
    return _pairs(places.where(F.col("first.root") != F.col("root")).select("node", F.col("first.node").alias("end")), "node", "end")


def within(places: DataFrame) -> DataFrame:
    """(band, node, root, n) -> all pairs (u, v) of different components in bands of WIDE nodes or fewer."""
    narrow = places.where(F.col("n") <= WIDE).select("band", "node", "root")
    other = narrow.select("band", F.col("node").alias("end"), F.col("root").alias("end_root"))
    both = narrow.join(other, (narrow["band"] == other["band"]) & (F.col("node") < F.col("end")) & (F.col("root") != F.col("end_root")))
    return both.select(F.col("node").alias("u"), F.col("end").alias("v"))


def divided(places: DataFrame) -> DataFrame:
    """(band, node, root, ...) of the bands that hold more than one component, with their size ``n`` and their ``first`` node by a hash (node, root); the others have nothing left to find."""
    first = F.min(F.struct(F.xxhash64("band", "node").alias("h"), F.col("node"), F.col("root"))).alias("f")
    of = places.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), first).where("a != b").select("band", "n", F.struct("f.node", "f.root").alias("first"))
    return durable(places.join(of, "band"), "near-divided")


def distinct_bands(places: DataFrame, order: str, *kept: Column) -> DataFrame:
    """(band, node, ``order``) -> (band, n, ...): of bands that hold the same nodes, two or more, the first by ``order``; the others would only give the same pairs again. ``kept``: what else is summed for a band.

    Bands are the same if their numbers of nodes and two 64-bit sums of hashes are.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in range(2)]
    bands = places.groupBy("band").agg(F.min(order).alias("first"), F.count("*").alias("n"), *marks, *kept).where("n > 1")
    return bands.groupBy("n", "x0", "x1").agg(F.min_by(F.struct(*[c for c in bands.columns if c not in ("x0", "x1", "n")]), F.struct("first", "band")).alias("b")).select("n", "b.*").drop("first")


def rarest(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) and their ``sets`` -> (node, root, size, of, at, band): of each set the shingles, one of which any similar set has among its own; those that no other set has are left out.

    ``of`` is how many sets have the shingle, ``at`` its place (from 1) in the set's order, by ``of`` and then by value.
    """
    tokens = durable(nodes.join(sets, "node").select("node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("band")), "near-tokens")
    shared = durable(tokens.groupBy("band").agg(F.count("*").alias("of")).where("of > 1"), "near-shared")
    ordered = tokens.join(maybe_broadcast(shared, BROADCAST_NODES), "band").groupBy("node", "root", "size").agg(F.array_sort(F.collect_list(F.struct("of", "band"))).alias("held"))
    alone = F.col("size") - F.size("held")  # shingles of one set come first
    wanted = F.greatest(F.lit(0), F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9) + 1 - alone).cast("int")
    return ordered.select("node", "root", "size", alone.alias("alone"), F.posexplode(F.slice("held", F.lit(1), wanted)).alias("pos", "p")).select("node", "root", "size", "p.of", (F.col("alone") + F.col("pos") + 1).alias("at"), "p.band")


def meeting(rare: DataFrame) -> DataFrame:
    """Rows of ``rarest`` -> pairs (u, v) of different components that meet at a shingle of WIDE nodes or fewer and can be similar by their sizes and the shingle's places in them.

    At the first shingle that two sets share, all that they share is still to come; a similar pair passes there, and need not elsewhere. Of shingles with the same nodes only the first can be that one.
    """
    bands = distinct_bands(rare, "of", F.min("root").alias("a"), F.max("root").alias("b"))
    once = durable(bands.where((F.col("n") <= WIDE) & (F.col("a") != F.col("b"))).select("band"), "near-meeting")
    rows = durable(rare.join(once, "band"), "near-rare")
    other = rows.select("band", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "size", "at")])
    least = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("other_size")) - 1e-9)
    fits = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at")) + 1 >= least
    both = rows.join(other, (rows["band"] == other["band"]) & (F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root")) & fits)
    return both.select(F.col("node").alias("u"), F.col("other_node").alias("v"))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of 0..n-1's component by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, by products of COLUMNS shared shingles at a time."""
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    common = np.intersect1d(*flat)
    place = [np.searchsorted(common, f) for f in flat]
    held = [np.take(common, np.minimum(p, len(common) - 1)) == f if len(common) else np.zeros(len(f), bool) for p, f in zip(place, flat)]
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), COLUMNS):
        parts = []
        for side, p, h, o in zip((left, right), place, held, owner):
            part, here = np.zeros((len(side), COLUMNS), np.float32), h & (p >= at) & (p < at + COLUMNS)
            part[o[here], p[here] - at] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total.astype(np.float64)


def compared(part: pd.DataFrame) -> pd.DataFrame:
    """Rows (node, root, shingles, at, i, j) of blocks i and j of a family -> links (u, v) that join what the similar pairs of one block and the other join."""
    sides = [part[part["at"] == part[c]] for c in ("i", "j")]
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    sets = [[np.asarray(s) for s in side["shingles"]] for side in sides]
    size = [np.array([len(s) for s in side], np.float64) for side in sets]
    both = overlaps(*sets)
    close = (both >= SIMILARITY * (size[0][:, None] + size[1][None, :] - both)) & (sides[0]["root"].to_numpy()[:, None] != sides[1]["root"].to_numpy()[None, :])
    a, b = np.nonzero(close)
    node = np.concatenate([side["node"].to_numpy() for side in sides])
    label = least_labels(len(node), a, b + len(sides[0]))
    return pd.DataFrame({"u": node[label], "v": node})[node[label] != node]


def families(places: DataFrame, sets: DataFrame) -> DataFrame:
    """(band, node, root, first) of wide bands -> links (u, v): nodes that bands join are a family, and any two of its blocks of nodes are compared in a task."""
    of = connected_components(_pairs(places, "node", F.col("first.node"))).select("node", F.col("root").alias("family"))
    rows = durable(places.select("node", "root").distinct().join(of, "node").join(sets, "node"), "near-families")
    n = F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int")
    blocks = durable(rows.groupBy("family").agg(n.alias("blocks")), "near-blocks")
    dealt = rows.join(maybe_broadcast(blocks, BROADCAST_NODES), "family").withColumn("at", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = dealt.select("family", "node", "root", "shingles", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    pairs = other.withColumn("i", F.least("at", "with")).withColumn("j", F.greatest("at", "with")).drop("with")
    return pairs.groupBy("family", "i", "j").applyInPandas(compared, "u long, v long")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose ``sets`` (in buckets of their node) are similar. The set of one end goes to the other's, but for nodes of very many pairs, whose sets are broadcast."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "uv")
    both = F.size(F.array_intersect("su", "sv"))
    fits = (F.least(F.size("su"), F.size("sv")) >= SIMILARITY * F.greatest(F.size("su"), F.size("sv"))) & (both >= SIMILARITY * (F.size("su") + F.size("sv") - both))
    pairs = durable(pairs.distinct(), "near-pairs")
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).groupBy("node").count().where(F.col("count") >= HOT)
    hot = durable(sets.join(ends.select("node"), "node", "left_semi"), "near-hot")
    if not 0 < (hot.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        return durable(pairs.join(left, "u").join(right, "v").where(fits).select("u", "v"), "near-links")
    ids = lambda end: F.broadcast(hot.select(F.col("node").alias(end)))
    of_hot = F.broadcast(hot.select(F.col("node").alias("v"), F.col("shingles").alias("sv")))
    other = pairs.join(ids("v"), "v", "left_anti")
    turned = other.join(ids("u"), "u", "left_semi").select(F.col("v").alias("u"), F.col("u").alias("v"))
    at_hot = pairs.join(ids("v"), "v", "left_semi").select("u", "v").unionByName(turned).join(left, "u").join(of_hot, "v")
    rest = other.join(ids("u"), "u", "left_anti").join(left, "u").join(right, "v")
    return durable(at_hot.unionByName(rest).where(fits).select("u", "v"), "near-links")


def nearest_least(links: DataFrame) -> DataFrame:
    """(node, root): the least node within two links. Nodes of one root are in one component; a component may have several roots, which costs a few checks more and no link."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    once = durable(both.groupBy("u").agg(F.least("u", F.min("v")).alias("least")), "near-least")
    twice = both.join(once.select(F.col("u").alias("v"), F.col("least").alias("of")), "v").groupBy("u").agg(F.min("of").alias("of"))
    return twice.join(once, "u").select(F.col("u").alias("node"), F.least("least", "of").alias("root"))


def near_links_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` and their sketches -> links (u, v) of nodes."""
    nodes = durable(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("doc_id").alias("id")), "near-nodes")
    places = nodes.select("node", F.posexplode("bands").alias("k", "band"))
    several = durable(distinct_bands(places, "k"), "near-bands")
    places = durable(places.join(several.select("band"), "band"), "near-places")
    one = durable(anchored(nodes), "near-pairs")
    ends = places.select("node").unionByName(one.select(F.col("u").alias("node"))).unionByName(one.select(F.col("v").alias("node")))
    wanted = durable(ends.distinct(), "near-wanted")
    ids = nodes.join(wanted, "node", "left_semi").select("id")  # a row of each node, so that no other text is cut up again
    some = with_ids(docs.select("doc_id", "text"), ids, BROADCAST_NODES)
    sets = sets_of(some).join(maybe_broadcast(wanted, BROADCAST_NODES), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = bucketed(sets, "near-sets", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("node",), placed=True)  # read in each wave without a shuffle
    checked = partial(alike, sets=sets)
    found = [checked(one)]

    def labelled(places: DataFrame) -> DataFrame:
        """``places`` with a ``root`` for each node, by the links so far."""
        of = maybe_broadcast(durable(nearest_least(reduce(DataFrame.unionByName, found)), "near-roots"), BROADCAST_NODES)
        return places.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))

    found.append(checked(pivoted(divided(labelled(places.where(F.col("k") < EARLY))))))
    places = divided(labelled(places))
    found.append(checked(pivoted(places)))
    places = divided(labelled(places.select("node", "band")))
    found.append(checked(within(places)))
    wide = places.where(F.col("n") > WIDE).select("node", "root").distinct()
    if not wide.isEmpty():
        rare = durable(rarest(durable(wide, "near-wide"), sets), "near-rarest")
        found.append(checked(meeting(rare)))
        if not (common := divided(rare).where(F.col("n") > WIDE)).isEmpty():
            found.append(durable(families(common, sets), "near-links"))
    return durable(reduce(DataFrame.unionByName, found), "near-all")


def near_components(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, node long, group long, component_id): one row for each input row.

    ``group`` is the same for all rows of a component, ``component_id`` its least doc_id. Null and blank texts are one component. Repeated rows each get a row; null doc_ids too, and never become a
    component's id unless no row of it has one. Very long texts are compared whole. Other columns are ignored. An empty table gives an empty result.
    """
    rows = durable(sketches(docs), "near-rows")
    roots = connected_components(near_links_of(docs, rows))
    of = rows.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("group"))
    of = durable(of, "near-of")
    least = of.groupBy("group").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "node").join(durable(of.join(least, "group"), "near-groups"), "node").select("doc_id", "node", "group", "component_id")


def one_of_each(docs: DataFrame, broadcast_ids: int = BROADCAST_NODES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay: of each component one row of its least doc_id; of several of that id the least by its columns in order.

    Rows are found by their ids; those of ids on several rows, and those without one, by their texts' sets.
    """
    groups = durable(near_components(docs), "near-rows")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max(stays).alias("_stays")).where("_stays").select(F.col("doc_id").alias("id"), "_n")
    ids = durable(ids, "near-ids")
    alone, several = ids.where("_n = 1 AND id IS NOT NULL").select("id"), ids.where("_n > 1 OR id IS NULL").select("id")
    once = with_ids(docs, alone, broadcast_ids)
    if several.isEmpty():
        return once
    by_node = groups.where(stays).groupBy("node").agg(F.first("group").alias("_group"), F.first("component_id").alias("_least"))
    again = with_nodes(with_ids(docs, several, broadcast_ids)).join(by_node.withColumnRenamed("node", "_node"), "_node").where(F.col("doc_id").eqNullSafe(F.col("_least")))
    picked = again.groupBy("_group").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return once.unionByName(picked)
