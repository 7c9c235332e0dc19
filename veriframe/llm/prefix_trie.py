"""Conversation prefix trie, families first: conversations of one base id are rebuilt and combined before families meet.

Only digests of turns travel, never texts. A node (a distinct sequence of first d rebuilt turns) is known by its depth and by
two 64-bit sums (exclusive or) of hashes that know a turn's place and its SHA-256; 60 further bits of that digest are compared
wherever sequences are merged, and a difference raises. The steps, each a DataFrame job over small rows:

1. Turns are dealt by ranges of (conversation, turn, digest) and numbered within their range; a conversation that goes over
   several ranges adds the ranges before, one row a range. So no conversation is one task's.
2. Families: a conversation takes over the first turns of its base's (three at most), by a join on the base id.
3. Sums run within blocks of BLOCK depths; what a long conversation's earlier blocks sum to is one more row of a block.
   Rows lie by (base id, block), so each family's trie is made in place: members are counted and the family's smallest one known.
4. Global merging: only the families' combined nodes are shuffled, and summed in map tasks first, so that a first turn
   that a third of all conversations share is a row a task.
5. What a node adds to its ancestors (a leaf, tokens saved) is put at its smallest member's row, summed up that member's
   path by blocks again, and summed by node. No node is joined with its descendants.
6. The digest of the conversations that end at a node is taken over their ids in order as they stream by; a list is never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import durable, text_or_empty, word_count

#: Conversations of a family, and the most turns that one takes from its base: the fixed rule of the rebuilding.
FAMILY, HEAD = 20, 4
#: Depths of a block.
BLOCK = 1_024
NODE = ["depth", "k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, t3, words): turns as 180 bits of the SHA-256 of role and text, and the number of words."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("_sha"), word_count(text).alias("words"))
    bits = [F.conv(F.substring("_sha", 1 + 15 * i, 15), 16, 10).cast("long").alias(f"t{i + 1}") for i in range(3)]
    return rows.select("conv_id", "turn", *bits, "words")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation -> with their number in it, from 0, and the partition's."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        number = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
        if conv[0] == last:
            until = first[1] if len(first) > 1 else len(conv)
            number[:until] += seen
        last, seen = conv[-1], int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64()), pa.array(np.full(len(conv), part), pa.int64())], names=[*batch.schema.names, "_i", "_part"])


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, t1, t2, t3, words, pos) of all turns, pos from 0 in order of turn (null first), then digest; and (conv_id, n_own)."""
    order = ["conv_id", F.asc_nulls_first("turn"), "t1", "t2", "t3", "_tie"]  # equal rows may change places: _tie only spreads them
    dealt = turns_of(conversations).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "t3", "words")
    rows = durable(dealt.mapInArrow(_number, "conv_id long, t1 long, t2 long, t3 long, words long, _i long, _part long"), "trie-turns")
    counts = rows.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A range continues one conversation at most: fewer rows than ranges.
    later = F.broadcast(counts.withColumn("_before", before).where("_before IS NOT NULL").drop("_n"))
    placed = rows.join(later, ["conv_id", "_part"], "left").select("conv_id", "t1", "t2", "t3", "words", (F.col("_i") + F.coalesce("_before", F.lit(0))).alias("pos"))
    return placed, counts.groupBy("conv_id").agg(F.sum("_n").alias("n_own"))


def families(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(base, conv_id, h, n_own, taken, length): each conversation with the turns taken from its base, and its rebuilt length."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEAD - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "t3", "words"))).alias("_head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    met = convs.select(base.alias("base"), "conv_id", h.cast("int").alias("h"), "n_own").join(heads, "base", "left")  # a family's rows meet here: 39 at most
    met = met.withColumn("taken", F.slice(F.coalesce("_head", F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,t3:bigint,words:bigint>>")), 1, F.col("h")))
    return met.select("base", "conv_id", "h", "n_own", "taken", (F.size("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).cast("long").alias("length"))


def _blocks(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / BLOCK).cast("long")))


def paths(turns: DataFrame, family: DataFrame) -> DataFrame:
    """A row for each rebuilt turn: (base, conv_id, length, depth, k1, k2, p1, p2, t3, words, n_family); p: the parent's key. n_family: members in the family, at its smallest member's row; else null."""
    same = ["base", "conv_id", "length"]
    taken = family.select(*same, F.posexplode("taken").alias("_at", "_t")).select(*same, (F.col("_at") + 1).cast("long").alias("depth"), "_t.t1", "_t.t2", "_t.t3", "_t.words")
    shifts = family.where("n_own > h").select(*same, "h", F.size("taken").alias("_k"), _blocks(F.col("n_own")).alias("_block"))
    own = turns.withColumn("_block", F.floor(F.col("pos") / BLOCK).cast("long")).join(shifts, ["conv_id", "_block"]).where("pos >= h").select(*same, (F.col("pos") - F.col("h") + F.col("_k") + 1).alias("depth"), "t1", "t2", "t3", "words")
    rows = taken.unionByName(own).withColumn("block", F.floor((F.col("depth") - 1) / BLOCK).cast("long"))
    rows = rows.withColumn("a", F.xxhash64("depth", "t1", "t2")).withColumn("b", F.xxhash64("t2", "depth", "t1"))
    # What the blocks before sum to, of the conversations that have several: a row before the block's first.
    sums = rows.where(F.col("length") > BLOCK).groupBy(*same, "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy(*same).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*same, "block", F.bit_xor("a").over(earlier).alias("a"), F.bit_xor("b").over(earlier).alias("b")).where("block > 0").withColumn("depth", F.col("block") * BLOCK)
    dealt = rows.unionByName(carried, allowMissingColumns=True).repartition("base", "block")
    so_far = Window.partitionBy("base", "block", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = dealt.withColumn("k1", F.bit_xor("a").over(so_far)).withColumn("k2", F.bit_xor("b").over(so_far)).where("words IS NOT NULL")
    node = Window.partitionBy("base", "block", *NODE)
    keyed = keyed.withColumn("_first", F.min("conv_id").over(node)).withColumn("_n", F.count("*").over(node))
    return keyed.select(*same, *NODE, F.col("k1").bitwiseXOR(F.col("a")).alias("p1"), F.col("k2").bitwiseXOR(F.col("b")).alias("p2"), "t3", "words", F.when(F.col("_first") == F.col("conv_id"), F.col("_n")).alias("n_family"))


def merged(path: DataFrame) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv_id, n_convs, words): the families' nodes merged."""
    one = F.when(F.min("t3") == F.max("t3"), F.any_value("words")).otherwise(F.raise_error(F.lit("two turns with one digest")).cast("long"))
    return path.where("n_family IS NOT NULL").groupBy(*NODE, "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.sum("n_family").alias("n_convs"), one.alias("words"))


def _up_the_paths(path: DataFrame, adds: DataFrame, family: DataFrame) -> DataFrame:
    """``adds`` (conv_id, depth, leaf, saved), summed over each node's subtree: (depth, k1, k2, n_leaves, saved_tokens)."""
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    rows = path.select("conv_id", *NODE).join(adds, ["conv_id", "depth"], "left").withColumn("block", block)
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    cut = family.where(F.col("length") > BLOCK).select("conv_id", _blocks(F.col("length")).alias("block")).join(adds.groupBy("conv_id", block.alias("block")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), ["conv_id", "block"], "left")
    carried = cut.select("conv_id", "block", F.sum("leaf").over(later).alias("leaf"), F.sum("saved").over(later).alias("saved")).where("leaf > 0 OR saved > 0").withColumn("depth", (F.col("block") + 1) * BLOCK + 1)
    upward = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(upward), F.lit(0))
    summed = rows.unionByName(carried, allowMissingColumns=True).select(*NODE, total("leaf").alias("leaf"), total("saved").alias("saved")).where("k1 IS NOT NULL")
    return summed.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, k1, k2, conv_id) in order of conv_id -> a row for each node of a batch: its ids joined, and the first of them."""
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            found.setdefault(tuple(node), []).append(conv)
        depth, k1, k2 = zip(*found) if found else ((), (), ())
        arrays = [pa.array(x, pa.int64()) for x in (depth, k1, k2, [ids[0] for ids in found.values()])]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([",".join(map(str, ids)) for ids in found.values()], pa.string())], names=[*NODE, "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids in order of (node, first) -> a row for each node with the hash of its pieces, comma-joined."""
    at, state = None, None
    for batch in batches:
        done = []
        for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node == at:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((*at, state.hexdigest()))
            at, state = node, hashlib.sha256(ids.encode())
        yield _rows(done)
    if state:
        yield _rows([(*at, state.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    *node, sha = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in node), pa.array(sha, pa.string())], names=[*NODE, "ends_sha256"])


def ends(path: DataFrame, family: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which a conversation ends."""
    zero = F.lit(0).cast("long")
    at = path.where("depth = length").select(*NODE, "conv_id").unionByName(family.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    pieces = at.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(_joined_ids, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed_ids, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text, ...) -> a row for each node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first; equal numbers by the SHA-256 of role and text, and rows that are equal in all
    count as a turn each. Null roles and texts are empty. Rows without a conv_id take no part. Texts are read whole where they lie,
    and only their digests are moved. Other columns are ignored, whatever their names. An empty table has no node, not even a root.
    """
    turns, convs = numbered(conversations)
    family = durable(families(turns, convs), "trie-families")
    path = durable(paths(turns, family), "trie-paths")
    nodes = durable(merged(path), "trie-nodes")
    top = family.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    if not top.n_convs:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    own = durable(own.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-own")
    sums = _up_the_paths(path, own.where("leaf > 0 OR saved > 0").select("conv_id", "depth", "leaf", "saved"), family)
    whole = own.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.coalesce(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    root = whole.select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(top.conv_id).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top.n_convs).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deep = own.where("depth > 1").join(parents, ["depth", "p1", "p2"])  # a parent of very many children: a skew join, which Spark splits
    high = own.where("depth = 1").withColumn("parent_conv_id", F.lit(top.conv_id).cast("long"))
    kept = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    every = deep.select(kept).unionByName(high.select(kept)).join(sums, NODE).unionByName(root)
    done = every.join(ends(path, family), NODE, "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE_OP11 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN o ON o.conv_id = c.base AND pos < h UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h),
l AS (SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
path AS (SELECT conv_id, d AS depth, len(turns) AS n, turns[:d] AS node FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM l)),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ids FROM path GROUP BY node, depth),
kids AS (SELECT p.node, count(*) AS n_children FROM nodes k JOIN path p ON p.conv_id = k.conv_id AND p.depth = k.depth - 1 GROUP BY p.node),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[-1].t, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes LEFT JOIN kids USING (node)),
sums AS (SELECT p.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM own JOIN path p ON p.conv_id = own.conv_id AND p.depth <= own.depth GROUP BY p.node)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(own.ids) AS ends_sha256
FROM own JOIN sums USING (node) LEFT JOIN path p ON p.conv_id = own.conv_id AND p.depth = own.depth - 1 LEFT JOIN nodes up ON up.node = p.node
"""
