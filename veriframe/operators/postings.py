"""A postings table of terms and identifiers, and many queries ranked over it in one pass.

Identifiers (record numbers, rule ids, regulation references) are terms as a whole. The table lies by passage, a list of postings each, so
that neither postings nor scores are shuffled. A block holds a term's postings of like weight, so that its heaviest bounds them all. A
search first scores the heaviest block of each term, which gives each query a score that its k-th best can't be below;
then only blocks that can still matter are scored. The result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.runtime import checkpointed
from veriframe.operators.retrieval import B, K1, KEEP, RRF_K

#: Of lower-cased text: references to regulations and guidelines, numbered sections, ids of hyphenated parts of which one
#: after the first has a digit, else runs of letters and digits.
TERM = (
    r"[0-9]+ cfr [0-9]+(?:\.[0-9]+)?(?:\([a-z0-9]+\))*"
    r"|ich [a-z][0-9]+[a-z]?(?:\(r[0-9]+\))?"
    r"|[0-9]+(?:\.[0-9]+)+(?:\([a-z0-9]+\))*"
    r"|[a-z][a-z0-9]*+(?:-[a-z0-9]+)*?-[a-z]*[0-9][a-z0-9]*(?:-[a-z0-9]+)*"
    r"|[a-z0-9]+"
)
#: Blocks of a term, by weight; rows of a search's plan that are sent to all tasks at most; pairs of a passage and a query that a task scores at once.
BLOCKS, MOST_BROADCAST, CELLS = 16, 200_000, 1_000_000


def terms(text: Column) -> Column:
    """The terms of a text in order; white space within one is a single space. Null has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    return F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))


def is_identifier(term: Column) -> Column:
    return term.rlike("[^a-z0-9]")


@dataclass
class Index:
    """postings (term, block, doc_id, chunk_index, tf, positions, weight), blocks (term, block, n, most), the number of passages, and the table of passages with their lists that the postings are read from."""

    postings: DataFrame
    blocks: DataFrame
    passages: int
    lists: DataFrame


_LIST = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32())), ("weight", pa.float64())]))


def _lists(mean: float, k1: float, b: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, chunk_index, _t) -> (doc_id, chunk_index, list): a passage's postings by term."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["_t"]
            n = np.diff(words.offsets.to_numpy())
            row, starts = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
            coded = words.flatten().dictionary_encode()
            names = coded.dictionary
            place = np.empty(len(names), np.int64)
            place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
            code = place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            order = np.lexsort((code, row))  # stable: positions of a term stay in order
            row, code, position = row[order], code[order], (np.arange(len(order)) - starts)[order]
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
            tf, held = np.diff(np.append(first, len(row))), row[first]
            weight = tf / (tf + k1 * (1 - b + b * n[held] / mean))  # below 1
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(position, pa.int32()))
            rows = pa.StructArray.from_arrays([names.take(pc.sort_indices(names)).take(pa.array(code[first])), pa.array(tf, pa.int32()), positions, pa.array(weight)], fields=list(_LIST.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(held, minlength=len(n)))), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["chunk_index"], lists], names=["doc_id", "chunk_index", "list"])

    return of


def index(passages: DataFrame, k1: float = K1, b: float = B) -> Index:
    """Of ``passages`` (doc_id, chunk_index, content), one row a key. Texts are split once, and a passage's terms are summed where it lies: only counts of (term, block) are shuffled."""
    split = checkpointed(passages.select("doc_id", "chunk_index", terms(F.col("content")).alias("_t")))
    size = split.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("mean")).first()
    key = split.select("doc_id", "chunk_index").schema.simpleString()[7:-1]
    lists = checkpointed(split.mapInArrow(_lists(size.mean or 1.0, k1, b), f"{key.replace(':', ' ')}, list array<struct<term: string, tf: int, positions: array<int>, weight: double>>"))
    each = lists.select("doc_id", "chunk_index", F.explode("list").alias("_p"))
    postings = each.select("_p.term", F.floor(F.col("_p.weight") * BLOCKS).cast("int").alias("block"), "doc_id", "chunk_index", "_p.tf", "_p.positions", "_p.weight")
    return Index(postings, checkpointed(postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("weight").alias("most"))), size.n, lists)


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table written once, and whether its rows are few enough for broadcast."""
    held = checkpointed(df)
    few = held.count() <= MOST_BROADCAST
    return (F.broadcast(held) if few else held), few


def _best(asked: pa.Table, k: int, only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, chunk_index, list) -> (_q, doc_id, chunk_index, score, n_identifiers): the ``k`` best passages of a task for each query of ``asked`` (_q, term, block, idf, named), passages scored a few at a time."""
    asked = asked.take(pc.sort_indices(asked, sort_keys=[("term", "ascending"), ("block", "ascending")]))
    names = asked["term"].unique()
    cell = pc.index_in(asked["term"], value_set=names).to_numpy() * BLOCKS + asked["block"].to_numpy()
    starts = np.searchsorted(cell, np.arange(len(names) * BLOCKS + 1))  # of each (term, block): its queries
    query, idf, named = (asked[c].to_numpy() for c in ("_q", "idf", "named"))
    queries = int(query.max(initial=-1)) + 1

    def scored(batch: pa.RecordBatch) -> pa.Table:
        held = batch["list"]
        row, flat = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy())), held.flatten()
        at = pc.fill_null(pc.index_in(flat.field("term"), value_set=names), -1).to_numpy()
        met = np.flatnonzero(at >= 0)
        weight = flat.field("weight").to_numpy()[met]
        at, row = at[met] * BLOCKS + np.floor(weight * BLOCKS).astype(np.int64), row[met]
        n = starts[at + 1] - starts[at]
        which = np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)
        pair, value = np.repeat(row, n) * queries + query[which], idf[which] * np.repeat(weight, n)
        size = len(held) * queries
        hit = np.flatnonzero(np.bincount(pair, minlength=size))
        sums, names_met = np.bincount(pair, value, size)[hit], np.bincount(pair, named[which], size)[hit]
        rows = pa.table({"_q": hit % queries, "doc_id": batch["doc_id"].take(pa.array(hit // queries)), "chunk_index": batch["chunk_index"].take(pa.array(hit // queries)), "score": np.round(sums.astype(float), 9), "n_identifiers": names_met.astype(np.int32)})
        return rows.filter(pc.field("n_identifiers") > 0) if only else rows

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("_q", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("chunk_index", "ascending")]))
        q = rows["_q"].to_numpy()
        return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, more, step = None, [], max(1, CELLS // max(1, queries))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                more.append(scored(batch.slice(at, step)))
                if sum(map(len, more)) >= CELLS:
                    best, more = cut(pa.concat_tables(([best] if best else []) + more)), []
        if more or best:
            yield from cut(pa.concat_tables(([best] if best else []) + more)).combine_chunks().to_batches()

    return of


def _scores(of: Index, plan: DataFrame, few: bool, k: int, only: bool = False) -> DataFrame:
    """(query_id, doc_id, chunk_index, score, n_identifiers) by ``plan`` (query_id, term, block, idf): with few rows of a plan, the ``k`` best of each task that reads the lists, and nothing else is shuffled; else all, by a join."""
    named = F.when(is_identifier(F.col("term")), 1).otherwise(0)
    if not few:
        sums = of.postings.join(plan, ["term", "block"]).groupBy("query_id", "doc_id", "chunk_index").agg(F.round(F.sum(F.col("idf") * F.col("weight")), 9).alias("score"), F.sum(named).cast("int").alias("n_identifiers"))
        return sums.where("n_identifiers > 0") if only else sums
    asked = plan.select("query_id", "term", "block", "idf", named.alias("named")).toArrow()
    ids = asked["query_id"].unique()
    numbered = asked.append_column("_q", pc.index_in(asked["query_id"], value_set=ids).cast(pa.int64()))
    key = of.lists.select("doc_id", "chunk_index").schema.simpleString()[7:-1].replace(":", " ")
    rows = of.lists.select("doc_id", "chunk_index", F.transform("list", lambda p: F.struct(p["term"].alias("term"), p["weight"].alias("weight"))).alias("list"))
    best = rows.mapInArrow(_best(numbered.drop_columns(["query_id"]), k, only), f"_q long, {key}, score double, n_identifiers int")
    names = plan.sparkSession.createDataFrame(pa.table({"query_id": ids, "_q": np.arange(len(ids))}))
    return best.join(F.broadcast(names), "_q").drop("_q")


def search(of: Index, queries: DataFrame, k: int, k1: float = K1, exact: bool = False, prune: bool = True) -> DataFrame:
    """``queries`` (query_id, text) -> (query_id, rank, doc_id, chunk_index, score, n_identifiers): each query's ``k`` best passages.

    A term counts once in a query. Scores are rounded to nine digits, equal ones go by (doc_id, chunk_index). ``n_identifiers``: the query's identifiers that the passage
    holds; with ``exact`` only passages that hold one are ranked. Queries without a known term have no row; ``prune`` off scores all blocks.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    met = asked.join(of.blocks, "term")
    df = F.sum("n").over(Window.partitionBy("query_id", "term"))  # a term's BLOCKS rows
    idf = F.log(1 + (of.passages - df + 0.5) / (df + 0.5)) * (k1 + 1)
    met = met.withColumn("idf", idf).withColumn("_most", F.col("idf") * F.col("most"))
    top = F.max("_most").over(Window.partitionBy("query_id", "term"))
    plan, few = _small(met.select("query_id", "term", "block", "idf", "_most", top.alias("_top")))
    if prune and not exact:
        first = _scores(of, plan.where("_most = _top").select("query_id", "term", "block", "idf"), few, k).withColumnRenamed("score", "_s")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s")))
        least = first.withColumn("_r", place).where(F.col("_r") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("_s")).alias("_least"))
        whole = plan.select("query_id", "term", "_top").distinct().groupBy("query_id").agg(F.sum("_top").alias("_whole"))
        bounds = plan.join(whole, "query_id").join(least, "query_id", "left")
        plan, few = _small(bounds.where(F.col("_whole") - F.col("_top") + F.col("_most") >= F.coalesce("_least", F.lit(0.0)) - 1e-8).select("query_id", "term", "block", "idf"))
    scored = _scores(of, plan, few, k, exact)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_index"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "chunk_index", "score", "n_identifiers")


def fuse(dense: DataFrame, sparse: DataFrame, exact: DataFrame, keep: int = KEEP, k: int = RRF_K) -> DataFrame:
    """Ranked lists (query_id, rank, doc_id, chunk_index) -> (query_id, place, doc_id, chunk_index, score, exact): reciprocal ranks summed.

    Passages of ``exact`` come before all others, so that an identifier's passages stay however far they are in meaning.
    """
    key = ["query_id", "doc_id", "chunk_index"]
    lists = [rows.select(*key, (1.0 / (k + F.col("rank"))).alias("_v"), F.lit(n == 2).alias("_x")) for n, rows in enumerate((dense, sparse, exact))]
    met = lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy(*key).agg(F.sum("_v").alias("score"), F.max("_x").alias("exact"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc(F.round("score", 9)), "doc_id", "chunk_index"))
    return met.withColumn("place", place).where(F.col("place") <= keep).select("query_id", "place", "doc_id", "chunk_index", "score", "exact")
