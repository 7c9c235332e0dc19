"""Hard negatives by a two-dimensional block matrix product (the SUMMA scheme).

The scores of anchors against all rows are a matrix product, made on a grid of cells. Anchors are dealt into blocks, some
blocks to a row of the grid; rows of the table are packed into panels, some panels to a strip, a column of the grid. Strips
lie in buckets and stay there; the panels of anchors are sent to each strip by a cogroup. A task goes through its cell tile by tile: panels of DIMS
dimensions are multiplied into partial tiles, which are added where they are made, and of the whole tile only the best few rows of each
anchor, or of each anchor and positive, are kept. So no score is shuffled but those: the best of each block and strip meet by block.

Two products: positives first, within rows of one label; then negatives, over all rows, whose window of scores follows from
the positives. Blocks are by hash of the id and panels by place, so that no label, however frequent, makes one larger. Of N rows,
N^2 / 50 scores are made, a stated query set against all rows; what is written and shuffled is in proportion to N, but for the anchors, which are sent once to each strip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import bucketed, durable

#: Anchors and rows of a tile, dimensions of a chunk.
ANCHORS, ROWS, DIMS = 512, 1_024, 32
#: What a task holds: blocks of anchors, and bytes of either side's components.
BLOCKS, HELD = 64, 2**26
#: Strips that a table is dealt into for the sake of tasks, of so many panels at least; more where HELD asks for them.
STRIPS, PANELS = 16, 8
#: Scores that wait until they are sorted in, and rows of a cell's first tile; each further one has twice as many.
WAITING, FIRST = 2**16, 32
#: Positives of an anchor, negatives of each, and the window of negative scores in hundredths of the positive's: fixed values.
POSITIVES, NEGATIVES, FROM, TO = 5, 3, 50, 95
#: Sums below these are exact in doubles and in floats, which BLAS multiplies.
EXACT, EXACT_FLOAT = 2**53, 2**24
_SIDE = "ids binary, labels binary, width int, bytes int, least long, panel binary"
_FOUND = "slots binary, found_ids binary, scores binary"
_MOST = np.iinfo(np.int64).max
_NONE = -_MOST


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, with the label that they count for and the components as integers."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = fit.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_r")).select("vec_id", "_r.label", "_r.v")


def _panel(rows: pa.RecordBatch | pa.Table) -> dict:
    """Rows (vec_id, label, v) -> their ids, labels and components as bytes; shorter lists are filled with zeros.

    Of the components what they have above the least is kept, the lowest byte of all first: the others are mostly zeros, which compress.
    """
    lists = rows["v"].combine_chunks() if isinstance(rows, pa.Table) else rows["v"]
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    size, least = _size(int(out.min(initial=0)), int(out.max(initial=0))), int(out.min(initial=0))
    planes = (out - least).astype(f"<u{size}") if size < 8 else out  # the difference may be too large for a type of 8 bytes
    panel = planes.view(np.uint8).reshape(-1, size).T.tobytes()
    return {"ids": rows["vec_id"].to_numpy().tobytes(), "labels": rows["label"].to_numpy().tobytes(), "width": out.shape[1], "bytes": size, "least": least if size < 8 else 0, "panel": panel}


def _components(panel: pa.BinaryScalar, size: int, least: int) -> np.ndarray:
    """The components of a panel, row by row."""
    planes = np.frombuffer(panel.as_buffer(), np.uint8).reshape(size, -1).T.copy()
    return planes.view(f"<u{size}").astype(np.int64).ravel() + least if size < 8 else planes.view("<i8").ravel()


def _size(low: int, high: int) -> int:
    """Bytes of the smallest whole number type that holds both."""
    return next(n for n in (2, 4, 8) if -(2 ** (8 * n - 1)) <= low and high < 2 ** (8 * n - 1))


def _longs(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in column]


def _side(panels: pa.Table, by_id: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Panels -> (ids, labels, components), in the order of the ids or of the panels."""
    parts, widths, sizes = _longs(panels["ids"]), panels["width"].to_pylist(), panels["bytes"].to_pylist()
    ids, labels = np.concatenate(parts), np.concatenate(_longs(panels["labels"]))
    order = np.argsort(ids) if by_id else np.arange(len(ids))
    place = np.argsort(order)
    out, at = np.zeros((len(ids), max(widths)), f"<i{max(sizes)}"), 0
    for own, width, size, least, panel in zip(parts, widths, sizes, panels["least"].to_pylist(), panels["panel"]):
        out[place[at : at + len(own)], :width] = _components(panel, size, least).reshape(len(own), width)
        at += len(own)
    return ids[order], labels[order], out


def _kinds(a: np.ndarray, b: np.ndarray, chunk: int) -> tuple[type, type]:
    """The types in which partial tiles of ``a`` and ``b`` and their sums are exact."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    bounds = [most(a[:, k : k + chunk]) * most(b[:, k : k + chunk]) * min(chunk, a.shape[1] - k) for k in range(0, a.shape[1], chunk)]
    if max(bounds, default=0) >= EXACT:
        raise ValueError("components too large: their products can't be summed exactly")
    return (np.float32, np.float32) if sum(bounds) < EXACT_FLOAT else (np.float64, np.float64 if sum(bounds) < EXACT else np.int64)


def _tile(a: np.ndarray, b: np.ndarray, chunk: int, kind: type) -> np.ndarray:
    """The scores of ``a`` against ``b``: partial tiles of ``chunk`` dimensions, added."""
    total = np.zeros((len(a), len(b)), kind) if not a.shape[1] else (a[:, :chunk] @ b[:, :chunk].T).astype(kind, copy=False)
    for k in range(chunk, a.shape[1], chunk):
        total += (a[:, k : k + chunk] @ b[:, k : k + chunk].T).astype(kind, copy=False)
    return total


def _ranks(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted slots: where each begins, and the place of every entry within its own."""
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, np.int64)
    return first, np.arange(len(slots)) - np.repeat(first, np.diff(np.r_[first, len(slots)]))


def _best(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, barred: Callable, sizes: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores above ``low`` and up to ``high`` of each row of ``a`` and slot, and their rows of ``b``; of equal ones the first.

    low, high: (rows of ``a``, slots). barred(rows of ``a``, rows of ``b``): pairs that don't count. Scores above the least that can still matter wait, and are sorted in many at a time.
    """
    n_slots = low.shape[1]
    scores, at = np.full((low.size, k), _NONE), np.zeros((low.size, k), np.int64)
    least, floor, waiting, n_waiting = low.copy(), low.min(axis=1), [], 0
    of_anchors, of_rows, chunk = sizes
    width = min(a.shape[1], b.shape[1])  # what a vector lacks counts as zeros
    a, b = a[:, :width], b[:, :width]
    kind, sums = _kinds(a, b, chunk)
    bound = EXACT_FLOAT if kind is np.float32 else EXACT if sums is np.float64 else _MOST  # no score is beyond it

    def settle() -> None:
        nonlocal n_waiting
        row, col, score = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        n_waiting = 0
        for some in np.array_split(np.arange(len(row)), math.ceil(len(row) / (4 * WAITING))):
            some = some[~barred(row[some], col[some])]
            e, slot = np.nonzero((score[some, None] > least[row[some]]) & (score[some, None] <= high[row[some]]))
            if not len(e):
                continue
            e, slot = some[e], row[some[e]] * n_slots + slot
            order = np.lexsort((col[e], -score[e], slot))
            e, slot = e[order], slot[order]
            first, rank = _ranks(slot)
            here, of, kept = slot[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(slot)])), rank < k
            both, places = (np.concatenate([x[here], np.full((len(here), k), fill)], axis=1) for x, fill in ((scores, _NONE), (at, 0)))
            both[of[kept], k + rank[kept]], places[of[kept], k + rank[kept]] = score[e[kept]], col[e[kept]]
            best = np.argsort(-both, axis=1, kind="stable")[:, :k]
            scores[here], at[here] = np.take_along_axis(both, best, 1), np.take_along_axis(places, best, 1)
            least.reshape(-1)[here] = np.maximum(least.reshape(-1)[here], scores[here, k - 1])
            rows = np.unique(here // n_slots)
            floor[rows] = least[rows].min(axis=1)

    start, step = 0, min(FIRST, of_rows)
    while start < len(b):
        right = b[start : start + step].astype(kind)
        for top in range(0, len(a), of_anchors):
            tile = _tile(a[top : top + of_anchors].astype(kind), right, chunk, sums)
            above = np.clip(floor[top : top + of_anchors], -bound, bound).astype(sums)
            hit = np.flatnonzero(tile.max(axis=1) > above)
            if len(hit):
                some = tile[hit]
                at_once = np.flatnonzero(some > above[hit, None])
                r, c = np.divmod(at_once, len(right))
                waiting.append((top + hit[r], start + c, some.ravel()[at_once].astype(np.int64)))
                n_waiting += len(r)
                if n_waiting >= WAITING:
                    settle()
        start, step = start + step, min(of_rows, 2 * step)
    if waiting:
        settle()
    return scores.reshape(*low.shape, k), at.reshape(*low.shape, k)


def _cell(left: pa.Table, right: pa.Table, sizes: tuple[int, int, int], negatives: bool) -> pa.Table:
    """A cell of the grid -> for each block of anchors the best rows of the strip: slots, their ids and scores. A slot is an anchor, or an anchor and a positive."""
    out = {"block": [], "slots": [], "found_ids": [], "scores": []}
    if left.num_rows and right.num_rows:
        anchors, rows = _side(left, False), _side(right, True)  # of equal scores the first is then that of the smallest id
        scores, at = (_negatives if negatives else _positives)(left, anchors, rows, sizes)
        lengths = [len(x) for x in _longs(left["ids"])]
        for block, end, n in zip(left["block"].to_pylist(), np.cumsum(lengths), lengths):
            own, ids = scores[end - n : end].reshape(n * scores.shape[1], -1), rows[0][at[end - n : end]].reshape(n * scores.shape[1], -1)
            slot, place = np.nonzero(own > _NONE)
            for name, x in zip(out, (block, slot.tobytes(), ids[slot, place].tobytes(), own[slot, place].tobytes())):
                out[name].append(x)
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("slots", pa.binary()), ("found_ids", pa.binary()), ("scores", pa.binary())]))


def _positives(_: pa.Table, anchors: tuple, rows: tuple, sizes: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The best rows of each anchor's label, the anchor itself left out; label by label."""
    (a_ids, a_labels, a), (b_ids, b_labels, b) = anchors, rows
    scores, at = np.full((len(a), 1, POSITIVES), _NONE), np.zeros((len(a), 1, POSITIVES), np.int64)
    by_label, there = np.argsort(a_labels, kind="stable"), np.argsort(b_labels, kind="stable")
    labels, first = np.unique(a_labels[by_label], return_index=True)
    begin, end = (np.searchsorted(b_labels[there], labels, side) for side in ("left", "right"))
    for x, lo, hi in zip(np.split(by_label, first[1:]), begin, end):
        y, bare = there[lo:hi], np.full((len(x), 1), _NONE)
        scores[x], own = _best(a[x], b[y], bare, -bare, POSITIVES, lambda r, c, x=x, y=y: a_ids[x[r]] == b_ids[y[c]], sizes)
        at[x] = y[own] if len(y) else 0
    return scores, at


def _negatives(armed: pa.Table, anchors: tuple, rows: tuple, sizes: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The best rows of another label of each anchor and positive, within the positive's window."""
    (_, a_labels, a), (_, b_labels, b) = anchors, rows
    low, high = np.full((len(a), POSITIVES), _MOST), np.full((len(a), POSITIVES), _NONE)
    at = 0
    for ids, slots, positive in zip(*(_longs(armed[c]) for c in ("ids", "slots", "scores"))):
        q, r = np.divmod(positive, 100)  # so that no product is too large
        place = (at + slots, _ranks(slots)[1])
        low[place], high[place] = q * FROM - (-r * FROM) // 100 - 1, q * TO + r * TO // 100
        at += len(ids)
    return _best(a, b, low, high, NEGATIVES, lambda r, c: a_labels[r] == b_labels[c], sizes)


def _merged(found: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the strips found for a block -> (slots, ids, scores), the best ``k`` of each slot, in order."""
    slots, ids, scores = (np.concatenate([np.zeros(0, np.int64), *_longs(found[c])]) for c in ("slots", "found_ids", "scores"))
    order = np.lexsort((ids, -scores, slots))
    order = order[_ranks(slots[order])[1] < k]
    return slots[order], ids[order], scores[order]


def _armed(found: pa.Table, anchors: pa.Table) -> pa.Table:
    """A block of anchors with the positives that the strips found for it."""
    for name, x in zip(("slots", "found_ids", "scores"), _merged(found, POSITIVES)):
        anchors = anchors.append_column(name, pa.array([x.tobytes()] * anchors.num_rows, pa.binary()))
    return anchors


def _rows(found: pa.Table, armed: pa.Table) -> pa.Table:
    """A block's anchors, positives and the negatives that the strips found for these."""
    slots, ids, scores = _merged(found, NEGATIVES)
    anchor, positive = np.divmod(slots, POSITIVES)
    out = [np.zeros(0, np.int64)] * 6
    if len(slots) and armed.num_rows:
        a_ids, of, p_ids, p_scores = (_longs(armed[c])[0] for c in ("ids", "slots", "found_ids", "scores"))
        p = np.searchsorted(of, anchor) + positive
        out = [a_ids[anchor], p_ids[p], _ranks(slots)[1] + 1, ids, p_scores[p], scores]
    return pa.table(out, schema=pa.schema([(n, pa.int32() if n == "rank" else pa.int64()) for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]))


def _packed(batches: Iterator[pa.RecordBatch], rows: int, strips: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows -> panels, dealt to the strips in turn."""
    at = TaskContext.get().partitionId()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield pa.RecordBatch.from_pylist([{"strip": strips[at % len(strips)]} | _panel(batch.slice(start, rows))], schema=_schema("strip"))
            at += 1


def _schema(key: str) -> pa.Schema:
    return pa.schema([(key, pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("bytes", pa.int32()), ("least", pa.int64()), ("panel", pa.binary())])


def _keys(spark, n: int) -> list[int]:
    """A number for each of ``n`` buckets, which holds no other of them."""
    found = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id").alias("key")).collect()
    return sorted(r.key for r in found)


def _grid(anchors: DataFrame, strips: DataFrame, keys: list[int], n_rows: int, sizes: tuple[int, int, int], negatives: bool) -> DataFrame:
    """What each strip has for each block of ``anchors``; cells of one row of the grid after the other, so that strips are read again and not shuffled."""
    cells = []
    for i in range(n_rows):
        sent = anchors.where(F.col("block") % n_rows == i).withColumn("strip", F.explode(F.array(*map(F.lit, keys)).cast("array<long>")))
        cells.append(sent.groupBy("strip").cogroup(strips.groupBy("strip")).applyInArrow(lambda left, right: _cell(left, right, sizes, negatives), f"block long, {_FOUND}"))
    return reduce(DataFrame.union, cells)


def hard_negatives(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """``embeddings`` (vec_id, label, embedding, ...) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Of rows that repeat an id the
    smallest by (label, vector) does. What a shorter vector lacks counts as zeros; an empty one scores 0. Equal scores go by the smaller
    id. Other columns are ignored, whatever their names. No anchor, no rows. Components so large that products can't be summed exactly raise.
    """
    spark = embeddings.sparkSession
    vectors = durable(whole_vectors(embeddings), "vectors")
    anchor = F.col("vec_id") % every == 0
    size = vectors.agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.max(F.size("v")).alias("dims"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    length = max(1, (size.dims or 0) * _size(size.low or 0, size.high or 0))  # bytes of the longest vector
    of_anchors, of_rows = (max(1, min(n, HELD // length)) for n in (ANCHORS, ROWS))
    sizes, n_blocks = (of_anchors, of_rows, DIMS), max(1, math.ceil(size.anchors / of_anchors))
    n_rows = math.ceil(n_blocks / max(1, min(BLOCKS, HELD // (of_anchors * length))))
    keys = _keys(spark, max(1, min(STRIPS, math.ceil(size.n / (PANELS * of_rows))), math.ceil(size.n * length / HELD)))
    strips = bucketed(vectors.mapInArrow(lambda batches: _packed(batches, of_rows, keys), f"strip long, {_SIDE}"), "strips", len(keys), ("strip",))
    dealt = vectors.where(anchor).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("long"))
    blocks = durable(dealt.groupBy("block").applyInArrow(lambda key, rows: pa.Table.from_pylist([{"block": key[0].as_py()} | _panel(rows)], schema=_schema("block")), f"block long, {_SIDE}"), "blocks")
    found = _grid(blocks, strips, keys, n_rows, sizes, False)
    armed = durable(found.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_armed, f"block long, {_SIDE}, {_FOUND}"), "armed-blocks")
    best = _grid(armed.drop("found_ids"), strips, keys, n_rows, sizes, True)
    return best.groupBy("block").cogroup(armed.groupBy("block")).applyInArrow(_rows, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
