"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target of words; the rate target / size, at most two, is every document's expected number of copies:
its whole part is taken, its fraction is an inclusion probability. The flight phase moves the probabilities of a block
of one source along vectors of the null space of the balancing constraints (documents, and words), keeping both totals
exactly, until at most two of the block are still fractional. What is left of many blocks is gathered into new blocks,
level by level, and only the last two or so of each source are landed: rounded to come nearest the word total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import durable, maybe_broadcast, text_or_empty, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Rows of a block on average; fractional rows of all sources that may be landed at once, a group each.
BLOCK = 5_000
#: Sources whose totals may come to the driver; more are refused.
MAX_SOURCES = 100_000
#: Keys of repeated rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
_EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    rest = share * sum(size.values())
    free = [s for s, _ in order]
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * size[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = most * size[s]
            rest -= out[s]
        free = [s for s in free if s not in over]
    return out


def flight(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probabilities moved, in the given order, to 0 or 1 but for two at most, keeping their sum and the sum of prob * size.

    Three fractional rows always have a direction in which both sums stay: (s2 - s3, s3 - s1, s1 - s2). One goes as far
    along it as the first of the three comes to a bound; rows of equal sizes fall back to moving two against each other.
    """
    p, s = prob.tolist(), size.tolist()
    held: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            step, sign = float("inf"), 1
            for d in (1, -1):  # the shorter way of the two; ties go up
                far = min(((1 - p[i]) if d * v > 0 else p[i]) / abs(v) for i, v in zip(held, u) if v)
                if far < step:
                    step, sign = far, d
            for i, v in zip(held, u):
                p[i] += sign * step * v
                if p[i] < _EPS:
                    p[i] = 0.0
                elif p[i] > 1 - _EPS:
                    p[i] = 1.0
            held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few rows still fractional, each rounded the way that keeps the running word total nearest."""
    p, debt = prob.copy(), 0.0
    for i in np.argsort(-size, kind="stable"):
        if 0 < p[i] < 1:
            want = p[i] * size[i] + debt
            p[i] = 1.0 if abs(want - size[i]) <= abs(want) else 0.0
            debt = want - p[i] * size[i]
    return p


_ROWS = "source string, key long, number long, size long, prob double"


def _flight(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "key", "number"], ascending=[False, True, True], kind="stable")  # short texts last: they are what is left to land
    return rows.assign(prob=flight(rows.prob.to_numpy(), rows["size"].to_numpy()))[["source", "key", "number", "size", "prob"]]


def _land(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = _flight(key, rows)
    return rows.assign(prob=land(rows.prob.to_numpy(), rows["size"].to_numpy()))


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) -> (doc_id, source, size, source_size, target, copies, taken, *keep), one row for each input row.

    ``size`` is the number of words (null text: 0), ``taken`` is copies * size with 0, 1 or 2 copies. Nothing is random: rows are taken
    longest first, then by a hash of doc_id, within blocks set by another hash, so reruns agree. Documents without words and sources
    without words get no copies and a target of 0. Rows that repeat a doc_id and text count each; equal rows may swap their copies. Very long texts
    are counted whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    text = text_or_empty()
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64("doc_id", text).alias("key"), *([F.struct(*keep).alias("_row")] if keep else []))
    rows = durable(wide.drop("_row"), "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: their totals are not collected")
    spark = docs.sparkSession
    of = targets([(r.source, r.size) for r in sums], weights, share, most)
    table = [(r.source, r.size, float(of[r.source]), of[r.source] / r.size if r.size else 0.0, r.n) for r in sums]
    plan = F.broadcast(spark.createDataFrame(table, "source string, source_size long, target double, rate double, n long"))  # at most MAX_SOURCES rows

    def planned(rows: DataFrame) -> DataFrame:
        known = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return known.withColumn("whole", F.floor("rate")).withColumn("prob", F.col("rate") - F.col("whole"))

    known = planned(rows)
    # Rows that repeat a key are told apart by a number, so that each gets its own copies.
    counted = known.where("size > 0 AND prob > 0").groupBy("source", "key", "size", "prob", "n").agg(F.count("*").alias("times"))
    moving = counted.select("source", "key", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("number"), "size", "prob", "n")
    settled: list[DataFrame] = []
    most_rows, level = max((r.n for r in sums), default=0), 0
    while True:
        last = most_rows <= block
        blocks = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(level), "key", "number"), F.ceil(F.col("n") / block))
        done = durable(moving.withColumn("part", blocks).groupBy("source", "part").applyInPandas(_land if last else _flight, _ROWS), "mix-flight")
        if last:
            settled.append(done)
            break
        settled.append(done.where("prob <= 0 OR prob >= 1"))
        # Two at most are left of each block, so the next level's sizes are known without a count.
        most_rows, level = 2 * -(-most_rows // block), level + 1
        left = F.greatest(F.lit(1), 2 * F.ceil(F.col("n") / block ** level))
        moving = done.where("prob > 0 AND prob < 1").join(plan.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("n", left)
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    picked = chosen.where("prob >= 1").groupBy("source", "key").agg(F.count("*").alias("extra"))
    repeated = known.where("size > 0").groupBy("source", "key").count().where("count > 1").select(F.col("source").alias("_s"), F.col("key").alias("_k"))
    picks = picked.select(F.col("source").alias("_s"), F.col("key").alias("_k"), "extra")
    picks = picks.hint("merge") if keep else picks  # texts are joined the same way at every size
    out = planned(wide if keep else rows).join(picks, (F.col("key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "_k")
    return _share(out, durable(repeated, "mix-repeated")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_row.{c}").alias(c) for c in keep])


#: Parts that the rows of a repeated key are numbered in.
PARTS = 64


def _share(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``copies`` of each row: its whole part, and one more for as many rows of a key as were picked. Only rows of keys that repeat are numbered for that; which of a key's rows are picked isn't defined, as they have one id and text."""
    base, extra = F.col("whole").cast("long"), F.coalesce("extra", F.lit(0)).cast("long")
    alone = rows.withColumn("copies", F.when(F.col("size") > 0, base + extra).otherwise(0).cast("long"))
    if repeated.isEmpty():
        return alone
    from pyspark.sql import Window

    repeated = maybe_broadcast(repeated, BROADCAST_KEYS)
    known = (F.col("key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s"))
    # Rows of a key are dealt into parts and numbered in each, after those of the parts before, so that one key may have any number of rows.
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).alias("_part")
    held = durable(rows.join(repeated, known, "left_semi").select("*", part), "mix-several")
    sizes = held.groupBy("source", "key", "_part").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("source", "key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = held.withColumn("_turn", F.row_number().over(Window.partitionBy("source", "key", "_part").orderBy("doc_id"))).join(sizes, known & (F.col("_part") == F.col("_p")))
    several = numbered.withColumn("copies", base + (F.col("_turn") + F.col("_before") <= extra).cast("long")).drop("_turn", "_before", "_part", "_s", "_k", "_p")
    return alone.join(repeated, known, "left_anti").unionByName(several)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
