"""Exact duplicates by an exchange of Golomb-coded fingerprints.

The task that reads some documents sorts the 64-bit fingerprints of its run of texts, keeps one of equals (noting that
there were several), and sends every owner (an equal range of the fingerprint space) the sorted differences, Rice
coded (Golomb with a power of two). The run itself, its rows with their place in the sorted order, stays where it is
written, in buckets by run. An owner merges the codes it gets and answers each with a bitmap of the fingerprints that
occur elsewhere or were repeated. The bitmaps go to the runs, whose rows are not shuffled for that; only rows whose bit
is set, the suspects, go on to have their bytes compared: they are grouped by the normalised text itself, summed in the
map tasks first, so that a group of any size is one row of each task in that shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import SPACES, bucketed, durable, maybe_broadcast, slices, small_batches, text_or_empty

#: Rows of a sender's run at most, and fingerprints of an owner on average.
RUN_ROWS, OWNER_ROWS = 200_000, 1_000_000
#: Ids of suspects that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_DELETE = SPACES.encode()


def normalised(text: bytes) -> bytes:
    return text.translate(None, _DELETE)


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct uint64 -> (Rice parameter, bytes): unary high bits, then fixed low bits, of the differences."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(gaps.max()).bit_length() - 1 if len(gaps) == 1 else int(np.median(gaps)).bit_length() - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    while high.sum() > 8 * len(gaps) + 64:  # a few wide gaps would make the unary part long
        k += 1
        high >>= 1
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(k: int, n: int, data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    high = np.diff(ends, prepend=-1) - 1
    start = -(-int(ends[-1] + 1) // 8) * 8
    low = bits[start : start + n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) | low.sum(axis=1, dtype=np.uint64), dtype=np.uint64)


def encode(fps: np.ndarray, owners: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """(owner, number, Rice parameter, code, bits of those that occur more than once) of a run's fingerprints; distinct, by owner, in order."""
    distinct, counts = np.unique(fps, return_counts=True)
    owner = ((distinct >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(distinct) else []
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(distinct)]):
        k, data = rice_encode(distinct[a:b] - np.uint64(-(-(int(owner[a]) << 32) // owners) << 32))
        out.append((int(owner[a]), int(b - a), k, data, np.packbits(counts[a:b] > 1).tobytes()))
    return out


_ROWS = "doc_id long, chars long, sha binary, place long, run long"
_CODES = "owner long, n long, k long, data binary, repeated binary"
_NAMES = ["doc_id", "chars", "sha", "place", "run", "owner", "n", "k", "data", "repeated"]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def runs_and_codes(docs: DataFrame, owners: int, run_rows: int = RUN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, chars, sha, place, run), one row for each of ``docs``, in buckets by run, and (owner, run, n, k, data, repeated), the codes sent.

    Both are made in one pass by the task that reads the texts. A run is what a task read, at most ``run_rows`` rows; a row's place is that of its fingerprint among the run's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        chars: list[int] = []
        digests: list[bytes] = []

        def table(columns: list) -> pa.RecordBatch:
            n = len(next(c for c in columns if c is not None))
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            fps = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
            name, place = task << 20 | number, np.unique(fps, return_inverse=True)[1].ravel()
            for a in range(0, len(ids), 20_000):
                part = slice(a, a + 20_000)
                yield table([ids[part], chars[part], digests[part], place[part], np.full(len(ids[part]), name), *[None] * 5])
            codes = list(zip(*encode(fps, owners)))
            yield table([None, None, None, None, np.full(len(codes[0]), name), *codes])
            number += 1
            for x in (ids, chars, digests):
                x.clear()

        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            ids += batch.column(0).to_pylist()
            digests += [hashlib.sha256(normalised(t)).digest() for t in texts]
            chars += [len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in texts]
            if len(ids) >= run_rows:
                yield from close()
        if ids:
            yield from close()

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    both = texts.mapInArrow(run, f"{_ROWS}, {_CODES}").withColumn("code", F.col("owner").isNotNull())
    both = bucketed(both, "dedup-runs", docs.sparkSession.sparkContext.defaultParallelism, ("run",), partition_by=("code",), placed=True)
    return both.where("NOT code").select("doc_id", "chars", "sha", "place", "run"), both.where("code").select("owner", "run", "n", "k", "data", "repeated")


def bitmaps(codes: DataFrame) -> DataFrame:
    """(run, bits): of each run the bitmap of its distinct fingerprints, in order, that another run has or that it has more than once, as 32-bit words."""

    def own(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([rice_decode(k, n, d) for k, n, d in zip(part.k, part.n, part.data)])
        _, at, counts = np.unique(every, return_inverse=True, return_counts=True)
        shared = counts[at.ravel()] > 1
        rows, start = [], 0
        for run, n, repeated in zip(part.run, part.n, part.repeated):
            bits = shared[start : start + n] | np.unpackbits(np.frombuffer(repeated, np.uint8))[:n].astype(bool)
            rows.append((key[0], run, n, np.packbits(bits).tobytes()))
            start += n
        return pd.DataFrame(rows, columns=["owner", "run", "n", "bits"])

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("owner")
        bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(part.bits, part.n)])
        words = np.packbits(np.pad(bits, (0, -len(bits) % 32)), bitorder="little").view("<u4").astype(np.int64)
        return pd.DataFrame({"run": [key[0]], "bits": [words.tolist()]})

    answers = codes.groupBy("owner").applyInPandas(own, "owner long, run long, n long, bits binary")
    return answers.groupBy("run").applyInPandas(join, "run long, bits array<long>")


def exact_groups(docs: DataFrame, owner_rows: int = OWNER_ROWS, broadcast_ids: int = BROADCAST_IDS, run_rows: int = RUN_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, keep_id, group_size, kept, sha): one row for each input row.

    Texts are equal when identical without white space; null counts as empty. Of equal texts the longest in code
    points, then the smallest doc_id stays (null ids last). Rows that repeat a doc_id and text each get a row and count
    in group_size; all rows of the kept doc_id that have the kept length are marked kept. Very long texts are hashed whole, and compared
    whole if suspect. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    owners = max(1, -(-docs.count() // owner_rows))  # for a Parquet table a look at its footers
    rows, codes = runs_and_codes(docs, owners, run_rows)
    word = F.get("bits", F.floor(F.col("place") / 32).cast("int"))
    bit = F.call_function("shiftright", word, F.pmod("place", F.lit(32)).cast("int")).bitwiseAND(F.lit(1)) == 1
    judged = durable(rows.join(durable(bitmaps(codes), "dedup-bitmaps").hint("merge"), "run").select("doc_id", "chars", "sha", bit.alias("suspect")), "dedup-judged", "suspect")
    single, found = (judged.where(F.col("suspect") == x).select("doc_id", "chars", "sha") for x in (False, True))
    ids = maybe_broadcast(durable(found.select(F.col("doc_id").alias("_id")).distinct(), "dedup-ids"), broadcast_ids)
    plain = F.translate(text_or_empty(), SPACES, "")
    best = F.min(F.struct(-F.char_length("t"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"), plain.alias("plain"))
        .join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        .groupBy("plain")
        .agg(F.count("*").alias("group_size"), best.alias("best"))
        .select(F.unhex(F.sha2("plain", 256)).alias("sha"), "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("keep_chars"))
    )
    text_sha256 = F.lower(F.hex("sha")).alias("text_sha256")
    # A suspect whose id other, single texts have too is in a group of its own.
    grouped = found.join(groups, "sha").select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"), text_sha256)
    return single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha256).unionByName(grouped)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY p) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(p) AS text_sha256
FROM d WINDOW w AS (PARTITION BY p ORDER BY length(t) DESC, doc_id)
"""
