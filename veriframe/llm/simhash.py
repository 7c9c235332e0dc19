"""SimHash near-duplicates by anchor points of a covering code.

The 64 bits of a fingerprint are cut into A (23 bits), B (23) and C (18). The binary Golay code is a perfect covering
code of 23 bits with radius 3: each A has one *home* codeword within distance 3. Two parts that differ in e bits meet
when one is sent to its home and the other to every codeword within 3 + e. Two fingerprints that differ in at most two
bits agree in one of three views:

* (A, B), with at most one difference over both parts: anchors are pairs of codewords;
* (C, A), C equal and at most one difference in A: anchors are C and a codeword;
* (C, B), likewise with B.

So every fingerprint goes to about twenty anchors, no more, at any size of the corpus, and is compared within its
anchors only. Copies of a fingerprint are one row there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import durable, slices, small_batches
from veriframe.llm.components import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Generator polynomial of the binary Golay code (a fixed value).
GOLAY = 0b101011100011
#: Anchors with more rows than this are searched breadth first, not by all shifts.
WIDE = 64
#: Rows of an anchor that 256 others are held against at once.
STRETCH = 32_768


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of a UTF-8 text: majority of each bit over the XXH64 of its word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[min(SHINGLE, len(words)) :]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t or b"") for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a 23-bit word; by syndrome: the error of weight 3 or less, the up to five of weight 4, whether there are any."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    tables = np.array([[remainder((b << (8 * k)) & 0x7FFFFF) for b in range(256)] for k in range(3)])
    near, four = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    unit = [remainder(1 << i) for i in range(23)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for i in bits:
                s, e = s ^ unit[i], e | 1 << i
            if weight < 4:
                near[s] = e
            else:
                four[s].append(e)
    return tables, near, np.array([x or [0] * 5 for x in four], np.int64), np.array([bool(x) for x in four])


def _codewords(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home codeword of each 23-bit word; rows and codewords of those within distance 4 but not 3."""
    tables, near, four, has = _cosets()
    syndrome = tables[0][part & 255] ^ tables[1][part >> 8 & 255] ^ tables[2][part >> 16]
    rows = np.repeat(np.flatnonzero(has[syndrome]), 5)
    return part ^ near[syndrome], rows, part[rows] ^ four[syndrome[has[syndrome]]].ravel()


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, is home) for every anchor that each fingerprint (uint64) is sent to."""
    a = (fps & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (fps >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fps >> np.uint64(46)).astype(np.int64)
    every = np.arange(len(fps))
    home_a, row_a, far_a = _codewords(a)
    home_b, row_b, far_b = _codewords(b)
    view = [1 << 60, 2 << 60, 3 << 60]
    keys = [
        view[0] | home_a << 23 | home_b, view[0] | far_a << 23 | home_b[row_a], view[0] | home_a[row_b] << 23 | far_b,
        view[1] | c << 23 | home_a, view[1] | c[row_a] << 23 | far_a,
        view[2] | c << 23 | home_b, view[2] | c[row_b] << 23 | far_b,
    ]
    rows = [every, row_a, row_b, every, row_a, every, row_b]
    homes = [np.full(len(r), k in (0, 3, 5)) for k, r in enumerate(rows)]
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def _spanning(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a forest that links what lies within MAX_BITS of each other: breadth first, in blocks, at most one edge a row."""
    rest = np.unique(fps)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:256], front[256:]
            left = []
            for at in range(0, len(rest), STRETCH):  # an anchor of any size is compared in memory of one size
                part = rest[at : at + STRETCH]
                close = np.bitwise_count(block[:, None] ^ part[None, :]) <= MAX_BITS
                hit = close.any(axis=0)
                left.append(part[~hit])
                if hit.any():
                    new = part[hit]
                    yield block[close[:, hit].argmax(axis=0)], new
                    front = np.concatenate([front, new])
            rest = np.concatenate(left)


def _links(keys: np.ndarray, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows sorted by anchor; whole anchors only."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    wide = sizes > WIDE
    us, vs = [], []
    for at, size in zip(first[wide], sizes[wide]):
        for u, v in _spanning(fps[at : at + size]):
            us.append(u)
            vs.append(v)
    keep = np.repeat((sizes > 1) & ~wide, sizes)
    keys, fps, home = keys[keep], fps[keep], home[keep]
    alive = np.arange(len(keys))
    for shift in range(1, WIDE):
        alive = alive[alive < len(keys) - shift]
        alive = alive[keys[alive] == keys[alive + shift]]
        if not len(alive):
            break
        other = alive + shift
        x = fps[alive] ^ fps[other]
        hit = (np.bitwise_count(x) <= MAX_BITS) & (x != 0) & (home[alive] | home[other])
        us.append(fps[alive[hit]])
        vs.append(fps[other[hit]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def near_links(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) that join any two within MAX_BITS, directly or through others."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(whole), 50_000):
                fps = whole[at : at + 50_000]
                key, row, home = anchors_of(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            u, v = _links(*part)
            both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            if not len(part[0]):
                continue
            cut = np.searchsorted(part[0], part[0][-1])  # the last anchor may go on in the next batch
            if cut:
                yield out(tuple(np.concatenate([h[k] for h in held] + [part[k][:cut]]) for k in range(3)))
                held = []
            held.append(tuple(p[cut:] for p in part))
        if held:
            yield out(tuple(np.concatenate([h[k] for h in held]) for k in range(3)))

    sent = nodes.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, fp long, component_id): one row for each input row.

    Null and blank texts have fingerprint 0 and form one component with whatever lies within two bits of it. Equal
    fingerprints are linked. Repeated rows each get a row; null doc_ids too, and never become a component's id unless
    no row of it has one. Very long texts are hashed whole. Other columns are ignored. An empty table gives an empty result.
    """
    fps = durable(fingerprints(docs), "simhash")
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    member = connected_components(near_links(nodes)).select(F.col("node").alias("fp"), "root")
    low = member.join(nodes, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    of = nodes.join(member.join(low, "root").drop("root"), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    of = durable(of, "simhash-of")  # both sides of the last join are then plain exchanges, so that a fingerprint of very many rows can be split
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
