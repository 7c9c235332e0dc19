"""Benchmark decontamination by an FM-index over each shard of the corpus.

A shard is a bounded number of words of what one task reads. Words of the benchmark are the index's alphabet; any
other word, which no window can hold, is a separator, as is a document's end, and stretches between separators that
are shorter than the shortest window hold no occurrence and are left out. What remains is sorted by suffix (prefix
doubling; separators differ from each other, so that it ends within the longest stretch), its Burrows-Wheeler
transform is kept in a wavelet matrix, and all windows of the benchmark are searched backwards in it at once. The rows
found are located by walking back to the next sampled suffix, and the spans of each document are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.llm.common import slices, small_batches

WINDOW = 10
#: Words of a shard; items of the benchmark that are searched in one pass over the corpus.
SHARD_WORDS, BLOCK_CHARS = 1_500_000, 20_000_000
#: Every so many positions a suffix's place is kept.
SAMPLE = 8
#: A-Z to lower case, what is no digit, letter or non-ASCII byte to a space: UTF-8 bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class WaveletMatrix:
    """Rank and access over small integers, a bit vector with block counts for each bit."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.n, self.bits, self.words, self.counts, self.zeros = len(values), bits, [], [], []
        for level in range(bits - 1, -1, -1):
            one = (values >> level & 1).astype(bool)
            padded = np.zeros((len(one) // 64 + 1) * 64, np.uint8)
            padded[: len(one)] = one
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(len(one) - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = np.where(one, self.zeros[level] + a, start - a), np.where(one, self.zeros[level] + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            ones = self._ones(level, at)
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (0: a separator, each unlike the others and below all words; the last is one), sorted, by prefix doubling."""
    n = len(text)
    separators = np.flatnonzero(text == 0)
    key = text + len(separators)
    key[separators] = np.arange(len(separators))
    order = np.argsort(key, kind="stable")
    new = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first place of the suffix's group
    step = 1
    ends = np.r_[np.flatnonzero(new)[1:], n]
    open_ = np.repeat(ends - np.flatnonzero(new), ends - np.flatnonzero(new)) > 1
    slots = np.flatnonzero(open_)
    while len(slots):
        at = order[slots]
        group, after = rank[at], rank[np.minimum(at + step, n - 1)]
        by = np.lexsort((after, group)) if n > 1 << 31 else np.argsort(group * n + after, kind="stable")
        order[slots] = at = at[by]
        group, after = group[by], after[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        first = np.flatnonzero(new)
        rank[at] = slots[first][np.cumsum(new) - 1]
        size = np.diff(np.r_[first, len(slots)])
        slots = slots[np.repeat(size, size) > 1]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over ``text`` of symbols 1 .. sigma, 0 for separators."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        order = suffix_array(text)
        bwt = text[order - 1]  # before place 0 comes the last separator
        self.wavelet = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 1))]
        starts = np.r_[True, text[:-1] == 0]
        sampled = (order % SAMPLE == 0) | starts[order]  # walks never pass a separator
        self.marked, self.places = np.cumsum(sampled), order[sampled]
        self.sampled = sampled

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (rows of words, right aligned, all of at least one word)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.wavelet.n, np.int64)
        alive = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            alive = alive[(lengths[alive] >= back) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, -back]
            low[alive] = self.first[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.wavelet.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, rows, walked = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.sampled[rows[todo]]
            done = todo[here]
            out[done] = self.places[self.marked[rows[done]] - 1] + walked[done]
            todo = todo[~here]
            symbol = self.wavelet.access(rows[todo])
            rows[todo] = self.first[symbol] + self.wavelet.rank(symbol, rows[todo])
            walked[todo] += 1
        return out


class Windows:
    """The benchmark's windows: distinct sequences of word numbers, right aligned in rows of an array, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items}, key=by_name)
        place = {name: k for k, name in enumerate(self.names)}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for name, text in items:
            numbers = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int32)
            if len(numbers):
                rows.append(np.lib.stride_tricks.sliding_window_view(np.pad(numbers, (max(0, window - len(numbers)), 0)), window))
                owners.append(np.full(len(rows[-1]), place[name], np.int64))
        self.patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.longest = int(self.lengths.max(initial=0))
        self.patterns = np.ascontiguousarray(self.patterns[:, window - self.longest :])
        pairs = np.unique(of.ravel() * max(1, len(self.names)) + np.concatenate(owners))
        self.owner = (pairs % max(1, len(self.names))).astype(np.int32)
        self.cuts = np.searchsorted(pairs, np.arange(len(self.patterns) + 1) * max(1, len(self.names)))

    def items(self, k: int) -> list[str | None]:
        return [self.names[i] for i in self.owner[self.cuts[k] : self.cuts[k + 1]]]


def by_name(name: str | None) -> tuple[bool, str]:
    """Order of items: by id as text, one without an id last."""
    return name is None, name or ""


def _search_shard(numbers: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence in ``numbers`` (0 for separators)."""
    none = np.zeros(0, np.int64)
    if not len(numbers) or not len(windows.patterns):
        return none, none
    inside = numbers > 0
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, end = edges[::2], edges[1::2]
    keep = end - start >= windows.lengths.min()
    start, size = start[keep], (end - start)[keep]
    if not len(start):
        return none, none
    place = np.cumsum(size + 1) - size - 1  # of each stretch in the text, a separator after it
    text = np.zeros(int((size + 1).sum()), np.int64)
    shift = np.repeat(start - place, size)
    at = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
    text[at] = numbers[at + shift]
    index = FMIndex(text, len(windows.ids))
    low, high = index.search(windows.patterns, windows.lengths)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    found = index.locate(rows)
    stretch = np.searchsorted(place, found, side="right") - 1
    return found + (start - place)[stretch], which


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


_FOUND = T.StructType([T.StructField("_n_words", T.LongType()), T.StructField("_spans", SPANS), T.StructField("_items", T.ArrayType(T.StringType()))])
_FOUND_ARROW = [("_n_words", pa.int64()), ("_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("_items", pa.list_(pa.string()))]


def _pass(docs: DataFrame, windows: Windows, shard_words: int, again: bool) -> DataFrame:
    """``docs`` (..., _text) with _n_words, _spans, _items of every row; ``again``: those that an earlier pass has found are merged in."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)  # bounded by BLOCK_CHARS
    own = [c for c in docs.columns if c not in _FOUND.names]
    docs = docs.select(*own, *_FOUND.names) if again else docs.select(*own)
    schema = T.StructType([docs.schema[c] for c in own] + _FOUND.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        get, overlap = w.ids.get, max(0, w.longest - 1)
        begun: list[pa.RecordBatch] = []  # not yet given out; of their rows the words, spans and items so far
        totals: list[int] = []
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        parts: list[tuple[int, int, np.ndarray]] = []  # row, first word's number, words
        held = 0

        def flush() -> None:
            nonlocal held
            if parts:
                joined = np.concatenate([np.r_[p[2], 0] for p in parts])
                offsets = np.cumsum([0] + [len(p[2]) + 1 for p in parts])
                at, which = _search_shard(joined, w)
                part = np.searchsorted(offsets, at, side="right") - 1
                for p, a, k in zip(part.tolist(), (at - offsets[part]).tolist(), which.tolist()):
                    row, base, _ = parts[p]
                    spans.setdefault(row, []).append((base + a, base + a + int(w.lengths[k])))
                    items.setdefault(row, set()).update(w.items(k))
                for row in {p[0] for p in parts} & spans.keys():
                    spans[row] = _union(spans[row])
            parts.clear()
            held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            flush()
            row = 0
            for batch in begun:
                mine = range(row, row + batch.num_rows)
                row += batch.num_rows
                found = [
                    pa.array([totals[i] for i in mine], _FOUND_ARROW[0][1]),
                    pa.array([[{"start": a, "end": b} for a, b in spans.get(i, [])] for i in mine], _FOUND_ARROW[1][1]),
                    pa.array([sorted(items.get(i, ()), key=by_name) for i in mine], _FOUND_ARROW[2][1]),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *found], names=[*own, *_FOUND.names])
            for x in (begun, totals, spans, items):
                x.clear()

        words_begun = 0
        for batch in slices(batches):
            earlier = zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()) if again else [(None, None)] * batch.num_rows
            begun.append(batch)
            for text, (old_spans, old_items) in zip(batch.column("_text").to_pylist(), earlier):
                found = words_of(text)
                row = len(totals)
                totals.append(len(found))
                words_begun += len(found)
                if old_spans:
                    spans[row], items[row] = [(x["start"], x["end"]) for x in old_spans], set(old_items)
                for at in range(0, len(found), shard_words):  # a longer text goes on, with an overlap, in the next shard
                    numbers = np.array([get(x, 0) for x in found[at : at + shard_words + overlap]], np.int64)
                    parts.append((row, at, numbers))
                    held += len(numbers)
                    if held >= shard_words:
                        flush()
            if words_begun >= shard_words or len(totals) >= 50_000:
                yield from emit()
                words_begun = 0
        yield from emit()

    return small_batches(docs).mapInArrow(run, schema)


def _blocks(bench: DataFrame, block_chars: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark in blocks of at most ``block_chars`` bytes (or one item), streamed a partition at a time."""
    block, size = [], 0
    for row in bench.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        length = len(row[1] or b"")
        if block and size + length > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], None if row[1] is None else bytes(row[1])))
        size += length
    yield block


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (_text binary, ...), ``bench`` (item_id, text, ...) -> docs with _n_words, _spans, _items; one row for each row, no shuffle.

    Spans are merged ranges of word numbers that lie inside an occurrence of a window of ``window`` consecutive words of
    an item (the whole item, if shorter). A benchmark beyond ``block_chars`` is searched in several passes, each adding to
    what the one before found. Null and empty texts have no words; items without words have no windows; items that repeat
    an id count once; items without an id count as one that no list names. Input columns with the results' names are replaced. Repeated rows of docs each get a row. An empty table gives an empty result.
    """
    for k, block in enumerate(_blocks(bench, block_chars)):
        docs = _pass(docs, Windows(block, window), shard_words, again=k > 0)
    return docs


def cut_contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (text, ...) with what find_contamination finds cut out of ``text``; other columns and clean texts stay as they are."""
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    found = find_contamination(docs.select(F.struct(*others).alias("_row"), F.col("text").cast("binary").alias("_text")), bench, window).select("_row", "_text", "_spans")
    schema = T.StructType([found.schema["_row"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else cut_spans(t, s) if s else t.decode("utf-8", "replace") for t, s in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "text"])

    return found.mapInArrow(cut, schema).select(*["text" if c == "text" else F.col(f"_row.{c}").alias(c) for c in columns])


def cut_spans(text: bytes, spans: list) -> str:
    """``text`` without the given ranges of word numbers: each range goes with all between its first and last word; a space stays."""
    flat = text.translate(_TABLE)
    out, done, word, at = [], 0, -1, 0
    for span in spans:
        begin = at
        while word < span["start"]:
            while flat[at] == 32:
                at += 1
            begin, word = at, word + 1
            end = flat.find(b" ", at)
            at = len(flat) if end < 0 else end
        while word < span["end"] - 1:
            while flat[at] == 32:
                at += 1
            word += 1
            end = flat.find(b" ", at)
            at = len(flat) if end < 0 else end
        out.append(text[done:begin])
        done = at
    out.append(text[done:])
    return b"".join(out).decode("utf-8", "replace")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("_text"))
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
