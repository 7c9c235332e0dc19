"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

The tokenizer's pattern cuts a text into pre-tokens; a leaf of the tree has the length of one in code points and its number
of tokens, leaves are held in blocks, and a binary tree over the blocks has their sums. An edit re-encodes from the first
pre-token whose end the edited place could have moved (a match of the pattern depends on its own text and at most two
code points after it) until a boundary of the new text falls on one of the old beyond the edit; from there on the old
leaves hold. Only the path of sums above the blocks touched is updated.

Trees are a binary column, so they can be kept as a table and edited again later.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm.common import slices, small_batches

#: Pre-tokens of a block on average; a block of four times as many makes the tree be built anew.
BLOCK = 64
#: Pre-tokens whose counts a task keeps.
CACHE = 400_000
Edit = tuple[int, int, str]


class Encoder:
    """Pre-tokens and token counts by a byte-level vocabulary (the bytes of a .tiktoken file) and its pattern."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def pieces(self, text: str, at: int = 0) -> Iterator[str]:
        return (m.group() for m in self.pattern.finditer(text, at))

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        found = self.pattern.findall(text)
        known = self.known
        try:
            counts = [known[x] for x in found]
        except KeyError:
            counts = [self.count(x) for x in found]
        return [len(x) for x in found], counts


class TokenTree:
    """Lengths and token counts of pre-tokens in blocks, with sums over the blocks in a binary tree."""

    def __init__(self, lengths: list[int], counts: list[int]) -> None:
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        cuts = range(0, max(1, len(lengths)), BLOCK)
        self.lengths = [lengths[a : a + BLOCK] for a in cuts]
        self.counts = [counts[a : a + BLOCK] for a in cuts]
        self.width = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k in range(len(self.lengths)):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(self.lengths[k]), sum(self.counts[k])
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, end: int) -> tuple[int, int, int]:
        """(block, place in it, start) of the first pre-token that ends at ``end`` or later; of the place after all, if none does."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if start + self.chars[k] < end:
                start += self.chars[k]
                k += 1
        block = min(k - self.width, len(self.lengths) - 1)
        if k - self.width > block:
            start = self.chars[1] - self.chars[self.width + block]
        place = 0
        for n in self.lengths[block]:
            if start + n >= end:
                break
            start += n
            place += 1
        return block, place, start

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """The leaves from ``first`` to before ``last`` (block, place) become the given ones."""
        (a, i), (b, j) = first, last
        lengths = self.lengths[a][:i] + lengths + self.lengths[b][j:]
        counts = self.counts[a][:i] + counts + self.counts[b][j:]
        share = -(-len(lengths) // (b - a + 1))
        for k in range(a, b + 1):
            cut = slice((k - a) * share, (k - a + 1) * share)
            self.lengths[k], self.counts[k] = lengths[cut], counts[cut]
        if share > 4 * BLOCK:
            self._build([n for x in self.lengths for n in x], [n for x in self.counts for n in x])
            return
        touched = range(self.width + a, self.width + b + 1)
        for k in touched:
            self.chars[k], self.tokens[k] = sum(self.lengths[k - self.width]), sum(self.counts[k - self.width])
        while touched[0] > 1:
            touched = range(touched[0] // 2, touched[-1] // 2 + 1)
            for k in touched:
                self._sum(k)

    def to_bytes(self) -> bytes:
        flat = np.array([[n for x in self.lengths for n in x], [n for x in self.counts for n in x]], np.uint64).reshape(2, -1)
        size = next(s for s in (1, 2, 4, 8) if not flat.size or int(flat.max()) < 1 << (8 * s))
        return bytes([size]) + flat.astype(f"<u{size}").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenTree:
        flat = np.frombuffer(data, f"<u{data[0]}", offset=1).reshape(2, -1)
        return cls(flat[0].tolist(), flat[1].tolist())


def valid_edits(edits: list[Edit], size: int) -> list[Edit]:
    """Edits by place, clipped to the text; of two that overlap the one that begins (then ends) first stays."""
    out: list[Edit] = []
    for a, b, text in sorted((max(0, min(a, size)), max(0, min(b, size)), t or "") for a, b, t in edits):
        if a <= b and (not out or a >= out[-1][1]):
            out.append((a, b, text))
    return out


def edited(text: str, edits: list[Edit]) -> str:
    parts, at = [], 0
    for a, b, new in edits:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


def edit_tree(tree: TokenTree, text: str, edits: list[Edit], encoder: Encoder) -> tuple[str, int]:
    """The edited text, and how many pre-tokens were encoded again; ``tree`` is changed. ``edits`` as from valid_edits."""
    new, again, shift, k = edited(text, edits), 0, 0, 0
    while k < len(edits):
        block, place, start = tree.find(edits[k][0] + shift - 1)
        old_block, old_place, old = block, place, start  # a boundary of the old leaves; behind the edits taken it lies ``moved`` further in the new text
        moved, safe, at, first = 0, start, start, True
        lengths: list[int] = []
        counts: list[int] = []
        pieces = encoder.pieces(new, start)
        while True:
            while k < len(edits) and (first or edits[k][0] + shift + moved < at or at == len(new)):
                a, b, t = edits[k]
                safe, first = a + shift + moved + len(t), False
                moved += len(t) - (b - a)
                k += 1
            while old < at - moved:
                if old_place < len(tree.lengths[old_block]):
                    old += tree.lengths[old_block][old_place]
                    old_place += 1
                else:
                    old_block, old_place = old_block + 1, 0
            if at >= safe and old == at - moved:
                break
            piece = next(pieces)
            at += len(piece)
            lengths.append(len(piece))
            counts.append(encoder.count(piece))
        tree.replace((block, place), (old_block, old_place), lengths, counts)
        again += len(lengths)
        shift += moved
    return new, again


def _encoder_of(spark: SparkSession, path: str | None, pattern: str | None) -> tuple:
    """The vocabulary's bytes (about 1 MB, whatever the corpus), read once by the driver, and the pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern or public_tokenizers.PATTERN


def build_trees(docs: DataFrame, find_edits: Callable[[str], list[Edit]] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, text, tree binary, n_pretokens, n_tokens, edits), one row for each input row.

    ``edits`` is what ``find_edits`` finds in the text. Null and empty texts have an empty tree. Repeated rows and null
    ids each get a row; other columns are ignored. An empty table gives an empty result.
    """
    ranks, pattern = _encoder_of(docs.sparkSession, path, pattern)
    edit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                lengths, counts = encoder.leaves(text or "")
                edits = [{"start": a, "end": b, "text": t} for a, b, t in find_edits(text or "")] if find_edits else []
                rows.append((TokenTree(lengths, counts).to_bytes(), len(lengths), sum(counts), edits))
            trees, pretokens, tokens, edits = zip(*rows) if rows else ((),) * 4
            arrays = [batch.column(0), batch.column(1), pa.array(trees, pa.binary()), pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64()), pa.array(edits, pa.list_(edit))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "tree", "n_pretokens", "n_tokens", "edits"])

    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text string, tree binary, n_pretokens long, n_tokens long, edits array<struct<start:long,end:long,text:string>>")


def apply_edits(trees: DataFrame, path: str | None = None, pattern: str | None = None, keep_text: bool = True) -> DataFrame:
    """Rows as from build_trees -> (doc_id, text, tree, n_edits, n_tokens_edited, n_reencoded, n_pretokens, n_tokens) after their ``edits``.

    Places of edits are code points of the text as it was; they are clipped to it, and one that overlaps an earlier one is
    left out and not counted. Null edits are none. Without ``keep_text`` the new text and tree are null.
    """
    ranks, pattern = _encoder_of(trees.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in slices(batches):
            rows = []
            for text, data, edits in zip(*(batch.column(k).to_pylist() for k in (1, 2, 5))):
                text = text or ""
                todo = valid_edits([(e["start"], e["end"], e["text"]) for e in edits or [] if e and e["start"] is not None and e["end"] is not None], len(text))
                tree = TokenTree.from_bytes(data)
                new, again = edit_tree(tree, text, todo, encoder)
                rows.append((new if keep_text else None, tree.to_bytes() if keep_text else None, len(todo), tree.total, again))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), batch.column(3), batch.column(4)],
                names=["doc_id", "text", "tree", "n_edits", "n_tokens_edited", "n_reencoded", "n_pretokens", "n_tokens"],
            )

    schema = "doc_id long, text string, tree binary, n_edits long, n_tokens_edited long, n_reencoded long, n_pretokens long, n_tokens long"
    return trees.select("doc_id", "text", "tree", "n_pretokens", "n_tokens", "edits").mapInArrow(run, schema)


#: What the query's edits mask: mail addresses, and runs of seven or more digits.
_MASKS = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}|\d{7,}")


def mask_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "[mail]" if "@" in m.group() else "[number]") for m in _MASKS.finditer(text)]


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = apply_edits(build_trees(docs, mask_edits), keep_text=False)
    return done.select("doc_id", "n_pretokens", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")
