"""Toxicity by a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

A word's input is its own embedding (if it is in the vocabulary) beside the mean embedding of its character n-grams,
so that unseen words are judged by their letters. A text is cut into overlapping windows of words, all of which are
scored; a logistic model on the windows' probabilities (highest, second, mean, log of their number) gives the
document's score.

The fit takes a bounded sample (SAMPLE_ROWS labelled documents of each class and, of all their windows,
SAMPLE_WINDOWS of each class, both by hash): only that comes to the driver. It goes the same way at every size: so many
steps, and a quarter of the sampled documents kept from the network for the document model. Scoring runs over every window of every document in Spark, and computes what does
not depend on the neighbours, the input's part of the gates, once for each distinct word of a batch.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.llm.common import durable, slices, small_batches
from veriframe.llm.decontaminate import words_of

WINDOW, STRIDE = 64, 48
SAMPLE_ROWS, SAMPLE_WINDOWS = 1_500, 6_000
#: One sampled document of so many, by hash, is kept from the network and fits the document model: on what the network has learned by heart, its windows look better than they are.
KEPT_APART = 4
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS, VOCABULARY = 8, 12, 12, 8_192, 20_000
STEPS, BATCH, RATE, DROP, SEED = 240, 256, 0.01, 0.25, 7
#: Decay of the embeddings by step and rate: rare words that a few documents repeat are forgotten again. It and DROP have the least log loss on a quarter of the learning rows kept apart for the choice (sf0.1, check_s); held-out rows had no part in it.
DECAY = 3.0
THRESHOLD = 0.7
#: Distinct words whose gates a task keeps at once.
CACHE = 100_000
#: Bytes of a piece of a long word at most, and those that it shares with the next one at least: an n-gram less one.
PIECE, OVERLAP = 64, 4
_BEGIN, _END = b"\x01", b"\x02"


def ngrams(word: bytes) -> list[int]:
    """Buckets of the 3- and 5-byte pieces of a word with its bounds, and of the whole if it is short."""
    w = _BEGIN + word + _END
    crc = zlib.crc32
    return [crc(w[i : i + n]) % CHAR_BUCKETS for n in (3, 5) for i in range(max(1, len(w) - n + 1))]


def _character(word: bytes, at: int) -> int:
    """Where the UTF-8 character at byte ``at`` begins."""
    return next((i for i in range(at, at - 4, -1) if word[i] & 0xC0 != 0x80), at)


def pieces_of(text: bytes | None) -> list[bytes]:
    """The words of a text. One of more than PIECE bytes (text without spaces) comes as consecutive pieces of whole characters, which share OVERLAP bytes or a little more, so that each n-gram lies in a piece."""
    out = []
    for word in words_of(text):
        at = 0
        while len(word) - at > PIECE:
            end = _character(word, at + PIECE)
            out.append(word[at:end])
            at = _character(word, end - OVERLAP)
        out.append(word[at:])
    return out


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows that cover ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Model:
    """The network's parameters, its forward pass, and its gradients."""

    def __init__(self, vocabulary: list[bytes], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN

        def new(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.ids = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.p = {"word": new(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": new(CHAR_BUCKETS, CHAR_DIM, scale=0.3)}
        for d in "fb":  # forwards, backwards
            self.p |= {f"in_{d}": new(WORD_DIM + CHAR_DIM, 3 * h, scale=0.3), f"own_{d}": new(h, 3 * h, scale=0.3), f"bias_{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"attend": new(2 * h, scale=0.3), "out": new(2 * h, scale=0.3), "out_bias": np.full(1, -1, np.float32)}
        self.document = np.zeros(5)
        self.pieces: dict[bytes, list[int]] = {}  # of the training words, while training

    def inputs(self, words: list[bytes], drop: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Inputs of distinct words, and what the gradient needs."""
        ids = np.array([self.ids.get(w, 0) for w in words], np.int64)
        if drop is not None:
            ids[drop] = 0
        pieces = [self.pieces.get(w) or ngrams(w) for w in words]
        sizes = np.array([len(x) for x in pieces], np.int64)
        flat = np.fromiter(chain.from_iterable(pieces), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        chars = np.add.reduceat(self.p["char"][flat], starts, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1), (ids, flat, sizes)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """The inputs' part of the gates for both directions, with a last row that leaves the state as it is (padding)."""
        out = []
        for d in "fb":
            g = x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"]
            still = np.zeros((1, 3 * HIDDEN), np.float32)
            still[:, :HIDDEN] = 60
            out.append(np.concatenate([g, still]))
        return out

    def run(self, gates: list[np.ndarray], at: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, tuple]:
        """Logits of windows ``at`` (steps, windows): rows of ``gates``, -1 for padding."""
        h, (steps, n) = HIDDEN, at.shape
        states = np.empty((steps, n, 2 * h), np.float32)
        for k, d in enumerate("fb"):
            own, state = self.p[f"own_{d}"], np.zeros((n, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, u = gates[k][at[t]], state @ own
                zr = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                z, r, un = zr[:, :h], zr[:, h:], u[:, 2 * h :]
                new = np.tanh(x[:, 2 * h :] + r * un)
                if keep is not None:
                    keep.append((k, t, state, z, r, un, new))
                state = new + z * (state - new)
                states[t, :, k * h : k * h + h] = state
        e = states @ self.p["attend"]
        e[at < 0] = -1e9
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states, optimize=True)
        return pooled @ self.p["out"] + self.p["out_bias"][0], (states, alpha, pooled)

    def gradients(self, words: list[bytes], at: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> dict[str, np.ndarray]:
        h, p = HIDDEN, self.p
        x, (ids, flat, sizes) = self.inputs(words, drop)
        gates, kept = self.gates(x), []
        logit, (states, alpha, pooled) = self.run(gates, at, kept)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dlogit = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["out_bias"] = dlogit @ pooled, dlogit.sum(keepdims=True)
        dpooled = dlogit[:, None] * p["out"]
        dalpha = np.einsum("tnh,nh->tn", states, dpooled)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", de, states)
        dstates = alpha[:, :, None] * dpooled + de[:, :, None] * p["attend"]
        dgates = [np.zeros((*at.shape, 3 * h), np.float32) for _ in "fb"]
        for k, d in enumerate("fb"):
            dstate = np.zeros((at.shape[1], h), np.float32)
            for _, t, state, z, r, un, new in reversed([x for x in kept if x[0] == k]):
                dh = dstate + dstates[t, :, k * h : k * h + h]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (state - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                du = np.concatenate([dz, dr, dnew * r], axis=1)
                dgates[k][t] = np.concatenate([dz, dr, dnew], axis=1)
                g[f"own_{d}"] += state.T @ du
                dstate = dh * z + du @ p[f"own_{d}"].T
        dx = np.zeros_like(x)
        rows = at.ravel()
        real = rows >= 0
        for k, d in enumerate("fb"):
            flat_g = dgates[k].reshape(-1, 3 * h)[real]
            by_word = np.stack([np.bincount(rows[real], weights=flat_g[:, c], minlength=len(words)) for c in range(3 * h)], axis=1).astype(np.float32)
            g[f"in_{d}"], g[f"bias_{d}"] = x.T @ by_word, by_word.sum(axis=0)
            dx += by_word @ p[f"in_{d}"].T
        for c in range(WORD_DIM):
            g["word"][:, c] = np.bincount(ids, weights=dx[:, c], minlength=len(p["word"]))
        share = np.repeat(dx[:, WORD_DIM:] / sizes[:, None], sizes, axis=0)
        for c in range(CHAR_DIM):
            g["char"][:, c] = np.bincount(flat, weights=share[:, c], minlength=CHAR_BUCKETS)
        return g


def train(windows: list[tuple[list[bytes], int, float]], seed: int = SEED) -> Model:
    """A model of windows (words, label, weight)."""
    seen = Counter(w for words, _, _ in windows for w in set(words))
    model = Model(sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY], seed)
    model.pieces = {w: ngrams(w) for w in seen}
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-STEPS * BATCH // len(windows)))])
    for step in range(STEPS):
        batch = [windows[i] for i in order[step * BATCH : (step + 1) * BATCH]]
        words = sorted({w for x, _, _ in batch for w in x})
        row = {w: k for k, w in enumerate(words)}
        at = np.full((WINDOW, len(batch)), -1, np.int64)
        for k, (x, _, _) in enumerate(batch):
            at[: len(x), k] = [row[w] for w in x]
        y, weight = np.array([b[1] for b in batch], np.float32), np.array([b[2] for b in batch], np.float32)
        g = model.gradients(words, at, y, weight, rng.random(len(words)) < DROP)
        norm = max(1.0, float(np.sqrt(sum(float((v * v).sum()) for v in g.values()))) / 5)
        rate = RATE * (1 - 0.9 * (step + 1) / STEPS)
        for k, v in g.items():
            v /= norm
            m, s = moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            if k in ("word", "char"):
                model.p[k] *= np.float32(1 - rate * DECAY)
            model.p[k] -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
    model.pieces = {}
    return model


def document_features(probabilities: np.ndarray) -> list[float]:
    top = np.sort(probabilities)[::-1]
    return [1.0, float(top[0]), float(top[1] if len(top) > 1 else top[0]), float(probabilities.mean()), float(np.log(len(probabilities)))]


def fit_document(features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    b = np.zeros(features.shape[1])
    for _ in range(50):
        q = _sigmoid(features @ b)
        ridge = 1e-2 * np.r_[0, np.ones(len(b) - 1)]
        gradient = features.T @ (weight * (q - y)) + ridge * b
        hessian = (features * (weight * q * (1 - q))[:, None]).T @ features + np.diag(ridge + 1e-6)
        move = np.linalg.solve(hessian, gradient)
        b -= move * min(1.0, 5.0 / max(1e-9, float(np.abs(move).max())))
    return b


class Scorer:
    """Window probabilities of texts, with the gates of the words of a batch kept."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.tables: list[list[np.ndarray]] = [[], []]

    def _learn(self, new: list[bytes]) -> None:
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        for a in range(0, len(new), 20_000):
            for k, g in enumerate(self.model.gates(self.model.inputs(new[a : a + 20_000])[0])):
                self.tables[k].append(g[:-1])

    def features(self, texts: list[bytes | None]) -> list[list[float]]:
        out: list[list[float]] = []
        held: list[tuple[int, np.ndarray]] = []
        count = 0

        def flush() -> None:
            nonlocal held, count
            if not held:
                return
            still = self.model.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))
            gates = [np.concatenate([*self.tables[k], still[k]]) for k in (0, 1)]
            self.tables = [[g[:-1]] for g in gates]
            windows, sizes = [], []
            for _, ids in held:
                starts = window_starts(len(ids))
                sizes.append(len(starts))
                padded = ids if len(ids) >= WINDOW else np.r_[ids, np.full(WINDOW - len(ids), -1, np.int64)]
                windows.append(padded[np.array(starts)[:, None] + np.arange(WINDOW)])
            at = np.concatenate(windows)
            score = np.concatenate([_sigmoid(self.model.run(gates, np.ascontiguousarray(at[a : a + 2_048].T))[0]) for a in range(0, len(at), 2_048)])
            cut = np.cumsum(sizes)
            for (row, _), a, b in zip(held, cut - sizes, cut):
                partial.setdefault(row, []).append(score[a:b])
            held, count = [], 0

        partial: dict[int, list[np.ndarray]] = {}
        for k, text in enumerate(texts):
            words = pieces_of(text)
            for a in range(0, max(1, len(words)), 48 * 4_000):  # a very long text in pieces that begin where a window does
                piece = words[a : a + 48 * 4_000 + (WINDOW - STRIDE)]
                if a and len(piece) <= WINDOW - STRIDE:
                    break
                new = list({w for w in piece if w not in self.rows})
                if len(self.rows) + len(new) > CACHE and self.rows:
                    flush()
                    self._forget()
                    new = list(set(piece))
                self._learn(sorted(new))
                held.append((k, np.array([self.rows[w] for w in piece], np.int64)))
                count += len(piece)
                if count > 250_000:
                    flush()
        flush()
        for k in range(len(texts)):
            out.append(document_features(np.concatenate(partial[k])))
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        features = np.array(self.features(texts)).reshape(len(texts), 5)
        return _sigmoid(features @ self.model.document)


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> Model | None:
    """A model of ``docs`` (doc_id, text) by ``labels`` (doc_id, toxic); None where there is no label to learn from.

    A doc_id with both labels is toxic; one on several rows is learned from the row whose text has the least hash, so that at
    most ``sample_rows`` documents and ``sample_windows`` windows of a class come to the driver. Of long documents relatively fewer windows are
    drawn. Null texts have one window of nothing. Other columns are ignored.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    totals = dict(known.groupBy("toxic").count().collect())
    if not totals:
        return None
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample_rows rows at most
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = durable(texts.withColumn("apart", F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(KEPT_APART)) == 0), "toxic-sample")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, toxic in zip(batch.doc_id, batch.text, batch.toxic):
                words = pieces_of(text)
                starts = window_starts(len(words))
                rows = [(doc_id, toxic, s, len(starts) * float(zlib.crc32(f"{doc_id} {s}".encode())), b" ".join(words[s : s + WINDOW])) for s in starts]
                yield pd.DataFrame(rows, columns=["doc_id", "toxic", "start", "turn", "words"])

    every = durable(small_batches(sample).where("NOT apart").mapInPandas(cut, "doc_id long, toxic int, start long, turn double, words binary"), "toxic-windows")
    drawn = [every.where(F.col("toxic") == k).orderBy("turn", "doc_id", "start").limit(sample_windows) for k in (0, 1)]
    rows = sorted((r.doc_id, r.start, r.toxic, bytes(r.words)) for r in drawn[0].unionByName(drawn[1]).collect())
    of = Counter(r[0] for r in rows)
    windows = [(words.split(), toxic, 1.0 / of[doc_id] ** 0.5) for doc_id, _, toxic, words in rows]
    model = train([w for w in windows if w[0]] or [([b"-"], 0, 1.0)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the module's constants

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "toxic": batch.toxic, "features": scorer.features(list(batch.text))})

    seen = sorted(sample.where("apart").mapInPandas(measure, "doc_id long, toxic int, features array<double>").collect())  # a quarter of 2 * sample_rows
    if seen:
        y = np.array([r.toxic for r in seen], float)
        model.document = fit_document(np.array([r.features for r in seen]), y, class_weights(y, totals))
    return model


def class_weights(y: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights that give the classes of a sample the shares that they have among all labels; their mean is 1."""
    taken = Counter(int(v) for v in y)
    weight = np.array([totals[int(v)] / taken[int(v)] for v in y])
    return weight / weight.mean()


def score_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text, ...) with ``_score`` (an input column of that name is replaced), one row for each input row; no shuffle.

    Null and empty texts are scored as one window of nothing. Very long texts are scored whole, a bounded number of windows at a time. Without a model every score is 0. Repeated rows each get
    their score, the same; other columns pass through. An empty table gives an empty result.
    """
    docs = docs.drop("_score")
    if model is None:
        return docs.withColumn("_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the module's constants

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            texts = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.score(texts), pa.float64())], names=[*batch.schema.names, "_score"])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
