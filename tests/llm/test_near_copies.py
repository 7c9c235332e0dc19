"""The pipeline's near copies against brute force on five-word shingles."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pandas as pd

import corpus_pipeline as pipeline
from tests.llm.test_operators import docs
from veriframe.llm import near_copies


def brute(texts: dict[int, str]) -> list[int]:
    """Least ids of the components of Jaccard 0.8 or more."""
    sets = {}
    for k, text in texts.items():
        w = text.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted({find(k) for k in texts})


def test_near_copies_stage(spark):
    rng = random.Random(8)
    texts = {}
    for n, changes in ((400, 4), (400, 8), (100, 2), (2_000, 16), (400, 14), (30, 1)):
        for _ in range(10):
            words = [f"w{rng.randrange(5_000)}" for _ in range(n)]
            texts[len(texts)] = " ".join(words)
            for at in rng.sample(range(n), changes):
                words[at] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(words)
    base = [f"v{k}" for k in range(200)]
    for k in range(100):  # one band of more than WIDE nodes
        words = base.copy()
        words[rng.randrange(200)] = f"y{k}"
        texts[len(texts)] = " ".join(words)
    for short in ("", "  ", "one two", "ONE  two", "one two three"):
        texts[len(texts)] = short
    frame = docs(spark, *texts.items(), (None, texts[0]), (0, texts[0])).drop("_id")
    want = brute(texts)
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, frame, "").collect())
    assert len(want) < len(texts) - 130 and got == want
    parts = near_copies.near_components(frame).collect()
    assert len(parts) == len(texts) + 2 and pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0


def test_rows_of_one_id_and_of_none(spark):
    """Exact copies never both stay, whatever their ids."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "b c d e f g h")
    frame = docs(spark, (7, a), (7, a), (7, b), (3, b), (None, c), (None, c), (None, a), (9, None), (8, ""), (4, "long word " * 100_000), (4, "long word " * 100_000)).drop("_id")
    got = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in pipeline.near_duplicates(spark, frame, "").collect())
    assert got == [(0, c), (3, b[:20]), (4, ("long word " * 3)[:20]), (7, a[:20]), (8, "")]


def template(rng, n: int, words: int, step: int, changes: int, more: int) -> dict[int, str]:
    """``n`` pairs of texts of one template; texts of different pairs differ in twice ``changes`` words, those of a pair in ``more``."""
    base, texts = [f"v{k}" for k in range(words)], {}

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(0, len(out) - 6, step), n):
            out[at] = f"z{rng.randrange(10**9)}"
        return out

    for k in range(n):
        mine = changed(base, changes)
        texts[2 * k], texts[2 * k + 1] = " ".join(mine), " ".join(changed(mine, more))
    return texts


def test_wide_bands(spark):
    """Texts of one template, all about 0.7 alike, in pairs that are 0.8 alike: none of 300 links is missed."""
    texts = template(random.Random(3), 300, 300, 6, 5, 5)
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs(spark, *texts.items()).drop("_id"), "").collect())
    assert got == brute(texts)


def test_families(spark, monkeypatch):
    """Texts of one template, most of them just under 0.8 alike, so that their rarest shingles are common too; blocks so small that there are many."""
    monkeypatch.setattr(near_copies, "BLOCK_NODES", 40)
    monkeypatch.setattr(near_copies, "WIDE", 8)
    called = []
    whole = near_copies.families
    monkeypatch.setattr(near_copies, "families", lambda *a: called.append(1) or whole(*a))
    texts = template(random.Random(4), 150, 300, 6, 4, 2)
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs(spark, *texts.items()).drop("_id"), "").collect())
    assert called and got == brute(texts)


def test_blocks_against_sets():
    """Overlaps by products and links of blocks against Python's sets."""
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.permutation(60)[: rng.integers(44, 56)]) for _ in range(70)]
    frame = pd.DataFrame({"node": range(100, 170), "root": range(100, 170), "shingles": sets, "at": [k % 2 for k in range(70)], "i": 0, "j": 1})
    both = near_copies.overlaps(sets, sets)
    assert all(both[a, b] == len(set(sets[a]) & set(sets[b])) for a in range(70) for b in range(70))
    near = [(a, b) for a, b in combinations(range(70), 2) if a % 2 != b % 2 and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))]
    assert 10 < len(near) < 1_000
    want = near_copies.least_labels(70, *(np.array(x) for x in zip(*near)))
    links = near_copies.compared(frame)
    got = near_copies.least_labels(70, links["u"].to_numpy() - 100, links["v"].to_numpy() - 100)
    assert (want == got).all()
