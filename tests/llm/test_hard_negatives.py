"""Operator 12 against all pairs, and its edge cases."""

from __future__ import annotations

import math
import random

import pytest

from veriframe.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, g long, k string"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label) with columns that clash with the operator's own."""
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)


def brute(rows):
    import numpy as np

    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, r), r)
    out = []
    for a, (label, v) in kept.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in kept.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, positive, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fit[:3])]
    return sorted(out)


def result(spark, rows):
    got = hard_negatives.hard_negatives(vectors(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_small_blocks_and_a_hot_label(spark, monkeypatch):
    for name, n in (("ANCHORS", 3), ("ROWS", 17), ("DIMS", 5)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(3)
    rows = []
    for i in range(400):
        label = 1 if rng.random() < 0.4 else rng.randrange(10)
        rows.append((i, [0.4 + rng.gauss(0, 0.3) + (label == j) * 0.4 for j in range(12)], label))
    rows += [(1_000 + i, [0.5] * 12, i % 3) for i in range(60)]  # ties
    want = brute(rows)
    assert len(want) > 60 and result(spark, rows) == want


@pytest.mark.parametrize("partitions", ["3", "5", "64"])
def test_chunks_in_any_order(spark, monkeypatch, partitions):
    """Without adaptive execution a tile's chunks come in the order of their partitions, the one with the positives not always first."""
    for name, n in (("ROWS", 40), ("DIMS", 3)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(4)
    rows = [(i, [0.4 + rng.gauss(0, 0.3) for _ in range(12)], rng.randrange(10)) for i in range(300)]
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": partitions}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert result(spark, rows) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nulls_ragged_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (50, [1.0, 0.5], 3), (50, [1.0, 0.25], 2), (100, [1.0, None], 3), (150, None, 3), (200, [1.0, nan], 3), (250, [inf, 1.0], 3), (300, [1.0, 1.0], None), (None, [1.0, 1.0], 3),
        (1, [1.0, 0.5], 2), (2, [1.0], 2), (3, [], 2), (4, [0.9, 0.1, 7.0], 5), (5, [0.6, 0.6], 6), (6, [0.8], 6), (8, [-1.0, -1.0], 2), (8, [-1.0, -1.0], 2), (350, [1.0, 0.4], 9), (9, [1.0, 0.4], 0), (10, [0.6, 0.4], 4),
    ]
    want = brute(rows)
    assert want and result(spark, rows) == want


def test_no_rows_and_no_anchors(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, [1.0], 1), (2, [1.0], 1), (3, [1.0], 2)]) == []
    assert result(spark, [(50, [], 1), (51, [], 1), (52, [], 2)]) == [(50, 51, 1, 52, 0, 0)]


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        result(spark, [(50, [1e30], 1), (51, [1e30], 1)])
