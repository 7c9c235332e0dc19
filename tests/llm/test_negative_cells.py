"""What operator 12 shuffles, and its cells."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.test_hard_negatives import brute, result
from veriframe.llm import hard_negatives


def shuffled(spark, n: int) -> int:
    """Bytes that a search among ``n`` vectors writes to shuffles."""
    sc = spark.sparkContext
    vectors = spark.range(n).selectExpr("id AS vec_id", "transform(sequence(1, 4), x -> cast(xxhash64(id, x) % 1000 / 1000.0 AS float)) AS embedding", "cast(id % 10 AS int) AS label")

    def stages() -> dict:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    assert hard_negatives.hard_negatives(vectors).count()
    return sum(v for k, v in stages().items() if k not in before)


def test_scores_are_not_shuffled(spark):
    """Three times the vectors make nine times the scores, but not of what is shuffled, whose strips grow from two to four; and that is less than a byte a score."""
    few, many = shuffled(spark, 10_000), shuffled(spark, 30_000)
    assert many < 5 * few and many < 30_000**2 / 50


def test_grid_of_many_cells(spark, monkeypatch):
    """Several rows of the grid, each of several blocks, several strips, one label on half of the rows and many equal scores."""
    for name, n in (("ANCHORS", 3), ("BLOCKS", 2), ("ROWS", 7), ("PANELS", 1), ("DIMS", 4)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(5)
    rows = [(10 * i - 900, [rng.choice([0.25, 0.5, 0.75]) + rng.choice([0, 0.1]) for _ in range(6)], 1 if rng.random() < 0.5 else rng.randrange(10)) for i in range(250)]
    rows += [(5_001 + i, [0.5] * rng.randrange(4, 9), rng.randrange(3)) for i in range(60)]
    want = brute(rows)
    assert len({r[0] for r in want}) > 20 and result(spark, rows) == want


@pytest.mark.parametrize("most", [1.0, 2.0**8, 2.0**16])
def test_large_components(spark, monkeypatch, most):
    """Sums that only floats, only doubles or only whole numbers hold; panels of each size; negative components."""
    monkeypatch.setattr(hard_negatives, "DIMS", 4)
    rng = random.Random(6)
    rows = [(5 * i, [rng.uniform(-0.4, 1) * most * rng.choice([1, 2**-4]) for _ in range(40)], rng.randrange(3)) for i in range(150)]
    want = brute(rows)
    assert want and result(spark, rows) == want


@pytest.mark.parametrize(("waiting", "first"), [(1, 1), (40, 3), (10**6, 64)])
def test_best_of_many_ties(monkeypatch, waiting, first):
    """Whenever scores are sorted in, the best of each slot are those within its bounds, of equal ones the first."""
    monkeypatch.setattr(hard_negatives, "WAITING", waiting)
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    rng = np.random.default_rng(7)
    a, b = rng.integers(-2, 3, (30, 5)).astype(np.int16), rng.integers(-2, 3, (200, 7)).astype(np.int16)
    low = rng.integers(-9, 6, (30, 2))
    high = low + rng.integers(-1, 9, (30, 2))
    barred = lambda r, c: (r + c) % 3 == 0
    scores, at = hard_negatives._best(a, b, low, high, 4, barred, (7, 16, 2))
    exact = a.astype(int) @ b[:, :5].astype(int).T
    for r in range(30):
        for s in range(2):
            want = sorted((-x, c) for c, x in enumerate(exact[r].tolist()) if low[r, s] < x <= high[r, s] and not barred(r, c))[:4]
            assert [(-x, c) for x, c in zip(scores[r, s].tolist(), at[r, s].tolist()) if x > hard_negatives._NONE] == want
