"""Keys that hold a third of all rows or more, in operators that once met them in one task or one array."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tests.llm.test_operators import docs
from veriframe.llm import mixing, simhash


def test_a_row_that_repeats_very_often_is_mixed_right(spark):
    """One id and text two thousand times: each row has its own place, and as many are picked as were drawn."""
    rows = [(7, "some words of one text", "a")] * 2_000 + [(100 + i, f"word {i} " * (1 + i % 5), "a") for i in range(500)] + [(5_000 + i, "b " * 3, "b") for i in range(40)]
    got = mixing.mix(docs(spark, *rows)).collect()
    assert len(got) == len(rows)
    for source in ("a", "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 20
    hot = [r.copies for r in got if r.doc_id == 7]
    assert len(hot) == 2_000 and max(hot) - min(hot) <= 1 and max(hot) <= 2
    same = {r.doc_id: r.taken for r in got if r.doc_id != 7}
    assert same == {r.doc_id: r.taken for r in mixing.mix(docs(spark, *rows)).collect() if r.doc_id != 7}


def test_a_wide_anchor_is_compared_in_bounded_memory():
    rng = np.random.default_rng(1)
    fps = np.full(150_000, np.uint64(0x123456789ABCDEF))
    for _ in range(6):
        fps ^= np.uint64(1) << rng.integers(0, 23, len(fps)).astype(np.uint64)
    distinct = np.unique(fps)
    tracemalloc.start()
    edges = sum(len(u) for u, _ in simhash._spanning(fps))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(distinct) > 2 * simhash.STRETCH // 2 and edges >= len(distinct) - 5  # dense: all but a few are joined
    assert peak < 8 * 256 * simhash.STRETCH * 4
