"""What the waves of the near copies join and shuffle."""

from __future__ import annotations

import random

from tests.llm.test_near_copies import brute
from tests.llm.test_operators import docs
from veriframe.llm import near_copies
from veriframe.llm.common import bucketed, with_ids


def test_pivots_need_no_join(spark):
    """The first node of a band comes with the band's size, so that bands are joined once a wave."""
    places = spark.createDataFrame([(1, 10, 10), (1, 11, 10), (1, 12, 12), (2, 10, 10), (2, 11, 10)], "band long, node long, root long")
    held = near_copies.divided(places)
    pairs = near_copies.pivoted(held)
    assert sorted((r.band, r.node, r.n) for r in held.collect()) == [(1, 10, 3), (1, 11, 3), (1, 12, 3)]
    got = {(r.u, r.v) for r in pairs.collect()}
    assert got in ({(10, 12)}, {(11, 12)}, {(10, 12), (11, 12)})  # by which node is first
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_hot_nodes(spark, monkeypatch):
    """Nodes of very many pairs, at either end or at both, give the same links; sets lie in buckets of their node."""
    rng = random.Random(2)
    sets = {k: sorted(rng.sample(range(24), rng.randrange(19, 24))) for k in range(40)}
    sets[40] = []
    pairs = sorted({(min(a, b), max(a, b)) for a, b in [(0, k) for k in range(1, 41)] + [(k, 39) for k in range(39)] + [rng.sample(range(1, 39), 2) for _ in range(40)]})
    want = [(a, b) for a, b in pairs if min(len(sets[a]), len(sets[b])) and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
    held = bucketed(spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"), "near-sets", 4, ("node",))
    frame = spark.createDataFrame([*pairs, *pairs], "u long, v long")
    for hot, most in ((10, 1_000), (10, 1), (1_000, 1_000)):
        monkeypatch.setattr(near_copies, "HOT", hot)
        monkeypatch.setattr(near_copies, "BROADCAST_SHINGLES", most)
        got = sorted(tuple(sorted((r.u, r.v))) for r in near_copies.alike(frame, held).collect())
        assert len(want) > 8 and got == want


def test_ids_are_sent_to_the_texts(spark):
    """Rows are found by bits of their ids, whatever these are, without a shuffle; beyond the bound by a join, with the same rows."""
    here = [0, 1, 63, 64, 127, 128, -1, -64, -65, 2**63 - 1, -(2**63), 10**12, None]
    frame = docs(spark, *[(k, f"text {k}") for k in [*here, *here, 2, 62, 65, -2, -63, 10**12 + 1]]).select("doc_id", "text")
    for wanted in (here, here[:-1], [None], here[3:6], []):
        ids = spark.createDataFrame([(k,) for k in wanted], "id long")
        want = sorted(f"text {k}" for k in [*wanted, *wanted])
        for most in (100, 0):
            assert sorted(r.text for r in with_ids(frame, ids, most).collect()) == want


def test_texts_are_neither_shuffled_nor_cut_twice(spark, monkeypatch):
    """What stays is found where the texts lie, also where its ids are too many for Spark to broadcast by itself; only texts that have candidates are cut into shingles again."""
    cut, whole = [], near_copies.sets_of
    monkeypatch.setattr(near_copies, "sets_of", lambda some: cut.append(some.count()) or whole(some))
    rng = random.Random(6)
    texts = {k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for k in range(60)}
    texts |= {100 + k: texts[k] + " more" for k in range(5)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stays = near_copies.one_of_each(docs(spark, *texts.items()).drop("_id"))
        assert "SortMergeJoin" not in stays._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in stays.collect()) == brute(texts) == list(range(60))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert cut == [10]
