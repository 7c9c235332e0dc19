"""Reconciliation, event order and the nine dimensions, on planted faults."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from veriframe.operators import reconcile, retrieval

ROWS = "id string, a long, b string"


def test_reconcile_finds_what_differs(spark):
    rng = random.Random(1)
    left = [(f"k{i}", rng.randint(0, 9), rng.choice(["x", "y", None])) for i in range(3_000)]
    right = [r for r in left if r[0] not in ("k7", "k2999")]
    right[100] = (right[100][0], right[100][1] + 1, right[100][2])
    right[200] = (right[200][0], right[200][1], "other")
    right += [("new", 1, None), right[300], (None, 1, "x")]
    a, b = spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS)
    want = {"k7": "lost", "k2999": "lost", right[100][0]: "changed", right[200][0]: "changed", right[300][0]: "changed", "new": "extra"}
    for levels in (1, 2, 3):
        assert {r.id: r.outcome for r in reconcile.reconcile(a, b, "id", ["a", "b"], levels).collect()} == want
    assert {r.id: r.outcome for r in reconcile.reconcile(a, b, "id", []).collect()} == {k: v for k, v in want.items() if v != "changed"} | {right[300][0]: "changed"}  # a row too many
    assert reconcile.differing_leaves(a, b.where("id IS NOT NULL"), "id", ["a", "b"]).count() <= 6
    assert reconcile.differing_leaves(a, a, "id", ["a", "b"]).count() == 0 and reconcile.reconcile(a, a, "id", ["a", "b"]).count() == 0
    none = spark.createDataFrame([], ROWS)
    assert reconcile.reconcile(none, none, "id", ["a"]).count() == 0 and reconcile.reconcile(a, none, "id", ["a"]).count() == 3_000


@pytest.mark.parametrize("span", [1, 8, 4_096])
def test_event_sequence(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["A", "B", None]), rng.choice([None, rng.randint(-40, 90)]), rng.choice([None, rng.randint(0, 50)])) for _ in range(400)]
    rows += [("HOT", i, 5 * i - (100 if i % 50 == 7 else 0)) for i in range(300)]
    by = defaultdict(list)
    for s, q, at in rows:
        if s is not None and q is not None:
            by[s].append((q, at is not None, at or 0))
    want = {}
    for s, events in by.items():
        last, late = None, 0
        for _, dated, at in sorted(events):
            if dated:
                late += last is not None and at < last
                last = at
        want[s] = (len(events), sum(not d for _, d, _ in events), late)
    got = reconcile.event_sequence(spark.createDataFrame(rows, "subject string, seq long, at long"), span).collect()
    assert {r.subject: (r.n_events, r.n_undated, r.n_out_of_order) for r in got} == want


def test_each_fault_fails_its_dimension(spark):
    ids = [f"DOC-{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, "SYS-1", "URS", "ann", "2024-01-01", False, "APPROVED", 10) for i in ids], "id string, system_id string, doc_type string, author string, created_date string, is_copy boolean, status string, n_chars long")
    source = spark.createDataFrame([(i, 11 if i == "DOC-1" else 10) for i in ids], "id string, n_chars long")
    archive = spark.createDataFrame([(i,) for i in ids if i != "DOC-2"], "id string")
    events = [(i, n, 100 * n) for i in ids for n in range(4)]
    events[events.index(("DOC-3", 1, 100))], events[events.index(("DOC-3", 2, 200))] = ("DOC-3", 1, 200), ("DOC-3", 2, 100)
    events[events.index(("DOC-4", 2, 200))] = ("DOC-4", 2, None)
    got = retrieval.alcoa_extended(docs, spark.createDataFrame([("SYS-1",)], "id string"), source, archive, spark.createDataFrame(events, "subject string, seq long, at long"))
    assert {r.id: (r.failed, r.n_true, r.outcome) for r in got.collect()} == {
        "DOC-0": ("", 9, "VERIFIED"), "DOC-1": ("accurate", 8, "FAIL"), "DOC-2": ("enduring", 8, "FAIL"), "DOC-3": ("consistent", 8, "FAIL"), "DOC-4": ("contemporaneous", 8, "FAIL"), "DOC-5": ("", 9, "VERIFIED")
    }
