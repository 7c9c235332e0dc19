"""The postings table: identifiers as units, and searches against a full scan."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veriframe.operators import postings

PASSAGES = "doc_id long, chunk_index int, content string"


@pytest.mark.parametrize(
    "text, want",
    [
        ("See URS-042 and TC-2026-042.", ["see", "urs-042", "and", "tc-2026-042"]),
        ("rule ANNEX11-S12-ACC-001, per 21  CFR 11.10(d);", ["rule", "annex11-s12-acc-001", "per", "21 cfr 11.10(d)"]),
        ("ICH Q9(R1) of GXP-MFG-DEMO-01", ["ich q9(r1)", "of", "gxp-mfg-demo-01"]),
        ("section 11.10(a) well-known up-to-date x-1-y", ["section", "11.10(a)", "well", "known", "up", "to", "date", "x-1-y"]),
        ("21 CFR eleven, ich, 5", ["21", "cfr", "eleven", "ich", "5"]),
        ("", []),
        (None, []),
    ],
)
def test_terms(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(postings.terms(F.col("t"))).first()[0] == want


def made(spark, n=240):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(i // 3, i % 3, " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(1, 60)))) for i in range(n)]
    rows[17] = (*rows[17][:2], rows[17][2] + " as URS-042 says")
    rows[90] = (*rows[90][:2], rows[90][2] + " 21 CFR 11.10(d) holds, URS-042 too")
    rows += [(1_000, 0, None), (1_001, 0, ""), (1_002, 0, "w0 " * 400), (1_003, 0, rows[5][2]), (1_004, 0, rows[5][2])]
    return rows


def brute(rows, asked, k):
    tokens = [re.findall(postings.TERM, re.sub(r"\s+", " ", (c or "").lower())) for _, _, c in rows]
    mean = sum(map(len, tokens)) / len(rows)
    df = Counter(t for own in tokens for t in set(own))
    out = []
    for query, text in asked:
        want = set(re.findall(postings.TERM, re.sub(r"\s+", " ", (text or "").lower())))
        scored = []
        for (doc, chunk, _), own in zip(rows, tokens):
            tf = Counter(own)
            score = sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 * tf[t] / (tf[t] + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t in want if tf[t])
            if score:
                scored.append((-round(score, 7), doc, chunk))
        out += [(query, r + 1, d, c) for r, (_, d, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search_is_a_full_scan(spark):
    rows = made(spark)
    of = postings.index(spark.createDataFrame(rows, PASSAGES).repartition(5))
    rng = random.Random(9)
    asked = [(i, " ".join(f"w{rng.randrange(45)}" for _ in range(rng.randint(1, 6)))) for i in range(30)] + [(90, None), (91, "unknown"), (92, "w0 w0 w0"), (93, "URS-042 w1"), (94, rows[5][2])]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for k in (1, 4):
        got = postings.search(of, queries, k)
        assert sorted(tuple(r)[:4] for r in got.collect()) == brute(rows, asked, k) == sorted(tuple(r)[:4] for r in postings.search(of, queries, k, prune=False).collect())


def test_positions_and_blocks(spark):
    of = postings.index(spark.createDataFrame([(1, 0, "a b a URS-042 a"), (2, 0, "b")], PASSAGES))
    assert {(r.term, r.doc_id): (r.tf, r.positions) for r in of.postings.collect()} == {("a", 1): (3, [0, 2, 4]), ("b", 1): (1, [1]), ("urs-042", 1): (1, [3]), ("b", 2): (1, [0])}
    bounds = of.postings.join(of.blocks, ["term", "block"]).where("weight > most").count()
    assert bounds == 0 and of.passages == 2


def test_exact_matches_stay(spark):
    """Passages with the query's identifiers come first in the fused list, though no other list has them."""
    of = postings.index(spark.createDataFrame(made(spark), PASSAGES))
    asked = spark.createDataFrame([(1, "w0 w1 w2 URS-042"), (2, "w3 under 21 CFR 11.10(d)"), (3, "w3")], "query_id long, text string")
    exact = postings.search(of, asked, 8, exact=True)
    assert {(r.query_id, 3 * r.doc_id + r.chunk_index) for r in exact.collect()} == {(1, 17), (1, 90), (2, 90)}
    dense = spark.createDataFrame([(q, r, 500 + r, 0) for q in (1, 2, 3) for r in range(1, 21)], "query_id long, rank int, doc_id long, chunk_index int")
    fused = postings.fuse(dense, postings.search(of, asked.withColumn("text", F.lit("w0")), 20), exact).collect()
    assert {(r.query_id, 3 * r.doc_id + r.chunk_index) for r in fused if r.exact} == {(1, 17), (1, 90), (2, 90)}
    assert [r.exact for r in sorted(fused, key=lambda r: (r.query_id, r.place)) if r.query_id == 1] == [True, True] + [False] * 6


def test_nothing_to_index(spark):
    of = postings.index(spark.createDataFrame([], PASSAGES))
    assert postings.search(of, spark.createDataFrame([(1, "a")], "query_id long, text string"), 3).count() == 0


@pytest.mark.parametrize("cells, few", [(1, True), (500, True), (1_000_000, True), (500, False)])
def test_search_in_slices(spark, monkeypatch, cells, few):
    """Passages scored a few at a time, many of them without any of the terms; and by a join, where the plan is too long for all tasks."""
    monkeypatch.setattr(postings, "CELLS", cells)
    monkeypatch.setattr(postings, "MOST_BROADCAST", 200_000 if few else 0)
    rows = made(spark)
    of = postings.index(spark.createDataFrame(rows, PASSAGES).repartition(3))
    asked = [(1, "w39"), (2, "w38 w30"), (3, "w0 w1 URS-042")]
    got = postings.search(of, spark.createDataFrame(asked, "query_id long, text string"), 4)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(rows, asked, 4)


def test_neither_postings_nor_scores_are_shuffled(spark):
    of = postings.index(spark.createDataFrame(made(spark), PASSAGES))
    assert "Exchange" not in of.postings._jdf.queryExecution().executedPlan().toString()
    found = postings.search(of, spark.createDataFrame([(1, "w0 w1 w2")], "query_id long, text string"), 4)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # the best of each task, and their ranks
