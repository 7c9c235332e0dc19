"""The pipeline's stages, each against brute force on what the one before kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_near_copies import brute
from tests.llm.test_operators import brute_spans, docs
from veriframe.llm import decontaminate, mixing, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and gave, as rows by doc_id."""
    base = tmp_path_factory.mktemp("stages")
    at, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before = at
        stage(spark, at, SF).write.parquet(str(base / name))
        at = spark.read.parquet(str(base / name))
        out[name] = (before.collect(), at.collect())
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert all(list(r.asDict()) == COLUMNS for name in list(stages)[:-1] for r in stages[name][1][:1])


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r._score for r in toxicity.score_rows(frame, toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if scores[r.doc_id] < 0.7)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.translate(low).strip(" \t\n\x0b\x0c\r")
    seen: dict[str, set[int]] = {}
    for r in before:
        for line in (r.text or "").split("\n"):
            seen.setdefault(key(line), set()).add(r.doc_id)
    gone = {k for k, ids in seen.items() if k and len(ids) >= 10}
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if key(x) not in gone) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(stages):
    """Against all pairs of five-word shingle sets: the operator's contract for this stage is a similarity of 0.8, not op10's two bits."""
    before, after = stages["near_duplicates"]
    assert sorted(r.doc_id for r in after) == brute({r.doc_id: r.text or "" for r in before})
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in after}
    dirty = {r.doc_id for r in before if brute_spans(r.text or "", items, 10)[0]}
    assert dirty and text.keys() == {r.doc_id for r in before}
    assert all(text[r.doc_id] == r.text for r in before if r.doc_id not in dirty)
    assert not any(brute_spans(text[k] or "", items, 10)[0] for k in dirty)
    for r in before:  # exactly the words that lie in an occurrence go
        if r.doc_id in dirty:
            words = decontaminate.words_of(r.text.encode())
            hit = brute_spans(r.text, items, 10)[0]
            assert decontaminate.words_of(text[r.doc_id].encode()) == [w for k, w in enumerate(words) if k not in hit]


def test_stages_on_empty_odd_and_long_rows(spark, monkeypatch):
    """Each stage on an empty table, and on nulls, repeats, a very long text and columns with clashing names."""
    monkeypatch.setattr(toxicity, "STEPS", 20)
    odd = docs(spark, (None, None), (None, None), (1, ""), (1, "a text of some words"), (1, "a text of some words"), (2, "long words " * 150_000, None), (3, "漢" * 5_000)).withColumn("_score", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("copy", F.lit(2))
    for name, stage in pipeline.STAGES:
        for frame, n in ((odd.limit(0), 0), (odd, 7)):
            got = stage(spark, frame, SF)
            assert got.columns[: len(COLUMNS)] == COLUMNS
            rows = got.collect()
            if not n or name in ("toxicity", "line_dedup", "decontamination"):
                assert len(rows) == n or (name == "toxicity" and len(rows) <= n)
            if n and name != "toxicity":
                assert any(r.text and len(r.text) == 11 * 150_000 for r in rows) or name == "mixing"
            if n and name == "near_duplicates":
                assert len(rows) == 4 and sum(not r.text for r in rows) == 1
            if n and name == "mixing":
                assert all(r.text for r in rows) and sum(len(r.text.split()) for r in rows) > 0


def test_mixing(stages):
    before, after = stages["mixing"]
    size = {r.doc_id: len((r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("") for r in before}
    sums: dict = {}
    for r in before:
        sums[r.source] = sums.get(r.source, 0) + size[r.doc_id]
    target, taken = mixing.targets(list(sums.items())), dict.fromkeys(sums, 0)
    for r in after:
        taken[r.source] += size[r.doc_id]
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= max(1, longest) for s in sums)
    assert all(r.copy in (1, 2) for r in after)


def test_run(spark, stages):
    assert pipeline.run(spark, SF).select(F.count("*")).first()[0] == len(stages["mixing"][1])
