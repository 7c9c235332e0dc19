"""The chunk store's upserts, and sections of chunks against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from veriframe.operators import retrieval, sections
from veriframe.sources.chunk_store import ChunkStore

CHUNKS = "doc_id long, chunk_index int, content string"


def files(folder):
    return sorted(str(p) for p in folder.rglob("*.parquet"))


def test_upserts(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=8)
    assert store.table().count() == 0
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "k struct<d: long, c: int>, content string").select(F.col("k.d").alias("doc_id"), F.col("k.c").alias("chunk_index"), "content")
    state = {(d, c): f"text {d} {c}" for d in range(40) for c in range(3)}
    assert store.upsert(frame(state)) == {"inserted": 120, "changed": 0, "deleted": 0, "same": 0, "buckets": 8}
    before = files(tmp_path)
    assert store.upsert(frame(state))["buckets"] == 0 and files(tmp_path) == before  # nothing new: nothing written
    # One document edited, one chunk gone, one document new.
    state[7, 1] = "edited"
    del state[9, 2]
    state[100, 0] = None
    got = store.upsert(frame(state))
    assert (got["inserted"], got["changed"], got["deleted"], got["same"]) == (1, 1, 1, 118) and got["buckets"] <= 3
    read = lambda: {(r.doc_id, r.chunk_index): r.content for r in store.table().collect()}
    assert read() == state and [tuple(r) for r in store.tombstones().collect()] == [(9, 2, 2)]
    version, paths = store.manifest()
    assert version == 2 and sum("/v2/" in p for p in paths.values()) == got["buckets"]
    # A write that fails leaves the version readable; the next one replaces what it left.
    bad = frame(state | {(8, 0): "never"}).withColumn("content", F.when(F.col("content") == "never", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad)
    assert store.manifest() == (2, paths) and read() == state
    state[9, 2] = "back"
    assert store.upsert(frame(state))["inserted"] == 1 and read() == state and store.tombstones().count() == 0
    assert store.upsert(frame({}))["deleted"] == len(state) and read() == {} and store.tombstones().count() == len(state)


def brute_headings(text):
    out, at = [], 0
    for line in text.split("\n"):
        own = line.rstrip(" ")
        ends = re.search(r"[.,;:!?|]$", own)
        if m := re.match(sections.MARKED, line):
            out.append([at, None, len(m[1]), line])
        elif (m := re.match(sections.NUMBERED, line)) and not ends and len(own) <= 120:
            out.append([at, None, min(6, m[1].count(".") + 1), line])
        elif re.match("[A-Z]", own) and not ends and len(own) <= 60:
            out.append([at, None, 7, line])
        at += len(line) + 1
    for i, h in enumerate(out):
        h[1] = next((x[0] for x in out[i + 1 :] if x[2] <= h[2]), len(text))
        h[3] = re.sub("^#+", "", h[3]).strip(" ")
    return out


def test_sections(spark):
    rng = random.Random(4)
    lines = ["# One", "## Two of é", "### Three", "1 Scope", "1.2 Terms used", "1.2.3. Deep", "A short heading", "a line of text that goes on, as lines do.", "More text; it ends as a sentence does.", "", "2024 was a year.", "####### no heading as it has seven marks, and is a sentence."]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "no heading at all.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in sections.headings(frame).collect():
        got.setdefault(r.doc_id, []).append([r.start, r.end, r.level, r.title])
    want = {i: h for i, t in docs if t and (h := brute_headings(t))}
    assert {k: sorted(v) for k, v in got.items()} == want
    hits = retrieval.chunks(frame, 60, 10).select("doc_id", "chunk_index").withColumn("score", F.lit(1.0))
    text = dict(docs)
    found = sections.parent_sections(hits, frame, 50).collect()
    assert len(found) == hits.count()
    for r in found:
        at = 50 * r.chunk_index
        inside = [h for h in want.get(r.doc_id, []) if h[0] <= at < max(h[1], h[0] + 1)]
        a, b = min(((h[0], h[1]) for h in inside), key=lambda s: s[1] - s[0], default=(0, len(text[r.doc_id])))
        assert (r.start, r.end, r.section) == (a, b, text[r.doc_id][a:b])
