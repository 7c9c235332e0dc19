"""Operator 11 against a plain trie, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from veriframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 long"
NONE = hashlib.sha256(b"").hexdigest()


def conversations(spark, rows):
    """Rows (conv_id, turn, role, text) with columns that clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def brute(rows):
    sha = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, sha(role, text), role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        seq = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ended[seq].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    stats = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].split()) if node else 0
        below = [stats[k] for k in kids[node]]
        stats[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(kids[n]), *stats[n], hashlib.sha256(",".join(map(str, ended[n])).encode()).hexdigest()) for n in members
    )


def result(spark, rows):
    got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def made(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in sorted(rng.sample(range(-50, 200), n)):
        for turn in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "a b c"])))
    return rows


def test_against_brute_force(spark):
    rows = made(1, 90, 7)
    assert result(spark, rows) == brute(rows)


def test_conversations_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    # One conversation has a third of all rows, and a copy that leaves it late.
    long = [(40, t, "user", f"word {t % 3}") for t in range(70)]
    copy = [(60, t, "user", f"word {t % 3}") for t in range(61)] + [(60, 61, "user", "other words")]
    rows = long + copy + made(2, 30, 9)
    assert result(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_missing_bases(spark):
    rows = [
        (0, None, "user", "first"), (0, 0, "user", "second"), (0, 0, "bot", "tie"), (0, 0, "bot", "tie"),
        (7, 1, None, None), (7, 2, "user", ""), (None, 1, "user", "no id"), (23, 0, "user", "base absent"), (23, 1, "user", "two"), (24, 0, "user", "turnless perhaps"),
        (25, 0, "u", "x" * 300_000 + " y"), (45, 0, "u", "x" * 300_000 + " y"), (45, 1, "u", "x" * 300_000 + " z"),
    ]
    assert result(spark, rows) == brute(rows)


def test_many_copies_of_one_conversation(spark):
    """A first turn, a conversation and an end that very many share."""
    rows = [(20 * c, t, "user", f"t{t}") for c in range(2_500) for t in range(2)] + [(1, 0, "user", "t0")]
    got = result(spark, rows)
    assert got == brute(rows)
    assert max(r[3] for r in got) >= 2_500


def test_empty_and_single(spark):
    assert result(spark, []) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # loses all its turns and its base is absent
    assert result(spark, [(lone, 0, "user", "gone")]) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


@pytest.mark.parametrize("text, words", [("", 0), (" \t\n", 0), ("a\x0bb c", 3), (" x", 1)])
def test_words(spark, text, words):
    rows = [(0, 0, "u", text), (20, 0, "u", text)]
    got = {r[1]: r for r in result(spark, rows)}
    assert (got[1][3], got[1][6]) == (2, words)
