"""Operator 13: base spans against the plain patterns, the field on rows kept apart, and edge cases."""

from __future__ import annotations

import random
import re
import timeit

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_operators import docs
from veriframe.llm import personal_data as pd13

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
            keep = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if keep:
                out.append((n, *m.span()))
    return out


@pytest.fixture(scope="module")
def field(spark):
    return pd13.learn(pd13.labelled_table(spark))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z", "@", ".", "-", "%", "+", "1", "0", "25", "255", "256", "0007", " ", "(", ")", "\n", "é", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "1.2.3.4", "a@b.c"]), max_size=24).map("".join))
def test_base_is_the_plain_patterns(text):
    assert pd13.base_spans(text) == brute(text)


def test_base_in_texts_of_the_tables(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [pd13.base_spans(t) for t in texts] == [brute(t) for t in texts]


def _found(field, rows):
    """Of labelled lines by kind, those whose spans are all found, and no others, without any base span."""
    got = pd13.learned_spans([t for t, _ in rows], [[] for _ in rows], field)
    out = {}
    for (_, spans), own in zip(rows, got):
        want = [(pd13.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
        out.setdefault(spans.split(":")[0], []).append(sorted(own) == sorted(want))
    return {k: sum(v) / len(v) for k, v in out.items()}


def test_lines_kept_apart(field, monkeypatch):
    monkeypatch.setattr(pd13, "SEED", 99)  # other values, in other contexts
    found = _found(field, pd13.labelled_lines())
    assert min(found.values()) >= 0.97


def test_formats_never_seen(spark, monkeypatch):
    """One format in four kept from the field: two formats of three of emails are found, of other kinds about a half, with no false alarm."""
    every = pd13.VALUES
    monkeypatch.setattr(pd13, "VALUES", {k: [v for i, v in enumerate(vs) if i % 4 != 2] for k, vs in every.items()})
    field = pd13.learn(pd13.labelled_table(spark))
    monkeypatch.setattr(pd13, "VALUES", {k: [v for i, v in enumerate(vs) if i % 4 == 2] for k, vs in every.items()})
    found = _found(field, pd13.labelled_lines())
    assert found[""] >= 0.97 and found["email"] >= 0.6 and min(found.values()) >= 0.45


def test_field_is_exact():
    """Viterbi and forward-backward against all label sequences."""
    rng = np.random.default_rng(1)
    features = pd13.Features()
    words = [["a", "1-2", "b@c"], ["x", "+1"], ["44"]]
    x = [features.of(w) for w in words]
    features.growing = False
    field = pd13.Field(features, rng.normal(size=(len(features.known) + 1, pd13.LABELS)), rng.normal(size=(pd13.LABELS, pd13.LABELS)))
    field.weights[0] = 0  # where there is no feature
    for w, own, got in zip(words, x, field.decode(words)):
        emit = np.array([field.weights[f].sum(axis=0) for f in own])
        best = max(np.ndindex(*[pd13.LABELS] * len(w)), key=lambda y: sum(emit[i][k] for i, k in enumerate(y)) + sum(field.follow[a, b] for a, b in zip(y, y[1:])))
        assert tuple(got) == best
    # The gradient against differences of the likelihood.
    rows, lengths = pd13._padded(x)
    y, inside = np.array([[0, 7, 1], [0, 7, 0], [5, 0, 0]]), np.arange(3) < lengths[:, None]

    def likelihood(follow):
        total = 0.0
        for i, n in enumerate(lengths):
            emit = np.array([field.weights[f].sum(axis=0) for f in x[i]])
            score = lambda y: sum(emit[t][k] for t, k in enumerate(y)) + sum(follow[a, b] for a, b in zip(y, y[1:]))
            total += score(y[i][:n]) - np.log(sum(np.exp(score(z)) for z in np.ndindex(*[pd13.LABELS] * n)))
        return total

    up = field._gradient(rows, y, inside)[1]
    for a, b in ((0, 7), (7, 1), (3, 4)):
        more = field.follow.copy()
        more[a, b] += 1e-5
        assert abs((likelihood(more) - likelihood(field.follow)) / 1e-5 - up[a, b]) < 1e-3


def test_adjacent_cards_that_the_pattern_takes_as_one(field):
    text = "paid with 4111111111111111 5500000000000004 and more"
    assert pd13.base_spans(text) == []
    assert pd13.learned_spans([text], [[]], field) == [[(2, 10, 26), (2, 27, 43)]]


def test_scan(spark, field):
    mail = "write to jane.doe@example.com, or jane (at) firma.com. call (017) 555-7713!"
    rows = [(1, None), (2, ""), (3, mail), (3, mail), (4, "no data in 2024-01-05, 3.14 and 473696257"), (5, "x" * 500_000 + " 10.0.0.1 " + "1" * 400_000), (6, "a b " * 50_000 + "+49 30 901820 end")]
    got = {}
    for r in pd13.scan(docs(spark, *rows), field).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    one = got[3][0]
    assert (one.n_email, one.n_phone, one.base) == (1, 0, "email:9:29")
    assert [mail[int(a) : int(b)] for _, a, b in (s.split(":") for s in one.spans.split(","))] == ["jane.doe@example.com", "jane (at) firma.com", "(017) 555-7713"]
    for k in (1, 2, 4):
        assert (got[k][0].base, got[k][0].spans, got[k][0].n_learned) == ("", "", 0)
    assert got[5][0].base == "ip:500001:500009" and got[6][0].base == "phone:200000:200013"
    assert pd13.scan(docs(spark), field).count() == 0


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1 " * 60_000, "+1((" * 100_000, "1." * 200_000, "a@" * 200_000, "(at)" * 100_000])
def test_time_is_linear(field, text):
    assert timeit.timeit(lambda: pd13.learned_spans([text], [pd13.base_spans(text)], field), number=1) < 6


def test_learning_from_little(spark):
    empty = pd13.learn(spark.createDataFrame([], "text string, spans string"))
    assert pd13.learned_spans(["call 017-555-7713"], [[]], empty) == [[]]
    rng = random.Random(1)
    rows = [(f"k {rng.randint(100, 999)}-{rng.randint(1000, 9999)} z", "phone:2:10") for _ in range(40)] + [("nothing 12", None), (None, "x")]
    field = pd13.learn(spark.createDataFrame(rows, "text string, spans string"))
    assert pd13.learned_spans(["k 555-1234 z"], [[]], field) == [[(3, 2, 10)]]
