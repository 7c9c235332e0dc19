"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.test_operators import docs
from veriframe.llm import decontaminate, html_text, secrets, toxicity

# 1: main text

LEAD, BODY, SECOND = "A lead that is long enough to count as prose.", "Body words of a long article go on and on here. " * 40, "A closing paragraph beside the inner container."


@pytest.mark.parametrize("tag", ["article", "main"])
def test_headline_and_lead_stay(spark, tag):
    page = f'<body><nav><a href="/">Home of it all, with a long name</a></nav><{tag}><h1>Head</h1><p class="lead">{LEAD}</p><div class="body"><p>{BODY}</p></div><section><p>{SECOND}</p></section></{tag}><p>Outside of it all, and long enough.</p></body>'
    want = f"Head\n\n{LEAD}\n\n{BODY.strip()}\n\n{SECOND}"
    rows = [(k, f"http://a.com/{k}", page) for k in range(3)]
    assert {r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {want}
    assert html_text.extract(page, None) == want


def test_lists_of_links_in_main_stay_out():
    links = "".join(f'<li><a href="/{k}">Another story of ours, number {k}</a></li>' for k in range(9))
    page = f'<body><main><div class="body"><p>{BODY}</p><p>{BODY}</p></div><ul>{links}</ul></main></body>'
    assert html_text.extract(page, "/body/main/div.body") == f"{BODY.strip()}\n\n{BODY.strip()}"


# 3: toxicity


def test_long_words_are_read_to_their_end():
    rng = random.Random(6)
    for letters in ("abc", "éü", "漢字仮名", "aé漢😀"):
        word = "".join(rng.choice(letters) for _ in range(500)).encode()
        pieces = toxicity.pieces_of(b"short " + word)
        assert pieces[0] == b"short" and all(len(p) <= toxicity.PIECE and p.decode() for p in pieces)
        inside = {p[i : i + n] for p in pieces[1:] for n in (3, 5) for i in range(len(p) - n + 1)}
        assert {word[i : i + n] for n in (3, 5) for i in range(len(word) - n + 1)} <= inside
    assert toxicity.ngrams(b"a" * 64 + b"x") != toxicity.ngrams(b"a" * 64 + b"y")
    for broken in (b"\x80" * 300, b"\xff\x80" * 200):  # no UTF-8: still ends, still whole
        assert b"".join(toxicity.pieces_of(broken)).count(b"\x80") >= broken.count(b"\x80")
    text = "some words of a text, " * 40
    assert toxicity.pieces_of(text.encode()) == decontaminate.words_of(text.encode())


def test_ends_of_long_words_count():
    model = toxicity.Model([])
    model.document = np.array([0.0, 1.0, 0.0, 0.0, 0.0])
    one, other = toxicity.Scorer(model).score([("漢" * 100 + "字" * 30).encode(), ("漢" * 130).encode()])
    assert one != other


# 5: secrets


def test_short_and_plain_credentials_are_scored(spark):
    rng = random.Random(7)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    capitals, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    both = [draw(capitals, 12) for _ in range(200)] + [draw(capitals + digits, 13) for _ in range(200)]
    prose = lambda: " ".join(draw("etaoinshrdlu", 8) for _ in range(12))
    rows = [(k, f"{prose()} password = {word} {prose()}") for k, word in enumerate(both)]
    letters, mixed = draw(capitals, 12), draw(capitals, 6) + draw(digits, 3) + draw(capitals, 4)
    frame = docs(spark, *rows, (900, f"the {letters} here"), (901, f"the {mixed} here"), (902, "the counterrevolutionary internationalization here"))
    got = {r.doc_id: r for r in secrets.scan(frame, secrets.learn(frame)).collect()}
    assert [(got[k].base, got[k].spans) for k in (900, 901, 902)] == [("", "like_assign:4:16"), ("", "like_assign:4:17"), ("", "")]


def test_background_is_of_all_texts(spark):
    frame = docs(spark, (1, "some words, numbered 2024.123, token=Abc123def456ghi"), (2, None), (3, "numbered again"))
    back = secrets.learn(frame).back
    want = secrets.follows_of(secrets.Counter({secrets.classes("numbered"): 2, "0000.000": 1}))
    assert back.after.keys() == {k[:2] for k in want} and back.score("0000.000") > back.score("AAAA.AAA")
