"""Main text where names say too much or too little: open names, controls in sentences, comments by their form."""

from __future__ import annotations

import pytest

from veriframe.llm import html_text

LONG = "Words of an article that go on and on, so that it is long enough to be prose. " * 3
LEAD, END = f"<h1>Head</h1><p>{LONG}</p>", f"<p>The end. {LONG}</p>"
MORE = "A paragraph of the article that tells more, in a whole sentence."


def text_of(inner, after=""):
    return html_text.extract(f'<body><nav><a href="/">Home</a></nav><article>{LEAD}{inner}{END}</article>{after}</body>', None)


@pytest.mark.parametrize("inner", [f"<div class='hidden-gems'><p>{MORE}</p></div>", f"<section class='alerts'><p>{MORE}</p></section>", f"<p id='promotion'>{MORE}</p>", f"<h2 id='related-work'>{MORE}</h2>", f"<p><label>{MORE.split()[0]}</label> {' '.join(MORE.split()[1:])}</p>", f"<p>{' '.join(MORE.split()[:-1])} <button>{MORE.split()[-1]}</button></p>"])
def test_prose_stays(inner):
    assert text_of(inner) == "\n\n".join(["Head", LONG.strip(), MORE, f"The end. {LONG.strip()}"])


COMMENT = "<div class='item'><span class='author'>Ann</span><p>I think so too, and said so at length before.</p></div>"


@pytest.mark.parametrize(
    "gone",
    [
        f"<section id='discussion'><h3>3 Comments</h3>{COMMENT * 3}</section>", f"<div><h3>Comments</h3>{COMMENT * 2}</div>", f"<ol><li>2 Kommentare</li>{COMMENT}{COMMENT}</ol>", "<p><button>Share</button></p>", "<form><label>Mail</label><input><button>Go</button></form>",
        "<div class='related-posts'><p>Another story of ours, told in one sentence.</p></div>", "<div class='alerts'><a href='/x'>See all of our alerts</a></div>", "<div class='ad'>Buy this thing, it is really very good.</div>", "<div class='newsletter'><p>Sign up for our letter, it is free.</p></div>",
    ],
)
def test_boilerplate_goes(gone):
    want = "\n\n".join(["Head", LONG.strip(), f"The end. {LONG.strip()}"])
    assert text_of(gone) == want and text_of("", gone) == want


def test_headings_about_comments_stay():
    """A section on comments or a discussion, without signed items, is the article's."""
    assert "Comments\n\n" + MORE in text_of(f"<section><h2>Comments</h2><p>{MORE}</p><p>{MORE}</p></section>")
    assert "Discussion\n\n" + MORE in text_of(f"<section id='discussion'><h2>Discussion</h2><p>{MORE}</p></section>")


def test_hosts_vote_on_open_names(spark):
    """A notice that a host repeats goes; a box of the same name whose text is each page's own stays."""
    page = lambda n, name, said: f"<body><article>{LEAD}<div class='{name}'><p>{said}</p></div><p>Page {n} ends. {LONG}</p></article></body>"
    rows = [(n, "http://same.com/x", page(n, "notice", "We changed our terms; read them with care.")) for n in range(4)]
    rows += [(10 + n, "http://own.com/x", page(n, "notice", f"Note {n}: the fruit must be ripe, as number {n} shows.")) for n in range(4)]
    rows += [(20, "http://alone.com/x", page(0, "notice", "The only page of its host has a note of its own.")), (21, None, None)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert not any("terms" in got[n] for n in range(4))
    assert all(f"Note {n}: the fruit" in got[10 + n] for n in range(4))
    assert "a note of its own" in got[20] and got[21] == ""
