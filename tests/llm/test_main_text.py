from __future__ import annotations

import itertools
import random

import pytest
from llm_fixtures import with_clashes

from tallyloom.llm import main_text as mt

A = "This is the first paragraph of the article, and it has a number of words."
B = "Here comes another one, which goes on about the same matter for a while."
C = "Finally, the article ends with a short remark."
CHROME = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News of the day</a></ul></nav>"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<article><h1>Title</h1><p>{A}<p>{B}</article>", f"Title {A} {B}"),
        (f"<body><header>Site name</header>{CHROME}<main><p>{A}</p><p>{B}</p></main><footer>&copy; us</footer>", f"{A} {B}"),
        (f"<div class='content'><p>{A}</p><div class=ad>Buy this now, it is great!</div><p>{B}</p></div>", f"{A} {B}"),
        (f"<article><p>{A}</p><section id='comments'><p>{B}</p><article class=comment><p>{B}</p></article></section></article>", A),
        (f"<aside class=sidebar><p>{B}</p></aside><article><p>{A}</p><form><p>{B}</p><textarea>x</textarea></form></article>", A),
        (f"<div id=cookie-notice><p>{B}</p></div><article><p>{A}</p></article><div class='newsletter'><p>{B}</p></div>", A),
        (f"<div class='layout with-sidebar'><main><p>{A}</p></main><div class=sidebar><p>{B}</p></div></div>", A),
        (f"<article><header><h1>Title here</h1></header><p>{A}</p></article>", f"Title here {A}"),
        (f"<article><script>var a='<p>{B}</p>'</script><style>p{{}}</style><!-- <p>{B}</p> --><p>{A}</p></article>", A),
        ("<article><p>a &lt;b&gt; &amp; &eacute;&#233;&#x41; c&nbsp;d\n\t e.</p></article>", "a <b> & ééA c d e."),
        (f"<article><p>in<b>li</b>ne <i>words</i> and{C}<br>more</p></article>", f"inline words and{C} more"),
        (f"<article><p>{A}</p><p>{B[:20]}<scr", f"{A} {B[:20]}"),
        (f"<article><p>{A} 1 < 2 and 3 > 2</p></article>", f"{A} 1 < 2 and 3 > 2"),
        (f"<ARTICLE><P TITLE='a>b'>{A}</P></ARTICLE>", A),
        (f"<html><body class='home sidebar-left'><div class=post><p>{A}</p><p>{B}</p></div></body>", f"{A} {B}"),
        (f"<article><p>{A}</p><p hidden>{B}</p><div style='display: none'>{B}</div></article>", A),
    ],
)
def test_pages(page, want):
    assert " ".join(mt.content_blocks(page)) == want


def test_short_blocks_follow_their_surroundings():
    page = f"<body><div><p>{A}</p><p>Why.</p><p>{B}</p></div><div><a href=x>Ok</a></div>{CHROME}</body>"
    assert mt.content_blocks(page) == [A, "Why.", B]


def test_minimum_cut_is_minimal():
    draw = random.Random(2)
    for _ in range(500):
        n = draw.randint(0, 8)
        unary = [draw.randint(-6, 6) for _ in range(n)]
        edges = [(a, b, draw.randint(1, 5)) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]

        def cost(labels):
            own = sum(abs(u) for u, x in zip(unary, labels) if u and (u > 0) != x)
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert cost(mt.minimum_cut(unary, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_large_and_broken_pages():
    assert len(mt.content_blocks("<article>" + f"<div><p>{A}</p></div>" * 20_000)) == 20_000
    for page in ["<div><p>a<li>x" * 20_000, '<p title="' * 20_000, "<" * 100_000, "<!--" * 50_000, "&#" * 50_000, "</p>" * 50_000, "<a>" * 20_000 + "x"]:
        mt.content_blocks(page)


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{A}</p></article>"), (1, "u", f"<article><p>{A}</p></article>"), (None, None, None), (2, "v", "")]
    pages = with_clashes(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = sorted([tuple(r) for r in mt.main_text(pages).collect()], key=str)
    assert got == sorted([(1, "u", A, 1), (1, "u", A, 1), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert mt.main_text(pages.limit(0)).count() == 0


def test_given_pages(spark):
    """The given pages hold their article in one element; everything in it, and nothing else, is content."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        inner = re.search(r"<article>(.*?)(?:</article|\Z)", r.html, re.S)[1]
        bare = re.sub(r"<(?!/?(?:b|a|i)\b)[a-zA-Z/!][^>]*(?:>|\Z)", " ", inner)
        want = html.unescape(re.sub(r"<[a-zA-Z/!][^>]*(?:>|\Z)", "", bare))
        assert " ".join(mt.content_blocks(r.html)) == " ".join(want.split())
