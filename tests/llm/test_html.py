import html
import random
import re

import numpy as np
import pytest

from fleetcat.llm import op12
from fleetcat.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
S = "A sentence, with some words; and a full stop."


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


BOILERPLATE = [
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News, all of it.</a></li></ul></nav>",
    '<div class="menu"><a href=/x>One</a> <a href=/y>Two</a></div>',
    "<header><h1>Site name</h1><p>A motto, long enough to look like text.</p></header>",
    f"<aside><p>{S} {S}</p></aside>", f'<div class="sidebar-right"><p>{S} {S}</p></div>', f"<div id=cookieNotice><p>{S} We use cookies.</p></div>",
    f'<div class="ad">{S}</div>', f'<p class="advert">{S}</p>', f"<form action=/s><label>Search</label><input name=q><p>{S}</p></form>",
    "<script>var t = '</p><p>not text, no.</p>';</script>", "<style>p { margin: 0 }</style>", "<!-- a comment, <p>not text.</p> -->",
    f'<section id="comments"><h2>2 comments</h2><article class="comment"><p>{S} {S} {S}</p></article></section>',
    f'<ol class="commentlist"><li><p>{S} {S}</p></li></ol>', f"<noscript><p>{S}</p></noscript>", f"<template><p>{S}</p></template>",
    f'<div role="alert">{S}</div>', f'<div style="display: none">{S}</div>', f"<div hidden><p>{S}</p></div>",
    "<footer>&copy; example, all rights reserved.</footer>", '<div class="share social">Share this, now.</div>']

ARTICLES = [
    (f"<h1>Title &amp; more</h1><p>{S}</p><p>Short</p><p>{S} {S}</p>", f"Title & more {S} Short {S} {S}"),
    (f"<h1>T</h1><p><b>{S}<br><p>{S}</p><ul><li>one<li>two <i>it</i></ul><p>{S}</p>", f"T {S} {S} one two it {S}"),
    (f"<header><h1>Own heading</h1></header><section><h2>Part</h2><p>{S}</p></section><section><p>x</p></section>", f"Own heading Part {S} x"),
    (f"<p>{S}</p><table><tr><th>a<th>b<tr><td>1<td>2</table><blockquote>{S}</blockquote><pre>x\n  y</pre>", f"{S} a b 1 2 {S} x y"),
    ("<p>tiny</p>", "tiny")]


@pytest.mark.parametrize("inside, text", ARTICLES)
@pytest.mark.parametrize("tag", ["article", "main", 'div role="main"'])
def test_article_among_boilerplate(inside, text, tag):
    rng = random.Random(len(inside))
    for _ in range(6):
        noise = rng.sample(BOILERPLATE, 7)
        within = rng.choice([x for x in BOILERPLATE if not x.startswith("<header")])
        source = page("".join(noise[:4]) + f"<{tag}>{inside}{within}</{tag.split()[0]}>" + "".join(noise[4:]))
        assert op12.main_text(source) == text


@pytest.mark.parametrize("inside, text", ARTICLES[:2])
def test_div_article_by_path_ratios(inside, text):
    """Nothing but the ratios of its paths tells this article from the rest."""
    rest = "<div><a href=/a>Home</a> <a href=/b>News</a></div>"
    more = "<div><span>Latest</span> <a href=/c>c</a></div><div>Imprint</div>"
    assert op12.main_text(page(f"{rest}<div><div>{inside}<p>{S} {S}</p></div></div>{more}")) == f"{text} {S} {S}"


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("   ", ""), ("<", "<"), ("plain text, no tag", "plain text, no tag"), ("a < b", "a < b"), ("<p>a<!-- open", "a"), ("<p>a<scr", "a"),
    ("<article>&lt;b&gt; &#233;&#x4e;&nbsp;x&amp</article>", "<b> éN x&"), ("<article><p>cut off &am", "cut off &am"),
    ("<article><p title='a > b'>x</p></article>", "x"), ("<article><p title=don't>x</p><p>it's</p></article>", "x it's"),
    ("<ARTICLE><P>x</P></ARTICLE>", "x"), ("<article></div></p><p>x</b></i></article>", "x"), ("<article><p>a<script>if (a < b) x('</p>')", "a"),
    ("<article><p>a\n\t b c</p>\n<p> d</p></article>", "a b c d"), ("<article>a<br>b<br/>c</article>", "a b c"),
    ("<article><h1>x</h1><h2>y<p>z</article>", "x y z"), ("<nav>x</nav><footer>y</footer>", ""), ("<article><svg><title>t</title><path/></svg>x</article>", "x"),
    ("<form><main><p>x</p></main></form>", "x"), ('<div class="has-sidebar no-ads"><p>x</p></div>', "x"), ("<article>a <b>b</b>c <a href=x>d</a></article>", "a bc d")])
def test_small_pages(source, text):
    assert op12.main_text(source) == text


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + f"<p>{S}</p>" + "</div>" * 50_000
    assert op12.main_text(page(deep)) == S
    assert op12.main_text(page("<article>" + f"<p>{S}</p>" * 60_000 + "</article>")) == " ".join([S] * 60_000)
    assert op12.main_text(page("<article><p>" + "word " * 1_000_000 + "</p></article>")) == " ".join(["word"] * 1_000_000)
    assert op12.main_text("<article>" + "<b>x" * 20_000) == "x" * 20_000
    assert op12.main_text("<article><p>" + "<" * 200_000) == "<" * 200_000


def test_path_values_by_plain_python():
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 40):
        paths, size, marks = ([rng.randrange(k) for _ in range(n)] for k in (5, 300, 9))
        mean = {p: [sum(v for q, v in zip(paths, x) if q == p) / paths.count(p) for x in (size, marks)] for p in paths}

        def smooth(i, which):
            near = [j for j in range(i - 2, i + 3) if 0 <= j < n]
            weight = [np.exp(-0.5 * (i - j) ** 2) for j in near]
            return sum(w * mean[paths[j]][which] for w, j in zip(weight, near)) / sum(weight)

        fused = [smooth(i, 0) * (1 + smooth(i, 1)) for i in range(n)]
        want = [np.mean([f for q, f in zip(paths, fused) if q == p]) for p in paths]
        value, threshold = op12.path_values(np.array(paths), np.array(size, float), np.array(marks, float))
        assert np.allclose(value, want) and np.isclose(threshold, np.std(fused))


def test_table(spark):
    schema = "page_id long, url string, html string, text string, path string, n_chars long"
    rows = [(1, "u", "<article><p>x</p></article>", "t", "p", 9), (1, "u", "<article><p>x</p></article>", "t", "p", 9), (None, None, None, None, None, None),
            (2, None, "", "t", "p", 0)]
    found = op12.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [(1, "u", "x"), (1, "u", "x"), (None, None, ""), (2, None, "")]))
    assert op12.extract(spark.createDataFrame([], schema)).collect() == []


def test_whole_table_by_plain_python(spark):
    """The given pages hold one article element each: its text by removing tags."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        want[r.page_id] = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())
    found = QUERIES["op12_html_extraction"](spark, SF).collect()
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)
