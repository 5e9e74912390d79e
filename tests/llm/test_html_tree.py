"""op13: held-out pages against their own markup, pages of other layouts, messages against enumeration, odd rows."""

import html
import itertools
import re

import numpy as np
import pytest

from foliant.llm import html_pages, html_tree

A = "The river rose again last night, and the road to the mill was closed by the police at about ten. Nobody was hurt."
B = "Farmers in the valley have asked for help: they say the dams that were built in 1960 no longer hold what falls in a week."
C = "Great piece, thank you! I remember the flood of 1987 very well, we had to carry my grandmother out through a window."
HARD = [
 (f'<!DOCTYPE html><html><head><title>x</title><script>if(a<b){{document.write("<p>no</p>")}}</script></head><body><div class="cookie-consent"><p>This website uses cookies. Accept all or choose.</p></div><div id="nav-main"><a href=/>Home</a><a href=/b>About us</a></div><div id="main-content"><h1>Flood</h1><p>{A}</p><p>{B}</p><div class="advertisement"><p>Cheap boats! Call now.</p></div><p>{A}</p></div><div id="comments-section"><h3>What readers say</h3><p>{C}</p><p>{C}</p></div><div id="right-rail"><p>{B}</p></div><div id="page-footer"><p>All rights reserved 2020</p></div></body></html>', ["Flood",A,B,A]),
 (f'<body><header><nav><a href="/">Home</a></nav><h2>My site</h2></header><article><h1>Flood</h1><p>{A}<br>{B}</p><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table></article><aside><h3>Related</h3><p>{B}</p></aside><section class="comments"><article class="comment"><p>{C}</p></article></section><footer>Imprint</footer></body>', ["Flood",A+" "+B,"one","two","a","b"]),
 (f'<body><main><article><h1>Flood</h1><p>{A}</p><p>{B}</p><section class="comments"><h2>Comments</h2><p>{C}</p><form action="/c"><label>Your name</label><textarea>hi</textarea></form></section></article></main><div class="notice">{B}</div></body>', ["Flood",A,B]),
 (f'<body><div class="wrapper"><div class="sidebar"><h4>Archive</h4><ul><li><a href="1">May</a></li><li><a href="2">June</a></li></ul></div><div class="post-body"><h2>Flood</h2><p>{A}</p><p>Short.</p><p>{B}</p></div><form class="newsletter"><p>Get the best of the valley by mail every week, for free, no strings attached.</p></form></div><div class="footer">Powered by mills</div></body>', ["Flood",A,"Short.",B]),
 (f'<html><body><nav><ul><li><a href="/">A</a></li></ul></nav><div class="ad">{A}</div><article><h1>T &amp; U</h1><p>{B}</p></article><aside class="sidebar">{A}</aside><div class="comments"><p>{C}</p><p>{A}</p></div><div class="cookie-notice">{B}</div><form><p>{A}</p></form><footer>{B}</footer></body></html>', ["T & U",B]),
 (f'<html><body><article><header><h1>T</h1></header><p>{A}</p><aside><p>{B}</p></aside><p>{B}</p><div class="comments"><p>{C}</p></div></article></body></html>', ["T",A,B]),
]


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_tree.train(pages)


def inside_article(source):
    """The main text by the given pages' own markup, for which a pattern is enough."""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", source, re.S)[1])
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b.replace("<b>", ""))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf):
    rows = html_tree.query(spark, sf)
    assert rows.columns == ["page_id", "url", "text", "n_chars"]
    bodies = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in rows.collect()}
    assert len(got) == len(bodies)
    for k, body in bodies.items():
        assert got[k].text == inside_article(body) and got[k].n_chars == len(got[k].text)


def test_pages_that_it_was_not_fitted_on(pages, spark):
    """Fitted on the even pages, right on the odd ones; nearly so when their tags and classes are made plain."""
    rows = pages.orderBy("page_id").collect()
    model = html_tree.fit([r.html for r in rows if r.page_id % 2 == 0][: html_tree.SAMPLE])
    odd = [r.html for r in rows if r.page_id % 2]
    read = lambda sources: ["\n".join(t for t, p in runs if p > 0.5) for runs in model.runs(sources)]
    assert read(odd) == [inside_article(s) for s in odd]
    plain = [re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", s).replace(' class="ad"', "") for s in odd]
    right = sum(a == inside_article(s) for a, s in zip(read(plain), odd))
    assert right >= 0.95 * len(odd)


@pytest.mark.parametrize("k", range(len(HARD)))
def test_other_layouts(model, k):
    source, want = HARD[k]
    assert [t for t, p in model.runs([source])[0] if p > 0.5] == want


def test_messages_against_enumeration():
    rng = np.random.default_rng(2)
    parents, kinds = [-1, 0, 1, 1, 0, 4], [2, 2, 0, 1, 1, 0]
    seen = [[k] for k in range(6)]
    weights, edges = rng.normal(size=6), rng.normal(size=(3, 2, 2))
    belief, both = html_tree.Forest([(parents, kinds, seen), ([-1], [2], [[0]])]).marginals(weights, edges)
    total, ones, pairs = 0.0, np.zeros(6), np.zeros((6, 2, 2))
    for y in itertools.product((0, 1), repeat=6):
        p = np.exp(sum(weights[k] * y[k] for k in range(6)) + sum(edges[kinds[k], y[parents[k]], y[k]] for k in range(1, 6)))
        total += p
        ones += p * np.array(y)
        for k in range(1, 6):
            pairs[k, y[parents[k]], y[k]] += p
    assert np.allclose(1 / (1 + np.exp(-belief[:6])), ones / total)
    assert np.allclose(both[1:6], pairs[1:] / total)
    assert np.isclose(belief[6], weights[0])


def test_reading_of_broken_markup():
    read = lambda s: [t for t in html_tree.Page(s).texts if t is not None]
    assert read("<p>a<p>b<b>c<br>d</p>e") == ["a", "bc d", "e"]
    assert read("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert read('<p title="a > b">x &lt; y &amp;amp; &#233;&nbsp; z</p><a href="unclosed') == ["x < y &amp; é z"]
    assert read("<script>var t = '</p>';</script>a<style>p{}</style><!-- <p>no</p> -->b<!-- open <p>no") == ["ab"]
    assert read("<p>don't <i x='>'>stop</i>, it's</p>") == ["don't stop, it's"]
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert read("<div>" * 3000 + "deep") == ["deep"] and read("") == [] and read("a < b & c &am") == ["a < b & c &am"]
    assert read("<select><option>no</select><button>no</button>yes<template>no") == ["yes"]


def test_odd_rows(spark, model):
    long = "<article>" + "<p>Word after word goes on, and on, to the end of the line.</p>" * 3000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><h1>T</h1><p>A line that says something, and ends.</p></article>"), (4, "u", long), (4, "u", long), (5, "u", "  \n "), (6, "u", "<<<>>> &#0; </")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_tree.extract(df, model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[5] == "" and by[None].startswith("T\n") and by[4].count("\n") == 2999
    marginals = html_tree.blocks(df, model).filter("page_id = 4").collect()
    assert len(marginals) == 6000 and all(0 <= r.marginal <= 1 for r in marginals)
    none = df.limit(0)
    assert html_tree.extract(none, html_tree.train(none)).count() == 0


def test_the_labelled_pages(model):
    """The model agrees with the pages it was taught by on nearly all runs."""
    wrong = total = 0
    for source in html_pages.LABELLED:
        page = html_tree.Page(source)
        labels = [bool(x) for x, t in zip(page.labels, page.texts) if t is not None]
        runs = model.runs([source])[0]
        wrong += sum((p > 0.5) != own for (_, p), own in zip(runs, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.03 * total
