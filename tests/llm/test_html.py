"""Page extraction: broken markup in linear time, decoding against enumeration, and hand-marked pages."""

import html
import random
import re
import time
from collections import Counter
from itertools import product

import numpy as np
import pytest

from fieldweave.llm import queries as q
from fieldweave.llm.html_extract import Page, decided, extract_texts, keep_nodes, train, unescape
from test_brute import MIDDLE, SMALL, needs_tables

MEGABYTE = 1 << 20


@pytest.fixture(scope="module")
def model():
    return train()


@pytest.mark.parametrize("broken", ['<a"', '<a ="', "<a ='", "<a ", "<", "<!", "<!--", "<a='>' ", "<script>", "<title>", "&#9", "class=\"", "<a class", "</"])
def test_broken_markup_takes_linear_time(model, broken):
    page = "<p>before</p>" + broken * (MEGABYTE // len(broken) // (4 if broken.endswith("' ") else 1)) + " end"
    began = time.process_time()
    extract_texts([page], model)
    assert time.process_time() - began < 4


@pytest.mark.parametrize("opened, closed", [("<span>", "</b>"), ("<b><div>", "</b>"), ("<p>", "</p>"), ("<ul><li>", "</ol>"), ("<table><td>", "</tr>")])
def test_deep_markup_takes_linear_time(opened, closed):
    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        Page(opened * n + closed * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_markup_is_read_whole(model):
    story = "The committee met on Tuesday, and after a long debate, it agreed on a budget for the coming year. "
    formula = "<math><mi>E</mi><mo>=</mo><mi>m</mi></math>"
    cases = {
        f"<article><p>{story}{formula} holds. {story}</p></article>": f"{story}E=m holds. {story}",
        f"<article><p title=\"a > b\">{story}</p><p data-x='<p>'>{story}</p></article>": story * 2,
        f"<article><p title=don't>{story}</p><p>{story}</p></article>": story * 2,
        f"<article><p>{story}</p><p class=\"x>{story}</p></article>": story * 2,
        f"<article><p>{story} 1 < 2 and 3 > 2. {story}</p></article>": f"{story} 1 < 2 and 3 > 2. {story}",
        f"<article><p>{story}&#0000000065;&#{'9' * 6000};&amp;&lt;&nbsp;{story}</p></article>": f"{story}A�&< {story}",
        f"<article><p>{story}<!-- no </p> --><![CDATA[ no ]]>{story}</p></article>": story * 2,
        f"<title>Left open<article><p>{story}</p><p>{story}</p></article>": None,
    }
    for page, want in cases.items():
        (got,) = extract_texts([page], model)
        if want is None:
            assert story.strip() in got
        else:
            assert got == " ".join(want.split())


def test_references_decode_as_the_standard_library_does():
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice(["&", "#", "x", "1", "9f", "amp", ";", "lt", " ", "0", "&#x41;", "é"]) for _ in range(r.randint(0, 12)))
        assert unescape(text) == html.unescape(text)


def test_decoding_is_the_best_labelling():
    """Against all labellings of small trees in which nothing is kept beneath a dropped element."""
    r = random.Random(2)
    for _ in range(150):
        page = Page("".join(r.choice(("<div>", "<div>", "</div>", "<p>", "<span>", "</span>", "x")) for _ in range(12)))
        n = len(page.tag)
        odds = np.array([r.uniform(-2, 2) for _ in range(n)])
        free = [i for i in range(1, n) if decided(page)[i]]
        value = lambda kept: sum(odds[i] for i in free if kept[i])
        best = 0.0
        for bits in product((True, False), repeat=len(free)):
            chosen, kept = dict(zip(free, bits)), [True] * n
            for i in range(1, n):
                kept[i] = kept[page.parent[i]] and chosen.get(i, True)
            if all(kept[page.parent[i]] or not chosen[i] for i in free):
                best = max(best, value(kept))
        got = keep_nodes(page, odds)
        assert all(got[page.parent[i]] or not got[i] for i in range(1, n))
        assert value(got) == pytest.approx(best)


#: Pages unlike the training grammar, marked by hand: what stands between the brackets is the article.
BY_HAND = [
    """<!doctype html><html><body class="home"><div id="top-nav"><a href="/">Start</a> | <a href="/w">World</a> | <a href="/s">Sport</a></div>
    <div class="layout"><div class="col-main"><h1>[[River levels rise after storm]]</h1><div class="meta">By A. Writer, 3 May</div>
    <p>[[Water in the lower valley rose by two metres overnight, officials said, and several roads were closed.]]</p>
    <div class="ad-slot">Buy new boots today, half price!</div>
    <p>[[The town's bridge, built in 1902, has not been damaged. Engineers will look at it again on Friday.]]</p></div>
    <div class="col-side sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten tips</a></li><li><a href="/2">What now?</a></li></ul></div></div>
    <div id="footer">Copyright 2024 Example Press. All rights reserved. <a href="/p">Privacy</a></div></body></html>""",
    """<html><body><header><div class="logo">My garden diary</div><nav><ul><li><a href=/>Home</a><li><a href=/about>About</a></ul></nav></header>
    <main><article><h2>[[Planting beans]]</h2><p>[[I put the beans in on Sunday, a little late, but the soil was still cold in April.]]<p>[[Things you need:]]
    <ul><li>[[Beans]]<li>[[A spade]]<li>[[Patience, mostly]]</ul><p>[[They should come up within two weeks.]]</article>
    <section id="comments" class="comments-area"><h3>2 replies</h3><div class="comment"><p>Lovely, mine came up already, in the greenhouse.</p></div><div class="comment"><p>Good luck with the slugs this year!</p></div></section></main>
    <footer><p>Powered by an engine. Theme by somebody.</p></footer></body></html>""",
    """<html><body><div id="cookie-banner" role="dialog"><p>We use cookies to improve your visit. By going on you agree to our policy.</p><button>Accept</button></div>
    <div class="wrapper"><div class="breadcrumbs"><a href=/>Docs</a> &gt; <a href=/api>API</a></div><div class="content"><h1>[[Reading files]]</h1>
    <p>[[The function opens a file and returns its lines, one after the other.]]</p><pre>[[for line in lines("a.txt"): print(line)]]</pre>
    <table><tr><th>[[Name]]</th><th>[[Meaning]]</th></tr><tr><td>[[path]]</td><td>[[where the file lies]]</td></tr></table>
    <p>[[Errors are raised, not returned, so wrap the call where that matters.]]</p></div>
    <div class="pager"><a href=/p>Previous</a><a href=/n>Next</a></div></div></body></html>""",
    """<div role="navigation"><a href="/a">A</a><a href="/b">B</a><a href="/c">C</a></div><div role="main"><p>[[Short note: the office stays closed on Monday, because of the holiday.]]</p></div>
    <form action="/subscribe"><label>Your address</label><input name="mail"><button>Subscribe to our letters</button></form><div role="contentinfo">Imprint, terms, contact</div>""",
    """<html><body><table width="100%"><tr><td class="menu"><a href="1">One</a><br><a href="2">Two</a><br><a href="3">Three</a></td>
    <td class="story"><h1>[[An old page]]</h1><p>[[Once upon a time pages were laid out with tables, and nobody minded much.]]</p>
    <p>[[There were counters at the bottom, and guest books, and moving text in many colours.]]</p></td></tr></table>
    <p class="copyright">&copy; 1998, best viewed at 800 by 600</p></body></html>""",
    """<html><body><nav class="navbar"><a href="/">Shop</a><a href="/cart">Cart</a></nav><section class="post-content"><h1>[[How to choose a kettle]]</h1>
    <p>[[A kettle should hold enough water for two pots, and should be light when it is full.]]</p><aside class="related"><h4>You may like</h4><a href="/k1">Kettle one</a> <a href="/k2">Kettle two</a></aside>
    <p>[[Steel lasts longest; glass shows the lime.]]</p><blockquote>[[Mine has whistled for twenty years, and it still does.]]</blockquote></section>
    <div class="newsletter-signup">Get ten per cent off when you sign up.</div><footer class="site-footer"><ul><li>Returns</li><li>Delivery</li></ul></footer></body></html>""",
]


def test_hand_marked_pages(model):
    """Precision and recall in words over pages that no grammar drew."""
    want, got, both = 0, 0, 0
    for page in BY_HAND:
        marked = Counter(w for part in re.findall(r"\[\[(.*?)\]\]", page, re.S) for w in html.unescape(part).split())
        (text,) = extract_texts([page.replace("[[", "").replace("]]", "")], model)
        found = Counter(text.split())
        want, got, both = want + marked.total(), got + found.total(), both + (marked & found).total()
    print(f"precision {both / got:.3f}, recall {both / want:.3f}")
    assert both / got > 0.93 and both / want > 0.93


@needs_tables
@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_article_element_is_the_text(spark, folder):
    """In the tables' pages the article is one element, adverts aside: against a plain reading of it."""
    got = {r.page_id: r for r in q.op10_html_extraction(spark, folder).collect()}
    for p in q.table(spark, folder, "pages").collect():
        inside = "".join(re.findall(r"<article>(.*?)</article>", p.html or "", re.S))
        inside = re.sub(r'<div class="ad">.*?</div>|<!--.*?-->|<(script|style)>.*?</\1>', "", inside, flags=re.S)
        plain = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h\d|br|ul|li|div)\b[^>]*>", " ", inside)))
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (" ".join(plain.split()), len(" ".join(plain.split())))
