import os
import random
import re
import time

import numpy as np
import pytest

from stratum.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, text string, host string"


def test_article_and_what_is_left_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav">
    <header>Site</header><nav><ul><li>a<li>b</ul></nav><div class="cookie-notice">ok?</div><!-- ad --><div class="ad">buy</div>
    <article><header><h1>Title&amp;</h1></header><p><b>One  two<br>three<p>F&ouml;ur &lt;x&gt; fi<i>ve</i></p><aside>side</aside>
    <ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><form>mail <input></form><div class="shareBar">share</div>
    <section id="comments"><article class="comment">me first</article></section><p hidden>no</p></article>
    <div id="sidebar"><p>more</p></div><footer>&copy; x</footer></body></html>"""
    assert h.extract(page) == "Title& One two three Föur <x> five x y c1 c2"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a b"), ("<div><p>x</div>y</p>", "x y"), ("<nav>only</nav>", ""), ("<p>a&nbsp;b&#x41;", "a bA"), ("<main>m<p>n</main>o", "m n"), ("<script>x", ""), ("<" * 50, "<" * 50)])
def test_odd_pages(page, text):
    assert h.extract(page) == text


def test_deep_pages():
    assert h.extract("<div>" * 20000 + "deep") == "deep"


ODD = ["<![foo[x]]>", "<![ CDATA [x]]>", "<![CDATA[x]]>", "<!x>", "<!>", "<?x>", "</>", "</ x>", "<!-->"]


@pytest.mark.parametrize("odd", ODD)
def test_odd_declarations_are_comments(odd):
    assert h.extract(f"<p>a</p>{odd}<p>b</p>") in ("a b", "a x b", "a")
    assert h.extract("<p>a</p>" + odd[:-1]) == "a" or odd == "</>"


def test_any_markup():
    bits = ["<", ">", "</", "<!", "<![", "[x]", "CDATA", "]]>", "--", "-->", "<!--", "?", "&", "#x", ";", '"', "'", "=", "p", "div", "article", "ul", "li", "td", " ", "\n", "/", "script", "<p>", "</p>", "<b>", "é", "<!doctype", "\0"]
    r = random.Random(3)
    for _ in range(3000):
        assert isinstance(h.extract("".join(r.choices(bits, k=r.randint(0, 40))), "h", np.array([5])), str)


@pytest.mark.parametrize("one", ["<b>|</i>", "<!--", "<a ", '<a b="', "<![CDATA[", "</", "<b>|<p></p>", "<li><ul>|<b>|<li></li>", "<div class=ad>|<article>", "<p>|<b>|</p>"])
def test_markup_without_end_takes_linear_time(one):
    def seconds(n):
        began = time.process_time()
        h.extract("".join(x * n for x in one.split("|")) + "x")
        return time.process_time() - began

    assert seconds(40_000) < 5


def test_counts_of_subtrees_against_brute_force(spark):
    data = [(i, f"https://s{i % 3}.example/{i}", f"<nav><ul><li>to {i % 4}</li></ul></nav><article><div>box {i % 5}</div><p>own {i}</p></article><footer>site {i % 3}</footer>") for i in range(60)]
    expected = {}
    for i, u, page in data:
        host = f"s{i % 3}.example"
        for x in set(h.subtree_hashes(h.parse(page), host).values()):
            expected.setdefault(x, set()).add(page)
    most = {x for x, pages in expected.items() if len(pages) >= max(h.MIN_PAGES, 20 * h.MIN_SHARE)}
    got = {r.h for r in h.templates_of(h.hosted(rows(spark, data))).collect()}
    assert got == most and len(most) > 10
    for r in h.extract_pages(rows(spark, data)).collect():
        assert r.text == f"own {r.page_id}"


PAGES = "/root/testdata/sf0.1/pages.parquet"
needs_pages = pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables here")


@needs_pages
def test_pages_without_names_of_parts_lose_what_their_host_repeats(spark):
    """With all parts as plain div elements, neither tag nor class says what the menu is: what goes, goes by its hashes' counts."""
    plain = lambda html: re.sub(r'<div class="[^"]*">', "<div>", re.sub(r"(?i)<(/?)(?:article|main|nav|header|footer|aside|section)\b[^>]*>", r"<\1div>", html or ""))
    pages = [(r.page_id, r.url, plain(r.html), None, None) for r in spark.read.parquet(PAGES).collect()]
    with_templates = {r.page_id: r.text for r in h.extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}
    without = {i: h.extract(html) for i, _, html, *_ in pages}
    changed = [i for i in without if with_templates[i] != without[i]]
    assert len(changed) > 100 and all(len(with_templates[i]) < len(without[i]) for i in changed)
    words = {i: set(with_templates[i].split()) for i in changed}
    assert all(words[i] <= set(without[i].split()) for i in changed)
    print(len(changed), "of", len(pages), "texts change by templates alone")


@needs_pages
def test_an_article_without_its_tag_gives_the_same_text(spark):
    pages = [r.html for r in spark.read.parquet(PAGES).limit(600).collect()]
    for html in pages:
        assert h.extract(re.sub(r"(?i)<(/?)article\b[^>]*>", r"<\1div>", html or "")) == h.extract(html)


def rows(spark, data):
    return spark.createDataFrame([(i, u, t, "clash", None) for i, u, t in data], SCHEMA)


def sites():
    out = []
    for i in range(12):
        out.append((i, f"https://a.example/{i}", f"<div class='x'><h2>About us</h2><p>We write things.</p></div><div><p>Page {i} says {i * i}.</p></div>"))
        out.append((100 + i, f"http://b.example/{i}", f"<article><p>Shared words.</p><p>own {i}</p></article><section>Shared words.</section>"))
    return out + [(500, None, "<p>none</p>"), (501, "not a url", None), (None, "http://c.example", "<p>null id</p>")] + [(502, "http://d.example/x", "<div>copy of all</div>")] * 9


@pytest.mark.parametrize("sent", [h.SENT, 0])
def test_templates_of_a_host(spark, monkeypatch, sent):
    monkeypatch.setattr(h, "SENT", sent)
    got = h.extract_pages(rows(spark, sites())).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(sites())
    for i in range(12):
        assert text[i] == f"Page {i} says {i * i}."
        assert text[100 + i] == f"Shared words. own {i}"
    assert (text[500], text[501], text[None], text[502]) == ("none", "", "null id", "copy of all")


@pytest.mark.parametrize("sent", [h.SENT, 0])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_templates_inside_the_article(spark, monkeypatch, sent, tag):
    monkeypatch.setattr(h, "SENT", sent)
    page = "<{0}><h2>Intro</h2><p>Own {1}.</p><div class='k7'><p>Read also: our best.</p></div><figure>Logo</figure></{0}>"
    data = [(i, f"https://a.example/{i}", page.format(tag, i)) for i in range(12)]
    copies = [(100 + i, f"https://b.example/{i}", f"<{tag}><div>Same story.</div><section>Its end.</section></{tag}>") for i in range(12)]
    text = {r.page_id: r.text for r in h.extract_pages(rows(spark, data + copies)).collect()}
    assert [text[i] for i in range(12)] == [f"Intro Own {i}." for i in range(12)]
    assert {text[100 + i] for i in range(12)} == {"Same story. Its end."}


def test_empty(spark):
    assert h.extract_pages(rows(spark, [])).collect() == []
