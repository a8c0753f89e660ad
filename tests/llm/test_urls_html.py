"""URL filter and HTML rendering on small pages."""

import pytest

from conftest_llm import rows
from paperlantern.llm import html_text, urls


def brute(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:cut].lower(), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (r[1].count("."), len(r[2])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


RULES = [*urls.RULES, ("block", "a.example.org", "/fr/x"), ("allow", "a.example.org", "/fr/xy"), ("block", "com", "/")]
URLS = [
    "http://x.net/en/1", "https://example.net/en/", "https://EXAMPLE.NET/en", "http://q.example.net/en/?a#b", "http://example.com/de/", "http://badexample.com/de/", "http://example.com/de",
    "http://a.org/fr/1", "http://org/fr/", "http://a.b.example.com/en/de/", "http://a.example.org/fr/x", "http://a.example.org/fr/xyz", "http://a.example.org/fr/", "http://net", "http://net?x=/", "http://net#/",
    "no scheme", "", None, "://net/", "ftp://x//y", "http://user@net/", "http://net:80/", "http://.net/", "http:///net/", "a://b://net/", "http://example.com\n/de/",
]


def test_urls_equal_every_rule(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)] + [(None, None, "x", "y")], "page_id long, url string, rule string, host string")
    found = rows(urls.filter_urls(pages, RULES), "page_id", "host", "path", "rule", "verdict")
    assert found == sorted([(i, *brute(u, RULES)) for i, u in enumerate(URLS * 2)] + [(None, *brute(None, RULES))], key=repr)
    assert urls.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, []).collect()} == {"allow"}


def test_same_rule_twice_blocks(monkeypatch):
    trie = urls.Trie([("block", "a.b", "/"), ("allow", "a.b", "/")])
    assert trie.find("x.a.b", "/q").verdict == "block"
    monkeypatch.setattr(urls, "MAX_RULES", 1)
    with pytest.raises(ValueError):
        urls.Trie(RULES)


CASES = [
    ("<p>one<p>two <b>bold</b>text", "one\n\ntwo boldtext"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a <script>x<b>y</b></script>b<style>p{}</style>", "a b"),
    ("<head><title>t</title></head><body>x", "x"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><td>a<td>long cell<tr><td>longer<td>b</table>", "a       long cell\nlonger  b"),
    ("<table><td>lone<td>cells</table>", "lone  cells"),
    ("<table><tr><td colspan=2>wide<td>c<tr><td>1<td>22<td>333</table>", "wide   c\n1  22  333"),
    ("<table><tr><td rowspan=2>r<td>a<tr><td>b</table>", "r  a\n   b"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ("<style>.ad, #x{display:none} p{color:red}</style><div class='big ad'>no</div><div id=x>no</div><p>yes", "yes"),
    ("caf&eacute; &amp; &lt;b&gt; &#8364;", "café & <b> €"),
    ("a<!-- no -->b<![CDATA[x]]>", "ab"),
    ("</p></div></b>x", "x"),
    ("<b>x<p>y</b>z", "x\n\nyz"),
    ("<h1>t<h2>u", "t\n\nu"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<table><tr><td><ul><li>a<li>b</ul><td>c</table>", "- a  c\n- b"),
    ("<table><tr><td>o<table><tr><td>i<td>j</table><td>p</table>", "o     p\n\ni  j"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("x<hr>y", "x\n\n----\n\ny"),
    ("<input type=submit value=Go><input type=hidden value=no>", "Go"),
    ("  \n ", ""), ("", ""), (None, ""), ("plain  text\n here", "plain text here"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_rendering(html, text):
    rendered = html_text.render(html)
    assert "\n".join(x for x in rendered.split("\n") if x) == "\n".join(x for x in text.split("\n") if x)
    if "<td><ul>" not in (html or "") and "<table><tr><td>o" not in (html or ""):
        assert rendered == text


STYLED = [
    ("<style>@media print { .nav { display:none } } .ad{display:none}</style><p class=nav>a</p><p class=ad>no</p>b", "a\n\nb"),
    ("<style>@media (max-width:600px){.s{display:none}} @media screen and (min-width:600px){.m{display:none}}</style><p class=s>a<p class=m>no", "a"),
    ("<style>@import 'x'; .menu{display:none} .menu{display:block} /* } */ #i{display:none}</style><p class=menu>a<p id=i class=menu>no", "a"),
    ("<style>.a{display:none !important} .a{display:block}</style><p class=a>no<p>b", "b"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>@font-face{src:url(x)} @keyframes k{from{visibility:hidden}} .x{color:red;visibility:hidden", ""),
    ("<style>p{display:none}</style><p style='display:block'>a", "a"),
    ("<div style='visibility:hidden'>no <b style='visibility:visible'>a</b></div>b", "a\nb"),
    ("<div style='display:none'>no <b style='visibility:visible;display:block'>no</b></div>b", "b"),
    ("x <svg><title>no</title><desc/><path d='M0'/><text>one</text><text>two</text></svg> <math><mi>y</mi><mo>=</mo><mn>2</mn></math>", "x one two y=2"),
]


STYLED += [
    ("<style>div.a{display:none} .b .c{display:none} ul > .d{display:none}</style><div class=a>no</div><p class=a>x</p><div class=b><i><b class=c>no</b></i>y</div>"
     "<b class=c>z</b><ul><li><b class=d>v</b></ul><ul class=e><b class=d>no</b></ul>", "x\n\ny\nz\n\n- v"),
    ("<style>.a.b{display:none} .a{display:block} [data-x=no]{display:none} p:hover{display:none}</style><p class='a b'>no<p class=a>x<p data-x=no>no<p data-x=yes>y", "x\n\ny"),
    ("<div class=o><style>.o .i{display:none}</style><p class=i>no</p>a</div>", "a"),
    ("<style>p p,.x{display:none}</style><p>a<p>b<p class=x>no", "a\n\nb"),
    ("<details><summary>more</summary>no <p>no</p></details><details open><summary>s</summary>t</details>", "more\ns\nt"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("a<!-- never <p>ended", "a"), ("a<?php never ended", "a"), ("a<!doctype never", "a"),
]


@pytest.mark.parametrize("html,text", STYLED)
def test_styled_pages(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize("start", [1500, 0, -3])
def test_list_starts(start):
    assert html_text.render(f"<ol start={start}><li>a<li>b</ol>") == f"{start}. a\n{start + 1}. b"


def test_columns_of_a_wide_table():
    one, two = html_text.render("<table><tr>" + "<td>aaa" * 300 + "<tr>" + "<td>b" * 300 + "</table>").split("\n")
    assert len(one) == 5 * 299 + 3 and len(two) == 5 * 299 + 1


def test_deep_and_wide_pages():
    assert html_text.render("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    wide = html_text.render("<table>" + "".join(f"<tr><td>{'w' * 5_000 if i == 0 else i}<td>b" for i in range(2_000)) + "</table>")
    assert len(wide) < 200_000
    assert html_text.render("<" * 1_000 + "a" * 200_000).endswith("a")


LONG = {
    "lists": "<ul><li>x" * 110_000,
    "comments": "<!--" * 250_000,
    "instructions": "<?" * 500_000,
    "open tags": "<a " * 330_000,
    "tables": "<table><tr><td>x" * 62_000,
    "spans": "<table><tr>" + "<td colspan=1000 rowspan=1000>x" * 32_000,
    "rows below spans": "<table><tr>" + "<td rowspan=900>" * 500 + "<td>a" + "<tr><td>b" * 100_000,
    "buttons": "<p><button>" + "<span>" * 80_000 + "<div></div>" * 45_000,
    "items in blocks": "<ul><li><ul>" + "<div>" * 90_000 + "<li>x" * 90_000,
    "quotes": "<blockquote>x" * 80_000,
    "rules": "<style>.b .c{display:none} .c > .d{display:none}</style>" + "<i class=c>x" * 80_000,
}


@pytest.mark.parametrize("kind", LONG)
def test_long_pages_take_time_in_proportion(kind):
    import time

    begun = time.process_time()
    text = html_text.render(LONG[kind])
    assert time.process_time() - begun < 15  # of a page of a megabyte
    assert len(text) < 30 * len(LONG[kind])


def test_cells_below_spans():
    html = "<table><tr><td rowspan=2>a<td colspan=2>b<td rowspan=3>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>"
    assert html_text.render(html) == "a  b     c\n   d  e\nf  g  h"


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "t"), (1, "<p>a<p>b", "t"), (2, None, "t"), (None, "", "t")], "page_id long, html string, text string")
    assert rows(html_text.extract_text(pages), "page_id", "text", "n_lines") == sorted([(1, "a\n\nb", 3), (1, "a\n\nb", 3), (2, "", 0), (None, "", 0)], key=repr)
    assert html_text.extract_text(pages.limit(0)).count() == 0
