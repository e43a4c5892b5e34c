"""Main text of pages: made-up layouts with what a reader would keep, odd markup, and long and deep pages."""

import time

import pytest

from telewatch.llm import html as H

P = [f"This is paragraph {k}, which says something of some length, and goes on for a while; it has commas." for k in range(6)]
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


LAYOUTS = {
    "article": (f"{MENU}<div class='ad'>Buy this, now, please, cheap.</div><article><h1>Title &amp; more</h1><p>{P[0]}</p><p>{P[1]}</p></article><footer>&copy; x, y, z</footer>",
                ["Title & more", P[0], P[1]]),
    "unclosed": (f"{MENU}<article><h1>T<p><b>{P[0]}<br><p>{P[1]}<ul><li>one<li>two</ul><p>Be.</article><footer>f", ["T", P[0], P[1], "one", "two", "Be."]),
    "divs": (f"<div id='header'>Site, name</div><div class='wrap'><div class='sidebar'><p>{P[5]}</p></div><h1>Title</h1><div class='post-body'><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></div>"
             f"<div class='comments'><p>{P[3]}</p><p>{P[4]}</p></div></div>", ["Title", P[0], P[1], P[2]]),
    "sections": (f"<header><h2>Site</h2></header><main><article><header><h1>T</h1></header><section><p>{P[0]}</p><p>{P[1]}</p></section><aside>{P[5]}</aside><section><h2>S</h2><p>{P[2]}</p></section></article>"
                 f"<section class='comment-list'><p>{P[3]}</p></section></main>", ["T", P[0], P[1], "S", P[2]]),
    "siblings": (f"<div><div><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></div><p>{P[3]}</p><p><a href='x'>{P[4]}</a></p></div>", [P[0], P[1], P[2], P[3]]),
    "link lists": (f"<div><ul><li><a href='a'>{P[4]}</a></li><li><a href='b'>{P[5]}</a></li><li><a>c, d, e</a></li></ul><p>{P[0]}</p><p>{P[1]}</p></div>", [P[0], P[1]]),
    "cookie notice": (f"<div class='cookieNotice'><p>{P[4]}</p><p>{P[5]}</p></div><form><p>{P[3]}</p></form><div hidden><p>{P[3]}</p></div><div id='content'><p>{P[0]}</p></div>", [P[0]]),
    "table and quote": (f"<article><p>{P[0]}</p><table><tr><td>a<td>b</table><blockquote>{P[1]}</blockquote><pre>x\n  y</pre></article>", [P[0], "a", "b", P[1], "x y"]),
    "all under an off name": (f"<div class='widget'><p>{P[0]}</p></div>", [P[0]]),
    "class on body": (f"<article class='comments-open ad'><p>{P[0]}</p></article>", [P[0]]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    body, want = LAYOUTS[name]
    assert H.main_text(page(body)).split("\n") == want


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("   ", ""), ("just text, no tags", "just text, no tags"), ("<p>a &lt;b&gt; &#233;&nbsp;c</p>", "a <b> é c"), ("a < b and 3 <4", "a < b and 3 <4"),
    ("<p>x<!-- unclosed <p>y", "x"), ("<p>x</p><script>if (a<b) '</p>'", "x"), ("<p>x <a href='q>y</a> z", "x y z"), ("<p>x</p><div", "x"), ("</p></div>x</", "x"),
    ("<p>a<br>b\n\n c</p>", "a b c"), ("<script>x</script><style>y</style>", ""), ("<P CLASS=x>Up<B>per</P>case", "Upper\ncase"),
])
def test_odd_markup(html, want):
    assert H.main_text(html) == want


def test_time_is_linear():
    for part in ("<div>", "<a \"", "<b>x", "</i><p>y, ", "<!--", "<ul><li>", "<td><tr>", "<", "<script>", "&amp", "<textarea>", "<p><table>"):
        begin = time.perf_counter()
        H.main_text(part * 20_000)
        small = time.perf_counter() - begin
        begin = time.perf_counter()
        H.main_text(part * 80_000)
        assert time.perf_counter() - begin < 12 * small + 1, part


def test_extract_defined_cases(spark):
    rows = [(1, "u", "<p>Hello, you.</p>", 7), (1, "u", "<p>Hello, you.</p>", 7), (None, None, None, None), (2, "v", "", 1), (3, "w", page(f"<article><p>{'word, ' * 200_000}</p></article>"), 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, H.extract(df).collect()), key=str)
    long = " ".join(["word,"] * 200_000)
    assert got == sorted([(1, "u", "Hello, you.", 11)] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", long, len(long))], key=str)
    assert H.extract(df.limit(0)).collect() == [] and H.extract(df, keep=("text",)).columns == ["text", "text", "n_chars"]
