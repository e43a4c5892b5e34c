"""Main text of web pages by tree scoring: paragraphs pass points for length and commas to their ancestors, links discount them.

A page is read into a tree (end tags that may be left out are supplied). What is no article by its name is cut off: navigation, header, footer,
aside, form, script and the like, by tag, by role, or by a word of its class or id. Every paragraph then earns
1 point, 1 a comma and up to 3 for its length; its parent gets them whole, its grandparent half, those above less and less. A container's points
are multiplied by the share of its text that is no link; the best one is taken, or the article or main element around it,
with the siblings that score a fifth as much, read like sentences, or are headings before it. Its blocks are the text.

Rows are independent: there is no shuffle, and a task holds one batch of pages. Time is linear in the length of a page, whatever its nesting.

Defined cases. A null or empty page, or one without text, gives the empty text. Text outside any tag is a paragraph. Unclosed and misnested
tags, an unclosed comment (to the end of the page) and a tag without its end (dropped) are read as browsers do; line breaks and no-break
spaces are white space. If class names would leave nothing, they are not heeded. Repeated rows give repeated results, empty tables
empty ones; other columns stay out unless named in `keep`.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.llm.common import map_batches

# fixed values: names of the markup language, and words that name parts of pages
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER = frozenset("head script style noscript template svg math iframe object canvas audio video map nav footer aside form button select textarea "
                  "datalist dialog menu noframes noembed xmp title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("ul ol dl".split())
WHOLE = frozenset("html body article main".split())  # their class names say nothing about what they are
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
OFF = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion comment comments disqus respond replies "
                "cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead newsletter "
                "subscribe subscription signup login popup modal overlay share sharing social toolbar skip".split())
OFF_UNLESS_TEXT = frozenset("sidebar header banner widget related recommended notice alert rail aside meta tags byline tools".split())
TEXT = frozenset("article body content entry main post story text page".split())
# an opening tag ends these open elements, if they are nearer than those after the bar
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody", "table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
COMMAS = re.compile("[,،、，;；]")


class Node:
    __slots__ = ("tag", "parent", "parts", "off", "text", "links", "points", "place")

    def __init__(self, tag: str, parent: Node | None, off: int = 0):
        self.tag, self.parent, self.parts, self.off = tag, parent, [], off  # off: 1 by class or id, 2 by tag or role
        self.text = self.links = 0
        self.points = 0.0


def _off(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is no part of an article: 2 by its tag or role, 1 by its class or id."""
    if tag in NEVER or (tag == "header" and not in_article):
        return 2
    if not attributes.strip(" /\t\n"):
        return 0
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)) or (name == "aria-hidden" and value == "true"):
            return 2
        if name == "role" and value.lower() in ROLES:
            return 2
        if name in ("class", "id"):
            words.update(w.lower() for w in WORD.findall(value))
    if tag in WHOLE:
        return 0
    return int(bool(words & OFF or (words & OFF_UNLESS_TEXT and not words & TEXT)))


def parse(html: str) -> Node:
    """The tree of a page; texts are strings among the parts of a node, with white space as it stands."""
    top = node = Node("", None)
    open_tags: dict[str, int] = {}
    at, n, tag_pattern, no_end = 0, len(html), TAG, set()

    def pop() -> None:
        nonlocal node
        open_tags[node.tag] -= 1
        node = node.parent

    def say(text: str) -> None:
        if text:
            node.parts.append(unescape(text) if "&" in text else text)

    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            say(html[at:])
            break
        say(html[at:begin])
        following = html[begin + 1:begin + 2]
        if following in ("!", "?"):
            comment = html.startswith("<!--", begin)
            end = html.find("-->" if comment else ">", begin + (2 if comment else 1))
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        if not (following.isascii() and following.isalpha()) and following != "/":
            say("<")
            at = begin + 1
            continue
        m = tag_pattern.match(html, begin)
        if m is None and tag_pattern is TAG:  # a quote without its end, or no end at all: from here on tags end at the next >
            m = PLAIN_TAG.match(html, begin)
            tag_pattern = PLAIN_TAG if html.find(">", begin) < 0 or m else TAG
        if m is None:  # "</" before no name is a comment up to the next >; a tag without an end is none
            end = html.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if closing:
            if open_tags.get(tag):
                while node.tag != tag:
                    pop()
                pop()
            continue
        if tag in BLOCKS and open_tags.get("p"):  # a block ends an open paragraph
            while node.tag != "p":
                pop()
            pop()
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            up, last = node, None
            while up is not None and up.tag not in stop and (up.tag in ends or up.tag not in BLOCKS):
                if up.tag in ends:
                    last = up
                up = up.parent
            while last is not None and node is not last.parent:
                pop()
        child = Node(tag, node, max(node.off, _off(tag, attributes, bool(open_tags.get("article")))))
        node.parts.append(child)
        if tag in VOID or (tag not in BLOCKS and attributes.endswith("/") and tag not in RAW):
            continue
        if tag in RAW:
            if tag not in no_end:
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                if end:
                    at = html.find(">", end.end()) + 1 or n
                    continue
                no_end.add(tag)
            at = n
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        node = child
    return top


def _nodes(top: Node) -> list[Node]:
    """All nodes, parents before children and in page order."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return out


def _score(nodes: list[Node], off: int) -> None:
    """Text, link text and points of every node; nodes cut off at `off` count nothing."""
    commas: dict[int, int] = {}
    direct: dict[int, bool] = {}
    for k, node in enumerate(nodes):
        node.place = k
        node.text = node.links = 0
        node.points = 0.0
        if not node.off or node.off < off:
            mine = [" ".join(x.split()) for x in node.parts if isinstance(x, str)]
            node.text = sum(map(len, mine))
            commas[k] = sum(len(COMMAS.findall(x)) for x in mine)
            direct[k] = node.text > 0
    for node in reversed(nodes):  # texts of children, from the leaves up
        if node.tag == "a":
            node.links = node.text
        up = node.parent
        if up is not None and node.place in direct:
            up.text += node.text
            up.links += node.links
            if node.tag not in BLOCKS:  # text of inline elements is the block's own
                commas[up.place] = commas.get(up.place, 0) + commas[node.place]
                direct[up.place] = direct.get(up.place, False) or direct[node.place]
    for node in nodes:
        if node.place not in direct or not node.text or not (node.tag in PARAGRAPHS or (node.tag in BLOCKS or not node.tag) and direct[node.place]):
            continue
        if node.tag in HEADINGS or (node.tag == "li" and node.links * 2 > node.text):
            continue
        points = (1.0 if node.text >= 25 else 0.2) + commas[node.place] + min(node.text / 100, 3.0)
        if node.tag not in PARAGRAPHS or node.parent is None:
            node.points += points  # a container with text of its own
        up, share = node.parent, 1.0
        for level in range(5):
            while up is not None and up.tag not in BLOCKS and up.tag:
                up = up.parent
            if up is None:
                break
            up.points += points * share
            up, share = up.parent, (0.5, 1 / 6, 1 / 9, 1 / 12, 0)[level]


def _value(node: Node) -> float:
    return node.points * (1 - node.links / node.text) if node.text else 0.0


def _kept(nodes: list[Node], off: int) -> list[Node]:
    """The best container and the siblings that go with it, in page order."""
    _score(nodes, off)
    here = [x for x in nodes if x.text and (not x.off or x.off < off)]
    best = max(here, key=lambda x: (_value(x), -x.place), default=None)
    if best is None:
        return []
    for names in ({"article"}, {"main"}):
        around = [x for x in _ancestors(best) if x.tag in names]
        if around:
            best = around[-1]
            break
    while best.tag and best.tag not in BLOCKS and best.parent is not None:
        best = best.parent
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least, out = 0.2 * _value(best), []
    for x in best.parent.parts:
        if not isinstance(x, Node) or x is best:
            out += [x] if x is best else []
            continue
        if not x.text or (x.off and x.off >= off):
            continue
        links = x.links / x.text
        sentences = x.tag == "p" and (links < 0.25 if x.text > 80 else not links)
        if (_value(x) >= least > 0 and links < 0.5) or sentences or (x.tag in HEADINGS and x.place < best.place and links < 0.5):
            out.append(x)
    return out


def _ancestors(node: Node):
    while node is not None:
        yield node
        node = node.parent


def _menu(node: Node) -> bool:
    """A list of links only, outside an article."""
    items = [x for x in node.parts if isinstance(x, Node)]
    return node.tag in LISTS and len(items) > 2 and node.links > 0.9 * node.text and not any(x.tag == "article" for x in _ancestors(node))


def _blocks(kept: list[Node], off: int) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        block = " ".join("".join(run).split())
        if block:
            out.append(block)
        run.clear()

    for root in kept:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif not (x.off and x.off >= off) and not _menu(x):
                if x.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack += reversed(x.parts)
        end()
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one a line."""
    if not html:
        return ""
    nodes = _nodes(parse(html))
    for off in (1, 2):  # if class names leave nothing, tags alone decide
        blocks = _blocks(_kept(nodes, off), off)
        if blocks:
            return "\n".join(blocks)
    return ""


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, with `text` and `n_chars`, its code points, of every page."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
        columns = [batch.column(k) for k in range(len(keep))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    return map_batches(df.select(*keep, F.col(html).cast("string").alias("_html")), run, f"{schema}, text string, n_chars long")


# the pages of the test tables have one article element each, with headings and paragraphs, and no references but those of markup characters
SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS inside FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(inside, '</?(p|h[1-6])>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) AS blocks FROM a),
c AS (SELECT page_id, url, [regexp_replace(replace(replace(replace(replace(trim(regexp_replace(x, '\\s+', ' ', 'g')),
  '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') FOR x IN blocks] AS blocks FROM b),
t AS (SELECT page_id, url, array_to_string([x FOR x IN blocks IF x <> ''], chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""
