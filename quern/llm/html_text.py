"""Main text of HTML pages by composite text density.

A page is parsed into a tree (void elements, implied ends of p and li, raw text of script and style, comments). For every
node the composite text density is characters per tag, adjusted for links: with C characters, T tags, LC characters and
LT tags within links,

    CTD = C/T * log_base(C/LC' * T/LT'),   base = ln(LC/NC' * C + body LC/body C * C + e),

where NC are the characters outside links and a prime means at least one. Formatting elements (b, em, br and so on) are
markup of the text around them, neither tags nor nodes of their own; links count as tags. A node's density sum adds up its
children's densities. The subtree with the largest density sum is the core; the smallest density on the path from it to
body is the threshold, and the blocks kept are those in the highest node on that path up to which all neighbours of the
path but headings reach the threshold. Boilerplate elements (nav, footer, aside, forms and so on, a header outside an article,
and elements whose class, id or role says so) count no characters and are never part of the result: a comment or a sidebar
can be as dense as the article. Where a page names nothing, densities alone decide.

Defined results
* null, empty or tag-only pages: an empty text. A page without a body element: its root stands for the body.
* ties in the density sum: the outermost, then the first node in page order.
* repeated rows and extra columns are kept; a column named like the result is replaced; empty tables stay empty.
* very long pages are parsed in one pass with an explicit stack, whatever their depth, in time in proportion to their length:
  open elements are counted by name, so an end tag that fits none costs no walk.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An element's start ends open elements of these names up to the nearest of the others.
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: Elements that never hold main text.
SKIP = frozenset("head script style noscript template iframe object embed svg math nav footer aside form button select option textarea input label dialog menu search canvas audio video map noembed noframes".split())
#: Words in a class, id or role that mark an element as boilerplate.
MARKS = frozenset(
    "ad adbox adcontainer ads adslot adunit advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment commentlist comments complementary contentinfo alert alerts aside cookie cookiebanner cookiebar cookies consent copyright discussion disqus footer gdpr masthead menu menus menubar modal nav navbar navigation newsletter notice notices notification notifications pager pagination popular popup promo promoted promotion recommended recommendations related reply replies sidebar sidenav share sharing signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar topnav usercomments trending widget widgets".split()
)


#: The names that take part in each of these rules, and the rules (by their first name) that a name takes part in.
RULE = {"li": "li", "dt": "dt", "dd": "dt", "option": "option", "tr": "tr", "td": "td", "th": "td"}
MEMBER: dict[str, list[str]] = {}
for _rule in sorted(set(RULE.values())):
    for _name in sorted(SAME[_rule][0] | SAME[_rule][1]):
        MEMBER.setdefault(_name, []).append(_rule)


class Node:
    __slots__ = ("tag", "up", "kids", "skip", "link", "block", "inline", "chars", "tags", "lchars", "ltags", "density", "total")

    def __init__(self, tag: str, up: "Node | None", skip: bool, link: bool):
        self.tag, self.up, self.kids, self.skip, self.link = tag, up, [], skip, link
        #: The nearest element around that isn't inline, itself included; how many inline elements of a name are open in it.
        self.block = up.block if up is not None and tag in INLINE else self
        self.inline: dict[str, int] | None = None
        self.chars = self.tags = self.lchars = self.ltags = 0
        self.density = self.total = 0.0


def _marked(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is boilerplate by its name or attributes; a page's header is, but not an article's."""
    if tag in SKIP:
        return True
    heads = tag == "header"
    if attrs and tag not in ("html", "body", "main", "article"):
        found = _named(attrs)
        if found is True:
            return True
        heads |= found is None
    return heads and not in_article


def _named(attrs: str) -> bool | None:
    """True: the attributes mark boilerplate; None: they mark a header."""
    header = False
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(a or b or c)}
            if words & MARKS:
                return True
            header |= "header" in words or (a or b or c) == "banner"
        if name == "hidden" or name == "aria-hidden" and (a or b or c).lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c, re.I):
            return True
    return None if header else False


def parse(page: str) -> Node:
    """The tree: kids are nodes and, for runs of text, strings (references not yet decoded)."""
    root = at = Node("#root", None, False, False)
    pos, end = 0, len(page)
    match = _TOKEN.search
    open_: dict[str, int] = {}  # open elements of each name
    piles: dict[str, list[Node]] = {rule: [] for rule in SAME}  # open elements that take part in a rule

    def leave(node: Node) -> None:
        """Close ``node`` and all that is open in it."""
        nonlocal at
        while at is not node.up:
            open_[at.tag] -= 1
            if at.block is not at:
                at.block.inline[at.tag] -= 1
            for rule in MEMBER.get(at.tag, ()):
                piles[rule].pop()
            at = at.up

    while pos < end:
        m = match(page, pos)
        if m is None:
            at.kids.append(page[pos:])
            break
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos = max(m.end(), pos + 1)
        name = m[2]
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                at.kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;").replace("<", "&lt;"))
            continue
        tag = name.lower()
        if m[1]:
            # An inline end tag doesn't reach beyond the block it stands in.
            fits = (at.block.inline or {}).get(tag) if tag in INLINE else open_.get(tag)
            if fits:
                node = at
                while node.tag != tag:
                    node = node.up
                leave(node)
            continue
        if tag in CLOSES_P and at.block.tag == "p":
            leave(at.block)
        if tag in SAME:
            ends, last = SAME[tag][0], None
            for node in reversed(piles[RULE[tag]]):
                if node.tag not in ends:
                    break
                last = node
            if last is not None:
                leave(last)
        node = Node(tag, at, at.skip or _marked(tag, m[3], bool(open_.get("article") or open_.get("main"))), at.link or tag == "a")
        at.kids.append(node)
        if tag in VOID or m[4] and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            node.skip = True
            pos = close.end() if close else end
            continue
        open_[tag] = open_.get(tag, 0) + 1
        if node.block is not node:
            if node.block.inline is None:
                node.block.inline = {}
            node.block.inline[tag] = node.block.inline.get(tag, 0) + 1
        for rule in MEMBER.get(tag, ()):
            piles[rule].append(node)
        at = node
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.skip)
    return out


def measure(nodes: list[Node], body: Node) -> None:
    """Characters, tags and densities of all nodes."""
    for node in reversed(nodes):
        for kid in node.kids:
            if isinstance(kid, str):
                n = len("".join(_html.unescape(kid).split()))
                node.chars += n
                node.lchars += n * node.link
            elif not kid.skip:
                node.chars += kid.chars
                node.tags += kid.tags + (kid.tag not in INLINE or kid.tag == "a")
                node.lchars += kid.lchars
                node.ltags += kid.ltags + (kid.tag == "a")
    share = body.lchars / body.chars if body.chars else 0.0
    c, t, lc, lt = (np.array([getattr(n, k) for n in nodes], dtype=float) for k in ("chars", "tags", "lchars", "ltags"))
    t1, lc1, lt1, nc1 = np.maximum(t, 1), np.maximum(lc, 1), np.maximum(lt, 1), np.maximum(c - lc, 1)
    base = np.log(lc / nc1 * c + share * c + np.e)
    ratio = np.maximum(c / lc1 * t1 / lt1, 1.0)
    density = np.where(c > 0, c / t1 * np.log(ratio) / base, 0.0)
    for node, d in zip(nodes, density.tolist()):
        node.density = d
        if node.up is not None and node.tag not in INLINE:
            node.up.total += d


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order, white space as single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(_html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            run.append(item)
        elif item is None:
            flush()
        elif item.tag == "br":
            run.append(" ")
        elif not item.skip or item is node:
            if item.tag not in INLINE:
                flush()
                stack.append(None)
            stack.extend(reversed(item.kids))
    flush()
    return out


def main_node(page: str) -> Node:
    root = parse(page)
    nodes = _order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    measure(nodes, body)
    inside = [n for n in _order(body) if n.tag not in INLINE]
    core = max(inside, key=lambda n: n.total)  # the first of equals: parents come first
    if core.total <= 0:
        return body
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].up)
    threshold = min(n.density for n in path if n.chars)
    best = core
    # Up the path as long as every neighbour with text is dense enough to belong to it.
    for node in path[1:]:
        others = [k for k in node.kids if isinstance(k, Node) and k is not best and not k.skip and k.chars and k.tag not in HEADINGS]
        if not all(k.density >= threshold or k.tag in INLINE for k in others):
            break
        best = node
    return best


def extract(page: str | None) -> str:
    """The main text of one page; its blocks joined by one space."""
    return " ".join(blocks(main_node(page))) if page else ""


def text_column(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in batch.tolist()], dtype=object)

    return run(page)


def extract_text(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col``."""
    return pages.withColumn(into, text_column(F.col(html_col)))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html_text": op5_html_text}
