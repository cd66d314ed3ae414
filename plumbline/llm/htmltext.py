"""Operator 9: main text of HTML pages by composite text density.

For every node: C characters, T tags, LC characters within links, LT link tags. Its composite density is

    C/T * log base ln(C/nLC * LC + LCb/Cb * C + e) of (C/LC * T/LT)      (nLC = C - LC; b: the body)

that is characters per tag, adjusted by links. The densities of a node's children are summed; the container of the
largest sum holds the main text, whatever its tag. The least density on the path from the body to it is the threshold:
beside that path a part is main text too if its density reaches half of the threshold (a heading also if what follows it
is kept), so an article split into sibling sections stays whole. Within what is kept, lists and sections below the
threshold that carry links rather than text are menus and are left out; everything else stays.

What the result is defined to be without (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) is removed before densities are taken where the page names it: by element, by ``role``, by ``hidden``,
or by a class or id whose last telling word is one of ``FURNITURE``.

Scanning and tree building are linear in the page: every open tag is counted, so that no end tag looks for a partner
that isn't there, and a page of any depth is walked with a stack.

Defined cases: a null or blank page has the empty text; markup that is not closed or closed twice is repaired the
way browsers do for paragraphs, list items and table cells; a page without markup is one block of text; a null page_id
or url is carried as it is, and rows that repeat a page_id are extracted each for itself; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import small_batches

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements beyond which an end tag of an inline element doesn't reach.
BOUNDS = frozenset("table article body".split())
#: Elements that hold blocks; the others hold a line of text and are never the main part.
CONTAINERS = BLOCK - HEADINGS - {"p", "pre", "dt", "summary", "figcaption", "hr"}
LISTS = frozenset("div ul ol section table dl".split())
#: Elements that are menus, footers, sidebars, forms, scripts or styles, or show no text.
GONE = frozenset("script style noscript template textarea iframe noframes nav footer aside form button select option input svg canvas object audio video dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words by which classes and ids name what isn't the article: menus, sidebars, footers, notices, adverts, forms, comments.
FURNITURE = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead banner cookie cookies consent gdpr notice notices "
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion "
    "newsletter subscribe subscription signup signin login searchform searchbox comment comments commentlist disqus respond replies".split()
)
#: Words that say nothing of what a box holds.
PLAIN = frozenset("list lists item items container wrapper wrap box slot area section block inner outer left right top bottom bar panel unit group holder main primary secondary widget zone row col column desktop mobile".split())
#: Names of a page's own header; elsewhere a header is that of the article.
HEADERS = frozenset("header site-header page-header global-header topbar".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[^\s/>]+")
_PLAIN_PART = re.compile(r"[^>=]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")


BESIDE = 0.5  # of the threshold, that a part beside the path must reach


class Element:
    __slots__ = ("tag", "gone", "within", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Element | None, gone: bool = False):
        self.tag, self.parent, self.gone = tag, parent, gone
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.children: list[Element | str] = []


def named_furniture(name: str) -> bool:
    """Whether a class or id names furniture: the last of its words that isn't a plain one decides, so ``comment-list``
    and ``left-sidebar`` do and ``ad-free-article`` and ``related-work`` don't."""
    words = [w for w in _WORDS.findall(name) if w not in PLAIN]
    return bool(words) and words[-1] in FURNITURE


def _furniture(tag: str, raw: str, within: bool) -> bool:
    if tag in GONE or (tag == "header" and not within):
        return True
    if not raw:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)) or (name == "role" and value in ROLES):
            return True
        if name in ("class", "id") and tag in BLOCK and tag not in HEADINGS and tag not in ("html", "body", "article", "main"):
            names = value.split()
            if any(map(named_furniture, names)) or (not within and not HEADERS.isdisjoint(names)):
                return True
    return False


def _tag_end(page: str, at: int) -> int:
    """The place after the ``>`` of a tag whose name ends at ``at``; quotes count after an equals sign only."""
    size = len(page)
    while True:
        at = _PLAIN_PART.match(page, at).end()
        if at >= size or page[at] == ">":
            return min(at + 1, size)
        at += 1  # behind the equals sign
        while at < size and page[at].isspace():
            at += 1
        if at < size and page[at] in "\"'":
            close = page.find(page[at], at + 1)
            at = at + 1 if close < 0 else close + 1


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page in order: text, open, close."""
    at, held, size = 0, 0, len(page)  # text from ``held`` on isn't given out yet
    while (start := page.find("<", at)) >= 0:
        lead = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", start):
            close = page.find("]]>", start)
            end = size if close < 0 else close + 3
            if start > held:
                yield "text", entities.unescape(page[held:start]), ""
            yield "text", page[start + 9 : size if close < 0 else close], ""
            at = held = end
            continue
        elif lead in ("!", "?") and lead or (lead == "/" and not page[start + 2 : start + 3].isalpha() and page[start + 2 : start + 3]):
            close = page.find(">", start)
            end = size if close < 0 else close + 1
        elif lead == "/" and page[start + 2 : start + 3].isalpha() or lead.isalpha():
            first = start + 1 + (lead == "/")
            name = _NAME.match(page, first)
            end = _tag_end(page, name.end())
        else:
            at = start + 1
            continue
        if start > held:
            yield "text", entities.unescape(page[held:start]), ""
        at = held = end
        if lead == "/" and page[start + 2 : start + 3].isalpha():
            yield "close", name[0].lower(), ""
        elif lead.isalpha():
            tag = name[0].lower()
            yield "open", tag, page[name.end() : end - 1]
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = held = _tag_end(page, close.end()) if close else size
    if held < size:
        yield "text", entities.unescape(page[held:]), ""


def parse(page: str) -> Element:
    """The element tree of a page; text is decoded."""
    root = node = Element("html", None)
    opened: Counter = Counter()  # open elements by tag, so that nothing is looked for in vain
    inline: list[Counter] = [Counter()]  # the same of inline elements, for each open table, article and body

    def enter(new: Element) -> Element:
        opened[new.tag] += 1
        if new.tag in BOUNDS:
            inline.append(Counter())
        elif new.tag not in BLOCK:
            inline[-1][new.tag] += 1
        return new

    def leave(to: Element) -> Element:
        """Close all elements below ``to``; every element is left once."""
        up = node
        while up is not to:
            opened[up.tag] -= 1
            if up.tag in BOUNDS:
                inline.pop()
            elif up.tag not in BLOCK:
                inline[-1][up.tag] -= 1
            up = up.parent
        return to

    def close(tags: set[str], stop: set[str] | frozenset[str]) -> Element:
        if not any(opened[t] for t in tags):
            return node
        up = node
        while up is not root and up.tag not in stop:
            if up.tag in tags:
                return leave(up.parent)
            up = up.parent
        return node

    for kind, tag, raw in _tokens(page):
        if kind == "text":
            node.children.append(tag)
            continue
        if kind == "close":
            if opened[tag] if tag in BLOCK else inline[-1][tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up.parent)
            continue
        if tag in ("html", "body"):
            if tag == "body" and node is root:
                root.children.append(Element(tag, root))
                node = enter(root.children[-1])
            continue
        if tag in BLOCK:
            node = close({"p"}, BLOCK - {"p"})
            if tag in HEADINGS and node.tag in HEADINGS:
                node = leave(node.parent)
        if tag in CLOSES:
            node = close(CLOSES[tag], SCOPES[tag])
        new = Element(tag, node, _furniture(tag, raw, node.within))
        node.children.append(new)
        if tag not in RAW and tag not in VOID and not raw.endswith("/"):
            node = enter(new)
    return root


def _measure(root: Element) -> None:
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked |= node.tag == "a"
        node.chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.tags, node.link_chars, node.link_tags = 0, node.chars if linked else 0, 0
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not c.gone]
        stack += [(c, linked) for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        for c in node.children:
            if not isinstance(c, str):
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    whole = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        base = math.log(c / max(c - lc, 1) * lc + whole * c + math.e)
        node.density = c / t * (math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(max(base, 1.0001)) if lc else 1.0) if c else 0.0
        node.total = sum(x.density for x in node.children if not isinstance(x, str))


def _main(root: Element) -> tuple[set[int], Element, float]:
    """The elements on the path to the container of the largest density sum (the topmost of equal ones), that container,
    and the least density on the path."""
    best, stack = root, [root]
    while stack:
        node = stack.pop()
        if node.total > best.total:
            best = node
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and (c.tag in CONTAINERS or c.tag not in BLOCK)]
    while best is not root and best.tag not in CONTAINERS:  # an inline element around blocks
        best = best.parent
    path, least, up = set(), best.density, best
    while up is not None:
        path.add(id(up))
        if up.tag != "html":
            least = min(least, up.density)
        up = up.parent
    return path, best, least


def _kept(node: Element, path: set[int], threshold: float) -> list[Element | str]:
    """Of the children of an element on the path those that are on it or dense enough, and the headings before these."""
    out: list[Element | str] = []
    follows = False
    for c in reversed(node.children):
        if isinstance(c, str):
            if not c.isspace() and len("".join(c.split())) < threshold:
                continue
        elif id(c) in path or (c.chars and c.density >= threshold):
            follows = True
        elif c.tag in HEADINGS and follows:
            pass
        elif c.tag not in VOID:
            follows = follows and not c.chars
            continue
        out.append(c)
    return out[::-1]


def _blocks(root: Element, path: set[int], best: Element, threshold: float) -> list[list[str]]:
    """Text of the kept elements; a block element starts and ends a block."""
    out: list[list[str]] = [[]]
    stack: list[Element | str | None] = [root]
    while stack:
        node = stack.pop()
        if node is None:
            out.append([])
        elif isinstance(node, str):
            out[-1].append(node)
        elif node.tag == "br":
            out[-1].append(" ")
        elif node.tag == "hr":
            out.append([])
        elif id(node) in path or not (node.tag in LISTS and node.density < threshold and node.link_chars > 0.5 * node.chars):
            if node.tag in BLOCK:
                out.append([])
                stack.append(None)
            stack += reversed(_kept(node, path, BESIDE * threshold) if id(node) in path and node is not best else node.children)
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, joined by a blank line."""
    if not page or page.isspace():
        return ""
    root = parse(page)
    _measure(root)
    texts = (" ".join("".join(b).split()) for b in _blocks(root, *_main(root)))
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": pd.Series(texts, dtype=object, index=pdf.index), "n_chars": pd.Series([len(t) for t in texts], dtype="int64", index=pdf.index)})

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
