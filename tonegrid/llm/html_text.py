"""Main text of web pages by composite text density (operator 7).

Every DOM node has a link-adjusted density of characters per tag, and a density
sum over its children. The node of the largest sum holds the article; the
smallest density on its path up to the body is the threshold by which other
regions also count as content.

Three things come before or beside the densities.

* What a reader never sees as text (scripts, styles, controls, hidden elements)
  is no node at all.
* Structure. Menus, asides, footers, dialogs and a page's own header, by tag or
  role, are *boxes*. They leave the tree before anything is measured, whatever
  their size; only a page that has no other text at all is measured with them.
* Weights. A container whose class or id names boilerplate (each word of the name
  is such a word or a neutral one), a form, and an ``article`` inside an
  ``article`` (a reader's comment) weigh a tenth, with all that they hold. A
  weight divides densities where they are compared; it never removes text alone:
  the wrapper of the densest node is on its path and stays, whatever it is called,
  and does not count against what is beside the article in it.

From the body down the path to the densest node (``_content``): a region beside
the path is content if its weighted density reaches the threshold. Densities of
short blocks are low, so what is part of an article by its own tag stays as well
if nothing weighs it down and links are not most of it: headings, paragraphs,
lists, quotations, tables, figures, sections and articles; below the body also
containers without blocks inside (bylines, notes) and loose text. In a region
that is content, weighted containers and lists of links under the threshold go.

One narrow pass, a page at a time: the parser keeps explicit stacks, so deep
and broken pages neither recurse nor grow in cost with depth.

Cases: null and empty pages give an empty text; pages without tags give their
whole text; very long pages are read whole, in linear time; unclosed and stray
tags are tolerated; among equal density sums the first node counts; repeated rows
are extracted row by row; an empty table gives no rows; other columns are ignored,
whatever their names. No rule has a size from which text is dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import parts, small_batches, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Never text on a page.
DROPPED = frozenset("script style noscript template iframe object embed svg canvas audio video head title button select textarea input datalist".split())
#: Elements that a start tag of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Never content by tag or role, unless a page has nothing else.
BOXES = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Containers whose names are weighed; paragraphs, headings and the like are not.
NAMED = frozenset("div section ul ol dl table header details figure".split())
#: Words that name boilerplate.
WORDS = frozenset(
    "ad ads adbox adslot adunit adsense adsbygoogle advert adverts advertising advertisement sponsor sponsored sponsors banner promo promotion promotions "
    "comment comments commentlist disqus replies respond sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts popup modal overlay newsletter newsletters subscribe subscription signup share sharing social breadcrumb breadcrumbs pagination "
    "pager menu menus nav navbar navigation toolbar footer masthead topbar related recommended recommendations skiplink search login warning announcement announcements".split()
)
#: Words that say where or how something stands, not what it is.
NEUTRAL = frozenset(
    "area bar body bottom box block btn button buttons card center col column container content form global group header holder icons inner item items label left "
    "link links list main message module outer page panel post posts reader right row section site slot strip text thread title top unit user users wrap wrapper".split()
)
#: Words after which a class says what a page has, not what the element is.
STATES = frozenset("has with without no not is tag category type format layout".split())
#: Words that make a header an article's own.
OWN_HEADER = frozenset("article post entry content story".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What weighed containers count.
WEIGHT = 0.1
#: Parts of an article by their own tags.
OWN_PARTS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl blockquote pre figure table section article".split())
HEAD_TAGS = frozenset("title meta link style script base noscript template".split())


class _Node:
    __slots__ = ("tag", "parent", "parts", "box", "gone", "weight", "light", "blocks", "chars", "tags", "link_chars", "link_tags", "density", "total", "elements")

    def __init__(self, tag, parent, box, weight):
        self.tag, self.parent, self.box, self.light = tag, parent, box, weight < 1
        self.gone = tag in DROPPED
        self.weight = weight * (parent.weight if parent is not None else 1.0)
        self.parts: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.elements = self.blocks = 0
        self.density = self.total = 0.0

    def linked(self) -> bool:
        """Links are most of the text."""
        return 2 * self.link_chars > self.chars


def _named(value: str, inside: Counter) -> bool:
    """Whether a class or id has a name of boilerplate words (and neutral ones) only."""
    for name in value.split():
        words = [w for w in map(str.lower, _PARTS.findall(name)) if not w.isdigit()]
        if any(w in WORDS or (w == "header" and not (inside["article"] or inside["main"])) for w in words) and all(w in WORDS or w in NEUTRAL for w in words):
            if words[0] not in STATES and not ("header" in words and OWN_HEADER.intersection(words) and not WORDS.intersection(words)):
                return True
    return False


def _judge(tag: str, attrs, inside: Counter) -> tuple[bool, float]:
    """Whether an element is a box, and its weight."""
    if tag in ("html", "body", "main"):
        return False, 1.0
    box = tag in BOXES or (tag == "header" and not (inside["article"] or inside["main"]))
    weight = WEIGHT if (tag == "form" and not inside["form"]) or (tag == "article" and inside["article"]) else 1.0
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            box = True
        elif not value:
            continue
        elif name == "role":
            box = box or value.strip().lower() in ROLES
        elif name == "style":
            box = box or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        elif name in ("class", "id") and tag in NAMED and _named(value, inside):
            weight = WEIGHT
    return box, weight


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", None, False, 1.0)
        self.nodes = [self.root]
        self.stack = [self.root]
        self.open: Counter = Counter()
        self.body = None

    def _pop(self):
        self.open[self.stack.pop().tag] -= 1

    def _close_to(self, tags) -> None:
        """Close the nearest open element of ``tags`` above any other block."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                while len(self.stack) > depth:
                    self._pop()
                return
            if tag in BLOCK:
                return

    def handle_starttag(self, tag, attrs):
        if self.open["head"] and tag not in HEAD_TAGS:  # whatever is not the head's own ends an unclosed head
            self.handle_endtag("head")
        if tag in BLOCK and self.open["p"]:
            self._close_to({"p"})
        if tag in CLOSES:
            self._close_to(CLOSES[tag])
        parent = self.stack[-1]
        node = _Node(tag, parent, *_judge(tag, attrs, self.open))
        parent.parts.append(node)
        self.nodes.append(node)
        if tag == "body" and self.body is None:
            self.body = node
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "body") or not self.open[tag]:
            return  # what follows the end of the body still belongs to it
        while self.stack[-1].tag != tag:
            self._pop()
        self._pop()

    def handle_data(self, data):
        self.stack[-1].parts.append(data)


def _settle(nodes: list[_Node], body: _Node) -> None:
    """Mark what leaves the tree: boxes, unless the page has no text outside them."""

    def spread() -> bool:
        text = False
        for node in nodes:  # a parent comes before its children
            if node is not body and node.parent is not None and (node.parent.gone or (node.box and node.tag != "#root")):
                node.gone = True
            if not node.gone and not text:
                text = any(isinstance(p, str) and not p.isspace() for p in node.parts)
        return text

    body.gone = False
    before = [n.gone for n in nodes]
    if not spread():
        for node, gone in zip(nodes, before, strict=True):
            node.gone, node.box = gone, False
        spread()


def _measure(nodes: list[_Node], body: _Node) -> None:
    for node in reversed(nodes):
        if node.gone:
            continue
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.gone:
                node.elements += 1
                node.blocks += part.blocks + (part.tag in BLOCK and part.tag not in ("li", "dt", "dd"))
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.chars if part.tag == "a" else part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        if node.gone or not node.chars:
            continue
        per_tag = node.chars / max(node.tags, 1)
        linked = node.link_chars / max(node.chars - node.link_chars, 1) * node.chars
        base = math.log(linked + share * node.chars + math.e)
        value = (node.chars / max(node.link_chars, 1)) * (max(node.tags, 1) / max(node.link_tags, 1))
        node.density = per_tag * math.log(max(value, 1.0) + 1) / max(base, 1e-9)
        node.total = node.density * node.weight if not node.elements else sum(p.density * p.weight for p in node.parts if not isinstance(p, str) and not p.gone)


def _content(body: _Node) -> tuple[list, float, set]:
    """Regions and loose texts that hold the article, in page order; the threshold; the path to the densest node."""
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        if best is body or node.total > best.total:  # the body itself only where it has no elements with text
            best = node if node is body or node.chars else best
        stack += [p for p in reversed(node.parts) if not isinstance(p, str) and not p.gone]
    path, node = set(), best
    threshold = best.density
    own = best.weight  # what weighs the article itself down does not count against its parts
    while node is not None and node is not body.parent:
        if node is not body:  # the page's own density also counts what is not article
            threshold = min(threshold, node.density)
        path.add(id(node))
        node = node.parent
    threshold *= own
    chosen, stack = [], [body]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node is best:
            chosen.append(node)
        elif id(node) in path:
            stack += [p for p in reversed(node.parts) if isinstance(p, str) or (not p.gone and (id(p) in path or _beside(p, node is body, threshold, own)))]
        else:
            chosen.append(node)
    return chosen, threshold, path


def _beside(node: _Node, of_body: bool, threshold: float, own: float) -> bool:
    """Whether a child of a path node is content."""
    if node.density * node.weight >= threshold or not node.chars:
        return True
    if node.weight < own or node.linked():
        return False
    return node.tag in OWN_PARTS or (not of_body and not node.blocks) or node.tag not in BLOCK


def _text(tops: list, threshold: float, path: set) -> str:
    """Text of regions without what weighs too little in them: light containers and lists of links."""
    out, stack = [], list(reversed(tops))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.gone:
            if id(item) not in path and item.density * item.weight < threshold and (item.light or (item.tag in BLOCK and item.link_tags > 1 and item.linked())):
                out.append(" ")
                continue
            edge = " " if item.tag in BLOCK or item.tag == "br" else ""
            out.append(edge)
            stack.append(edge)
            stack.extend(reversed(item.parts))
    return " ".join("".join(out).split())


def main_text(html: str) -> str:
    """The main text of a page."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    body = tree.body or tree.root
    _settle(tree.nodes, body)
    _measure(tree.nodes, body)
    return _text(*_content(body)) or _text([body], 0.0, set())


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    small_batches(pages.sparkSession)
    source = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), pages[html].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            found = [main_text(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
