"""Main text by density: layouts in which sizes, names or tags alone would decide wrongly, and the definition by quadratic walks."""

import math
import re
from collections import Counter

import pytest

from tonegrid.llm import html_text

SF = "/root/testdata/sf0.01"
LINES = [f"This is paragraph number {k} of an article that goes on for some while, with several words more, and it ends in the usual way." for k in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in LINES)
ARTICLE = " ".join(LINES)
SIDE = "".join(f"<p>Side remark number {k} that nobody asked for, though it is long enough to be taken for prose.</p>" for k in range(30))
THREAD = "".join(f'<div class="x1"><span>Ann{k}</span> <a href="#r{k}">answer</a><div>I do not think so.</div></div>' for k in range(8))
LINKS = "".join(f'<li><a href="/{k}">Another story of this site, number {k}</a></li>' for k in range(9))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div><h1>Title</h1><ul><li>first point</li><li>second point</li></ul><div>{BODY}</div></div></body>", f"Title first point second point {ARTICLE}"),
        (f"<body><div><div>By Ann</div><div>{BODY}</div><div>Note at the end.</div></div></body>", f"By Ann {ARTICLE} Note at the end."),
        (f"<body><h1>Title</h1><div>{BODY}</div></body>", f"Title {ARTICLE}"),
        (f"<body><div>{BODY}<section><h2>End</h2><p>Short.</p></section></div></body>", f"{ARTICLE} End Short."),
        (f'<body><article><p class="teaser">The lead.</p>{BODY}</article></body>', f"The lead. {ARTICLE}"),
        (f'<body><article>{BODY}<div class="cookie-recipe"><p>Take flour.</p></div></article></body>', f"{ARTICLE} Take flour."),
        (f'<body><article>{BODY}<section id="search-algorithms"><p>Sort first.</p></section></article></body>', f"{ARTICLE} Sort first."),
        (f'<body><article>{BODY}<section id="announcement-of-results"><p>All won.</p></section></article></body>', f"{ARTICLE} All won."),
        (f'<body><article>{BODY}<p class="comment-on-law">It holds.</p></article></body>', f"{ARTICLE} It holds."),
        (f"<body><div>{BODY}</div><aside>{SIDE}</aside></body>", ARTICLE),
        (f'<body><div>{BODY}</div><div class="sidebar">{SIDE}</div></body>', ARTICLE),
        (f"<body><main><div>{BODY}</div><ul>{LINKS}</ul></main></body>", ARTICLE),
        (f"<body><main>{BODY}<ul>{LINKS}</ul></main></body>", ARTICLE),
        (f"<body><main><div>{BODY}</div><div>{THREAD}</div></main></body>", ARTICLE),
        (f"<body><main><article>{BODY}<article><p>First!</p></article></article></main></body>", ARTICLE),
        (f'<body><main>{BODY}<div class="comments">{SIDE}</div></main></body>', ARTICLE),
        (f'<body><div class="widget-area">{BODY}</div><div class="ad">Buy now.</div></body>', ARTICLE),
        (f"<body><aside>{BODY}</aside><footer></footer></body>", ARTICLE),
        ("<body><nav>only this</nav></body>", "only this"),
        (f"<body><form>{BODY}<input><label>Your name</label></form><footer>f</footer></body>", f"{ARTICLE} Your name"),
        (f"<body><div>{BODY}<form><label>Your mail</label><input></form></div></body>", ARTICLE),
        (f'<body><form class="widget">{BODY}<h2>End</h2><div>Note.</div><div class="comments">{SIDE}</div></form></body>', f"{ARTICLE} End Note."),
        ('<body><div class="comments"><div class="comment">First!</div><div class="comment">Second!</div></div></body>', "First! Second!"),
        (f'<body>{BODY}<div style="display:none">{SIDE}</div><p aria-hidden="true">x</p></body>', ARTICLE),
    ],
)
def test_layouts(page, want):
    assert html_text.main_text(page) == want


class _Plain:
    """The definition, straight: every figure of a node by a walk over its whole subtree, every question asked anew."""

    def __init__(self, html):
        tree = html_text._Tree()
        tree.feed(html or "")
        tree.close()
        self.top = tree.body or tree.root
        self.without_boxes = True
        if not self.count(self.top)["c"]:
            self.without_boxes = False

    def live(self, n):
        return n is self.top or not (n.tag in html_text.DROPPED or (n.box and self.without_boxes))

    def children(self, n):
        return [p for p in n.parts if isinstance(p, str) or self.live(p)]

    def count(self, n, linked=False):
        out = Counter()
        for p in self.children(n):
            if isinstance(p, str):
                size = len(re.sub(r"\s", "", p))
                out["c"] += size
                out["lc"] += size if linked else 0
            else:
                out["t"] += 1
                out["lt"] += p.tag == "a"
                out["blocks"] += p.tag in html_text.BLOCK and p.tag not in ("li", "dt", "dd")
                out.update(self.count(p, linked or p.tag == "a"))
        return out

    def density(self, n):
        x, body = self.count(n), self.count(self.top)
        c, t, lc, lt = x["c"], x["t"], x["lc"], x["lt"]
        if not c:
            return 0.0
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0) + 1) / math.log(lc / max(c - lc, 1) * c + body["lc"] / body["c"] * c + math.e)

    def weight(self, n):
        return (html_text.WEIGHT if n.light else 1.0) * (self.weight(n.parent) if n.parent is not None else 1.0)

    def total(self, n):
        below = [p for p in self.children(n) if not isinstance(p, str)]
        return sum(self.density(p) * self.weight(p) for p in below) if below else self.density(n) * self.weight(n)

    def nodes(self, n):
        yield n
        for p in self.children(n):
            if not isinstance(p, str):
                yield from self.nodes(p)

    def text(self):
        below = [n for n in self.nodes(self.top) if n is not self.top and self.count(n)["c"]]
        best = max(below, key=lambda n: round(self.total(n), 6)) if below else self.top
        path, n = [], best
        while n is not None:
            path.append(n)
            n = n.parent if n is not self.top else None
        own = self.weight(best)
        bar = min([self.density(n) for n in path if n is not self.top], default=self.density(best)) * own
        heavy = lambda n: 2 * self.count(n)["lc"] > self.count(n)["c"]

        def keeps(n):
            if self.density(n) * self.weight(n) >= bar or not self.count(n)["c"]:
                return True
            if self.weight(n) < own or heavy(n):
                return False
            return n.tag in html_text.OWN_PARTS or (n.parent is not self.top and not self.count(n)["blocks"]) or n.tag not in html_text.BLOCK

        def say(n):
            if isinstance(n, str):
                return n
            on_path = any(n is p for p in path)
            if not on_path and self.density(n) * self.weight(n) < bar and (n.light or (n.tag in html_text.BLOCK and self.count(n)["lt"] > 1 and heavy(n))):
                return " "
            edge = " " if n.tag in html_text.BLOCK or n.tag == "br" else ""
            return edge + "".join(say(p) for p in self.children(n)) + edge

        def walk(n):
            if n is best or isinstance(n, str) or not any(n is p for p in path):
                return say(n)
            return "".join(walk(p) for p in self.children(n) if isinstance(p, str) or any(p is q for q in path) or keeps(p))

        return " ".join(walk(self.top).split())


@pytest.mark.parametrize("rename", [None, "div"])
def test_every_page_equals_the_definition(spark, rename):
    pages = [r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    for html in pages:
        page = re.sub(r"<(/?)(article|main)\b", r"<\1div", html) if rename else html
        assert html_text.main_text(page) == _Plain(page).text()


def test_densities_decide(spark):
    """Without them the page's whole body, boxes apart, would come through."""
    pages = [r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    for html in pages:
        tree = html_text._Tree()
        tree.feed(html)
        tree.close()
        body = tree.body or tree.root
        html_text._settle(tree.nodes, body)
        assert html_text._text([body], 0.0, set()) != html_text.main_text(html)
