"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to the elements around them, less the higher these stand, and an
element's points are discounted by the share of its text that is in links. The best element and those of its siblings
that read like it are kept, without the boilerplate inside them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and words of class, id and role by what they mean in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Menus, footers, sidebars, forms, scripts, styles and media, by tag.
DROPPED = {"aside", "button", "datalist", "dialog", "embed", "footer", "form", "head", "input", "menu", "nav", "select", "svg", "audio", "video", "canvas"} | RAW
CLOSES_P = BLOCK - {"caption", "body", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"} | {"li", "dd", "dt"}
#: An element of the key ends an open one of the values, up to an element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
#: What a class or id calls a menu, footer, sidebar, notice, advert, sign-up form or reader comments, by its last word.
NAMED = {
    "breadcrumb", "breadcrumbs", "menu", "menus", "nav", "navbar", "navigation", "pager", "pagination", "sidenav", "footer", "sidebar", "sidebars", "consent", "cookie", "cookies", "gdpr", "modal", "notice", "notices", "overlay", "popup",
    "ad", "adbox", "ads", "adsense", "advert", "advertisement", "advertisements", "advertising", "adverts", "banner", "outbrain", "promoted", "sponsor", "sponsored", "sponsors", "taboola", "newsletter", "signup", "subscribe",
    "comment", "commentlist", "comments", "disqus", "replies", "respond",
}
#: The same for headers, which stay inside an article.
HEADERS = {"header", "masthead", "topbar"}
#: Words that only say what a thing stands in or where.
PLACES = {"area", "bar", "block", "bottom", "box", "container", "global", "inner", "item", "left", "list", "outer", "page", "panel", "region", "right", "section", "site", "slot", "sticky", "top", "unit", "wrap", "wrapper"}
#: Words that speak against a container.
NEGATIVE = NAMED | HEADERS | {
    "byline", "combx", "contact", "copyright", "credits", "disclaimer", "discussion", "dropdown", "foot", "footnotes", "promo", "promotion", "recommended", "related", "reply", "rss", "search", "share", "sharing", "shoutbox", "skip", "social", "subscription",
    "tags", "teaser", "toolbar", "tracking", "widget", "widgets",
}
POSITIVE = {"article", "body", "content", "entry", "hentry", "main", "page", "post", "story", "text", "blog"}
ROLES = {"navigation", "complementary", "contentinfo", "search", "form", "alert", "dialog", "menu", "menubar"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "h2", "h3", "h4"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ENDS_TAG = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
_COMMA = re.compile(r"[,،、，]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "kids", "bad", "head", "good", "poor", "points", "size", "linked")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False, head: bool = False, good: bool = False, poor: bool = False):
        self.tag, self.parent, self.kids, self.bad, self.head, self.good, self.poor = tag, parent, [], bad, head, good, poor
        self.points, self.size, self.linked = 0.0, 0, 0


def _judge(tag: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is boilerplate, is a header, and has a name that speaks for or against it as a container.

    Only the last word of a name says what an element is: a cookie-notice is a notice, a notice-period isn't.
    """
    bad, head, good, poor = tag in DROPPED, tag == "header", tag in ("article", "main"), False
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in _WORD.findall(token)]
                    what = next((w for w in reversed(words) if w not in PLACES), "")
                    bad, head = bad or what in NAMED, head or what in HEADERS
                    good, poor = good or not POSITIVE.isdisjoint(words), poor or not NEGATIVE.isdisjoint(words)
            elif name == "role":
                value = value.lower()
                bad, head, good = bad or value in ROLES, head or value == "banner", good or value in ("main", "article")
            elif name == "hidden" or _HIDDEN.search(value):
                bad = True
    if tag in ("html", "body", "article", "main"):
        return False, False, good, False
    return bad, head, good, poor


class _Open:
    """The elements that are open, with the places of each tag, so that an end finds its start at once."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        """The innermost place of any of the tags; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, tags, at: int) -> int:
        """The outermost place of any of the tags inside the place ``at``; 0 if there is none."""
        found = 0
        for t in tags:
            p = self.places.get(t)
            if p and p[-1] > at:
                k = p[bisect_right(p, at)]
                found = min(found or k, k)
        return found


_CELLS, _BOUNDS = ("td", "th", "table"), {"td", "th", "article", "section", "div", "button", "form"}
_THROUGH_CELLS = {"tr", "table", "tbody", "thead", "tfoot", "article", "main"}


def _tag_end(page: str, pos: int, gone: set[str]) -> int:
    """Where the tag ends whose name ends at ``pos``, its ``>``; -1 if it never does. ``gone`` collects quotes that close no more."""
    while m := _ENDS_TAG.search(page, pos):
        if not m[1]:
            return m.start()
        pos = m.end()
        if m[1] not in gone:
            close = page.find(m[1], pos)
            if close < 0:
                gone.add(m[1])
            else:
                pos = close + 1
    return -1


def parse(page: str) -> Node:
    """The element tree; texts are strings among the kids. Raw text elements have none.

    One pass: no part of a page is read more than a fixed number of times, however broken it is. A tag or comment that never
    ends takes the rest of the page with it.
    """
    root = Node("html", None)
    open_ = _Open(root)
    pos, n, gone = 0, len(page), set()
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            open_.stack[-1].kids.append(html.unescape(page[pos:at]))
        if at == n:
            break
        close = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + close)
        if not m:
            if page.startswith("<!--", at):
                ends = [e + len(x) for x in ("-->", "--!>") if x not in gone and ((e := page.find(x, at + 4)) >= 0 or gone.add(x))]
                pos = min(ends, default=n)
            elif page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < n:
                end = page.find(">", at)
                pos = end + 1 if end >= 0 else n
            else:
                open_.stack[-1].kids.append("<")
                pos = at + 1
            continue
        end = _tag_end(page, m.end(), gone)
        if end < 0:
            break
        tag, attrs, pos = m[0].lower(), page[m.end() : end], end + 1
        if close:
            k = open_.last((tag,))
            if k and (tag in _THROUGH_CELLS or open_.last(_CELLS) <= k):
                open_.cut(k)
            continue
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            end = page.find(">", m.end()) if m else -1
            pos = end + 1 if end >= 0 else n
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P or tag in ENDS:
            ends, stop = ENDS.get(tag, (set(), set()))
            own = ends | ({"p"} if tag in CLOSES_P else set())
            if k := open_.first_after(own, open_.last((stop | _BOUNDS) - own)):
                open_.cut(k)
        up = open_.stack[-1]
        node = Node(tag, up, *_judge(tag, attrs))
        up.kids.append(node)
        if tag not in VOID and not attrs.endswith("/") or tag in ("p", "div", "span", "a", "li"):
            open_.push(node)
    _place_headers(root)
    return root


def _place_headers(root: Node) -> None:
    """A header of the article keeps the heading; one of the page goes."""
    stack = [(root, False)]
    while stack:
        x, inside = stack.pop()
        inside = inside or x.good
        for k in x.kids:
            if isinstance(k, Node):
                k.bad = k.bad or k.head and not inside
                if not k.bad:
                    stack.append((k, inside))


def _score(root: Node) -> None:
    """Sizes, linked sizes and points of all elements without what is boilerplate."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in x.kids if isinstance(k, Node) and not k.bad]
    for x in reversed(order):
        own = 0
        for k in x.kids:
            if isinstance(k, str):
                own += len(k.strip())
            elif not k.bad:
                x.size += k.size
                x.linked += k.linked
        x.size += own
        if x.tag == "a":
            x.linked = x.size
        if x.size >= 1 and (x.tag in PARAGRAPHS or own >= 25):
            commas = sum(len(_COMMA.findall(k)) for k in x.kids if isinstance(k, str))
            worth = min(1.0, x.size / 25) + commas + min(x.size / 100, 3.0)
            up, share = x.parent if x.tag in PARAGRAPHS else x, 1.0
            level = 0
            while up is not None and level < 4:
                up.points += worth * share
                up, level, share = up.parent, level + 1, share / 2 if level == 0 else share / 1.5
    for x in order:
        x.points *= 1 - x.linked / x.size if x.size else 0
        if x.poor:
            x.points *= 0.25
        if x.good:
            x.points = x.points * 1.25 + 5


def _texts(top: Node) -> list[str]:
    """Texts of blocks in page order, white space made one space."""
    blocks, now, stack = [], [], [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            now.append(x)
        elif isinstance(x, tuple) or x.tag in BLOCK:
            blocks.append(now)
            now = []
        elif x.tag in ("br", "wbr"):
            now.append(" " if x.tag == "br" else "")
        if isinstance(x, Node):
            if x.tag in BLOCK:
                stack.append((x,))
            stack += [k for k in reversed(x.kids) if isinstance(k, str) or not k.bad]
    blocks.append(now)
    return [t for b in blocks if (t := _SPACE.sub(" ", "".join(b)).strip())]


def extract(page: str | None) -> str:
    """The main text of a page; empty if it has none."""
    if not page:
        return ""
    root = parse(page)
    _score(root)
    best, stack = None, [root]
    while stack:
        x = stack.pop()
        if x.size and (best is None or x.points > best.points) and x.tag not in ("ul", "ol", "dl", "tr", "a"):
            best = x
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.bad]
    if best is None:
        return ""
    # an article around the best element is the whole of it
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.parent is None:
        return "\n".join(_texts(best))
    least, kept = max(5.0, 0.2 * best.points), []
    for k in best.parent.kids:
        if k is best:
            kept.append(k)
        elif isinstance(k, Node) and not k.bad and k.size:
            dense = k.linked / k.size
            if k.tag == best.tag and k.points >= least and k.good == best.good or k.tag in ("h1", "h2") and not kept or k.tag in PARAGRAPHS and (k.size > 80 and dense < 0.25 or dense == 0 and k.size > 25):
                kept.append(k)
    return "\n".join(t for k in kept for t in _texts(k))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page from its whole html.

    Returns ``page_id, url, text, n_chars``, one row for each input row. Character references are decoded; white space inside a
    block is one space; blocks are joined in page order by one line break. A null or empty html, or one without text
    outside boilerplate, has an empty text. Broken markup never fails, and very long pages take time in proportion to their
    length. Rows repeated or with null ids or urls stay. Of containers with equal points the first in the page is taken. Other
    columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x.as_py()) for x in b.column("body")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("body"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
