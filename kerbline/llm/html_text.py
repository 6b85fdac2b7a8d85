"""Main text of a web page by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, halved at each step, and a container's sum is
discounted by the share of its text that is links.  An element that is marked as an article keeps the points of all that is in it
undivided, so it stands for its parts, unless links make up too much of it.  The best container and its siblings that look alike are kept.
A page is read once: all steps take time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - set("body html legend option optgroup dd dt li tbody td tfoot th thead tr".split()) | {"li", "dd", "dt", "table"}
# Start tag -> open elements that it ends, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}

# Elements, roles and words in class or id that mark what is not the article.
DROP_TAGS = set("aside button canvas datalist dialog embed footer form head iframe input menu nav noembed noframes noscript object option script search select style svg template textarea title xmp".split())
DROP_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
DROP_WORDS = set("""ad ads adv advert advertisement advertising adsense alert banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies disqus
 dialog footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended
 related reply replies reviews rss search share sharing shoutbox sidebar signin signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets""".split())
HEADER_WORDS = set("header head top site page global".split())
KEEP_WORDS = set("article body content entry main post story text".split())

COMMENT = re.compile(r"<!--.*?(?:--!?>|\Z)", re.S)
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>""", re.S)
TAG_OF_OPEN_QUOTES = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>", re.S)
OTHER = re.compile(r"<[!?/][^>]*>", re.S)
TAG_START = re.compile(r"</?[A-Za-z]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I | re.S)
COMMAS = ",،、，"

PARAGRAPHS = set("p pre td blockquote dd".split())
TAG_POINTS = {"div": 5, "article": 10, "main": 10, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "table": -3, "body": -5}


class Node:
    __slots__ = ("tag", "parent", "parts", "attrs", "dropped", "score", "whole", "articles", "length", "link", "commas")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.parts: list[Node | str] = []
        self.score: float | None = None
        self.whole = 0.0
        self.length = self.link = self.commas = self.articles = 0
        self.dropped = tag in DROP_TAGS or bool(attrs) and unwanted(tag, attrs)


def names(attrs: str) -> tuple[dict[str, str], set[str]]:
    """Attributes of use, and the words of class and id."""
    got = {m[1].lower(): html.unescape((m[2] or "").strip("\"'")).lower() for m in ATTRIBUTE.finditer(attrs)}
    return got, set(re.split(r"[\s_\-:]+", f"{got.get('class', '')} {got.get('id', '')}"))


def unwanted(tag: str, attrs: str) -> bool:
    got, words = names(attrs)
    if "hidden" in got or got.get("aria-hidden") == "true" or got.get("role") in DROP_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main") and not words & {"comment", "comments"}:
        return False  # these name what they may hold, not what they are
    return bool(words & DROP_WORDS) or ("header" in words and bool(words & (HEADER_WORDS - {"header"}) or words <= {"header", ""}))


def tokens(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """``(start, end, tag or None)`` of tags, comments and declarations in order.

    A quote that is never closed makes its tag, and every one after it, end at the next ``>``; what is left of an unfinished tag
    reaches to the end of the page.
    """
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        m = tag = None
        if page.startswith("<!--", at):
            m = COMMENT.match(page, at)
        elif at < last:
            if TAG_START.match(page, at):
                tag = m = TAG.match(page, at) if quotes else None
                if m is None:  # scanned to the end in vain: not once more
                    quotes = False
                    tag = m = TAG_OF_OPEN_QUOTES.match(page, at)
            else:
                m = OTHER.match(page, at)
        elif at + 1 < size and (page[at + 1] in "/!?" or page[at + 1].isascii() and page[at + 1].isalpha()):
            yield at, size, None
            return
        if m:
            resume = yield at, m.end(), tag
            at = resume or m.end()
            if resume:
                yield at, at, None  # answers send()
        else:
            at += 1


def parse(page: str) -> Node:
    """A tree with implied ends; what no rule ends stays open to the end of its parent."""
    root = node = Node("html", None)
    opened: Counter = Counter()
    body = False

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    def close(kinds: set[str], until: set[str]) -> None:
        at = node
        while at is not root and at.tag not in until and any(opened[k] for k in kinds):
            if at.tag in kinds:
                leave(at.parent)
            at = at.parent

    at, found = 0, tokens(page)
    for start, end, m in found:
        if start > at:
            node.parts.append(html.unescape(page[at:start]))
        at = end
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                node.parts.append(" ")
            up = node
            while up is not root and opened[tag] and up.tag != tag and not (tag not in BLOCK and up.tag in BLOCK):
                up = up.parent
            if up is not root and up.tag == tag:
                leave(up.parent)
            continue
        if tag == "html" or tag == "body" and body:
            continue
        if tag in CLOSES_P:
            close({"p"}, {"article", "aside", "blockquote", "body", "button", "div", "main", "section", "table", "td", "th"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag == "body" or node.tag == "head" and tag not in ("meta", "link", "base", "title", "script", "style", "noscript", "template"):
            leave(root)
            body = body or tag == "body"
        if tag in VOID:
            if tag in ("br", "hr"):
                node.parts.append(Node("hr", node) if tag == "hr" else " ")
            continue
        child = Node(tag, node, m[3])
        node.parts.append(child)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            found.send(at)
            continue
        if not (m[3].endswith("/") and tag in ("path", "circle", "rect", "use")):
            node = child
            opened[tag] += 1
    if at < len(page):
        node.parts.append(html.unescape(page[at:]))
    return root


def walk(root: Node) -> list[Node]:
    """Nodes outside dropped parts, parents before children, without recursion."""
    out, todo = [], [(root, False)]
    while todo:
        n, marked = todo.pop()
        if n.dropped or (n.tag == "header" and not marked):
            n.dropped = True
            continue
        out.append(n)
        marked = marked or n.tag in ("article", "main")
        todo.extend((p, marked) for p in reversed(n.parts) if isinstance(p, Node))
    return out


def commas(text: str) -> int:
    return text.count(",") if text.isascii() else sum(map(text.count, COMMAS))


def blocks(top: Node) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif not n.dropped:
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(n.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    """Blocks of the article joined by two line feeds; empty if the page has no text."""
    if not page:
        return ""
    root = parse(page)
    nodes = walk(root)
    for n in reversed(nodes):  # children before parents
        for p in n.parts:
            if isinstance(p, str):
                n.length += len(p.strip())
                n.commas += commas(p)
            elif not p.dropped:
                n.length += p.length
                n.link += p.link
                n.commas += p.commas
        if n.tag == "a":
            n.link = n.length
    for n in reversed(nodes):
        points, size, stops = 0.0, 0, 0
        if n.tag in PARAGRAPHS:
            size, stops = n.length, n.commas
        elif n.tag in BLOCK and n.tag not in ("h1", "h2", "h3", "h4", "h5", "h6") and any(isinstance(p, str) and not p.isspace() for p in n.parts):
            runs = [p for p in n.parts if isinstance(p, str) or p.tag not in BLOCK and not p.dropped]
            size = sum(len(p.strip()) if isinstance(p, str) else p.length for p in runs)
            stops = sum(commas(p) if isinstance(p, str) else p.commas for p in runs)
        if size:
            points = 1 + stops + min(size / 100, 3)
        below = n.score  # what children passed on
        if n.tag not in PARAGRAPHS and points:  # text straight inside a container counts for the container itself
            below = (below or 0.0) + points
        n.whole += points
        n.articles += n.tag == "article"
        up = n.parent
        if up is not None:
            up.whole += n.whole
            up.articles += n.articles
            if n.tag in PARAGRAPHS and points:
                up.score = (up.score or 0.0) + points
            if below is not None:
                up.score = (up.score or 0.0) + below / 2
        if below is not None:
            marked = n.tag == "article" or n.tag == "main" and not n.articles
            n.score = (n.whole if marked else below) + TAG_POINTS.get(n.tag, 0) + (10 if names(n.attrs)[1] & KEEP_WORDS else 0)
    scored = [n for n in nodes if n.score is not None]
    if not scored:
        return "\n\n".join(blocks(root))

    def value(n: Node) -> float:
        return (n.score or 0) * (1 - n.link / n.length if n.length else 0)

    best = max(scored, key=value)
    if best.parent is None or best.tag in ("body", "main"):
        return "\n\n".join(blocks(best))
    least = max(10, 0.2 * value(best))
    out: list[str] = []
    for s in best.parent.parts:
        if isinstance(s, str) or s.dropped:
            continue
        density = s.link / s.length if s.length else 1
        alike = s.score is not None and value(s) >= least and density < 0.5
        if s is best or alike or (s.tag == "p" and (s.length > 80 and density < 0.25 or 0 < s.length <= 80 and not s.link)) or (s.tag in ("h1", "h2") and best.tag not in ("article", "main") and not s.link):
            out += blocks(s)
    return "\n\n".join(out)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` of every row.

    A null html is empty, and a page without text gives an empty text of 0 characters; repeated rows and null keys are kept; other
    columns are ignored.
    """
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(p) for p in b], dtype="object")

    return pages.select(key, url, extract(F.coalesce(F.col(body), F.lit(""))).alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
