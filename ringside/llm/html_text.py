"""Main text of web pages from flat text blocks.

A page is cut into blocks: runs of text between block-level tags, with their number of words, the share of words inside links,
the same of the blocks before and after, and two hints of the elements around: whether one is the page's article, and whether
one stands beside it.  A decision tree, trained on a small labelled table of such blocks, tells text from boilerplate; it is
compiled into a Spark column expression over the blocks.

The hints come from tags, and from classes, ids and roles.  A name made of nothing but names of side elements (cookie-notice) counts
as one, a name that only has one in it (social-history) counts half, and names of html and body count for nothing.

Character references are decoded, white space inside a block becomes one space, and the blocks that stay are joined in page order
by an empty line.  Comments, scripts, styles, the head and other elements without visible text are no blocks, nor is what has
the attribute hidden or a style that hides it.  A null or empty
page, or one without text blocks, has an empty text; pages may be cut off or badly nested anywhere.  Rows and other columns
stay, but for text and n_chars, which replace older columns of their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.llm.common import free_name, with_struct

#: Elements of HTML whose text is not shown, or is no text.
HIDDEN = {"script", "style", "head", "noscript", "template", "svg", "annotation", "annotation-xml", "iframe", "object", "textarea", "select", "canvas", "audio", "video", "map"}
#: Of these, up to the end tag everything is text.
RAW = {"script", "style", "textarea", "iframe", "noscript"}
_RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Elements that hold others and are closed by their own end tags.
HOLDERS = {"address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "div", "fieldset", "figure", "footer", "form", "header", "html", "main", "menu", "nav", "ol", "section", "span", "table", "td", "tr", "ul"}
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button"}
MAIN_NAMES = {"article", "content", "entry", "main", "post", "story"}
SIDE_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup",
    "promo", "promoted", "recommended", "related", "replies", "reply", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
#: Names of boxes, which leave a side name that stands with them whole: ad-slot, share-buttons, site-footer.
BOX_NAMES = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "header", "icons",
    "inner", "item", "items", "layout", "left", "letter", "line", "links", "list", "main", "media", "outer", "page", "panel", "post", "posts", "primary",
    "right", "row", "secondary", "section", "signup", "site", "slot", "text", "thread", "top", "unit", "us", "wrap", "wrapper",
}

#: A class, id or role that begins so says what a page has, or lacks, elsewhere: no-sidebar, with-sidebar.
ABOUT_OTHERS = {"has", "no", "with", "without"}
#: With one of these a class, id or role doesn't name a main element: post-meta, entry-tags.
NOT_MAIN_NAMES = {"author", "byline", "date", "image", "info", "meta", "tag", "tags", "thumbnail"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^'\"<>]|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_KIND = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"""\shidden(?=[\s=/>])(?!\s*=\s*["']?until-found)|\sstyle\s*=\s*["']?[^"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "main", "side", "page_main"]
BLOCKS = "blocks array<struct<" + ",".join(["text:string", *[f"{f}:double" for f in FEATURES]]) + ">>"


def _side_name(parts: list[str]) -> float:
    """1 for a name of a side element, 1/2 for one with such a name in it, else 0."""
    found = [p in SIDE_NAMES for p in parts]
    if not any(found) or parts[0] in ABOUT_OTHERS:
        return 0.0
    return 1.0 if all(f or p in BOX_NAMES or len(p) == 1 for f, p in zip(found, parts, strict=True)) else 0.5


def _standing(name: str, tag: str, within_main: bool) -> tuple[bool, float, bool]:
    """(whether it is a main element, how far one beside the text, whether it is that by its tag and not only by a name)."""
    main, side = False, 0.0
    if name not in ("body", "html"):  # they hold the text as well as all that is beside it
        for m in _KIND.finditer(tag):
            for kind in (m[2] or m[3] or m[4] or "").split():
                parts = [p.lower() for p in _PARTS.findall(kind)]
                if parts:
                    side = max(side, _side_name(parts))
                    main = main or not MAIN_NAMES.isdisjoint(parts) and NOT_MAIN_NAMES.isdisjoint(parts)
    by_tag = name in SIDE_TAGS or (name == "header" and not within_main)
    side = 1.0 if by_tag else side
    return not side and (name in MAIN_TAGS or main), side, by_tag


def blocks(page: str | None) -> list[dict]:
    """The text blocks of a page with their features, in order.

    What holds a main element isn't beside the text for its name: the main element ends that.  An article ends it only on pages
    that have no main element otherwise, as sidebars have articles too.
    """
    found, page_main, held = _blocks(page, False)
    if held and not page_main:
        found, page_main, _ = _blocks(page, True)
    return _features(found, page_main)


def _blocks(page: str | None, articles: bool) -> tuple[list[list], bool, bool]:
    """(blocks, whether the page has a main element, whether an article stands in a side that is one by name only).

    articles: whether articles end such a side.
    """
    found: list[list] = []  # text, words, linked words, main, side
    parts: list[str] = []
    words = linked = links = 0
    stack: list[tuple[str, bool, float, bool, bool]] = []  # name, main, side, side by a tag, unseen: of the element or one around it
    opened: Counter = Counter()  # elements of the stack by name
    hidden_until = None
    page_main = held = unseen = False  # unseen: of a paragraph or another block that no end tag needs to close

    def close():
        nonlocal words, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, main, side, _, _ = stack[-1] if stack else ("", False, 0.0, False, False)
                found.append([text, words, linked, main, side])
            parts.clear()
        words = linked = 0

    def text(raw: str):
        nonlocal words, linked
        if raw and hidden_until is None and not unseen and not (stack and stack[-1][4]):
            raw = html.unescape(raw)
            n = len(raw.split())
            parts.append(raw)
            words += n
            linked += n if links else 0

    at, size, page = 0, len(page or ""), page or ""
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[0]
        named = _NAME.match(tag)
        if named is None:  # a comment or declaration
            continue
        name, ends = named[1].lower(), tag[1] == "/"
        if hidden_until is not None:
            if ends and name == hidden_until or name == "body":  # a head without its end ends there
                hidden_until = None
            if name != "body":
                continue
        if not ends and name in HIDDEN:
            if tag.endswith("/>"):
                continue
            if name in RAW:
                stop = _RAW_ENDS[name].search(page, at)
                at = stop.end() if stop else size
            else:
                hidden_until = name
            continue
        if name == "a":
            links = 0 if ends else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            close()
            links = 0 if name in HOLDERS else links
            unseen = not ends and name not in HOLDERS and _UNSEEN.search(tag) is not None
        if name in HOLDERS:
            if ends:
                if opened[name]:
                    last = None
                    while last != name:
                        last = stack.pop()[0]
                        opened[last] -= 1
            elif not tag.endswith("/>"):
                _, main, side, by_tag, off = stack[-1] if stack else ("", False, 0.0, False, False)
                own_main, own_side, own_tag = _standing(name, tag, main)
                if side and not by_tag and not main and own_main and name in MAIN_TAGS:
                    held = True
                    side = 0.0 if articles or name == "main" else side
                page_main = page_main or own_main and not side
                stack.append((name, main or own_main, max(side, own_side), by_tag or own_tag, off or _UNSEEN.search(tag) is not None))
                opened[name] += 1
    close()
    return found, page_main, held


def _features(found: list[list], page_main: bool) -> list[dict]:
    out = []
    for i, (t, n, k, main, side) in enumerate(found):
        before, after = (found[j] if 0 <= j < len(found) else ["", 0, 0, False, 0.0] for j in (i - 1, i + 1))
        share = lambda b: b[2] / b[1] if b[1] else 0.0
        values = [n, share((t, n, k)), before[1], share(before), after[1], share(after), main, side, page_main]
        out.append({"text": t} | {f: float(v) for f, v in zip(FEATURES, values, strict=True)})
    return out


#: The labelled table: whether a block is text, and its features, judged by eye on typical pages.
TABLE = [
    # text, words, links, words_before, links_before, words_after, links_after, main, side, page_main
    # In the article: headings, paragraphs of any length, points of lists.
    (1, 8, 0.0, 10, 0.0, 60, 0.0, 1, 0, 1),
    (1, 5, 0.0, 6, 1.0, 80, 0.1, 1, 0, 1),
    (1, 90, 0.0, 8, 0.0, 70, 0.0, 1, 0, 1),
    (1, 60, 0.1, 90, 0.0, 2, 0.0, 1, 0, 1),
    (1, 1, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1),
    (1, 2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1),
    (1, 40, 0.4, 1, 0.0, 12, 0.0, 1, 0, 1),
    (1, 300, 0.02, 25, 0.0, 0, 0.0, 1, 0, 1),
    (1, 12, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (1, 6, 0.0, 3, 0.0, 4, 0.0, 1, 0, 1),
    (1, 4, 0.0, 3, 1.0, 6, 0.0, 1, 0, 1),
    (1, 5, 0.6, 3, 0.0, 2, 1.0, 1, 0, 1),
    (1, 12, 0.0, 4, 1.0, 3, 0.0, 1, 0, 1),
    (1, 25, 0.6, 8, 0.0, 5, 1.0, 1, 0, 1),
    (1, 70, 0.0, 4, 0.0, 0, 0.0, 1, 0, 1),
    (1, 45, 0.0, 12, 1.0, 2, 0.0, 1, 0, 1),
    (1, 2, 0.0, 5, 0.0, 3, 1.0, 1, 0, 1),
    (1, 3, 0.0, 40, 0.0, 4, 1.0, 1, 0, 1),
    (1, 20, 0.0, 3, 1.0, 4, 1.0, 1, 0, 1),
    (1, 10, 0.0, 6, 1.0, 5, 1.0, 1, 0, 1),
    (1, 60, 0.1, 50, 0.1, 70, 0.2, 1, 0, 1),
    (1, 80, 0.05, 90, 0.2, 60, 0.3, 1, 0, 1),
    (1, 35, 0.3, 40, 0.2, 45, 0.25, 1, 0, 1),
    (1, 120, 0.1, 10, 1.0, 90, 0.1, 1, 0, 1),
    (1, 70, 0.15, 5, 1.0, 4, 1.0, 1, 0, 1),
    (1, 50, 0.2, 60, 0.1, 3, 1.0, 1, 0, 1),
    (1, 30, 0.4, 12, 0.0, 6, 1.0, 1, 0, 1),
    (1, 15, 0.5, 20, 0.2, 18, 0.4, 1, 0, 1),
    (1, 9, 0.3, 25, 0.0, 30, 0.3, 1, 0, 1),
    (1, 6, 0.5, 14, 0.5, 9, 0.4, 1, 0, 1),
    (1, 60, 0.1, 4, 1.0, 70, 0.1, 1, 0, 1),
    (1, 40, 0.3, 6, 1.0, 50, 0.0, 1, 0, 1),
    (1, 15, 0.2, 3, 1.0, 20, 0.1, 1, 0, 1),
    (1, 8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1),
    (1, 40, 0.0, 2, 1.0, 30, 0.0, 1, 0, 1),
    (1, 2, 0.0, 1, 1.0, 60, 0.2, 1, 0, 1),
    (1, 1, 0.0, 2, 1.0, 40, 0.4, 1, 0, 1),
    (1, 2, 0.0, 2, 1.0, 80, 0.3, 1, 0, 1),
    (1, 2, 0.0, 0, 0.0, 30, 0.5, 1, 0, 1),
    (1, 2, 0.0, 40, 0.2, 60, 0.0, 1, 0, 1),
    (1, 1, 0.0, 30, 0.3, 20, 0.1, 1, 0, 1),
    (1, 2, 0.0, 70, 0.1, 5, 0.0, 1, 0, 1),
    (1, 2, 0.0, 4, 1.0, 60, 0.0, 1, 0, 1),
    (1, 1, 0.0, 3, 1.0, 30, 0.0, 1, 0, 1),
    # A linked point or heading by itself, or after short points.
    (1, 4, 1.0, 50, 0.0, 60, 0.0, 1, 0, 1),
    (1, 6, 1.0, 30, 0.0, 40, 0.1, 1, 0, 1),
    (1, 12, 0.9, 60, 0.0, 25, 0.0, 1, 0, 1),
    (1, 9, 1.0, 20, 0.1, 50, 0.0, 1, 0, 1),
    (1, 2, 1.0, 70, 0.3, 8, 0.0, 1, 0, 1),
    (1, 7, 1.0, 40, 0.2, 30, 0.0, 1, 0, 1),
    (1, 2, 1.0, 1, 0.0, 1, 1.0, 1, 0, 1),
    (1, 10, 0.9, 2, 0.0, 4, 0.0, 1, 0, 1),
    (1, 3, 1.0, 4, 0.0, 6, 0.0, 1, 0, 1),
    (1, 6, 1.0, 0, 0.0, 70, 0.0, 1, 0, 1),
    (1, 4, 1.0, 5, 0.0, 5, 1.0, 1, 0, 1),
    # A list of links in the article, and short words between links.
    (0, 4, 1.0, 9, 1.0, 11, 1.0, 1, 0, 1),
    (0, 6, 1.0, 12, 1.0, 8, 1.0, 1, 0, 1),
    (0, 3, 1.0, 10, 1.0, 30, 0.0, 1, 0, 1),
    (0, 6, 1.0, 4, 1.0, 70, 0.0, 1, 0, 1),
    (0, 5, 1.0, 25, 0.0, 4, 1.0, 1, 0, 1),
    (0, 3, 1.0, 90, 0.0, 7, 0.9, 1, 0, 1),
    (0, 1, 0.0, 4, 1.0, 3, 1.0, 1, 0, 1),
    (0, 2, 0.0, 2, 1.0, 5, 0.9, 1, 0, 1),
    (0, 3, 1.0, 7, 1.0, 5, 1.0, 1, 0, 1),
    (0, 4, 1.0, 3, 1.0, 40, 0.0, 1, 0, 1),
    (0, 5, 0.9, 3, 1.0, 0, 0.0, 1, 0, 1),
    (0, 12, 0.9, 9, 1.0, 11, 1.0, 1, 0, 1),
    (0, 2, 1.0, 60, 0.0, 2, 1.0, 1, 0, 1),
    (0, 4, 1.0, 35, 0.1, 6, 1.0, 1, 0, 1),
    (0, 1, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1),
    (0, 2, 0.0, 3, 1.0, 4, 1.0, 1, 0, 1),
    # In the article in an element that may be one beside it: text if it reads like text.
    (1, 60, 0.0, 40, 0.0, 50, 0.0, 1, 0.5, 1),
    (1, 35, 0.1, 12, 0.0, 70, 0.0, 1, 0.5, 1),
    (1, 45, 0.0, 70, 0.0, 10, 0.0, 1, 0.5, 1),
    (1, 12, 0.0, 60, 0.0, 50, 0.0, 1, 0.5, 1),
    (1, 120, 0.0, 8, 0.0, 6, 0.0, 1, 0.5, 1),
    (0, 4, 0.0, 6, 0.0, 5, 0.0, 1, 0.5, 1),
    (0, 9, 0.0, 8, 0.0, 12, 0.0, 1, 0.5, 1),
    (0, 14, 0.0, 6, 0.0, 9, 0.0, 1, 0.5, 1),
    (0, 18, 0.1, 4, 0.0, 3, 0.0, 1, 0.5, 1),
    (0, 22, 0.0, 12, 0.0, 10, 0.0, 1, 0.5, 1),
    (0, 20, 0.0, 3, 1.0, 15, 0.0, 1, 0.5, 1),
    (0, 2, 1.0, 45, 0.0, 60, 0.0, 1, 0.5, 1),
    (0, 8, 0.7, 50, 0.0, 45, 0.0, 1, 0.5, 1),
    (0, 40, 0.8, 50, 0.0, 60, 0.0, 1, 0.5, 1),
    # In an advert, a notice, a form, a list of shares, readers' comments, in the article or not.
    (0, 9, 0.0, 80, 0.0, 70, 0.0, 1, 1, 1),
    (0, 30, 0.0, 60, 0.0, 50, 0.1, 1, 1, 1),
    (0, 2, 1.0, 45, 0.0, 2, 1.0, 1, 1, 1),
    (0, 120, 0.0, 40, 0.0, 6, 0.0, 1, 1, 1),
    (0, 4, 0.0, 90, 0.0, 0, 0.0, 1, 1, 1),
    (0, 6, 0.0, 3, 0.0, 4, 0.0, 1, 1, 1),
    (0, 18, 0.0, 3, 0.0, 8, 0.0, 1, 1, 1),
    (0, 1, 0.0, 60, 0.0, 40, 0.0, 1, 1, 1),
    (0, 25, 0.7, 8, 0.0, 5, 1.0, 1, 1, 1),
    (0, 300, 0.0, 70, 0.0, 90, 0.0, 1, 1, 1),
    (0, 1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1),
    (0, 2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 1),
    (0, 9, 0.0, 2, 1.0, 8, 0.0, 0, 1, 1),
    (0, 14, 0.1, 70, 0.0, 0, 0.0, 0, 1, 1),
    (0, 60, 0.0, 45, 0.0, 50, 0.2, 0, 1, 1),
    (0, 90, 0.0, 120, 0.0, 60, 0.0, 0, 1, 1),
    (0, 30, 0.0, 50, 0.0, 20, 0.0, 0, 1, 0),
    (0, 5, 1.0, 60, 0.0, 5, 1.0, 0, 1, 0),
    (0, 80, 0.0, 70, 0.0, 60, 0.0, 0, 1, 0),
    (0, 10, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0),
    (0, 120, 0.0, 100, 0.0, 80, 0.1, 0, 1, 0),
    # Outside of the article: unnamed menus, headers, footers, notices; but text where long blocks follow each other.
    (0, 3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 1),
    (0, 6, 0.5, 40, 0.0, 9, 0.1, 0, 0, 1),
    (0, 18, 0.0, 6, 1.0, 8, 0.0, 0, 0, 1),
    (0, 45, 0.0, 70, 0.0, 4, 1.0, 0, 0, 1),
    (0, 22, 0.0, 60, 0.0, 60, 0.0, 0, 0, 1),
    (0, 6, 0.0, 3, 0.0, 4, 0.0, 0, 0, 1),
    (0, 12, 0.0, 45, 0.0, 60, 0.0, 0, 0, 1),
    (0, 80, 0.0, 60, 0.0, 3, 0.0, 0, 0, 1),
    (0, 120, 0.0, 4, 0.0, 0, 0.0, 0, 0, 1),
    (0, 60, 0.7, 80, 0.0, 70, 0.6, 0, 0, 1),
    (0, 30, 0.1, 10, 0.0, 100, 0.0, 0, 0, 1),
    (0, 12, 0.2, 100, 0.0, 90, 0.0, 0, 0, 1),
    (0, 25, 0.05, 60, 0.0, 20, 0.0, 0, 0, 1),
    (0, 100, 0.1, 10, 0.0, 12, 0.0, 0, 0, 1),
    (0, 8, 0.2, 3, 1.0, 120, 0.0, 0, 0, 1),
    (0, 5, 0.0, 6, 1.0, 200, 0.0, 0, 0, 1),
    (0, 18, 0.0, 30, 0.0, 150, 0.0, 0, 0, 1),
    (0, 60, 0.0, 8, 0.0, 130, 0.0, 0, 0, 1),
    (0, 150, 0.0, 10, 0.0, 5, 0.0, 0, 0, 1),
    (0, 15, 0.1, 0, 0.0, 90, 0.0, 0, 0, 1),
    (0, 90, 0.1, 3, 1.0, 0, 0.0, 0, 0, 1),
    (0, 90, 0.0, 100, 0.0, 10, 0.5, 0, 0, 1),
    (0, 200, 0.1, 30, 0.0, 20, 0.0, 0, 0, 1),
    (0, 200, 0.0, 20, 0.0, 150, 0.0, 0, 0, 1),
    (1, 150, 0.0, 200, 0.0, 130, 0.0, 0, 0, 1),
    (1, 60, 0.1, 100, 0.05, 90, 0.0, 0, 0, 1),
    (1, 80, 0.0, 70, 0.0, 60, 0.1, 0, 0, 1),
    (1, 48, 0.0, 150, 0.1, 44, 0.0, 0, 0, 1),
    (1, 300, 0.05, 50, 0.0, 200, 0.0, 0, 0, 1),
    (1, 70, 0.0, 60, 0.0, 50, 0.0, 0, 0, 1),
    (1, 110, 0.1, 90, 0.0, 45, 0.0, 0, 0, 1),
    (1, 55, 0.0, 45, 0.1, 120, 0.0, 0, 0, 1),
    (0, 70, 0.0, 60, 0.0, 50, 0.0, 0, 0.5, 1),
    (0, 9, 0.0, 60, 0.0, 50, 0.0, 0, 0.5, 1),
    (0, 110, 0.0, 90, 0.0, 80, 0.0, 0, 0.5, 1),
    # Pages without an article element: by words and links of the block and its neighbours.
    (1, 60, 0.0, 30, 0.0, 70, 0.0, 0, 0, 0),
    (1, 35, 0.1, 60, 0.0, 40, 0.0, 0, 0, 0),
    (1, 18, 0.0, 70, 0.0, 45, 0.0, 0, 0, 0),
    (1, 20, 0.0, 35, 0.0, 28, 0.1, 0, 0, 0),
    (1, 45, 0.2, 5, 1.0, 50, 0.0, 0, 0, 0),
    (1, 90, 0.05, 3, 1.0, 4, 1.0, 0, 0, 0),
    (1, 8, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0),
    (1, 6, 0.0, 20, 0.0, 80, 0.0, 0, 0, 0),
    (1, 3, 0.0, 50, 0.0, 30, 0.0, 0, 0, 0),
    (1, 9, 0.0, 2, 1.0, 75, 0.0, 0, 0, 0),
    (1, 58, 0.0, 60, 0.0, 4, 1.0, 0, 0, 0),
    (1, 48, 0.0, 70, 0.0, 2, 1.0, 0, 0, 0),
    (1, 52, 0.1, 40, 0.0, 0, 0.0, 0, 0, 0),
    (1, 60, 0.0, 50, 0.0, 70, 0.0, 0, 0.5, 0),
    (1, 7, 0.0, 3, 1.0, 90, 0.0, 0, 0, 0),
    (1, 5, 0.0, 1, 1.0, 120, 0.1, 0, 0, 0),
    (1, 8, 0.0, 4, 1.0, 60, 0.0, 0, 0, 0),
    (1, 10, 0.0, 0, 0.0, 85, 0.0, 0, 0, 0),
    (1, 30, 0.1, 40, 0.2, 50, 0.1, 0, 0, 0),
    (1, 55, 0.25, 45, 0.3, 35, 0.2, 0, 0, 0),
    (1, 28, 0.3, 60, 0.0, 44, 0.1, 0, 0, 0),
    (0, 8, 0.0, 5, 1.0, 20, 0.0, 0, 0, 0),
    (0, 30, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0),
    (0, 10, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0),
    (0, 12, 0.1, 90, 0.0, 0, 0.0, 0, 0, 0),
    (0, 6, 0.0, 45, 0.0, 2, 1.0, 0, 0, 0),
    (1, 14, 0.0, 80, 0.0, 30, 0.0, 0, 0, 0),
    (1, 12, 0.0, 25, 0.0, 90, 0.0, 0, 0, 0),
    (0, 5, 0.0, 4, 1.0, 12, 0.9, 0, 0, 0),
    (0, 8, 0.0, 0, 0.0, 15, 0.2, 0, 0, 0),
    (0, 4, 0.0, 10, 1.0, 14, 0.6, 0, 0, 0),
    (0, 10, 0.0, 3, 0.0, 12, 0.0, 0, 0, 0),
    (0, 18, 0.0, 4, 1.0, 6, 1.0, 0, 0, 0),
    (0, 15, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0),
    (0, 14, 0.0, 8, 0.0, 10, 0.2, 0, 0, 0),
    (0, 2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0),
    (0, 1, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (0, 12, 0.9, 4, 1.0, 6, 1.0, 0, 0, 0),
    (0, 4, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0),
    (0, 3, 1.0, 2, 1.0, 70, 0.0, 0, 0, 0),
    (0, 6, 0.8, 3, 1.0, 50, 0.0, 0, 0, 0),
    (0, 2, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0),
    (0, 40, 0.8, 10, 0.9, 5, 1.0, 0, 0, 0),
    (0, 25, 0.6, 60, 0.0, 8, 1.0, 0, 0, 0),
    (0, 5, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0),
    (0, 7, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0),
    (0, 4, 0.5, 8, 0.0, 6, 0.3, 0, 0, 0),
    (0, 6, 0.0, 8, 0.2, 0, 0.0, 0, 0, 0),
    (0, 3, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0),
    (0, 10, 0.0, 40, 0.0, 6, 1.0, 0, 0.5, 0),
]


def fit(spark: SparkSession, table: list[tuple] = TABLE, depth: int = 10) -> list[list[tuple[str, bool, float]]]:
    """The paths of a decision tree that lead to text: each a list of (feature, whether at most, threshold)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([tuple(map(float, r)) for r in table], ", ".join(f"{c} double" for c in ("label", *FEATURES))).coalesce(1)
    features = rows.select("label", array_to_vector(F.array(*FEATURES)).alias("features"))
    tree = DecisionTreeClassifier(maxDepth=depth, maxBins=128, seed=1).fit(features)
    paths: list[list[tuple[str, bool, float]]] = []

    def walk(node, path):
        if node.subtreeDepth() == 0:
            if node.prediction() == 1.0:
                paths.append(path)
            return
        split = node.split()
        name, t = FEATURES[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), [*path, (name, True, t)])
        walk(node.rightChild(), [*path, (name, False, t)])

    walk(tree._java_obj.rootNode(), [])
    return paths


def is_text(block: Column, paths: list[list[tuple[str, bool, float]]]) -> Column:
    one = [reduce(lambda a, t: a & (block[t[0]] <= t[2] if t[1] else block[t[0]] > t[2]), path, F.lit(True)) for path in paths]
    return reduce(lambda a, b: a | b, one, F.lit(False))


def with_blocks(pages: DataFrame, html_col: str = "html", out: str = "__page") -> DataFrame:
    """``pages`` with the struct column ``out`` of one field, blocks."""
    return with_struct(pages, html_col, out, BLOCKS, lambda: lambda rows: {"blocks": [blocks(p) for p in rows]})


def extract(pages: DataFrame, paths: list[list[tuple[str, bool, float]]] | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars."""
    paths = fit(pages.sparkSession) if paths is None else paths
    struct = free_name("__page", pages)
    kept = F.filter(F.col(struct)["blocks"], lambda b: is_text(b, paths))
    text = F.coalesce(F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return with_blocks(pages, html_col, struct).select(*rest, text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
