"""Text blocks of an HTML page, and where in the page they stand. A small linear
reader: it never fails, whatever the markup, and reads truncated pages to their end."""

from __future__ import annotations

import html
import re

#: Element names by what they do to the text.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "math", "xmp")
DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "object", "audio", "video"}
BLOCK = {"html", "body", "div", "section", "article", "main", "header", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol",
         "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure",
         "figcaption", "address", "hr", "fieldset", "details", "summary", "center", "hgroup", "search"} | DROP
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
#: Words of class, id or role that name what is no article, and what is.
JUNK_WORDS = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "banner",
              "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "comment", "comments",
              "disqus", "reply", "replies", "respond", "responses", "tags", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login",
              "breadcrumb", "breadcrumbs", "popup", "modal", "overlay", "pagination", "pager", "skip", "toolbar", "widget"}
HEADER_WORDS = {"header", "masthead", "topbar"}
MAIN_WORDS = {"content", "article", "main", "post", "entry", "story"}
#: First words of names that say something about an element, not what it is ("has-comments").
STATE_WORDS = {"no", "not", "has", "with", "without", "is", "hide", "show", "category", "tag", "format", "type", "single", "layout", "page", "theme"}
#: Bits of a place: inside an article, main or content container; inside what is named junk, or
#: dropped whatever is in it; inside a container that stands in named junk; in junk of that again.
ARTICLE, MAIN, CONTENT, NAMED, DROPPED, HELD, HELD_JUNK = (1 << k for k in range(7))

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s=/>]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")
UNCLOSED = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


def tags(page: str):
    """(start, end, closing, name, attributes) of every tag, comment or declaration (name "")."""
    at = 0
    while (k := page.find("<", at)) >= 0:
        m = TAG.match(page, k) or LOOSE.match(page, k)
        if m is None:
            at = k + 1  # a bare "<" is text
            continue
        name = m.group(2)
        if name is None:
            yield k, m.end(), False, "", ""
        else:
            yield k, m.end(), bool(m.group(1)), name.lower(), m.group(3)
            if not m.group(1) and name.lower() in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, m.end())
                end = close.end() if close else len(page)
                yield m.end(), end, False, "", ""
                at = end
                continue
        at = m.end()


def is_junk(name: list[str], words: set[str]) -> bool:
    """Whether a name of these words is of ``words``: one alone, first ("cookie-notice") or
    last ("site-footer"), unless it tells a state ("has-comments", "no-sidebar")."""
    return bool(name) and (name[0] in words or name[-1] in words and name[0] not in STATE_WORDS)


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, place) of every block, white space made single, in page order; place: the bits
    of what the block stands in. Junk names never hide an article, main or content
    container that has them itself."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open blocks: (name, place of what they hold)
    place = 0

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, place))

    def enter(name: str, attributes: str) -> int:
        if place & DROPPED or name in DROP or attributes and HIDDEN.search(attributes):
            return place | DROPPED
        names = []
        if attributes and name not in ("html", "body"):
            for m in NAMES.finditer(attributes):
                names += map(WORD.findall, (m.group(1) or m.group(2) or m.group(3) or "").lower().split())
        junk = [n for n in names if is_junk(n, JUNK_WORDS) or not place & ARTICLE and is_junk(n, HEADER_WORDS)]
        words = {w for n in names if n not in junk for w in n}
        kind = 0
        if name == "article":
            kind = ARTICLE
        elif not place & ARTICLE and (name == "main" or "main" in words):
            kind = MAIN
        elif not place & (ARTICLE | MAIN | CONTENT) and words & MAIN_WORDS and name in ("div", "section", "td"):
            kind = CONTENT
        if kind:
            return place | kind | (HELD if place & NAMED else 0)
        if junk or name == "header" and not place & ARTICLE:
            return place | NAMED | (HELD_JUNK if place & HELD else 0)
        return place

    at = 0
    for start, end, closing, name, attributes in tags(page):
        if start > at:
            parts.append(page[at:start])
        at = max(at, end)
        if name in BLOCK:
            flush()
            if name in VOID:
                continue
            if closing:
                if any(n == name for n, _ in stack):
                    while stack.pop()[0] != name:
                        pass
            else:
                if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                    stack.pop()
                    place = stack[-1][1] if stack else 0
                if name == "li":  # and an item the one before it
                    if stack and stack[-1][0] == "li":
                        stack.pop()
                        place = stack[-1][1] if stack else 0
                if not attributes.rstrip().endswith("/") or name in ("p", "div", "article", "section"):
                    stack.append((name, enter(name, attributes)))
            place = stack[-1][1] if stack else 0
        elif name == "br":
            parts.append(" ")
    if at < len(page):
        rest = page[at:]
        parts.append(UNCLOSED.sub("", rest))
    flush()
    return out


def choose(found: list[tuple[str, int]]) -> tuple[list[str], bool]:
    """(texts of the article's blocks, whether the markup says where it is): all articles,
    all of main or all of content, whichever has most text (ties: in this order); where
    none has any, the containers within named junk, if they have more text than the blocks
    outside of it; all blocks where nothing else is left."""
    size = lambda texts: sum(map(len, texts))
    kinds = (ARTICLE, MAIN, CONTENT)
    own = max(([t for t, p in found if p & kind and not p & (NAMED | DROPPED)] for kind in kinds), key=size)
    if own:
        return own, True
    plain = [t for t, p in found if not p & (NAMED | DROPPED)]
    held = max(([t for t, p in found if p & kind and p & HELD and not p & (HELD_JUNK | DROPPED)] for kind in kinds), key=size)
    if size(held) > size(plain):
        return held, True
    return plain or [t for t, _ in found], False
