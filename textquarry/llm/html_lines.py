"""Text lines of a web page, with where they stand."""

from __future__ import annotations

import html
import re

NAMED, LOOSE, MAIN, ARTICLE = -1, 0, 1, 2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Elements by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
    "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
DROPPED = {
    "head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "button",
    "select", "option", "dialog", "menu", "object", "canvas", "audio", "video", "fieldset",
}
DROPPED_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor",
    "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
    "alert", "popup", "modal", "overlay", "sidebar", "aside", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "copyright",
    "comment", "comments", "respond", "replies", "disqus", "share", "sharing", "social",
    "related", "newsletter", "subscribe", "signup", "login", "search", "widget", "toolbar",
    "pagination", "pager", "complementary", "contentinfo", "form", "dialog",
}
_CLOSED_BY_NEXT = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}


def _dropped(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role") and not DROPPED_NAMES.isdisjoint(
            re.split(r"[^a-z]+", value)
        ):
            return True
    return False


def page_lines(page: str, named: bool = False) -> list[tuple[int, str]]:
    """(place, text) of every text block of a page in order, dropped elements left out.

    place is ARTICLE or MAIN inside such an element, else LOOSE. A block's white space is one space
    each and none at its ends; empty blocks are left out. With ``named``, the blocks of dropped
    elements are told too, as NAMED; scripts and styles have none.
    """
    lines: list[tuple[int, str]] = []
    parts: list[str] = []
    aside: list[str] = []  # of the dropped element, which may stand inside a block
    depth = {"article": 0, "main": 0}
    skip, nested, inner, at, raw = "", 0, 0, 0, ""

    def flush(own: list[str]) -> None:
        text = " ".join(html.unescape("".join(own)).split())
        own.clear()
        if text:
            place = ARTICLE if depth["article"] else MAIN if depth["main"] else LOOSE
            lines.append((NAMED if own is aside else place, text))

    position, end = 0, len(page)
    while position <= end:
        if raw:
            close = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, position)
            position, raw = (close.end() if close else end), ""
            at = position
        tag = _TAG.search(page, position)
        if not skip:
            parts.append(page[at : tag.start() if tag else end])
        elif named:
            aside.append(page[at : tag.start() if tag else end])
        if tag is None:
            break
        position = at = tag.end()
        name = (tag[1] or tag[3] or "").lower()
        if not name:  # a comment or declaration joins what stands around it
            continue
        attributes = tag[2] or tag[4] or ""
        closing = tag[0][1] == "/"
        block = name not in INLINE
        if not closing and name in RAW:
            raw = name
            continue
        if skip:
            if closing and name == skip:
                nested -= 1
            elif not closing and name == skip and name in _CLOSED_BY_NEXT and nested == 1:
                nested = 0
            elif not closing and skip == "p" and block:
                nested = 0
            elif not closing and name == skip and not attributes.endswith("/"):
                nested += 1
            elif closing and name in depth and inner:
                inner -= 1
            elif closing and name in depth and depth[name]:
                nested = 0  # never closed inside its article
            elif name in depth and not closing:
                if any(depth.values()) or inner or _dropped(name, attributes):
                    inner += 1
                else:
                    nested = 0  # never closed before the article
            if block or nested <= 0:
                flush(aside)
            if nested > 0 or (closing and name == skip):
                skip = skip if nested > 0 else ""
                continue
            skip = ""
        if name == "br":
            parts.append(" ")
            continue
        if block:
            flush(parts)
        if closing:
            if name in depth:
                depth[name] = max(0, depth[name] - 1)
            continue
        if name not in VOID and _dropped(name, attributes):
            if not attributes.endswith("/"):
                skip, nested, inner = name, 1, 0
            continue
        if name in depth:
            depth[name] += 1
    flush(aside)
    flush(parts)
    return lines
