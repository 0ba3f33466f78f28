"""A page's text blocks with the elements around them, for pages as they are: unclosed, nested wrongly, cut off."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Comments, declarations, tags; a tag that the page's end cuts off counts up to there.
EVENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")

#: Elements whose content is no text of the page.
OPAQUE = {"script", "style", "title", "template", "noscript", "svg", "iframe", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: An opening tag closes an open element of these names, up to an element that holds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "aside", "nav", "body", "form", "footer", "header"}


@dataclass
class Block:
    """Text between two block-level tags. ``path``: open block elements from the outside, each (name, attribute words)."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int
    links: list[str] = field(default_factory=list)


def attribute_words(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, split where case, digits or punctuation change."""
    if not attributes or "=" not in attributes:
        return ()
    found = []
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() != "href":
            found += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(values)).lower())
    return tuple(found)


def blocks(page: str) -> list[Block]:
    """The page's non-empty text blocks in order, white space made single spaces, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links: list[str] = []
    linked = depth_a = 0
    place = 0
    end = len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(stack), min(linked, len(text)), links.copy()))
            parts.clear()
        links.clear()
        linked = 0

    while place < end:
        event = EVENT.search(page, place)
        low = event.start() if event else end
        if low > place:
            parts.append(page[place:low])
            if depth_a:
                linked += low - place
        if not event:
            break
        place = event.end()
        name = (event[2] or "").lower()
        if not name:
            continue
        closing = bool(event[1])
        if name in INLINE:
            if name == "a":
                depth_a = 0 if closing else 1
                if not closing and (href := next(("".join(v) for n, *v in ATTRIBUTE.findall(event[3]) if n.lower() == "href"), None)):
                    links.append(html.unescape(href))
            continue
        if name in ("br", "wbr", "img"):
            if name == "br":
                parts.append(" ")
            continue
        if name in OPAQUE and not closing:
            if not event[3].endswith("/"):
                close = re.compile(f"</{re.escape(name)}\\b[^>]*(?:>|\\Z)", re.I).search(page, place)
                place = close.end() if close else end
            continue
        flush()
        depth_a = 0
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()  # a block-level tag ends a paragraph
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i][0] in HOLDS:
                break
        stack.append((name, attribute_words(event[3])))
    flush()
    return out
