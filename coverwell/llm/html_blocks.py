"""Leaf blocks of an HTML page: runs of text between block-level tags, each with its tag path."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Elements whose content is never shown as text of the page.
HIDDEN = "script|style|noscript|template|svg|math|iframe|object|title|select|textarea|button"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*?/>|<({HIDDEN})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag on the left closes an open one on the right, if none of the containers is opened since.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = frozenset("ul ol menu dl table".split())


class Block(NamedTuple):
    path: str  # from the root, elements separated by /, each a tag and the words of its class, id and role by .
    text: str
    links: float  # share of characters inside links


def _element(tag: str, attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return tag
    names = [a or b or c for a, b, c in NAMED.findall(attributes)]
    return ".".join([tag, *(p.lower() for n in names for p in PART.findall(n))])


def blocks(html: str | None) -> list[Block]:
    """The page's blocks in order. White space inside a block is one space; references are decoded."""
    out: list[Block] = []
    html = html or ""
    stack: list[tuple[str, str]] = []  # tag, path down to it
    parts: list[str] = []
    state = [0, 0]  # characters inside links of this block; links open

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack[-1][1] if stack else "", text, min(1.0, state[0] / len(text))))
            parts.clear()
        state[0] = 0

    def add(raw: str) -> None:
        if "&" in raw:
            raw = unescape(raw)
        parts.append(raw)
        if state[1]:
            state[0] += len(raw)

    def close(at: int) -> None:
        state[1] -= sum(t == "a" for t, _ in stack[at:])
        del stack[at:]

    end = 0
    for m in TOKEN.finditer(html):
        if m.start() > end:
            add(html[end : m.start()])
        end = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m.group(2):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    close(at)
                    break
                if not block and stack[at][0] in BLOCK:
                    break
            continue
        if tag in VOID or tag == "head":  # what a head may hold is void or hidden; all else is of the body
            continue
        if block:
            closes = SIBLINGS.get(tag, ()) if tag in SIBLINGS else ()
            for at in range(len(stack) - 1, -1, -1):
                name = stack[at][0]
                if name == "p" or name in closes:
                    close(at)
                    if name == "p":
                        continue
                    break
                if name in CONTAINERS or (name in BLOCK and not closes):
                    break
        if tag == "a":
            state[1] += 1
        stack.append((tag, f"{stack[-1][1] if stack else ''}/{_element(tag, m.group(4))}"))
    if end < len(html):
        add(html[end:])
    flush()
    return out
