"""Leaf blocks of a web page: runs of text between block-level tags, with the tags around them.

A tolerant scan in one pass, linear in the length of the page: unclosed and stray tags are accepted.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Text of these is never shown as part of the page. Without an end tag, those in RAW reach to its end.
RAW = ("script", "style", "textarea", "title", "xmp")
HIDDEN = ("script", "style", "template", "textarea", "title", "select", "iframe", "xmp")
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav
    ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
#: Elements that keep an end tag inside from closing what is outside.
WALLS = frozenset(("table", "td", "th", "html", "body"))

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]+|"[^"]*"|'[^']*'|["'])*+)>|<[!?/][^>]*>?|<""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """``text`` is final; ``path`` has the open block elements, outermost first, ``names`` their class words."""

    text: str
    path: tuple[str, ...]
    names: frozenset[str]
    linked: int
    total: int


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order; none for an empty page."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    text: list[str] = []
    links, linked, at, size = 0, 0, 0, len(page)
    last = max(page.rfind(">"), page.rfind("<!--"))  # no tag or comment ends or begins behind it

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                names = frozenset().union(*(n for _, n in stack)) if stack else frozenset()
                found.append(Block(whole, tuple(t for t, _ in stack), names, linked, sum(map(len, text))))
            text.clear()
        linked = 0

    def close(tags: tuple[str, ...], walls: frozenset[str] = WALLS) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in walls:
                return

    while at < size:
        token = TOKEN.search(page, at) if at <= last else None
        start = token.start() if token else size
        if start > at:
            text.append(page[at:start])
            if links:
                linked += start - at
        if not token:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            if token[0] == "<":
                text.append("<")
            continue
        tag = tag.lower()
        if token[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                text.append(" ")
            elif tag in BLOCKS:
                flush()
                close((tag,), frozenset() if tag in WALLS else WALLS)
            continue
        if tag in HIDDEN:
            if not token[3].endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if end:
                    at = page.find(">", end.start()) + 1 or size
                elif tag in RAW:
                    at = size
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            flush()
            links = 0
            if stack and stack[-1][0] == "p" or stack and stack[-1][0] in HEADINGS and tag in HEADINGS:
                stack.pop()
            if tag in ENDS:
                close(ENDS[tag], frozenset(("table", "ul", "ol", "menu", "dl")))
            if tag != "hr":
                words = [x for m in NAMES.finditer(token[3]) for x in WORDS.findall((m[1] or m[2] or m[3] or "").lower())]
                stack.append((tag, frozenset(words)))
    flush()
    return found
