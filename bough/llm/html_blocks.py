"""Leaf blocks of a page: runs of text between block-level tags, with the path of open tags."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[a-z]+")

#: What HTML says of its elements.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of a page's own text; those of the first kind hold no tags.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = RAW | frozenset("head template noscript svg math object canvas select option datalist button".split())
#: A start tag that ends an open element of the second kind, looked for above no element of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_P_SCOPE = frozenset("table td th caption button".split())


@dataclass
class Block:
    path: list[tuple[str, str]]  # tags with their attributes, from the outside in
    text: str
    linked: int  # characters of the text inside links


def leaf_blocks(html: str) -> list[Block]:
    """The non-empty blocks of a page in page order, their white space as single spaces."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = unseen = at = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(list(stack), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(to: int):
        nonlocal unseen
        for tag, _ in stack[to:]:
            unseen -= tag in UNSEEN
        del stack[to:]

    def say(text: str):
        nonlocal linked
        if text and not unseen:
            text = unescape(text)
            parts.append(text)
            if any(tag == "a" for tag, _ in stack):
                linked += len(text.strip())

    while True:
        found = _TOKEN.search(html, at)
        say(html[at : found.start()] if found else html[at:])
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ended, within = _ENDS.get(tag, ({"p"}, _P_SCOPE))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    pop(i)
                    break
                if stack[i][0] in within:
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append((tag, found[3]))
        unseen += tag in UNSEEN
    flush()
    return blocks


def path_words(path: list[tuple[str, str]]) -> list[str]:
    """Tags of a path and the words of its classes, ids and roles."""
    out = []
    for tag, attributes in path:
        out.append(f"<{tag}>")
        if attributes:
            for value in _NAMED.findall(attributes):
                out += _PIECE.findall("".join(value).lower())
    if path:
        out.append(f"in <{path[-1][0]}>")
    return out
