"""HTML pages as sequences of leaf blocks with their tag paths, in one pass over the page.

A block is a run of text between block-level tags; inline tags don't end it and <br> counts as white space. Comments, doctypes, the contents of
script, style and the like are markup. Open <p>, <li>, <td> and so on end where HTML says they do; a stray end tag is ignored; a page may stop anywhere.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: HTML's inline elements, empty elements, and elements whose content is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object xmp noembed noframes".split())
#: A start tag of the key ends an open element of the value's names.
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd td th tr".split()
)
_SCOPE = frozenset("ul ol table div article section nav aside main header footer form body blockquote dl fieldset figure".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[a-z]+")


class Path:
    """An open element: its marks (tag, then words of class, id and role) behind those of the elements around it. Elements share what is above them, so memory follows their number, not their depth."""

    __slots__ = ("parent", "own", "size", "last")

    def __init__(self, parent: Path | None, own: tuple[str, ...]):
        self.parent, self.own = parent, own
        self.size = len(own) + (parent.size if parent else 0)
        self.last = None  # for blocklabel: where each slot was marked last

    def marks(self, most: int | None = None) -> list[str]:
        """The marks, or the last `most` of them, from the outermost to the leaf's last."""
        out, at = [], self
        while at is not None and (most is None or len(out) < most):
            out += at.own[::-1]
            at = at.parent
        return out[:most][::-1]


@dataclass(slots=True)
class Block:
    text: str
    path: Path | None
    link_chars: int


def _marks(attributes: str) -> list[str]:
    """Words of an element's class, id and role."""
    out = []
    for _, value in _ATTRIBUTE.findall(attributes):
        out += _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return out


def blocks(page: str) -> list[Block]:
    """Every non-empty block of a page in order, with texts decoded and trimmed."""
    found: list[Block] = []
    stack: list[tuple[str, Path]] = []
    is_open: Counter[str] = Counter()
    pieces: list[str] = []
    links = link_chars = 0
    at = 0
    n = len(page)

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, stack[-1][1] if stack else None, min(link_chars, len(text))))
            pieces.clear()
        link_chars = 0

    def close(k: int) -> None:
        for name, _ in stack[k:]:
            is_open[name] -= 1
        del stack[k:]

    def add(raw: str) -> None:
        nonlocal link_chars
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            link_chars += len(text.strip())

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE or name in VOID:
                if name == "br":
                    pieces.append(" ")
                continue
            if not is_open[name]:
                if name in _SCOPE or not any(is_open[x] for x in _SCOPE):
                    flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    close(k)
                    break
                if stack[k][0] in _SCOPE and name not in _SCOPE:
                    break
            continue
        if name == "br":
            pieces.append(" ")
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at) if not m[3].rstrip().endswith("/") else None
            if end:
                at = end.end()
            elif not m[3].rstrip().endswith("/"):
                at = n
        elif name in INLINE:
            links += name == "a"
        elif name in VOID:
            if name == "hr":
                flush()
        else:
            flush()
            ends = IMPLIED_END.get(name, frozenset()) | ({"p"} if name in ENDS_P else set())
            if any(is_open[x] for x in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in _SCOPE:
                        break
            stack.append((name, Path(stack[-1][1] if stack else None, (name, *(f".{w}" for w in _marks(m[3]))))))
            is_open[name] += 1
            links = 0 if name in _SCOPE else links
    flush()
    return found
