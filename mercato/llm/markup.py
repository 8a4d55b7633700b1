"""Blocks of a web page: the text between block-level tags, each with its path of tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Elements that end a block at their start and end. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre"
    " search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SKIPPED = frozenset("iframe noembed noframes noscript script style svg template textarea title xmp".split())
#: Elements that can stand in a head; any other one, or text, ends a head that is open.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that end an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
# A quote opens a value only right after the equals sign; elsewhere it is an ordinary character. One that is never
# closed ends where the tag does.
_VALUE = r"""\s*+=\s*+("[^"]*+"|'[^']*+'|["'][^>]*+|[^\s>]++)?"""
_ATTRIBUTE = re.compile(rf"([^\s/>=]++)(?:{_VALUE})?|=")
_ATTRIBUTES = rf"(?:[\s/]++|[^\s/>=]++(?:{_VALUE})?|=)*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|[^<]++|<", re.S
)
_NAMING = frozenset(("class", "id", "role", "hidden"))
_WORD = re.compile(r"[A-Za-z]+|\d+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    head: bool = False
    #: The names of all open elements, each once, from the root; blocks of one element share it.
    path: tuple[str, ...] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            if self.path is None:
                self.path = tuple(dict.fromkeys(name for _, names in self.stack for name in names))
            self.blocks.append(Block(text, self.path, min(self.linked, len(text))))
        self.parts.clear()
        self.linked = 0

    def leave_head(self) -> None:
        self.path = None
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == "head":
                del self.stack[at:]
        self.head = False

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
            self.path = None
            # An open paragraph, or sibling of a list or table, ends here; what is open inside it ends too.
            ends = {"p"} | SIBLINGS.get(tag, set())
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] in ends:
                    del self.stack[at:]
                    break
                if self.stack[at][0] in BLOCKS:
                    break
        if tag not in VOID:
            names = [tag]
            for key, value in _ATTRIBUTE.findall(attributes):
                if key.lower() in _NAMING:
                    words = _WORD.findall(value.lower()) if key.lower() != "hidden" else ["hidden"]
                    names += [f".{w}" for w in words]
            self.stack.append((tag, tuple(names)))
            self.path = None
            self.head |= tag == "head"

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                del self.stack[at:]
                self.path = None
                break
            # An end tag inside a block does not end an element around it.
            if tag not in BLOCKS and self.stack[at][0] in BLOCKS:
                break


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order. Character references are decoded, white space is one blank."""
    html, page, at = html or "", _Page(), 0
    while at < len(html):
        token = _TOKEN.match(html, at)
        at = token.end()
        closing, tag = token[1], (token[2] or "").lower()
        if not tag:
            if token[0][0] != "<" or token[0] == "<":
                text = unescape(token[0])
                if page.head and text.strip():
                    page.leave_head()
                page.parts.append(text)
                if any(name == "a" for name, _ in page.stack[-3:]):
                    page.linked += len(text.strip())
        elif closing:
            page.close(tag)
        elif tag in SKIPPED:
            if page.head and tag not in HEAD:
                page.leave_head()
            if not token[3].endswith("/") or tag != "svg":
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
        else:
            if page.head and tag not in HEAD:
                page.leave_head()
            page.open(tag, token[3])
    page.flush()
    return page.blocks
