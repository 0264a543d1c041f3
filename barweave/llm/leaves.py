"""HTML text to leaf blocks: a forgiving tag reader that gives every block of text its path of elements.

Reading is one pass from left to right and linear in the length of the page: unfinished comments, raw elements and tags end
with the page, unknown end tags are passed over, and a new paragraph, list item, row or cell closes the one before it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np

from barweave.llm.features import EMPTY_PATH, path_vector

# Element names of HTML by how a browser lays them out.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("audio button canvas datalist iframe noembed noframes noscript object script select style svg template textarea title video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag closes open elements of these names that lie above the nearest container of theirs.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol menu dir dl table select".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_READ = frozenset({"class", "id", "role", "data-y"})


class Leaf(NamedTuple):
    text: str
    path: np.ndarray
    linked: float
    """Share of the characters that stand in links."""
    mark: str | None
    """Value of the nearest ``data-y``, which only made-up training pages carry and only training reads."""
    names: tuple[str, ...]
    """Element and class names from the page's root, for the teacher's landmarks."""


class Page(NamedTuple):
    title: str
    leaves: list[Leaf]


class _Open(NamedTuple):
    tag: str
    path: np.ndarray
    mark: str | None
    names: tuple[str, ...]


class _Reader:
    def __init__(self, keep_names: bool):
        self.stack = [_Open("", EMPTY_PATH, None, ())]
        self.open = Counter()
        self.links = 0
        self.title = ""
        self.leaves: list[Leaf] = []
        self.parts: list[str] = []
        self.linked = 0
        self.keep_names = keep_names

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(html.unescape(raw) if "&" in raw else raw)
            if self.links:
                self.linked += len(self.parts[-1])

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            words = " ".join(raw.split())
            if words:
                top = self.stack[-1]
                self.leaves.append(Leaf(words, top.path, min(1.0, self.linked / len(raw)), top.mark, top.names))
            self.parts, self.linked = [], 0

    def pop(self, down_to: int) -> None:
        for entry in self.stack[down_to:]:
            self.open[entry.tag] -= 1
        del self.stack[down_to:]

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "br":
            self.text(" ")
        elif tag in BLOCK_TAGS:
            self.flush()
            if self.open["p"] and tag not in ("html", "body"):
                self.close("p")
            for k in range(len(self.stack) - 1, 0, -1) if any(self.open[c] for c in CLOSES.get(tag, ())) else ():
                if self.stack[k].tag in BOUNDS:
                    break
                if self.stack[k].tag in CLOSES[tag]:
                    self.pop(k)
            if tag not in VOID_TAGS:
                above = self.stack[-1]
                names = (*above.names, tag, *attributes.get("class", "").split(), *attributes.get("id", "").split()) if self.keep_names else ()
                self.stack.append(_Open(tag, path_vector(above.path, tag, attributes), attributes.get("data-y", above.mark), names))
                self.open[tag] += 1
        elif tag == "a":
            self.links = 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        elif tag in BLOCK_TAGS:
            self.flush()
            if self.open[tag]:
                k = len(self.stack) - 1
                while self.stack[k].tag != tag:
                    k -= 1
                self.pop(k)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes that features read, and the place behind the tag's end; -1 if the page ends first."""
    out: dict[str, str] = {}
    while True:
        found = _ATTRIBUTE.match(page, at)
        if not found:
            end = page.find(">", at)
            return out, end + 1 if end >= 0 else -1
        name, value = found[1].lower(), found[2] or ""
        if name in _READ and name not in out:
            out[name] = html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
        at = found.end()


def read(page: str, keep_names: bool = False) -> Page:
    """Title and blocks of text of a page, in page order."""
    reader = _Reader(keep_names)
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            reader.text(page[at:])
            break
        reader.text(page[at:lt])
        follows = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2 if page.startswith("<!-->", lt) else lt + 4)
            at = n if end < 0 else end + 3
        elif follows in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif follows == "/":
            name = _NAME.match(page, lt + 2)
            end = page.find(">", lt + 2)
            at = n if end < 0 else end + 1
            if name and end >= 0:
                reader.close(name[0].lower())
        elif name := _NAME.match(page, lt + 1):
            tag = name[0].lower()
            if page[name.end():name.end() + 1] == ">":
                attributes, at = {}, name.end() + 1
            else:
                attributes, at = _attributes(page, name.end())
            if at < 0:
                break
            if tag in RAW_TAGS:
                close = _raw_end(tag).search(page, at)
                if tag == "title" and not reader.title:
                    reader.title = html.unescape(page[at:close.start() if close else n])
                end = page.find(">", close.start()) if close else -1
                at = n if end < 0 else end + 1
            else:
                reader.start(tag, attributes)
        else:
            reader.text("<")
            at = lt + 1
    reader.flush()
    return Page(reader.title, reader.leaves)


_RAW_ENDS: dict[str, re.Pattern] = {}


def _raw_end(tag: str) -> re.Pattern:
    return _RAW_ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE))
