"""A small tolerant HTML reader used inside Arrow batches."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator

_PIECE = re.compile(
    r"<!--.*?-->"
    r"|<(?P<raw>script|style)\b(?P<rawattrs>[^>]*)>(?P<rawtext>.*?)(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Fixed values of HTML itself.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)


def attributes(text: str) -> dict[str, str]:
    return {
        name.lower(): html_lib.unescape(double or single or bare)
        for name, double, single, bare in _ATTRIBUTE.findall(text)
    }


def pieces(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): open/close tags with attribute text, and text runs."""
    for m in _PIECE.finditer(source):
        if m["raw"]:
            yield "open", m["raw"].lower(), m["rawattrs"]
            if m["rawtext"]:
                yield "rawtext", "", m["rawtext"]
            yield "close", m["raw"].lower(), ""
        elif m["tag"]:
            name = m["tag"].lower()
            if m["close"]:
                yield "close", name, ""
            else:
                yield "open", name, m["attrs"]
                if m["attrs"].endswith("/"):
                    yield "close", name, ""
        elif m["text"]:
            yield "text", "", html_lib.unescape(m["text"])


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def find_all(self, wanted: Callable[[Element], bool]) -> Iterator[Element]:
        pending = [c for c in reversed(self.children) if isinstance(c, Element)]
        while pending:
            element = pending.pop()
            if wanted(element):
                yield element
            pending += [c for c in reversed(element.children) if isinstance(c, Element)]

    def find(self, wanted: Callable[[Element], bool]) -> Element | None:
        return next(self.find_all(wanted), None)

    def text(self) -> str:
        parts, pending = [], [self]
        while pending:
            item = pending.pop()
            if isinstance(item, Element):
                pending += reversed(item.children)
            else:
                parts.append(item)
        return "".join(parts)


def tree(source: str) -> Element:
    root = Element("", {})
    path = [root]
    for kind, name, content in pieces(source):
        if kind in ("text", "rawtext"):
            path[-1].children.append(content)
        elif kind == "open":
            if name in _ENDS_PARAGRAPH:
                _leave(path, "p")
            element = Element(name, attributes(content))
            path[-1].children.append(element)
            if name not in _VOID:
                path.append(element)
        elif name not in _VOID:
            _leave(path, name)
    return root


def _leave(path: list[Element], tag: str) -> None:
    for i in range(len(path) - 1, 0, -1):
        if path[i].tag == tag:
            del path[i:]
            return


def selector(*names: str) -> Callable[[Element], bool]:
    """Matches tag names (``article``) and class names (``.post-content``)."""
    tags = {n for n in names if not n.startswith(".")}
    classes = {n[1:] for n in names if n.startswith(".")}
    return lambda e: e.tag in tags or not classes.isdisjoint(e.classes)
