"""A small element tree over the standard HTML tokenizer.

Open elements close only by their own end tag, an end tag of an element around them, or the end of the
page: a ``<p>`` that is never closed contains what follows.  Text in script, style and template
elements belongs to no other element's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
HIDDEN_TEXT = frozenset(("script", "style", "template"))
LISTS = frozenset(("class", "rel"))


class Node:
    """An element: name, attributes (class and rel as lists), children (nodes and strings), parent."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))

    def strings(self) -> Iterator[str]:
        """Text below, without script, style and template (of which this may be one itself)."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in HIDDEN_TEXT:
                stack.extend(reversed(x.children))

    def text(self) -> str:
        """Stripped strings joined by a space, white space normalised."""
        return " ".join(" ".join(s for t in self.strings() if (s := t.strip())).split())

    def up(self) -> Iterator[Node]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def cut(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def _open(self, tag: str, attrs) -> Node:
        found = {k: (v or "").split() if k in LISTS else (v or "") for k, v in attrs}
        node = Node(tag, found, self.at)
        self.at.children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._open(tag, attrs)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.name != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        pass


def parse(html: str, references: str | None = None) -> Node:
    """The tree of a page.

    ``references`` is a pattern of the character references to decode, without their ``&``; others stay
    as they are written.  By default all are decoded, as HTML says.
    """
    if references is not None:
        html = re.sub(f"&(?!{references})", "&amp;", html)
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root
