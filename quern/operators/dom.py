"""A small HTML tree from the standard library's tokenizer.

Recovery: a block-level tag closes an open paragraph and the inline formatting in it; list items, cells, rows and
options close their like; an end tag without its start, or an inline one beyond the nearest block, is passed over; what
is open at the end is closed there. Comments and doctypes stay as nodes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html li td th tr tbody thead tfoot dd dt".split())
P_BOUNDS = frozenset("table td th caption html body button object".split())
#: Tag to (tags that it closes, tags that it doesn't look beyond).
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
}


class Text(str):
    """A text node; `comment` marks comments and doctypes."""

    comment = False


class Comment(Text):
    comment = True


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self) -> Iterator[Node]:
        """Nodes below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))

    def strings(self, comments: bool = False) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack.extend(reversed(x.children))
            elif comments or not x.comment:
                yield x

    def text(self) -> str:
        """All text below, white space collapsed."""
        return " ".join(" ".join(self.strings()).split())

    def find_all(self, *tags: str) -> list[Node]:
        return [x for x in self.walk() if x.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((x for x in self.walk() if x.tag in tags), None)

    def above(self) -> Iterator[Node]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.open = [self.root]

    def _pop_to(self, i: int) -> None:
        del self.open[i:]

    def _close(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in bounds:
                return
            if self.open[i].tag in tags:
                self._pop_to(i)
                if tags != {"tr", "td", "th"}:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, P_BOUNDS)
        if tag in SAME_LEVEL:
            self._close(*SAME_LEVEL[tag])
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        node = Node(tag, known, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag not in BLOCK:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._pop_to(i)
                return
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(Text(data))

    def handle_comment(self, data: str) -> None:
        self.open[-1].children.append(Comment(data))

    def handle_decl(self, decl: str) -> None:
        self.open[-1].children.append(Comment(decl[8:] if decl.lower().startswith("doctype ") else decl))


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
