"""A small tree of an HTML page; pages with other than plain tags go through the standard library's tokenizer.

Unclosed cells, rows, items and paragraphs end where the next one begins, so the usual broken markup still gives
the rows that a browser shows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = {"script", "style"}
_CELLS, _TABLE = {"td", "th"}, {"table"}
#: A new one of these ends an open one of the listed kinds, up to the given border.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "p": ({"p"}, {"td", "th", "li", "div", "body"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
}


class Node:
    __slots__ = ("attrs", "children", "known", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        #: Of a tree that is kept, nodes below by what was asked for: only texts and attributes change there.
        self.known = None

    def walk(self) -> Iterator[Node | str]:
        """Nodes and texts below, in document order."""
        left = self.children[::-1]
        while left:
            n = left.pop()
            yield n
            if n.__class__ is Node:
                left += n.children[::-1]

    def all(self, *tags: str) -> list[Node]:
        return self._once(("all", *tags), lambda: [*self._tagged(tags)])

    def first(self, *tags: str) -> Node | None:
        return self._once(("first", *tags), lambda: next(self._tagged(tags), None))

    def own(self, *tags: str) -> list[Node]:
        return self._once(("own", *tags), lambda: [n for n in self.children if n.__class__ is Node and n.tag in tags])

    def _once(self, asked: tuple, find):
        if self.known is None:
            return find()
        if asked not in self.known:
            self.known[asked] = find()
        return self.known[asked]

    def _tagged(self, tags: tuple) -> Iterator[Node]:
        left = self.children[::-1]
        while left:
            n = left.pop()
            if n.__class__ is Node:
                if n.tag in tags:
                    yield n
                left += n.children[::-1]

    def up(self, *tags: str) -> Node | None:
        n = self.parent
        while n is not None and n.tag not in tags:
            n = n.parent
        return n

    def raw(self, line_break: str = " ") -> str:
        parts = []
        for n in self.walk():
            if isinstance(n, str):
                parts.append(n)
            elif n.tag == "br":
                parts.append(line_break)
        return " ".join(parts) if line_break == " " else "".join(p if p == line_break else " " + " ".join(p.split()) + " " for p in parts)

    def text(self) -> str:
        """Visible text with single blanks."""
        children = self.children
        if len(children) == 1 and children[0].__class__ is str:
            return " ".join(children[0].split())
        return " ".join(self.raw().split()) if children else ""

    def label(self) -> str:
        """Visible text, or the alternative text of an image."""
        text = self.text()
        image = None if text else self.first("img")
        return (image.attrs.get("alt") or "").strip() if image else text


class _Tree:
    """The tree that tags and texts make, one after the other."""

    def __init__(self):
        self.root = self.at = Node("", {}, None)
        self.hidden = 0

    def _close(self, kinds: set[str], border: set[str]) -> None:
        n = self.at
        while n is not None and n.tag not in border:
            if n.tag in kinds:
                self.at = n.parent
                return
            n = n.parent

    def start(self, tag: str, attrs: dict) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _ENDS:
            if tag == "tr":
                self._close(_CELLS, _TABLE)
            self._close(*_ENDS[tag])
        at = self.at
        node = Node(tag, attrs, at)
        at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def empty(self, tag: str, attrs: dict) -> None:
        self.at.children.append(Node(tag, attrs, self.at))

    def end(self, tag: str, attrs: dict | None = None) -> None:
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        n = self.at
        while n is not None and n.tag != tag:
            if n.tag == "table" and tag in ("td", "th", "tr", "li", "p"):
                return  # a stray end tag doesn't leave the table
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def data(self, data: str) -> None:
        if not self.hidden:
            self.at.children.append(data)


class _Builder(HTMLParser):
    """The standard library's tokenizer, for pages with anything but plain tags and texts."""

    def __init__(self, tree: _Tree):
        super().__init__(convert_charrefs=True)
        self.tree = tree

    def handle_starttag(self, tag, attrs):
        self.tree.start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.tree.empty(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        self.tree.end(tag)

    def handle_data(self, data):
        self.tree.data(data)


_SPLIT = re.compile(r"(<[^<>]*>)")
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9-]*(?:=(?:"[^"<>]*"|'[^'<>]*'))?)*)[ \t\n]*(/?)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)(?:=(?:"([^"]*)"|'([^']*)'))?""")
_TITLE = re.compile(r"<title[^<>]*>[^<]*&", re.I)
#: What stands in these is text, or may be, depending on the tokenizer's version.
_RAW = {"script", "style", "title", "textarea", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}


@lru_cache(maxsize=4096)
def _plain_tag(text: str) -> tuple[str, dict] | None:
    """(what the tag does: "td", "/td" or "td/", attributes) of a tag of the plain form; nobody changes attributes, so tags share them."""
    found = _PLAIN.fullmatch(text)
    if not found or found[1] and (found[3] or found[4]):
        return None
    return found[1] + found[2].lower() + found[4], {m[1].lower(): unescape(m[2] or m[3] or "") for m in _ATTRIBUTE.finditer(found[3])}


def _tree_of(tags: tuple[str, ...], filled: tuple[bool, ...], known: bool = False) -> tuple[Node, list, list] | None:
    """The tree that tags make with texts before, between and after them, where they are ``filled``, the nodes of the tags (none for end tags) and the places of the texts."""
    tree, nodes, places, raw = _Tree(), [], [], None
    for tag, text in zip(("", *tags), filled, strict=True):
        if raw and tag != "/" + raw:
            return None
        raw, at, node = tag if tag in _RAW else None, tree.at, None
        if raw and raw != "title":
            return None
        if tag[:1] == "/":
            if at.tag == tag[1:] and at.parent is not None:
                tree.at = at.parent
            else:
                tree.end(tag[1:])
        elif tag[-1:] == "/":
            tree.empty(tag[:-1], {})
            node = tree.at.children[-1]
        elif tag:
            tree.start(tag, {})
            node = tree.at if tag not in _VOID else tree.at.children[-1]
        if tag:
            nodes.append(node)
        if text:
            children = tree.at.children
            places.append((children, len(children)))
            children.append("")
    if raw:
        return None
    for node in (tree.root, *filter(None, nodes)) if known else ():
        node.known = {}
    return tree.root, nodes, places


#: Pages of a site have the same tags again and again: this many trees of at most so many tags are kept in a process, once they came twice.
_SHAPES, _SHAPE_TAGS = 256, 256
_kept_tree = lru_cache(maxsize=_SHAPES)(lambda tags, filled: _tree_of(tags, filled, True))
_came: set[int] = set()


def _again(shape: tuple) -> bool:
    if len(_came) > 16 * _SHAPES:
        _came.clear()
    known = hash(shape)
    if known in _came:
        return True
    _came.add(known)
    return False


def _plain_page(html: str, shared: bool = False) -> Node | None:
    """The tree of a page all of whose tags are plain, which most are: one split instead of the tokenizer's steps."""
    pieces = _SPLIT.split(html)
    tags, texts = [*map(_plain_tag, pieces[1::2])], pieces[::2]
    # texts with "<" are the tokenizer's, and so are titles with entities, which its versions read differently
    if html.count("<") != len(tags) or None in tags:
        return None
    if "&" in html:
        if _TITLE.search(html):
            return None
        texts = [unescape(t) if "&" in t else t for t in texts]
    shape = tuple([t[0] for t in tags]), tuple(map(bool, texts))
    made = (_kept_tree if shared and len(tags) <= _SHAPE_TAGS and _again(shape) else _tree_of)(*shape)
    if made is None:
        return None
    root, nodes, places = made
    for node, tag in zip(nodes, tags, strict=True):
        if node is not None:
            node.attrs = tag[1]
    for (children, i), text in zip(places, filter(None, texts), strict=True):
        children[i] = text
    return root


def parse(html: str | None, shared: bool = False) -> Node:
    """The page's tree.  A ``shared`` one is the caller's until the next page is parsed: that page may put its texts into the same nodes."""
    root = _plain_page(html or "", shared)
    if root is None:
        tree = _Tree()
        builder = _Builder(tree)
        builder.feed(html)
        builder.close()
        root = tree.root
    return root
