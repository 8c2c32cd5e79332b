"""Captured HTML read as browsers read it: tokens, and the tree of elements with the end tags that HTML implies.

Both take time in proportion to the page, whatever is left open in it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.entities import html5

#: What a tag begins with, up to its attributes or, group 3, its end.
_TAG = re.compile(r"<(/?)([A-Za-z][^ \t\n\f\r/>]*+)(>?)")
#: One attribute after any white space, or the end of the tag; group 6 is a quote that nothing closes.
_ATTRIBUTE = re.compile(r"""[ \t\n\f\r/]*+(?:(>)|([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+|(?=>))|(["'])))?+)""")
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*+;?)(=?)")
#: Elements whose content is text up to their end tag; in the first group references count.
_TEXT_ONLY = {"title": True, "textarea": True, "script": False, "style": False, "xmp": False, "iframe": False, "noembed": False, "noframes": False}
_TEXT_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.IGNORECASE) for tag in _TEXT_ONLY}


def _in_attribute(m: re.Match) -> str:
    """A reference in an attribute; a name without semicolon counts only where it is whole and no = follows."""
    name = m[1]
    if name[0] == "#" or name[-1] == ";":
        return unescape(f"&{name}") + m[2]
    return m[0] if m[2] or name not in html5 else html5[name]


def attribute_text(value: str) -> str:
    return _REFERENCE.sub(_in_attribute, value) if "&" in value else value


def tokens(html: str | None) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """("start", tag, attributes), ("end", tag, []) and ("text", text, []) in page order, references decoded.

    Comments, declarations and marked sections go. A tag or comment that the page's end cuts off takes
    what is left of the page, as in browsers.
    """
    html, at, none = html or "", 0, []
    while True:
        lt = html.find("<", at)
        if lt < 0:
            if at < len(html):
                yield "text", unescape(html[at:]), none
            return
        if lt > at:
            text = html[at:lt]
            yield "text", unescape(text) if "&" in text else text, none
        if begun := _TAG.match(html, lt):
            closing, tag, ended = begun.groups()
            tag, at, attributes = tag.lower(), begun.end(), []
            if not ended:
                while found := _ATTRIBUTE.match(html, at):
                    at = found.end()
                    ended, name, double, single, bare, unclosed = found.groups()
                    if ended:
                        break
                    if unclosed:
                        return
                    attributes.append((name.lower(), attribute_text(double or single or bare or "")))
                else:
                    return
            if closing:
                yield "end", tag, none
                continue
            yield "start", tag, attributes
            if tag in _TEXT_ONLY:
                end = _TEXT_END[tag].search(html, at)
                text = html[at : end.start()] if end else html[at:]
                if text:
                    yield "text", unescape(text) if _TEXT_ONLY[tag] else text, none
                at = end.start() if end else len(html)
            elif tag == "plaintext":
                yield "text", html[at:], none
                return
            continue
        following = html[lt + 1 : lt + 2]
        closing = following == "/"
        begin = lt + 1 + closing
        if html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                at = html.index(">", lt) + 1
                continue
            end = _COMMENT_END.search(html, lt + 4)
            if not end:
                return
            at = end.end()
        elif following in ("!", "?") or closing and begin < len(html):
            end = html.find(">", lt)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "<" if not closing else "</", none
            at = begin


# -- the tree ----------------------------------------------------------------------------------

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_SPECIAL = CLOSES_P | _SCOPE | VOID | frozenset("body button colgroup frame frameset head iframe noembed noframes noscript script select style tbody textarea tfoot thead title tr xmp".split())
_ROWS, _GROUPS = frozenset(["tr"]), frozenset("tbody thead tfoot".split())
_TABLE_PARTS = _GROUPS | _ROWS | {"table"}
_IN_TABLE = _GROUPS | {"caption", "colgroup", "col", "tr", "td", "th"}
_STAY_IN_TABLE = frozenset("script style template form".split())
#: Elements whose start may end others or needs others around it; any other only stands where it is.
_ACTING = _IN_TABLE | CLOSES_P | frozenset("a button option optgroup".split())

#: Names under which the open elements of a kind are kept beside their own: what a search for an open element stops at.
_KINDS: dict[str, tuple[str, ...]] = {}


def _kinds(tag: str) -> tuple[str, ...]:
    if tag not in _KINDS:
        kinds = [tag]
        kinds += ["#scope"] if tag in _SCOPE else []
        kinds += ["#button"] if tag in _SCOPE or tag == "button" else []
        kinds += ["#list"] if tag in _SCOPE or tag in ("ol", "ul") else []
        kinds += ["#item"] if tag in _SPECIAL and tag not in ("address", "div", "p") else []
        kinds += ["#special"] if tag in _SPECIAL else []
        kinds += ["#heading"] if tag in _HEADINGS else []
        if len(_KINDS) > 10_000:  # pages may make names up
            _KINDS.clear()
        _KINDS[tag] = tuple(kinds)
    return _KINDS[tag]


class Node:
    """An element; children are elements and texts, `before` what was found inside a table but stands before it."""

    __slots__ = ("attributes", "before", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.before = tag, attributes, [], ()


class _Builder:
    def __init__(self):
        self.root = Node("", {})
        self.stack = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.paragraphs = self.places["p"]

    def last(self, kind: str) -> int:
        """Place of the innermost open element of the kind, -1 without one."""
        held = self.places.get(kind)
        return held[-1] if held else -1

    def pop(self) -> None:
        tag, places = self.stack.pop().tag, self.places
        for kind in _KINDS.get(tag) or _kinds(tag):
            places[kind].pop()

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def add(self, child: Node | str, foster: bool = False) -> None:
        table = self.last("table") if foster else 0
        if table <= 0:
            self.stack[-1].children.append(child)
        elif self.stack[table].before:
            self.stack[table].before.append(child)
        else:
            self.stack[table].before = [child]

    def push(self, tag: str, attributes: dict[str, str], foster: bool = False) -> None:
        node, stack = Node(tag, attributes), self.stack
        if foster:
            self.add(node, foster)
        else:
            stack[-1].children.append(node)
        if tag not in VOID:
            places, own = self.places, len(stack)
            for kind in _KINDS.get(tag) or _kinds(tag):
                places[kind].append(own)
            stack.append(node)

    def in_table(self, tag: str) -> bool:
        """Makes room for a part of a table, with the group and row that it lacks; false where no table is open."""
        table = self.last("table")
        if table < 0:
            return False
        stop = {"table"} if tag in _GROUPS or tag in ("caption", "colgroup", "col") else _GROUPS | {"table"} if tag == "tr" else _TABLE_PARTS
        if tag == "col":
            stop = {"table", "colgroup"}
        while self.stack[-1].tag not in stop:
            self.pop()
        if tag in ("tr", "td", "th") and self.stack[-1].tag == "table":
            self.push("tbody", {})
        if tag in ("td", "th") and self.stack[-1].tag != "tr":
            self.push("tr", {})
        return True

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in _IN_TABLE:
            if self.in_table(tag):
                self.push(tag, attributes)
            return
        if tag in _ACTING:
            self.make_room(tag)
        foster = self.stack[-1].tag in _TABLE_PARTS and tag not in _STAY_IN_TABLE
        self.push(tag, attributes, foster and not (tag == "input" and attributes.get("type", "").lower() == "hidden"))

    def make_room(self, tag: str) -> None:
        """Ends the open elements that the start of this one ends."""
        if self.paragraphs and tag in CLOSES_P and self.paragraphs[-1] > self.last("#button"):
            self.pop_to(self.paragraphs[-1])
        if tag == "li" and self.last("li") >= max(0, self.last("#item")):
            self.pop_to(self.last("li"))
        elif tag in ("dd", "dt") and (place := max(self.last("dd"), self.last("dt"))) >= max(0, self.last("#item")):
            self.pop_to(place)
        elif tag == "a" and self.last("a") > self.last("#special"):
            self.pop_to(self.last("a"))
        elif tag == "button" and self.last("button") > self.last("#scope"):
            self.pop_to(self.last("button"))
        top = self.stack[-1].tag
        if tag in _HEADINGS and top in _HEADINGS or tag in ("option", "optgroup") and top == "option":
            self.pop()
        if tag == "optgroup" and self.stack[-1].tag == "optgroup":
            self.pop()
        if tag == "table" and self.stack[-1].tag in _TABLE_PARTS:
            self.pop_to(self.last("table"))

    def end(self, tag: str) -> None:
        if self.stack[-1].tag == tag:
            self.pop()
            return
        if tag == "br":
            self.start("br", {})
            return
        place = self.last(tag)
        if tag in _IN_TABLE:
            stop = self.last("table")
        elif tag == "table":
            stop = -1
        elif tag == "li":
            stop = self.last("#list")
        elif tag == "p":
            stop = self.last("#button")
        elif tag in _HEADINGS:
            place, stop = self.last("#heading"), self.last("#scope")
        elif tag in _SPECIAL:
            stop = self.last("#scope") if tag not in _SCOPE else place - 1
        else:
            stop = self.last("#special")
        if place > max(0, stop):
            self.pop_to(place)

    def text(self, text: str) -> None:
        innermost = self.stack[-1]
        if innermost.tag in _TABLE_PARTS:
            self.add(text, not text.isspace())
        else:
            innermost.children.append(text)


def tree(html: str | None) -> Node:
    """The page's elements below a nameless root. html, head and body are elements only where they are written."""
    builder = _Builder()
    for kind, name, attributes in tokens(html):
        if kind == "text":
            builder.text(name)
        elif kind == "start":
            builder.start(name, dict(reversed(attributes)) if attributes else {})  # the first of repeated attributes counts
        else:
            builder.end(name)
    return builder.root
