"""XML files as small trees, and what the readers of XML formats share: runs of inline content, notes, builders."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint
from xml.parsers import expat

from quire.model.names import valid_anchor
from quire.model.tree import DocumentError, Node

#: Elements nested deeper than this reject the file.
NESTING = 64
#: White space of prose, which layout may vary.
_SPACE = re.compile(r"\s+")
_NAMED = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_OWN = ("amp", "lt", "gt", "quot", "apos")


class X:
    """An element: its tag without prefix, its attributes as written, and its children (texts and elements)."""

    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def get(self, *names: str) -> str | None:
        """The first of these attributes that is there, with or without a prefix."""
        for n in names:
            if n in self.attrs:
                return self.attrs[n]
            for k, v in self.attrs.items():
                if ":" in k and k.rpartition(":")[2] == n:
                    if v:
                        return v
                    break
        return None

    def all(self, *tags: str):
        """All elements below of these tags (of any, without tags), in document order."""
        left = self.kids[::-1]
        pop = left.pop
        while left:
            e = pop()
            if isinstance(e, str):
                continue
            if e.kids:
                left += e.kids[::-1]
            if not tags or e.tag in tags:
                yield e

    def own(self, *tags: str) -> list[X]:
        return [k for k in self.kids if isinstance(k, X) and (not tags or k.tag in tags)]

    def first(self, *tags: str) -> X | None:
        return next(self.all(*tags), None)

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def flat(self) -> str:
        return collapse(self.text()).strip()


def collapse(text: str) -> str:
    return text if text.isalnum() else _SPACE.sub(" ", text)


def read_tree(text: str, what: str) -> X:
    """The root element. Entities with HTML names stand for their characters, and prefixes need no declaration."""
    known = lambda m: m[0] if m[1] in _OWN or m[1] not in name2codepoint else f"&#{name2codepoint[m[1]]};"
    top = X("", {})
    open_ = [top]

    def start(name, attrs):
        if len(open_) > NESTING:
            raise DocumentError("Syntax", f"{what} import: nesting exceeds {NESTING} levels")
        made = X(name.rpartition(":")[2] if ":" in name else name, attrs)
        open_[-1].kids.append(made)
        open_.append(made)

    def data(text):
        kids = open_[-1].kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += text
        else:
            kids.append(text)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler = start, data
    parser.EndElementHandler = lambda _: open_.pop()
    try:
        parser.Parse(_NAMED.sub(known, text.removeprefix("﻿").lstrip()).encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        raise DocumentError("Syntax", f"{what} import: {expat.errors.messages.get(e.code, e)}", e.lineno, e.offset + 1) from None
    return top.own()[0]


# Builders.


def text(value: str) -> Node:
    return Node("text", text=value)


def span(symbol: str, body: list[Node], *classes: str, anchor: str | None = None) -> Node:
    return Node("span", symbol, body=body, classes=list(classes), anchor=anchor)


def para(run: list[Node]) -> Node:
    return Node("para", body=run, is_block=True)


def alone(symbol: str, run: list[Node], *classes: str) -> Node:
    """An element that stands alone in a paragraph."""
    return para([span(symbol, run, *classes)])


def block(symbol: str, body: list[Node], head: list[Node] = (), **more) -> Node:
    return Node("block", symbol, body=body, head=list(head), is_block=True, **more)


def verse(symbol: str, stanzas: list[list[list[Node]]], head: list[Node] = (), **more) -> Node:
    return Node("verse", symbol, body=stanzas, head=list(head), is_block=True, **more)


def void(symbol: str, value: str) -> Node:
    return Node("void", symbol, text=value)


def raw(value: str, as_block: bool = False, *classes: str) -> Node:
    if as_block:
        value = value.strip("\n") + "\n"
    return Node("raw", text=value, classes=list(classes), is_block=as_block)


def media(name: str) -> Node:
    return Node("media", text=name, is_block=True)


def embedded(schema: str, body: list[Node]) -> Node:
    return Node("embed", text=schema, body=body, is_block=True)


def field(name: str, value: str, when: str | None = None) -> Node:
    """A named field; a normalized date is a mark before the printed one."""
    marks = [void("?-", when)] if when else []
    return block(":", [para([*marks, text(value)])], [text(name)])


def trimmed(run: list[Node]) -> list[Node]:
    """Without blanks at the edges, and with neighbouring texts as one."""
    out: list[Node] = []
    for n in run:
        if n.kind == "text" and out and out[-1].kind == "text":
            out[-1] = text(collapse(out[-1].text + n.text))
        else:
            out.append(n)
    if out and out[0].kind == "text":
        out[0] = text(out[0].text.lstrip())
    if out and out[-1].kind == "text":
        out[-1] = text(out[-1].text.rstrip())
    return [n for n in out if n.kind != "text" or n.text]


def link(url: str, shown: list[Node]) -> list[Node]:
    """A link shows its address; text that says something else stands before it."""
    made = span("><", [text(url)])
    if not url:
        return shown
    if not shown or (len(shown) == 1 and shown[0].kind == "text" and shown[0].text.strip() == url):
        return [made]
    return [*shown, text(" ("), made, text(")")]


class Reader:
    """Handlers by tag: ``blocks_of`` for block content, ``inlines_of`` for runs; each gets the element.

    Bodies of notes that a run calls for stand after the block that holds the run.
    """

    what = "xml"

    def __init__(self):
        self.notes, self.late = 0, []
        self.blocks_of: dict[str, Callable[[X], list[Node]]] = {}
        self.inlines_of: dict[str, Callable[[X], list[Node]]] = {}

    def fail(self, message: str):
        raise DocumentError("Syntax", f"{self.what} import: {message}")

    def settled(self, *made: Node) -> list[Node]:
        """Blocks with the notes that their runs called for."""
        out, self.late = [*made, *self.late], []
        return out

    def block(self, e: X) -> list[Node]:
        handler = self.blocks_of.get(e.tag)
        return handler(e) if handler else self.other_block(e)

    def other_block(self, e: X) -> list[Node]:
        self.fail(f"unsupported <{e.tag}> at block level")

    def blocks(self, e: X, *skip: str) -> list[Node]:
        out: list[Node] = []
        for k in e.kids:
            if isinstance(k, X):
                out += [] if k.tag in skip else self.block(k)
            elif k.strip():
                self.fail(f"bare text at block level: `{k.strip()[:40]}`")
        return out

    def inline(self, e: X) -> list[Node]:
        handler = self.inlines_of.get(e.tag)
        return handler(e) if handler else self.other_inline(e)

    def other_inline(self, e: X) -> list[Node]:
        self.fail(f"unsupported <{e.tag}> inline")

    def pieces(self, kids: list) -> list[Node]:
        out: list[Node] = []
        for k in kids:
            out += self.inline(k) if isinstance(k, X) else [text(collapse(k))]
        return out

    def run(self, e: X) -> list[Node]:
        return trimmed(self.pieces(e.kids))

    def paragraph(self, e: X) -> list[Node]:
        return self.settled(para(self.run(e)))

    def spanned(self, symbol: str, *classes: str) -> Callable[[X], list[Node]]:
        return lambda e: [span(symbol, self.run(e), *classes)]

    def through(self, e: X) -> list[Node]:
        return self.pieces(e.kids)

    def note(self, e: X, body: Callable[[X], list[Node]] | None = None) -> list[Node]:
        """The call of a note; its body waits for the end of the block. A note without content is none."""
        before, self.late, number = self.late, [], self.notes
        self.notes += 1
        name = f"n{self.notes}"
        inner = (body or self.blocks)(e)
        if all(b.kind == "para" and not b.body for b in inner):
            self.late, self.notes = before, number
            return []
        self.late = [*before, block("^", inner, anchor=name)]
        return [Node("ref", "^", text=name)]


def anchor_of(e: X) -> str | None:
    name = e.get("xml:id", "id")
    return name if name and valid_anchor(name) else None
