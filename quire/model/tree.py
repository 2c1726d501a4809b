"""One node type for blocks and inlines, its walks and its interval encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


class DocumentError(Exception):
    """A typed error with its place; it rejects one document, never the job."""

    def __init__(self, kind: str, message: str = "", line: int = 0, col: int = 0):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind, self.message, self.line, self.col = kind, message, line, col


AUTO = -1


@dataclass(slots=True)
class Node:
    """kind: text span raw wrap void anchor point ref macro use, and of blocks para block verse raw wrap embed
    media media_hash include include_raw macro use. ``body`` holds child nodes; a verse's are stanzas of lines.
    """

    kind: str
    symbol: str | None = None
    text: str = ""
    scheme: str = ""
    anchor: str | None = None
    classes: list[str] = field(default_factory=list)
    ordinal: int | None = None
    head: list[Node] = field(default_factory=list)
    body: list = field(default_factory=list)
    tail: list[Node] = field(default_factory=list)
    flips: bool = True
    verbatim: bool = False
    is_block: bool = False
    start: int = 0
    end: int = 0

    @property
    def annotated(self) -> bool:
        return self.anchor is not None or bool(self.classes)

    def closing(self) -> str:
        return closing_symbol(self.symbol or "", self.flips)


def clone(seq: list) -> list:
    """A copy of a sequence of nodes, or of stanzas of lines of them, down to the leaves."""
    out = []
    for n in seq:
        if isinstance(n, list):
            out.append(clone(n))
            continue
        made = Node(n.kind, n.symbol, n.text, n.scheme, n.anchor, [*n.classes], n.ordinal, [], [], [], n.flips, n.verbatim, n.is_block, n.start, n.end)
        if n.head:
            made.head = clone(n.head)
        if n.body:
            made.body = clone(n.body)
        if n.tail:
            made.tail = clone(n.tail)
        out.append(made)
    return out


@dataclass(slots=True)
class Document:
    schema: str
    version: str | None = None
    blocks: list[Node] = field(default_factory=list)


_TURN = str.maketrans("()[]{}<>", ")(][}{><")


def closing_symbol(symbol: str, flips: bool = True) -> str:
    """The symbol reversed, with its brackets turned round unless the schema says otherwise; ``{name}`` as it is."""
    if symbol.startswith("{") and symbol.endswith("}"):
        return symbol
    return symbol[::-1].translate(_TURN) if flips else symbol[::-1]


def runs(node: Node) -> Iterator[list[Node]]:
    """The inline sequences that a block holds itself, in reading order, or an inline's content."""
    if not node.is_block:
        yield node.body
        return
    yield node.head
    if node.kind == "para":
        yield node.body
    elif node.kind == "verse":
        for stanza in node.body:
            yield from stanza
    yield node.tail


def has_blocks(node: Node) -> bool:
    return node.is_block and node.kind in ("block", "wrap", "embed", "macro")


def walk(blocks: list[Node]) -> Iterator[Node]:
    """All nodes in document order: a block, its head, its children, its tail."""
    left = blocks[::-1]
    while left:
        n = left.pop()
        yield n
        if not n.is_block:
            if n.body:
                left += n.body[::-1]
            continue
        left += n.tail[::-1]
        if n.kind == "verse":
            for stanza in reversed(n.body):
                for line in reversed(stanza):
                    left += line[::-1]
        elif n.kind == "para" or has_blocks(n):
            left += n.body[::-1]
        left += n.head[::-1]


def rebuild(blocks: list[Node], edit_blocks: Callable | None = None, edit_run: Callable | None = None) -> list[Node]:
    """Applies edits bottom-up: ``edit_run`` to each inline sequence, ``edit_blocks`` to each block sequence."""

    def run(seq: list[Node]) -> list[Node]:
        for n in seq:
            if n.body:
                n.body = run(n.body)
        return edit_run(seq) if edit_run else seq

    for b in blocks:
        b.head, b.tail = run(b.head), run(b.tail)
        if b.kind == "para":
            b.body = run(b.body)
        elif b.kind == "verse":
            b.body = [[run(line) for line in stanza] for stanza in b.body]
        elif has_blocks(b):
            b.body = rebuild(b.body, edit_blocks, edit_run)
    return edit_blocks(blocks) if edit_blocks else blocks


def plain_text(seq: list[Node]) -> str:
    return "".join(n.text if n.kind == "text" else plain_text(n.body) if n.kind in ("span", "wrap") else "" for n in seq)


#: Columns of the interval-encoded node table.
NODE_SCHEMA = (
    "doc_id long, pre long, post long, parent_pre long, depth int, ord int, sort string, slot string, kind string, symbol string, "
    "text string, scheme string, onym string, genoses array<string>, taxis decimal(20,0), taxis_auto boolean, bracket_matching boolean, "
    "verbatim boolean, strophe int, line int, src_start int, src_end int"
)


def encode(doc_id: int, doc: Document) -> Iterator[tuple]:
    """Rows of NODE_SCHEMA. ``pre`` and ``post`` number opening and closing events of one tag stream."""
    from decimal import Decimal

    tick = 0
    out: list[list] = []

    def put(n: Node, parent: int, depth: int, place: int, slot: str, stanza=None, line=None) -> None:
        nonlocal tick
        tick += 1
        pre = tick
        known = None if n.ordinal is None or n.ordinal == AUTO else Decimal(n.ordinal)
        row = [doc_id, pre, 0, parent, depth, place, "block" if n.is_block else "inline", slot, n.kind, n.symbol, n.text, n.scheme or None, n.anchor, list(n.classes), known, None if n.ordinal is None else n.ordinal == AUTO, n.flips, n.verbatim, stanza, line, n.start or None, n.end or None]
        out.append(row)
        groups = [("head", n.head)]
        if n.kind == "verse":
            groups += [(("line", s, k), row_) for s, st in enumerate(n.body) for k, row_ in enumerate(st)]
        else:
            groups.append(("body" if n.is_block else "content", n.body))
        groups.append(("tail", n.tail))
        for where, seq in groups:
            name, s, k = where if isinstance(where, tuple) else (where, None, None)
            for i, child in enumerate(seq):
                put(child, pre, depth + 1, i, name, s, k)
        tick += 1
        row[2] = tick

    for i, b in enumerate(doc.blocks):
        put(b, 0, 0, i, "body")
    return (tuple(r) for r in out)
