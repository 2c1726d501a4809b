"""Collation: the variants of parallel versions as notes in the base text, each referred to after its words."""

from __future__ import annotations

import re

from quire.functions.alignment import apparatus, merged_order, word_hunks
from quire.model.slicing import slices, words
from quire.model.tree import Document, DocumentError, Node, clone, has_blocks

NOTE = "^!"


def collate(witnesses: list[tuple[str, Document]], scheme: str, base: str) -> Document:
    """The base with a note per place where others differ; texts are compared slice by slice."""
    names = [n for n, _ in witnesses]
    if len(names) < 2:
        raise DocumentError("Syntax", "at least two witnesses are required")
    for n in names:
        if not n or any(c.isspace() for c in n):
            raise DocumentError("Syntax", f"witness siglum `{n}` is not a valid siglum")
    if len(set(names)) < len(names):
        raise DocumentError("Syntax", "duplicate witness siglum")
    schema = witnesses[0][1].schema
    if any(d.schema != schema for _, d in witnesses):
        raise DocumentError("Syntax", f"expected `{schema}` throughout (one dialektos per collation)")
    if base not in names:
        raise DocumentError("Syntax", f"base `{base}` is not among the witness ids")
    texts: dict[str, dict[str, list[str]]] = {}
    for n, d in witnesses:
        mine: dict[str, list[str]] = {}
        for s in slices(clone(d.blocks), scheme):
            if s.point is not None:
                if s.point.text in mine:
                    raise DocumentError("Syntax", f"witness `{n}`: `{s.point.text}` stands twice")
                mine[s.point.text] = words(s.nodes)
        texts[n] = mine
    try:
        merged_order([list(t) for t in texts.values()])
    except ValueError as e:
        raise DocumentError("Syntax", str(e)) from None
    notes = {}
    for coord, own in texts[base].items():
        hunks = [(n, *h) for n in names if n != base and coord in texts[n] for h in word_hunks(own, texts[n][coord])]
        notes[coord] = apparatus(coord, base, own, hunks)
    doc = next(d for n, d in witnesses if n == base)
    doc = Document(doc.schema, doc.version, clone(doc.blocks))
    doc.blocks = _Placer(scheme, notes).sequence(doc.blocks)
    return doc


class _Placer:
    """Counts words from each coordinate on; a note follows the block in which its reference was put."""

    def __init__(self, scheme: str, notes: dict[str, list[tuple[int, str, str]]]):
        self.scheme, self.notes = scheme, {c: list(reversed(n)) for c, n in notes.items()}
        self.coord: str | None = None
        self.count = 0
        self.early: tuple[str, int] | None = None
        self.ready: list[Node] = []

    def sequence(self, seq: list[Node]) -> list[Node]:
        out: list[Node] = []
        for b in seq:
            self.block(b)
            out += [b, *self.ready]
            self.ready = []
        return out

    def block(self, b: Node) -> None:
        opens = self.opening(b) if b.kind in ("block", "verse") and b.head else None
        b.head = self.run(b.head)
        if opens is not None:
            self.early = (opens, self.count)
        if b.kind == "para":
            b.body = self.run(b.body)
        elif b.kind == "verse":
            b.body = [[self.run(line) for line in s] for s in b.body]
        elif has_blocks(b) and b.kind != "embed":
            b.body = self.sequence(b.body)
        b.tail = self.run(b.tail)

    def opening(self, b: Node) -> str | None:
        """A head before the first coordinate of its block belongs to that coordinate's slice."""
        first = next((s for s in slices(clone([b]), self.scheme) if s.nodes), None)
        if first is None or first.point is None:
            return None
        if self.early is None or self.early[0] != first.point.text:
            self.coord, self.count = first.point.text, 0
        return first.point.text

    def run(self, seq: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in seq:
            if n.kind == "text" and self.coord is not None:
                out += self.text(n.text)
                continue
            if n.kind == "point" and n.scheme == self.scheme:
                known = self.early is not None and self.early[0] == n.text
                self.coord, self.count = n.text, self.early[1] if known else 0
                self.early = None if known else self.early
            elif n.kind in ("span", "wrap"):
                n.body = self.run(n.body)
            out.append(n)
        return out

    def text(self, text: str) -> list[Node]:
        out: list[Node] = []
        waiting, last = self.notes.get(self.coord, []), 0
        for m in re.finditer(r"\S+", text):
            self.count += 1
            while waiting and waiting[-1][0] == self.count:
                _, name, told = waiting.pop()
                if last < m.end():
                    out.append(Node("text", text=text[last : m.end()]))
                    last = m.end()
                out.append(Node("ref", NOTE, text=name))
                body = Node("para", body=[Node("text", text=told)], is_block=True)
                self.ready.append(Node("block", NOTE, body=[body], anchor=name, is_block=True))
        return out + ([Node("text", text=text[last:])] if last < len(text) or not out else [])
