"""The content id: a canonical document without its metadata, written and hashed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache

from quire.model.canon import normalize_run
from quire.model.schema import Catalog, Schema
from quire.model.tree import Document, DocumentError, Node, clone, has_blocks, walk
from quire.model.writer import write


def essence(doc: Document, catalog: Catalog | None = None, media: Callable[[str], bytes] | None = None) -> tuple[str, str]:
    """(stripped text, SHA-256). Class tags stay where they are terms of the block's vocabulary."""
    referred = cache(lambda whole=doc.blocks: {n.text for n in walk(whole) if n.kind == "ref"})
    named: set[str] = set()
    schema = catalog.schema(doc.schema) if catalog else None
    doc = Document(doc.schema, doc.version, strip(doc.blocks, schema, catalog, media, referred, named))
    new: dict[str, str] = {}
    for n in walk(doc.blocks):
        if n.is_block and n.anchor is not None and n.anchor not in named:
            new.setdefault(n.anchor, f"o{len(new) + 1}")
    for n in walk(doc.blocks):
        if n.anchor is not None:
            n.anchor = new.get(n.anchor, n.anchor)
        if n.kind == "ref":
            n.text = new.get(n.text, n.text)
    text = write(doc)
    return text, hashlib.sha256(text.encode()).hexdigest()


def bare(seq: list[Node]) -> list[Node]:
    """Copies without void elements and anchors; wrappers dissolve, and what stays has no annotations."""
    out: list[Node] = []
    for n in seq:
        if n.kind == "text":
            out.append(Node("text", text=n.text))
        elif n.kind == "wrap":
            out.extend(bare(n.body))
        elif n.kind in ("macro", "use"):
            raise DocumentError("Syntax", "the input is not canonical: a macro is left")
        elif n.kind not in ("void", "anchor"):
            out.append(Node(n.kind, n.symbol, n.text, n.scheme, None, [], n.ordinal, clone(n.head), bare(n.body), clone(n.tail), n.flips, n.verbatim, n.is_block, n.start, n.end))
    return out


def _texts(seq: list[Node], out: list[str]) -> bool:
    """Gathers the texts of a run; are they all that stays of it?"""
    for n in seq:
        kind = n.kind
        if kind == "text":
            out.append(n.text)
        elif kind == "wrap":
            if not _texts(n.body, out):
                return False
        elif kind != "void" and kind != "anchor":
            return False
    return True


def plain(seq: list[Node]) -> list[Node]:
    """What stays of a run, with neighbouring texts as one."""
    texts: list[str] = []
    if _texts(seq, texts):
        return normalize_run([Node("text", text="".join(texts))]) if texts else []
    return normalize_run(bare(seq))


def strip(seq: list[Node], schema: Schema | None, catalog: Catalog | None, media, referred: Callable[[], set[str]], named: set[str]) -> list[Node]:
    out: list[Node] = []
    for b in seq:
        if b.kind in ("include", "include_raw", "macro", "use"):
            raise DocumentError("Syntax", "the input is not canonical: an inclusion or macro is left")
        b = Node(b.kind, b.symbol, b.text, b.scheme, b.anchor, [*b.classes], b.ordinal, plain(b.head), b.body, plain(b.tail), b.flips, b.verbatim, b.is_block, b.start, b.end)
        if b.kind == "para":
            b.body = plain(b.body)
            if b.body:
                out.append(b)
            continue
        if b.kind == "media":
            b = Node("media_hash", text=hashlib.sha256(media(b.text)).hexdigest() if media else b.text, is_block=True)
        elif b.kind in ("block", "verse"):
            e = schema.elements.get(b.symbol or "") if schema else None
            if e is not None and e.autonym and b.anchor is not None:
                named.add(b.anchor)
            if b.anchor is not None and b.anchor not in named and b.anchor not in referred():
                b.anchor = None
            terms = schema.vocabularies.get(e.class_vocabulary or "", {}) if e is not None else {}
            b.classes = [c for c in b.classes if c in terms]
        else:
            b.anchor, b.classes = None, []
        if b.kind == "verse":
            b.body = [s for s in ([x for x in (bare(line) for line in stanza) if x] for stanza in b.body) if s]
        elif has_blocks(b):
            inner = schema
            if b.kind == "embed" and catalog is not None:
                try:
                    inner = catalog.schema(b.text)
                except DocumentError:
                    inner = None
            b.body = strip(b.body, inner, catalog, media, referred, named)
        if b.kind == "wrap":
            out.extend(b.body)
        else:
            out.append(b)
    return out
