"""Source to canonical form: a chain of passes over one tree, each a small edit of sequences."""

from __future__ import annotations

import hashlib
import posixpath
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.model.markup import parse
from quire.model.names import alphanumeric, valid_anchor
from quire.model.schema import Catalog, Schema
from quire.model.tables import expand_tables
from quire.model.tree import AUTO, Document, DocumentError, Node, clone, has_blocks, plain_text, rebuild, walk
from quire.model.writer import block, blocks as write_blocks, check_writable, inlines, write

#: Most bytes that macros may expand to in one document.
EXPANSION = 64 << 20
LAYOUT = re.compile(r"[ \t\n\r]+")


@dataclass
class Canonical:
    document: Document
    text: str
    media: list[tuple[str, str, str]] = field(default_factory=list)


def canonicalize(text: str, catalog: Catalog, path: str = "document", media: Callable[[str], bytes] | None = None) -> Canonical:
    """The canonical document. ``media`` reads a resource by name; without it names are kept as they are."""
    return canonicalize_tree(load(text, catalog, path, ()), catalog, media)


def composed(doc: Document) -> Document:
    """A tree that a reader made, as a source would give it: its texts in Unicode's composed form."""
    compose(doc.blocks)
    return doc


def compose(blocks: list[Node]) -> None:
    for n in walk(blocks):
        if not n.text.isascii():
            n.text = unicodedata.normalize("NFC", n.text)


def canonicalize_tree(doc: Document, catalog: Catalog, media: Callable[[str], bytes] | None = None) -> Canonical:
    """As ``canonicalize``, of a tree without inclusions; the tree itself is changed.

    Passes over all nodes run only on trees that hold what they are about.
    """
    has = contents(doc.blocks)
    if "macro" in has.kinds or "use" in has.kinds:
        doc.blocks = expand_macros(doc.blocks)
        has = contents(doc.blocks)
    kinds = has.kinds
    if "point" in kinds:
        check_points(doc.blocks)
    schema = catalog.schema(doc.schema)
    expand_tables(doc.blocks, schema)
    named = assign_anchors(doc.blocks, schema, catalog)
    if "ref" in kinds:
        check_references(doc.blocks)
    rename_anchors(doc.blocks, named, has)
    number_blocks(doc.blocks, schema, catalog)
    use_terms(doc.blocks, schema, catalog, has.classed)
    if "wrap" in kinds:
        doc.blocks = unwrap(doc.blocks)
    doc.blocks = normalize(doc.blocks)
    bundled = bundle_media(doc.blocks, media) if media else []
    text = write(doc)
    if "\\" in text:  # a backslash is written as it is
        check_writable(doc)
    return Canonical(doc, text, bundled)


@dataclass
class Contents:
    """The kinds of nodes, those with anchors and those that may refer to one, and whether any has classes."""

    kinds: set[str] = field(default_factory=set)
    anchored: list[Node] = field(default_factory=list)
    referring: list[Node] = field(default_factory=list)
    classed: bool = False


def contents(blocks: list[Node]) -> Contents:
    has = Contents()
    see, anchored, referring = has.kinds.add, has.anchored.append, has.referring.append
    for n in walk(blocks):
        see(n.kind)
        if n.kind == "void" or n.kind == "ref":
            referring(n)
        if n.anchor is not None:
            anchored(n)
        if n.classes:
            has.classed = True
    return has


def order_only(doc: Document, catalog: Catalog) -> Document:
    """The ordering passes alone: tables, self-made anchors, ordinals and terms. Anchors stay as written, references
    are not checked, and inclusions and macros stay as they are.
    """
    schema = catalog.schema(doc.schema)
    expand_tables(doc.blocks, schema)
    assign_anchors(doc.blocks, schema, catalog)
    number_blocks(doc.blocks, schema, catalog)
    use_terms(doc.blocks, schema, catalog)
    return doc


# 1: inclusion.


def load(text: str, catalog: Catalog, path: str, chain: tuple[str, ...]) -> Document:
    if path in chain:
        raise DocumentError("TransclusionCycle", " > ".join((*chain, path)))
    doc = parse(unicodedata.normalize("NFC", text), catalog)

    def include(seq: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in seq:
            if n.kind not in ("include", "include_raw"):
                out.append(n)
                continue
            target = contained(path, n.text)
            found = catalog.texts.get(target)
            if found is None:
                raise DocumentError("MissingResource", target)
            if n.kind == "include_raw":
                found = unicodedata.normalize("NFC", found)
                out.append(Node("raw", text=found if found.endswith("\n") or not found else found + "\n", is_block=True))
                continue
            inner = load(found, catalog, target, (*chain, path))
            same = inner.schema == doc.schema
            out.extend(inner.blocks if same else [Node("embed", text=inner.schema, body=inner.blocks, is_block=True)])
        return out

    doc.blocks = rebuild(doc.blocks, include)
    return doc


def contained(base: str, target: str) -> str:
    """A relative path beside ``base`` that stays below the catalog's root."""
    out = posixpath.normpath(posixpath.join(posixpath.dirname(base), target))
    if target.startswith("/") or out.startswith(".."):
        raise DocumentError("MissingResource", f"`{target}` leaves the document's folder")
    return out


# 2: macros and copies.


def _weight(nodes: list[Node]) -> int:
    return sum(64 + len(n.text) + _weight(n.head) + _weight(n.tail) + (sum(_weight(line) for s in n.body for line in s) if n.kind == "verse" else _weight(n.body)) for n in nodes)


def expand_macros(blocks: list[Node]) -> list[Node]:
    """Definitions vanish; a use takes the definition before it, a verbatim use the text of any anchored element."""
    anchored = {}
    for n in walk(blocks):
        if n.anchor is not None and n.kind != "macro":
            anchored.setdefault(n.anchor, n)
    known: dict[str, Node] = {}
    spent = 0

    def charge(nodes: list[Node], name: str) -> None:
        nonlocal spent
        spent += _weight(nodes)
        if spent > EXPANSION:
            raise DocumentError("Syntax", f"macros expand to over {EXPANSION} bytes at `{name}`")

    def used(n: Node, as_block: bool) -> list[Node]:
        found = known.get(n.text)
        if not n.verbatim:
            if found is None or found.is_block != as_block:
                raise DocumentError("AxiomaBeforeDefinition", n.text)
            charge(found.body, n.text)
            return clone(found.body)
        made = Node("raw", is_block=as_block)
        if found is not None:
            made.text = write_blocks(found.body) if found.is_block else inlines(found.body)
        elif (target := anchored.get(n.text)) is None:
            raise DocumentError("AxiomaBeforeDefinition", n.text)
        elif target.kind == "anchor":
            raise DocumentError("EnlexisStandaloneOnym", n.text)
        else:
            made.text = block(target) if target.is_block else inlines([target])
            if target.is_block and not as_block:
                raise DocumentError("EnlexisParaInEndoContext", n.text)
        charge([made], n.text)
        return [made]

    def run(seq: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in seq:
            if n.kind == "use":
                out.extend(used(n, False))
                continue
            n.body = run(n.body)
            if n.kind == "macro":
                known[n.anchor] = n
            else:
                out.append(n)
        return out

    def go(seq: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in seq:
            if n.kind == "use":
                out.extend(used(n, True))
                continue
            n.head = run(n.head)
            if n.kind == "para":
                n.body = run(n.body)
            elif n.kind == "verse":
                n.body = [[run(line) for line in s] for s in n.body]
            elif has_blocks(n):
                n.body = go(n.body)
            n.tail = run(n.tail)
            if n.kind == "macro":
                known[n.anchor] = n
            else:
                out.append(n)
        return out

    return go(blocks)


# 3, 6-9: coordinates, anchors, references, ordinals.


def check_points(blocks: list[Node]) -> None:
    seen = Counter((n.scheme, n.text) for n in walk(blocks) if n.kind == "point")
    if twice := next((k for k, c in seen.items() if c > 1), None):
        raise DocumentError("Syntax", f"duplicate coordinate `{twice[0]}:{twice[1]}`")


def _scoped(blocks: list[Node], schema: Schema, catalog: Catalog):
    """(sequence, schema) of every block sequence; an embedded part answers to its own schema."""
    yield blocks, schema
    for b in blocks:
        if has_blocks(b):
            inner = schema
            if b.kind == "embed" and b.text != schema.id:
                try:
                    inner = catalog.schema(b.text)
                except DocumentError:
                    inner = schema
            yield from _scoped(b.body, inner, catalog)


def anchor_from(head: list[Node], ordinal: int | None) -> str | None:
    text = "".join(c if alphanumeric(c) else " " for c in plain_text(head))
    out = "-".join([*text.split(), *([str(ordinal)] if ordinal not in (None, AUTO) else [])])
    return out if valid_anchor(out) else None


def assign_anchors(blocks: list[Node], schema: Schema, catalog: Catalog) -> set[str]:
    """Blocks that anchor themselves take their head's words; homographs are told apart by ordinals 1..n."""
    groups: dict[str, list[Node]] = {}
    found: list[Node] = []

    def go(seq: list[Node], schema: Schema) -> None:
        for b in seq:
            e = schema.elements.get(b.symbol or "")
            if b.kind == "block" and e is not None and e.autonym:
                base = anchor_from(b.head, None)
                if base is not None:
                    same = groups.setdefault(base, [])
                    if b.ordinal == AUTO:
                        b.ordinal = sum(x.ordinal is not None for x in same) + 1
                    same.append(b)
                found.append(b)
            if has_blocks(b):
                inner = schema
                if b.kind == "embed" and b.text != schema.id:
                    try:
                        inner = catalog.schema(b.text)
                    except DocumentError:
                        inner = schema
                go(b.body, inner)

    go(blocks, schema)
    taken: set[str] = set()
    for b in found:
        name = anchor_from(b.head, b.ordinal)
        if name is None:
            raise DocumentError("Syntax", f"`{b.symbol}`: the head yields no anchor")
        if b.anchor not in (None, name):
            raise DocumentError("Syntax", f"`{b.symbol}`: the anchor `{b.anchor}` contradicts `{name}`")
        if name in taken:
            raise DocumentError("Syntax", f"`{b.symbol}`: duplicate onym `{name}`")
        b.anchor = name
        taken.add(name)
    for base, same in groups.items():
        numbers = sorted(b.ordinal for b in same if b.ordinal is not None)
        if numbers and len(numbers) < len(same):
            raise DocumentError("Syntax", f"homographs of `{base}` must all carry a taxis")
        if numbers != list(range(1, len(numbers) + 1)):
            raise DocumentError("Syntax", f"homographs of `{base}`: ordinals must run 1..n")
    return taken


def check_references(blocks: list[Node]) -> None:
    owner: dict[str, str | None] = {}
    for n in walk(blocks):
        if n.anchor is not None and n.kind != "point":
            owner.setdefault(n.anchor, n.symbol if n.kind in ("block", "verse") else None)
    for n in walk(blocks):
        if n.kind == "ref":
            if n.text not in owner:
                raise DocumentError("DeixisUndefinedOnym", n.text)
            if owner[n.text] != n.symbol:
                raise DocumentError("DeixisTargetMismatch", f"`{n.text}` is not attached to `{n.symbol}`")


def rename_anchors(blocks: list[Node], kept: set[str], has: Contents) -> None:
    """Anchors become o1.. in order of declaration; those that nothing refers to go. Parameters refer, too.

    Blocks that have anchored themselves since their ``contents`` were taken keep their names.
    """
    declared = list(dict.fromkeys(n.anchor for n in has.anchored if n.anchor not in kept))
    used = {n.text for n in has.referring} if declared else set()
    new = {name: f"o{k}" for k, name in enumerate((n for n in declared if n in used), 1)} | {n: n for n in kept}

    def drop(seq: list[Node]) -> list[Node]:
        return [n for n in seq if not (n.kind == "anchor" and n.anchor is None)]

    for n in has.anchored:
        n.anchor = new.get(n.anchor)
    if new:
        for n in has.referring:
            n.text = new.get(n.text, n.text)
    if "anchor" in has.kinds:
        rebuild(blocks, None, drop)


def number_blocks(blocks: list[Node], schema: Schema, catalog: Catalog) -> None:
    """Ordinals count up within runs of siblings of one symbol that carry one."""
    for seq, scope in _scoped(blocks, schema, catalog):
        last, n = None, 0
        for b in seq:
            e = scope.elements.get(b.symbol) if b.ordinal is not None and b.kind == "block" else None
            counts = b.ordinal is not None and b.kind in ("block", "verse") and not (e is not None and e.autonym)
            n = n + 1 if counts and b.symbol == last else 1
            last = b.symbol if counts else None
            if counts:
                if b.ordinal not in (AUTO, n):
                    raise DocumentError("TaxisInconsistent", f"expected {n}, found {b.ordinal}")
                b.ordinal = n


# 10-12: vocabularies, wrappers, white space.


def use_terms(blocks: list[Node], schema: Schema, catalog: Catalog, classed: bool = True) -> None:
    """classed: may any node have classes?"""

    def classes(n: Node, scope: Schema) -> None:
        e = scope.elements.get(n.symbol or "")
        if e is not None and e.class_vocabulary:
            n.classes = [scope.term(e.class_vocabulary, c) for c in n.classes]

    def deep(seq: list[Node], scope: Schema) -> None:
        for n in seq if classed else ():
            if n.kind in ("span", "void", "ref"):
                classes(n, scope)
            deep(n.body, scope)

    for seq, scope in _scoped(blocks, schema, catalog):
        for b in seq:
            if b.kind in ("block", "verse") and b.symbol:
                classes(b, scope)
                e = scope.elements.get(b.symbol)
                if e is not None and e.head_vocabulary and len(b.head) == 1 and b.head[0].kind == "text":
                    b.head[0].text = scope.term(e.head_vocabulary, b.head[0].text.strip())
            deep(b.head, scope)
            if b.kind == "para":
                deep(b.body, scope)
            elif b.kind == "verse":
                for stanza in b.body:
                    for line in stanza:
                        deep(line, scope)
            deep(b.tail, scope)


def unwrap(blocks: list[Node]) -> list[Node]:
    """Wrappers without annotations dissolve; one that opens with a void element delimits what it annotates."""

    def block_run(seq: list[Node]) -> list[Node]:
        return [x for n in seq for x in (n.body if n.kind == "wrap" and not n.annotated else [n])]

    def run(seq: list[Node]) -> list[Node]:
        gone = lambda n: not n.annotated and not (n.body and n.body[0].kind == "void")
        if not any([n.kind == "wrap" and gone(n) for n in seq]):
            return seq
        return [x for n in seq for x in (n.body if n.kind == "wrap" and gone(n) else [n])]

    return rebuild(blocks, block_run, run)


def normalize_run(seq: list[Node]) -> list[Node]:
    out: list[Node] = []
    texts: list[Node] = []
    more: list[str] = []
    last = None
    for n in seq:
        if n.kind == "text":
            if last is not None:
                more.append(n.text)
                continue
            texts.append(n)
            last = n
        else:
            if n.kind == "span" or n.kind == "wrap":
                n.body = normalize_run(n.body)
            if more:
                last.text += "".join(more)
                more.clear()
            last = None
        out.append(n)
    if more:
        last.text += "".join(more)
    if not texts:
        return out
    for n in texts:
        t = n.text
        if "  " in t or "\n" in t or "\t" in t or "\r" in t:
            n.text = LAYOUT.sub(" ", t)
    if out[0] is texts[0]:
        out[0].text = out[0].text.lstrip(" ")
    if last is not None:
        last.text = last.text.rstrip(" ")
    return out if all([n.text for n in texts]) else [n for n in out if n.kind != "text" or n.text]


def normalize(blocks: list[Node]) -> list[Node]:
    """Layout white space collapses, and empty paragraphs go; lines of verse keep theirs."""
    for b in blocks:
        b.head, b.tail = normalize_run(b.head), normalize_run(b.tail)
        if b.kind == "para":
            b.body = normalize_run(b.body)
        elif has_blocks(b):
            b.body = normalize(b.body)
    return [b for b in blocks if b.kind != "para" or b.body]


# 13: media.


def bundle_media(blocks: list[Node], read: Callable[[str], bytes]) -> list[tuple[str, str, str]]:
    """(name, source, SHA-256): resources are named m1.ext.. in document order; one source has one name."""
    names: dict[str, tuple[str, str, str]] = {}
    for n in walk(blocks):
        if n.is_block and n.kind == "media":
            if n.text not in names:
                ext = posixpath.splitext(n.text)[1]
                names[n.text] = (f"m{len(names) + 1}{ext}", n.text, hashlib.sha256(read(n.text)).hexdigest())
            n.text = "media/" + names[n.text][0]
    return list(names.values())
