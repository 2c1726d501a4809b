"""Mappings between schemas: rule tables, their checks, their algebra and their application.

A mapping is a table from symbols to what becomes of them, and ranked regions that a lone heading opens over
what follows it. Tables are checked before any document is touched, and routes of tables are fused into one.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from collections.abc import Mapping as Named
from dataclasses import dataclass, field, replace

from quire.model.canon import check_references, number_blocks
from quire.model.names import valid_class
from quire.model.schema import KEYWORD, REQUIRED, UNSUPPORTED, Catalog, Element, Schema, declared
from quire.model.tree import Document, DocumentError, Node, clone, has_blocks, walk

RENAME, DROP, UNWRAP, EXTRACT = "rename", "drop", "unwrap", "extract"
#: What opens a region, by spelling: with its heading as head, as a wrapper without, dropped, or relabelled.
REGIONS = {"@>#": "wrap", "@><": "wrap_bare", "@>-": "drop", "@>:": "relabel"}


@dataclass(frozen=True)
class Rule:
    """``to`` is the new symbol of a rename, or the heading that an extract puts its head in."""

    kind: str
    to: str = ""
    classes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Region:
    trigger: str
    kind: str
    to: str
    classes: tuple[str, ...]
    rank: int


@dataclass
class SchemaMap:
    source: Schema
    target: Schema
    rules: dict[str, Rule]
    regions: list[Region] = field(default_factory=list)
    via: tuple[str, ...] = ()

    def region(self, symbol: str | None) -> Region | None:
        return next((r for r in self.regions if r.trigger == symbol), None)

    def unmapped(self) -> list[str]:
        return sorted(s for s in self.source.elements if s not in self.rules and not self.region(s))

    def is_identity(self) -> bool:
        return self.source.id == self.target.id and not self.regions and all(r == Rule(RENAME, s) for s, r in self.rules.items())

    def only_renames(self) -> bool:
        return not self.regions and all(r.kind == RENAME for r in self.rules.values())


def _bad(message: str) -> DocumentError:
    return DocumentError("InvalidMorph", message)


def _fits(a: Element, b: Element, both_ways: bool) -> bool:
    """Can content of element a be content of b? Optional parts may be lost, required ones must be there."""
    if a.form != b.form:
        return False
    if a.form != "block":
        return True
    if (a.body == "stichos") != (b.body == "stichos"):
        return False
    parts = [(getattr(a, x), getattr(b, x)) for x in ("ordinal", "head", "tail")]
    if both_ways:
        return all(x == y for x, y in parts)
    return all(not (y == REQUIRED and x != REQUIRED) for x, y in parts)


def read_mapping(text: str, catalog: Catalog, reverse: bool = False) -> SchemaMap:
    """Rules: ``@:: a b .c`` rename, ``@<< a`` unwrap, ``@<# a h .c`` extract, ``@-- a`` drop, and regions."""
    lines = [x.strip() for x in text.split("\n") if x.strip() and not x.strip().startswith("@@/")]
    kind = (declared(lines[0]) or ("", "", ""))[2] if lines else ""
    both = kind == "-iso"
    if len(lines) < 2 or kind not in ("-hom", "-iso"):
        raise _bad("no declaration")
    left, arrow, right = lines[1].removeprefix("@=").partition("<=>" if both else "=>")
    if not arrow or (reverse and not both):
        raise _bad(f"malformed header `{lines[1]}`")
    a, b = (right, left) if reverse else (left, right)
    source, target = catalog.schema(a.strip()), catalog.schema(b.strip())
    rules: dict[str, Rule] = {}
    regions: list[tuple[str, str, str, tuple[str, ...]]] = []
    for line in lines[2:]:
        mark, words = line[:3], line[3:].split()
        classes = tuple(w[1:] for w in words if w.startswith(".") and len(w) > 1 and w[1].isalpha())
        plain = [w for w in words if w[1:] not in classes or not w.startswith(".")]
        if not plain or any(not valid_class(c) for c in classes):
            raise _bad(f"malformed rule `{line}`")
        if both and (mark != "@::" or classes):
            raise _bad(f"`{line}` cannot be reversed")
        first, second = plain[0], plain[1] if len(plain) > 1 else ""
        if mark == "@::" and second:
            made = (second, Rule(RENAME, first)) if reverse else (first, Rule(RENAME, second, classes))
        elif mark == "@<#":
            made = (first, Rule(EXTRACT, second, classes))
        elif mark in ("@<<", "@--") and not second:
            made = (first, Rule(UNWRAP if mark == "@<<" else DROP))
        elif mark in REGIONS:
            kind = REGIONS[mark]
            if (kind == "wrap_bare" and not second) or (kind == "drop" and second) or (classes and not second):
                raise _bad(f"malformed region `{line}`")
            regions.append((first, kind, second, classes))
            continue
        else:
            raise _bad(f"unexpected line `{line}`")
        if made[0] in rules:
            raise _bad(f"`{made[0]}` has two rules")
        rules[made[0]] = made[1]
    out = SchemaMap(source, target, rules, [Region(*r, rank=k) for k, r in enumerate(regions)])
    return checked(with_identities(out), both)


def with_identities(m: SchemaMap) -> SchemaMap:
    """A symbol without a rule keeps itself where the target has it in a form that fits."""
    for s, e in m.source.elements.items():
        if s not in m.rules and not m.region(s) and s in m.target.elements and _fits(e, m.target.elements[s], False):
            m.rules[s] = Rule(RENAME, s)
    return m


def checked(m: SchemaMap, both_ways: bool = False) -> SchemaMap:
    for s, r in m.rules.items():
        e = m.source.elements.get(s)
        if e is None:
            raise _bad(f"`{s}` is no element of {m.source.id}")
        to = m.target.elements.get(r.to)
        if r.kind == RENAME and (to is None or not _fits(e, to, both_ways)):
            raise _bad(f"`{s}` cannot become `{r.to}`")
        if r.kind == EXTRACT and (e.form != "block" or (r.to and (to is None or to.form != "span"))):
            raise _bad(f"`{s}` has no head to extract to `{r.to}`")
        if r.kind == UNWRAP and e.form == "void":
            raise _bad(f"`{s}` has no content to unwrap")
    for r in m.regions:
        e, to = m.source.elements.get(r.trigger), m.target.elements.get(r.to)
        if e is None or e.form != "span" or (r.to and (to is None or to.form != ("span" if r.kind == "relabel" else "block"))):
            raise _bad(f"the region of `{r.trigger}` does not fit")
    if both_ways:
        twice = [t for t, n in Counter(r.to for r in m.rules.values()).items() if n > 1]
        if twice or set(r.to for r in m.rules.values()) != set(m.target.elements):
            raise _bad(f"not one to one at {twice or sorted(set(m.target.elements) - {r.to for r in m.rules.values()})}")
    if missing := m.unmapped():
        raise DocumentError("MorphIncomplete", ", ".join(missing))
    return m


def embedding(source: Schema, target: Schema) -> SchemaMap | None:
    """The mapping that a lineage implies: what came from the target goes back under its name there."""
    steps = [x for x in source.lineage if x[0] == target.id]
    rules: dict[str, Rule] = {}
    for _, kind, words in steps:
        if kind == "import":
            rules[words[-1]] = Rule(RENAME, words[0])
        else:
            brought = words if kind == "list" else [s for s in target.elements if s in source.elements and not (kind == "exclude" and s in words)]
            rules |= {s: Rule(RENAME, s) for s in brought}
    return SchemaMap(source, target, rules) if steps else None


class Atlas:
    """Mapping files by name, and routes over them."""

    def __init__(self, catalog: Catalog, files: Named[str, str]):
        self.catalog, self.files = catalog, dict(files)
        self.routes: dict[tuple[str, str], list[SchemaMap]] = {}

    def direct(self, a: str, b: str) -> SchemaMap | None:
        """A file a to b, one that goes both ways, a built-in mapping, or the embedding that the lineage implies."""
        from quire.model import maps

        for name, reverse in ((f"{a}.{b}.hom", False), (f"{a}.{b}.iso", False), (f"{b}.{a}.iso", True)):
            if name in self.files:
                return read_mapping(self.files[name], self.catalog, reverse)
        return maps.built_in(a, b, self.catalog) or embedding(self.catalog.schema(a), self.catalog.schema(b))

    def known_route(self, a: str, b: str) -> list[SchemaMap]:
        """As ``route``, found once."""
        if (a, b) not in self.routes:
            self.routes[a, b] = self.route(a, b)
        return self.routes[a, b]

    def names(self) -> list[str]:
        listed = {p for f in self.files for p in f.rsplit(".", 1)[0].split(".")}
        return sorted(listed | {t.rsplit(".", 1)[0] for t in self.catalog.texts if t.endswith((".dia", ".lektos"))} | set(self.catalog.library))

    def route(self, a: str, b: str) -> list[SchemaMap]:
        """The shortest route; two of the same length are an error, as they may differ."""
        names, found, depth = self.names(), [], None
        queue = deque([(a,)])
        reached = {a: 0}
        while queue:
            path = queue.popleft()
            if depth is not None and len(path) >= depth:
                continue
            for n in names:
                if n in path or reached.get(n, len(path)) < len(path) or self.direct(path[-1], n) is None:
                    continue
                reached[n] = len(path)
                if n == b:
                    found.append((*path, n))
                    depth = len(path) + 1
                else:
                    queue.append((*path, n))
        if not found:
            raise DocumentError("UnresolvableMorph", f"{a}=>{b}")
        if len(found) > 1:
            raise DocumentError("AmbiguousMorphRoute", " | ".join(" => ".join(p) for p in found))
        return [self.direct(x, y) for x, y in zip(found[0], found[0][1:])]


def compose(first: SchemaMap, second: SchemaMap) -> SchemaMap | None:
    """One table for two in a row; None where regions or extracted headings make that impossible."""
    if first.regions or second.regions or any(r.kind == EXTRACT and r.to for r in first.rules.values()):
        return None
    rules: dict[str, Rule] = {}
    for s, r in first.rules.items():
        if r.kind != RENAME:
            rules[s] = r
        elif (then := second.rules.get(r.to)) is not None:
            rules[s] = replace(then, classes=r.classes + then.classes) if then.kind == RENAME else then
            middle, end = first.target.elements[r.to], second.target.elements.get(then.to)
            if then.kind == EXTRACT and middle.head == UNSUPPORTED:
                rules[s] = Rule(UNWRAP)
            elif then.kind == RENAME and end is not None and any(getattr(middle, x) == UNSUPPORTED != getattr(end, x) for x in ("ordinal", "head", "tail")):
                return None  # the middle form loses a part that the last would take
    return SchemaMap(first.source, second.target, rules, via=(*first.via, first.target.id, *second.via))


def apply_route(doc: Document, maps: list[SchemaMap], catalog: Catalog, fuse: bool = True) -> Document:
    todo: list[SchemaMap] = []
    for m in maps:
        one = compose(todo[-1], m) if fuse and todo else None
        todo[-1:] = [one] if one else [*todo[-1:], m]
    for m in todo:
        doc = apply(doc, m, catalog)
    return doc


def apply(doc: Document, m: SchemaMap, catalog: Catalog) -> Document:
    if doc.schema != m.source.id:
        raise _bad(f"the document is `{doc.schema}`, the mapping from `{m.source.id}`")
    missing = {n.symbol for n in _own(doc.blocks, doc.schema) if n.symbol and n.symbol not in m.rules and not m.region(n.symbol)}
    if missing:
        raise DocumentError("MorphUnmapped", ", ".join(sorted(missing)))
    out = Document(m.target.id, blocks=_blocks(clone(doc.blocks), m))
    check_references(out.blocks)
    number_blocks(out.blocks, Schema(m.target.id), catalog)
    return out


def _own(blocks: list[Node], schema: str) -> Iterator[Node]:
    """All nodes but those of embedded parts that answer to another schema."""
    for b in blocks:
        if b.kind == "embed" and b.text != schema:
            continue
        if has_blocks(b):
            yield from walk([replace(b, body=[])])
            yield from _own(b.body, schema)
        else:
            yield from walk([b])


def _flips(m: SchemaMap, symbol: str) -> bool:
    e = m.target.elements.get(symbol)
    return e.flips if e is not None else True


def _blocks(seq: list[Node], m: SchemaMap) -> list[Node]:
    """Regions as a stack of open sequences: a trigger closes those of its rank and below."""
    out: list[Node] = []
    open_: list[tuple[int, Node | None, list[Node]]] = []
    here = lambda: open_[-1][2] if open_ else out

    def close() -> None:
        _, node, inner = open_.pop()
        if node is None:
            here().extend(inner)
        elif node.kind != "gone":
            node.body = inner
            here().append(node)

    for b in seq:
        alone = b.kind == "para" and len(b.body) == 1 and b.body[0].kind == "span"
        r = m.region(b.body[0].symbol) if alone else None
        if r is None:
            here().extend(_block(b, m))
            continue
        while open_ and open_[-1][0] >= r.rank:
            close()
        head = b.body[0]
        text, classes = _run(head.body, m), [*head.classes, *r.classes]
        node: Node | None = None
        if r.kind == "drop":
            node = Node("gone")
        elif r.kind in ("wrap", "wrap_bare") and r.to:
            node = Node("block", r.to, head=text if r.kind == "wrap" else [], anchor=head.anchor, classes=classes, flips=_flips(m, r.to), is_block=True)
        elif r.kind == "relabel" and r.to:
            here().append(Node("para", body=[Node("span", r.to, body=text, anchor=head.anchor, classes=classes, flips=_flips(m, r.to))], is_block=True))
        elif r.kind == "wrap" and text:
            here().append(Node("para", body=text, is_block=True))
        open_.append((r.rank, node, []))
    while open_:
        close()
    return out


def _renamed(n: Node, r: Rule, m: SchemaMap) -> None:
    n.symbol, n.classes = r.to, [*n.classes, *(r.classes if n.kind != "ref" else ())]
    n.flips = _flips(m, r.to)
    e = m.target.elements.get(r.to)
    if e is not None and n.is_block:
        n.ordinal = None if e.ordinal == UNSUPPORTED else n.ordinal
        n.head = [] if e.head == UNSUPPORTED else n.head
        n.tail = [] if e.tail == UNSUPPORTED else n.tail


def _block(b: Node, m: SchemaMap) -> list[Node]:
    r = m.rules.get(b.symbol) if b.symbol else None
    if r is not None and r.kind == DROP:
        return []
    if r is not None and r.kind in (UNWRAP, EXTRACT):
        head = _run(b.head, m) if r.kind == EXTRACT else []
        if head and r.to:
            head = [Node("span", r.to, body=head, classes=list(r.classes), flips=_flips(m, r.to))]
        return [*([Node("para", body=head, is_block=True)] if head else []), *_blocks(b.body, m)]
    if r is not None:
        _renamed(b, r, m)
    b.head, b.tail = _run(b.head, m), _run(b.tail, m)
    if b.kind == "para":
        b.body = _run(b.body, m)
        return [b] if b.body else []
    if b.kind == "verse":
        b.body = [[_run(line, m) for line in s] for s in b.body]
    elif b.kind in ("block", "wrap"):
        b.body = _blocks(b.body, m)
    elif b.kind == "embed" and b.text == m.source.id:
        b.text, b.body = m.target.id, _blocks(b.body, m)
    return [b]


def _run(seq: list[Node], m: SchemaMap) -> list[Node]:
    out: list[Node] = []
    for n in seq:
        r = m.rules.get(n.symbol) if n.symbol else None
        if r is None and n.kind == "ref" and (g := m.region(n.symbol)):
            r = Rule(RENAME, g.to) if g.to and g.kind != "drop" else Rule(DROP)
        if r is not None and (r.kind == DROP or (r.kind != RENAME and n.kind == "ref")):
            continue
        n.body = _run(n.body, m) if n.kind in ("span", "wrap") else n.body
        if r is not None and r.kind == RENAME:
            _renamed(n, r, m)
        out.extend(n.body if r is not None and r.kind != RENAME else [n])
    return out


def write_mapping(m: SchemaMap, keyword: str = KEYWORD) -> str:
    """The normal form: regions by rank, then rules by symbol, without those that change nothing."""
    marks = {v: k for k, v in REGIONS.items()}
    notes = lambda classes: "".join(f" .{c}" for c in classes)
    lines = [f"@@@!{keyword}-hom", f"@={m.source.id}=>{m.target.id}", ""]
    lines += [f"{marks[r.kind]} {r.trigger}{' ' + r.to if r.to else ''}{notes(r.classes)}" for r in sorted(m.regions, key=lambda r: r.rank)]
    for s, r in sorted(m.rules.items(), key=lambda x: x[0].encode()):
        if r == Rule(RENAME, s):
            continue
        mark = {RENAME: "@::", DROP: "@--", UNWRAP: "@<<", EXTRACT: "@<#"}[r.kind]
        lines.append(f"{mark} {s}{' ' + r.to if r.to else ''}{notes(r.classes)}")
    return "\n".join(lines) + "\n"
