"""Cutting trees at the coordinates of one scheme, and weaving the slices of parallel versions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quire.functions.alignment import CLAUSE, SENTENCE, WORD, cuts, merged_order, nearest
from quire.model.names import valid_class
from quire.model.tree import Document, DocumentError, Node, clone, walk


@dataclass
class Slice:
    """``point`` is the coordinate that opens the slice; none before the first."""

    point: Node | None = None
    nodes: list[Node] = field(default_factory=list)


def _blank(run: list[Node]) -> bool:
    return all(n.kind == "text" and not n.text.strip() for n in run)


def _part(n: Node, first: bool, **new) -> Node:
    """A part of a cut node; only the first keeps the anchor."""
    return replace(n, anchor=n.anchor if first else None, classes=list(n.classes), **new)


def slice_run(run: list[Node], scheme: str) -> list[Slice]:
    """Elements that hold a coordinate are closed before it and opened again; wrappers are not cut."""
    out = [Slice()]
    for n in run:
        if n.kind == "point" and n.scheme == scheme:
            out.append(Slice(n))
        elif n.kind == "span":
            parts = slice_run(n.body, scheme)
            for k, p in enumerate(parts):
                if p.point is not None:
                    out.append(Slice(p.point))
                if p.nodes or len(parts) == 1:
                    out[-1].nodes.append(_part(n, k == 0, body=p.nodes))
        else:
            out[-1].nodes.append(n)
    return out


def slices(blocks: list[Node], scheme: str) -> list[Slice]:
    """Slices in order. A coordinate at a container's start opens its slice before the container, whose head is
    not repeated after later ones; heads, tails and embedded parts are not cut.
    """
    out = [Slice()]
    for b in blocks:
        made = {"para": _paragraph, "block": _container, "verse": _verse, "wrap": _wrapper}.get(b.kind)
        for s in made(b, scheme) if made else [Slice(nodes=[b])]:
            if s.point is not None:
                out.append(Slice(s.point))
            out[-1].nodes += s.nodes
    return out


def _paragraph(b: Node, scheme: str) -> list[Slice]:
    return [Slice(s.point, [] if _blank(s.nodes) else [replace(b, body=s.nodes)]) for s in slice_run(b.body, scheme)]


def _container(b: Node, scheme: str) -> list[Slice]:
    inner = slices(b.body, scheme)
    lead: list[Slice] = []
    while len(inner) > 1 and not inner[0].nodes:
        lead.append(Slice(inner[0].point))
        inner = inner[1:]
    first, rest = inner[0], inner[1:]
    lead.append(Slice(first.point))
    if first.nodes or not rest or b.anchor is not None:
        lead[-1].nodes.append(replace(b, body=first.nodes, tail=[] if rest else b.tail))
    if rest and b.tail:
        rest[-1].nodes.append(Node("para", body=b.tail, is_block=True))
    return [x for x in lead if x.point is not None or x.nodes or x is lead[-1]] + rest


def _verse(b: Node, scheme: str) -> list[Slice]:
    groups: list[tuple[Node | None, list]] = [(None, [])]
    for stanza in b.body:
        lines: list[list[Node]] = []
        for line in stanza:
            run: list[Node] = []
            for n in line:
                if n.kind == "point" and n.scheme == scheme:
                    if not _blank(run):
                        lines.append(run)
                    if lines:
                        groups[-1][1].append(lines)
                    run, lines = [], []
                    groups.append((n, []))
                else:
                    run.append(n)
            if not _blank(run):
                lines.append(run)
        if lines:
            groups[-1][1].append(lines)
    out, first = [], True
    for k, (point, stanzas) in enumerate(groups):
        out.append(Slice(point))
        if stanzas:
            out[-1].nodes.append(_part(b, first, body=stanzas, head=b.head if first else [], tail=b.tail if k + 1 == len(groups) else []))
            first = False
    return out


def _wrapper(b: Node, scheme: str) -> list[Slice]:
    inner = slices(b.body, scheme)
    return [Slice(s.point, [_part(b, k == 0, body=s.nodes)] if s.nodes else []) for k, s in enumerate(inner)]


def schemes(doc: Document) -> list[str]:
    """The schemes of a document's coordinates."""
    return sorted({n.scheme for n in walk(doc.blocks) if n.kind == "point"})


def sole_scheme(docs: list[Document]) -> str:
    """The one scheme that the documents' coordinates have; none or several is an error."""
    found = sorted({s for d in docs for s in schemes(d)})
    if len(found) != 1:
        raise DocumentError("Syntax", f"the coordinates have {'no scheme' if not found else 'several schemes: ' + ', '.join(found)}: name one")
    return found[0]


def words(nodes: list[Node]) -> list[str]:
    """Words of each text node by itself: an element's edge ends a word."""
    out: list[str] = []
    for n in nodes:
        if n.kind == "text":
            out += n.text.split()
        out += words(n.head)
        if n.kind == "verse":
            out += [w for s in n.body for line in s for w in words(line)]
        elif n.kind not in ("raw", "macro"):
            out += words(n.body)
        out += words(n.tail)
    return out


def mass(nodes: list[Node]) -> int:
    """Characters of text, verbatim content included."""
    return sum((len(n.text) if n.kind in ("text", "raw") else 0) + mass(n.head) + (sum(mass(line) for s in n.body for line in s) if n.kind == "verse" else mass(n.body)) + mass(n.tail) for n in nodes)


def weave(witnesses: list[tuple[str, Document]], scheme: str, most: int | None = None) -> Document:
    """One document: what stands before the first coordinate, then at each coordinate every witness's slice,
    wrapped in its class ``zyg-<name>``; with ``most``, slices are halved in step until all are short.
    """
    if len(witnesses) < 2:
        raise DocumentError("Syntax", "at least two witnesses are required")
    schema = witnesses[0][1].schema
    for name, doc in witnesses:
        if doc.schema != schema:
            raise DocumentError("Syntax", f"witness `{name}` is `{doc.schema}`, expected `{schema}`")
        if not valid_class(name):
            raise DocumentError("Syntax", f"witness id `{name}` is not a valid identifier")
    if len({n for n, _ in witnesses}) < len(witnesses):
        raise DocumentError("Syntax", "duplicate witness id")
    cut = [(name, slices(clone(doc.blocks), scheme)) for name, doc in witnesses]
    traces = []
    for name, mine in cut:
        trace = [s.point.text for s in mine if s.point is not None]
        if len(set(trace)) < len(trace):
            raise DocumentError("Syntax", f"witness `{name}`: a coordinate of `{scheme}` stands twice")
        traces.append(trace)
    try:
        order = merged_order(traces)
    except ValueError as e:
        raise DocumentError("Syntax", str(e)) from None
    tagged = lambda name, nodes: Node("wrap", body=nodes, classes=[f"zyg-{name}"], is_block=True)
    out = [tagged(name, mine[0].nodes) for name, mine in cut if mine[0].nodes]
    at = [(name, {s.point.text: s for s in mine if s.point is not None}) for name, mine in cut]
    for coord in order:
        point = next(mine[coord].point for _, mine in at if coord in mine)
        out.append(Node("para", body=[point], is_block=True))
        parts = [(name, mine[coord].nodes) for name, mine in at if coord in mine and mine[coord].nodes]
        for turn in subdivide(parts, most) if most else [parts]:
            out += [tagged(name, nodes) for name, nodes in turn]
    return Document(schema, witnesses[0][1].version, out)


def subdivide(parts: list[tuple[str, list[Node]]], most: int) -> list[list[tuple[str, list[Node]]]]:
    if not parts or max(mass(n) for _, n in parts) <= most:
        return [parts]
    ends = [len(_cuts(n[0].body, SENTENCE)) if len(n) == 1 and n[0].kind == "para" else None for _, n in parts]
    same = ends[0] // 2 if ends[0] and len(set(ends)) == 1 else None
    halves = [_halved(n, same) for _, n in parts]
    if None in halves:
        return [parts]
    names = [name for name, _ in parts]
    return subdivide(list(zip(names, [h[0] for h in halves])), most) + subdivide(list(zip(names, [h[1] for h in halves])), most)


def _cuts(run: list[Node], marks: str) -> list[tuple[int, int, int]]:
    """(text node, offset in it, offset in the run)."""
    out, before = [], 0
    for k, n in enumerate(run):
        if n.kind == "text":
            out += [(k, at, before + at) for at in cuts(n.text, marks)]
        before += mass([n])
    return out


def _halved(nodes: list[Node], same: int | None) -> tuple[list[Node], list[Node]] | None:
    if len(nodes) > 1:
        half, sums = mass(nodes) // 2, []
        for n in nodes[:-1]:
            sums.append((sums[-1] if sums else 0) + mass([n]))
        at = sums.index(nearest(sums, half)) + 1
        return nodes[:at], nodes[at:]
    (b,) = nodes
    if b.kind == "verse":
        lines = [(s, k) for s, st in enumerate(b.body) for k in range(len(st))]
        if len(lines) < 2:
            return None
        s, k = lines[len(lines) // 2]
        left, right = [*b.body[:s], *([b.body[s][:k]] if k else [])], [b.body[s][k:], *b.body[s + 1 :]]
        return [_part(b, True, body=left, tail=[])], [_part(b, False, body=right, head=[])]
    if b.kind != "para":
        return None
    tiers = [_cuts(b.body, m) for m in (SENTENCE, CLAUSE, WORD)]
    if same is not None:
        chosen = tiers[0][same]
    else:
        tier = next((t for t in tiers if t), None)
        if tier is None:
            return None
        goal = nearest([c[2] for c in tier], mass(b.body) // 2)
        chosen = next(c for c in tier if c[2] == goal)
    k, at, _ = chosen
    text = b.body[k].text
    left = [*b.body[:k], *([Node("text", text=text[:at].rstrip())] if text[:at].strip() else [])]
    right = [*([Node("text", text=text[at:].lstrip())] if text[at:].strip() else []), *b.body[k + 1 :]]
    return ([replace(b, body=left)], [replace(b, body=right)]) if left and right else None
