"""Reading aids over a document: outlines with their line spans, spelled-out element names, label reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

from quire.model.names import ALIAS, SIGIL, symbolic
from quire.model.schema import Schema
from quire.model.tree import Document, DocumentError, Node, clone, has_blocks, walk
from quire.model.writer import write


def shown_text(run: list[Node]) -> str:
    def text(seq: list[Node]) -> str:
        return "".join(n.text if n.kind in ("text", "raw") else text(n.body) if n.kind in ("span", "wrap") else "" for n in seq)

    return " ".join(text(run).split())


def outline(doc: Document, schema: Schema) -> list[dict]:
    """Blocks with depth, first and last line, element name and head; by start, enclosing ones first."""
    out: list[dict] = []

    def go(seq: list[Node], depth: int) -> None:
        for b in seq:
            if b.kind in ("block", "verse", "wrap", "embed"):
                e = schema.elements.get(b.symbol or "")
                kind = {"block": "para", "verse": "stichoi", "wrap": "diaphane", "embed": "englossis"}[b.kind]
                out.append({"kind": kind, "symbol": b.text if b.kind == "embed" else b.symbol, "name": e.name if e else None, "depth": depth, "start": b.start, "end": b.end, "head": shown_text(b.head), "anchor": b.anchor, "classes": list(b.classes)})
            if has_blocks(b):
                go(b.body, depth + 1)

    go(doc.blocks, 0)
    return sorted(out, key=lambda x: (x["start"], -x["end"]))


def points(doc: Document, source: str) -> Iterator[dict]:
    """Coordinates, anchors and cross-references with the line they stand in, searched for onward; 0 if not found."""
    lines, at = source.split("\n"), 0

    def line(*needles: str) -> int:
        nonlocal at
        found = next((k for k in range(at, len(lines)) if any(n in lines[k] for n in needles)), None)
        at = at if found is None else found
        return 0 if found is None else found + 1

    for n in walk(doc.blocks):
        if n.kind == "point":
            key = f"{n.scheme}:{n.text}"
            yield {"kind": "milestone", "key": key, "line": line(f'("{key}")')}
        elif n.kind == "ref":
            key = f"{n.symbol}({n.text})"
            yield {"kind": "deixis", "key": key, "line": line(key, "{" + str(n.symbol) + "}(" + n.text + ")")}
        elif n.anchor is not None and n.kind in ("anchor", "span"):
            yield {"kind": "onym", "key": n.anchor, "line": line(f"({n.anchor})")}
        elif n.anchor is not None and n.is_block:
            yield {"kind": "onym", "key": n.anchor, "line": n.end}


def outline_text(doc: Document, schema: Schema, source: str) -> str:
    """The outline as a table text: a section for each block and point; a value that opens with ``$`` doubles it."""
    value = lambda v: "$" + v if v.startswith("$") else v
    out = [".!kaiv\n", f"dialektos={value(doc.schema)}"]
    for b in outline(doc, schema):
        fields = [("kind", b["kind"]), ("symbol", b["symbol"]), ("name", b["name"]), ("depth", str(b["depth"])), ("start", str(b["start"])), ("end", str(b["end"])), ("lemma", b["head"] or None), ("onym", b["anchor"])]
        plain = ("kind", "depth", "start", "end")
        out += ["\n[/@blocks]", *(f"{k}={v if k in plain else value(v)}" for k, v in fields if v is not None), *(f"@genoses+={value(c)}" for c in b["classes"])]
    found = list(points(doc, source))
    for section, kind in (("milestones", "milestone"), ("onyms", "onym"), ("deixes", "deixis")):
        for x in found:
            if x["kind"] == kind:
                out += [f"\n[/@{section}]", f"key={value(x['key'])}", f"line={x['line']}"]
    return "\n".join(out) + "\n"


def declared_id(source: str) -> str | None:
    """The schema that a source's first content line declares, without its version."""
    for k, line in enumerate(source.split("\n")):
        if k == 0 and line.startswith("#!") or not line.strip():
            continue
        m = re.match(r"(?:@@@|\\\\\\)!([^@\s]+)", line.strip())
        return m[1] if m else None
    return None


#: Kinds of marks for display (fixed values).
KINDS = ("namespace", "keyword", "comment", "number", "variable", "macro", "operator")


def highlights(source: str, schema: Schema | None = None) -> Iterator[tuple[int, int, int, str]]:
    """(line, start, length, kind) of what is markup, by lines from 0, in UTF-16 units. No tree is built.

    With a schema, symbols that it does not define show as operators; without one, every symbol shows as a keyword.
    """
    lines = source.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    first = next((x.strip() for k, x in enumerate(lines) if x.strip() and not (k == 0 and x.startswith("#!"))), "")
    sig, other = (ALIAS, SIGIL) if first.startswith(ALIAS * 3 + "!") else (SIGIL, ALIAS)
    closing = {e.closing() for e in schema.elements.values()} if schema else None
    declared, comment = False, 0
    for no, line in enumerate(lines):
        line = line.removesuffix("\r")

        def token(a: int, b: int, kind: str, no=no, line=line):
            units = lambda x: len(x.encode("utf-16-le", "surrogatepass")) // 2
            return (no, units(line[:a]), units(line[a:b]), kind)

        if no == 0 and line.startswith("#!"):
            if line:
                yield token(0, len(line), "comment")
            continue
        at = 0
        if not declared and line.strip():
            declared = True
            if m := re.match(rf"\s*({re.escape(sig * 3)}!)([^@\s]*)(@\S*)?", line):
                spans = ((1, "macro"), (2, "namespace"), (3, "number"))
                yield from (token(*m.span(g), kind) for g, kind in spans if m[g])
                continue
        if comment:
            end = line.find("/" + sig * comment)
            stop = len(line) if end < 0 else end + 1 + comment
            if stop:
                yield token(0, stop, "comment")
            if end < 0:
                continue
            at, comment = stop, 0
        while at < len(line):
            c = line[at]
            if c == other:
                yield token(at, min(at + 2, len(line)), "operator")
                at += 2
            elif c == sig:
                run = len(line[at:]) - len(line[at:].lstrip(sig))
                behind = at + run
                if line.startswith("/", behind):
                    end = line.find("/" + sig * run, behind + 1)
                    stop = len(line) if end < 0 else end + 1 + run
                    yield token(at, stop, "comment")
                    comment = run if end < 0 and run > 1 else 0
                    at = stop
                    continue
                e = schema.longest(line[behind:]) if schema else None
                size = len(e.symbol) if e else next((k for k, x in enumerate(line[behind:]) if not symbolic(x) or x == "("), len(line) - behind)
                yield token(at, behind + size, "keyword" if size and (e or not schema) else "operator")
                at = behind + size
                if line.startswith("(", at) and (end := line.find(")", at)) >= 0:
                    if end > at + 1:
                        yield token(at + 1, end, "number" if line[at + 1].isascii() and line[at + 1].isdigit() else "variable")
                    at = end + 1
            elif symbolic(c):
                end = next((k for k in range(at, len(line)) if not symbolic(line[k])), len(line))
                if line.startswith(sig, end):
                    run = len(line[end:]) - len(line[end:].lstrip(sig))
                    yield token(at, end + run, "keyword" if closing is None or line[at:end] in closing else "operator")
                    end += run
                at = end
            else:
                at += 1


def spelled(doc: Document, schema: Schema, language: str | None = None) -> str:
    """The document with elements written by name, in a language where it has them; reading it back is lossless."""
    if language is not None and language not in schema.localized:
        raise DocumentError("UnresolvableDialektos", f"{schema.id}.{language}")
    doc = Document(doc.schema, doc.version, clone(doc.blocks))
    for n in walk(doc.blocks):
        if n.symbol:
            e = schema.elements.get(n.symbol)
            if e is None:
                raise DocumentError("UndefinedSim", n.symbol)
            name = schema.localized.get(language or "", {}).get(n.symbol, e.name)
            back = schema.named(name)
            if back is None or back.symbol != n.symbol:
                raise DocumentError("Syntax", f"the name `{name}` is not addressable in `{schema.id}`")
            n.symbol = "{" + name + "}"
    return write(doc)


def unresolved_labels(doc: Document, label: str, entry: str, known: set[str]) -> list[tuple[str, str]]:
    """(head of the nearest entry around, label) of labels without an abbreviation, each once."""
    out: dict[tuple[str, str], None] = {}

    def inside(seq: list[Node], head: str) -> None:
        for n in seq:
            if n.kind == "span" and n.symbol == label and (text := shown_text(n.body)) not in known:
                out.setdefault((head, text))
            inside(n.body, head)

    def go(seq: list[Node], head: str) -> None:
        for b in seq:
            mine = shown_text(b.head) if b.symbol == entry else head
            inside(b.head, mine)
            if b.kind == "para":
                inside(b.body, mine)
            elif b.kind == "verse":
                for s in b.body:
                    for line in s:
                        inside(line, mine)
            elif has_blocks(b):
                go(b.body, mine)
            inside(b.tail, mine)

    go(doc.blocks, "")
    return list(out)
