"""Rule tables that render documents: patterns to templates, with an escape table.

A template is compiled to parts: literal text, slots and conditional groups. Rendering is a walk over the tree
that fills templates from dictionaries of slot values; a rule's class set must be among the node's classes,
and the largest such set wins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from quire.model.names import ALIAS, SIGIL, valid_class
from quire.model.schema import Catalog, Schema, declared
from quire.model.tree import Document, DocumentError, Node

#: Slots of node values, those escaped on output first; and structural patterns (fixed values).
ESCAPED = ("taxis", "onym", "genoses", "param", "dialect", "content", "scheme", "value")
SLOTS = (*ESCAPED, "lemma", "grammata", "hypograph", "cells")
STRUCTURES = ("document", "paragraph", "text", "stichoi", "strophe", "stichos", "verbatim", "verbatim-inline", "diaphane", "diaphane-inline", "englossis", "media", "onym-anchor")

Key = tuple[str, str, str]


@dataclass(frozen=True)
class Slot:
    """kind: value, void (of the host's void elements) or place (embedded parts put here)."""

    name: str
    kind: str = "value"
    raw: bool = False
    prefix: str | None = None
    gate: bool = False


@dataclass(frozen=True)
class Rule:
    classes: tuple[str, ...]
    parts: tuple
    separator: str = ""

    def slots(self) -> list[Slot]:
        return [s for p in self.parts for s in (p if isinstance(p, tuple) else (p,)) if isinstance(s, Slot)]

    def raw(self, name: str) -> bool:
        return any(s.raw and s.name == name and s.kind == "value" for s in self.slots())

    def voids(self) -> set[str]:
        return {s.name for s in self.slots() if s.kind == "void"}


@dataclass
class RuleTable:
    source: str
    target: str
    escape: dict[str, str] = field(default_factory=dict)
    rules: dict[Key, list[Rule]] = field(default_factory=dict)
    beside: dict[str, str] = field(default_factory=dict)
    assets: dict[str, str] = field(default_factory=dict)

    def add(self, key: Key, rule: Rule) -> None:
        mine = self.rules.setdefault(key, [])
        if any(r.classes == rule.classes for r in mine):
            raise _bad(f"duplicate pattern `{key}`")
        mine.append(rule)

    def find(self, key: Key, classes: list[str]) -> Rule | None:
        fits = [r for r in self.rules.get(key, ()) if set(r.classes) <= set(classes)]
        most = max((len(r.classes) for r in fits), default=0)
        best = [r for r in fits if len(r.classes) == most]
        if len(best) > 1:
            raise DocumentError("ExoAmbiguous", " ".join(key).strip())
        return best[0] if best else None


def _bad(message: str) -> DocumentError:
    return DocumentError("InvalidExo", message)


def read_rules(text: str, schema: Schema) -> RuleTable:
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    at = 1 if lines[0].startswith("#!") else 0
    found = declared(lines[at].strip()) if at < len(lines) else None
    if found is None or found[2] != "-exo":
        raise _bad("missing declaration")
    sig = found[0]
    out = RuleTable("", "")
    at += 1

    def block(close: Callable[[str], bool], what: str) -> list[str]:
        nonlocal at
        start = at
        while at < len(lines) and not close(lines[at]):
            at += 1
        if at == len(lines):
            raise _bad(f"unterminated {what}")
        at += 1
        return lines[start : at - 1]

    while at < len(lines):
        line = lines[at].strip()
        at += 1
        if not line or line.startswith(sig * 2 + "/"):
            continue
        if line.startswith(f"{sig}=* "):
            words = line[4:].split()
            if len(words) != 2 or "/" in words[0] or "\\" in words[0] or words[0] in out.assets:
                raise _bad(f"malformed asset `{line}`")
            out.assets[words[0]] = "".join(x + "\n" for x in block(lambda x: x == words[1], words[0]))
        elif line.startswith(f"{sig}-> "):
            key, classes, separator = read_pattern(line[4:].strip(), schema)
            body = "\n".join(block(lambda x: x.strip() == f">-{sig}", f"rule `{line[4:]}`"))
            out.add(key, Rule(classes, read_template(body, sig, schema), separator))
        elif line == f"{sig}%":
            for entry in block(lambda x: x.strip() == f"%{sig}", "escape table"):
                if entry.strip():
                    if entry[0] in out.escape or not entry[1:].strip():
                        raise _bad(f"malformed escape `{entry}`")
                    out.escape[entry[0]] = entry[1:].lstrip()
        elif line.startswith((f"{sig}+", f"{sig}=")):
            a, arrow, b = line[2:].partition("=>")
            if not arrow or (line[1] == "=" and out.source):
                raise _bad(f"malformed line `{line}`")
            if line[1] == "+":
                out.beside[a.strip()] = b.strip()
            else:
                out.source, out.target = a.strip(), b.strip()
        else:
            raise _bad(f"unexpected line `{line}`")
    if not out.source:
        raise _bad("no source and target")
    return out


_CLASSES = re.compile(r"((?:\.[\w-]+)*)\s*")


def _symbol(text: str, schema: Schema, what: str) -> tuple[str, str]:
    e = schema.longest(text)
    if e is None:
        raise _bad(f"`{what}` names no element of {schema.id}")
    return e.symbol, text[len(e.symbol) :]


def read_pattern(text: str, schema: Schema) -> tuple[Key, tuple[str, ...], str]:
    """``*structure``, ``*solo #``, ``*milestone s``, ``*row +|``, ``# in =``, ``&(term)``; then ``.class`` marks."""
    separator, within = "", ""
    text, has_parent, parent = text.partition(" in ")
    if has_parent:
        within, rest = _symbol(parent.strip(), schema, text)
        if rest:
            raise _bad(f"trailing text after `in {parent}`")
    if m := re.match(r"\*([a-z0-9][a-z0-9-]*)\s*", text):
        name, rest = m[1], text[m.end() :]
        if name in ("solo", "deixis", "row", "cell"):
            symbol, rest = _symbol(rest, schema, text)
            rest = rest.strip()
            if name == "row":
                if not rest:
                    raise _bad("`*row` needs a separator")
                separator, rest = rest[0], rest[1:].strip()
            key: Key = (name, symbol, "")
        elif name in ("milestone", "englossis"):
            arg = re.match(r"[a-z0-9-]*", rest)[0]
            key, rest = (name, arg, ""), rest[len(arg) :].strip()
        elif name in STRUCTURES:
            key = ("structure", name, "")
        else:
            raise _bad(f"unknown structure `*{name}`")
    else:
        symbol, rest = _symbol(text, schema, text)
        term = re.match(r"\(([^)]*)\)", rest)
        key = ("term", symbol, term[1].strip()) if term else ("element", symbol, "")
        rest = rest[term.end() :] if term else rest
    if within:
        if key[0] not in ("element", "structure"):
            raise _bad("`in` applies to an element or a structure")
        key = ("within", key[1] if key[0] == "element" else "*" + key[1], within)
    marks = _CLASSES.fullmatch(rest)
    classes = tuple(marks[1].split(".")[1:]) if marks else ()
    if not marks or not all(map(valid_class, classes)):
        raise _bad(f"unexpected suffix `{rest}` of a pattern")
    return key, classes, separator


def read_template(body: str, sig: str, schema: Schema) -> tuple:
    other = ALIAS if sig == SIGIL else SIGIL
    s = re.escape(sig)
    token = re.compile(rf"{re.escape(other)}{s}|{s}\(\(\s*([!]?)([a-z0-9-]+)(?::([^)]*))?\)\)|{s}\((\??)(!?)([a-z0-9-]+)(?::([^)]*))?\)|{s}\[|\]{s}|{s}")
    out: list = []
    group: list | None = None
    at = 0

    def slot(name: str, placing: bool, raw: bool, prefix: str | None, gate: bool) -> Slot:
        if placing:
            return Slot(name, "place")
        if name in SLOTS:
            return Slot(name, "value", raw, prefix, gate)
        e = schema.named(name)
        if e is None or e.form != "void":
            raise _bad(f"unknown slot `{name}`")
        return Slot(e.symbol, "void", raw, prefix, gate)

    for m in token.finditer(body):
        here = out if group is None else group
        if m.start() > at:
            here.append(body[at : m.start()])
        at = m.end()
        shown = m[0]
        if shown == other + sig:
            here.append(sig)
        elif shown == sig + "[":
            if group is not None:
                raise _bad("conditional sections do not nest")
            group = []
        elif shown == "]" + sig:
            if group is None:
                here.append("]")
                at -= 1
                raise _bad("a section closes that is not open")
            if not any(isinstance(x, Slot) for x in group):
                raise _bad("a conditional section without a slot")
            out.append(tuple(group))
            group = None
        elif shown == sig:
            raise _bad("an unescaped sigil in a template")
        elif m[2]:
            if m[1]:
                raise _bad("a place has no raw form")
            here.append(slot(m[2], False, True, m[3], False))
        else:
            if m[4] and (group is None or m[7] is not None):
                raise _bad("a gate stands alone in a conditional section")
            here.append(slot(m[6], bool(m[5]), False, m[7], bool(m[4])))
    if at < len(body):
        (out if group is None else group).append(body[at:])
    if group is not None:
        raise _bad("a conditional section is not closed")
    return tuple(out)


def hang(value: str, prefix: str) -> str:
    """Lines after the first take the prefix, blank ones without its trailing blanks; a last newline stays."""
    end = "\n" if value.endswith("\n") else ""
    first, *rest = value.removesuffix("\n").split("\n")
    return "\n".join([first, *[prefix + x if x else prefix.rstrip() for x in rest]]) + end


def overlaid(base: RuleTable, over: RuleTable) -> RuleTable:
    """A table whose rules, escapes and files win over those of another."""
    out = RuleTable(base.source, base.target, base.escape | over.escape, {k: list(v) for k, v in base.rules.items()}, base.beside | over.beside, base.assets | over.assets)
    for key, rules in over.rules.items():
        _overlay(out, key, rules)
    return out


def inherit(tables: Mapping[str, RuleTable], schema: Schema, catalog: Catalog, target: str) -> RuleTable:
    """A schema's own rules over those of its parents, renamed to its symbols; later parents win over earlier.

    ``tables`` gives the own rules of a name ``schema.target``.
    """
    out = RuleTable(schema.id, target)
    for parent, kind, words in schema.lineage:
        theirs = inherit(tables, catalog.schema(parent), catalog, target)
        names = catalog.schema(parent).elements
        new = {words[0]: words[-1]} if kind == "import" else {s: s for s in (words if kind == "list" else [s for s in names if not (kind == "exclude" and s in words)])}
        whole = kind in ("full", "exclude")
        out.escape |= theirs.escape if whole else {}
        out.beside |= theirs.beside if whole else {}
        out.assets |= theirs.assets if whole else {}
        for (k, a, b), rules in theirs.rules.items():
            on_symbol = k in ("solo", "deixis", "row", "cell", "element", "term") or (k == "within" and not a.startswith("*"))
            if on_symbol and a not in new or (k == "within" and b not in new) or (not on_symbol and not whole):
                continue
            key = (k, new.get(a, a) if on_symbol else a, new[b] if k == "within" else b)
            _overlay(out, key, rules)
    own = tables.get(f"{schema.id}.{target}")
    return out if own is None else overlaid(out, own)


def _overlay(out: RuleTable, key: Key, rules: list[Rule]) -> None:
    kept = [r for r in out.rules.get(key, []) if all(r.classes != x.classes for x in rules)]
    out.rules[key] = [*kept, *rules]


def render(doc: Document, rules: RuleTable, others: Callable[[str, str], RuleTable] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """The document's text, and (schema, target, text) of embedded parts that go beside it."""
    r = _Renderer(rules, others)
    r.place(doc.blocks)
    body = r.blocks(doc.blocks)
    classes = list(dict.fromkeys(c for b in doc.blocks for c in b.classes))
    top = rules.find(("structure", "document", ""), classes)
    return (r.fill(top, {"grammata": body, "genoses": " ".join(classes), "dialect": doc.schema}) if top else body), r.beside


class _Renderer:
    def __init__(self, rules: RuleTable, others: Callable[[str, str], RuleTable] | None):
        self.rules, self.others = rules, others
        self.beside: list[tuple[str, str, str]] = []
        self.placed: dict[str, str] = {}
        self.slotted = {s.name for rs in rules.rules.values() for r in rs for s in r.slots() if s.kind == "place"}
        self.around: list[str] = []
        self.raw = 0

    # Templates.

    def escaped(self, text: str) -> str:
        table = self.rules.escape
        return text if self.raw or not table else "".join(table.get(c, c) for c in text)

    def fill(self, rule: Rule, values: dict[str, str], hosts: list[Node] = ()) -> str:
        def one(part) -> tuple[str, bool]:
            if isinstance(part, str):
                return part, True
            if isinstance(part, tuple):
                filled = [one(p) for p in part]
                return ("".join(t for t, _ in filled) if all(ok for _, ok in filled) else ""), True
            if part.kind == "place":
                value, plain = self.placed.get(part.name, ""), False
            elif part.kind == "void":
                value, plain = " ".join(n.text for n in hosts if n.kind == "void" and n.symbol == part.name), True
            else:
                if part.name not in values:
                    raise _bad(f"the slot `{part.name}` is not there for this kind of node")
                value, plain = values[part.name], part.name in ESCAPED
            if part.gate:
                return "", bool(value)
            shown = self.escaped(value) if plain and not part.raw else value
            return (hang(shown, part.prefix) if part.prefix is not None else shown), bool(value)

        return "".join(one(p)[0] for p in rule.parts)

    def rule(self, key: Key, classes: list[str]) -> Rule:
        if (found := self.rules.find(key, classes)) is None:
            raise DocumentError("ExoUnhandled", " ".join(x for x in key if x))
        return found

    def quietly(self, on: bool, f: Callable[[], str]) -> str:
        self.raw += on
        try:
            return f()
        finally:
            self.raw -= on

    # Blocks.

    def place(self, seq: list[Node]) -> None:
        for name in self.slotted:
            self.placed[name] = "\n".join(self.block(b) for b in self.embedded(seq, name))

    def embedded(self, seq: list[Node], name: str) -> list[Node]:
        out = []
        for b in seq:
            if b.kind == "embed":
                out += [b] if b.text == name else []
            elif b.kind in ("block", "wrap", "macro"):
                out += self.embedded(b.body, name)
        return out

    def blocks(self, seq: list[Node]) -> str:
        return "\n".join(self.block(b) for b in seq if not (b.kind == "embed" and b.text in self.slotted))

    def notes(self, n: Node) -> dict[str, str]:
        return {"onym": n.anchor or "", "genoses": " ".join(n.classes)}

    def block(self, b: Node) -> str:
        made = {"para": self.paragraph, "block": self.element, "verse": self.verse, "embed": self.embed}.get(b.kind)
        if made:
            return made(b)
        if b.kind == "wrap":
            rule = self.rules.find(("structure", "diaphane", ""), b.classes)
            return self.fill(rule, {"grammata": self.blocks(b.body), **self.notes(b)}) if rule else self.blocks(b.body)
        if b.kind == "raw":
            return self.fill(self.rule(("structure", "verbatim", ""), b.classes), {"content": b.text, **self.notes(b)})
        if b.kind == "media":
            return self.fill(self.rule(("structure", "media", ""), []), {"param": b.text})
        raise DocumentError("Syntax", "rendering takes a canonical document")

    def paragraph(self, b: Node) -> str:
        if len(b.body) == 1 and b.body[0].kind in ("span", "void"):
            n = b.body[0]
            if solo := self.rules.find(("solo", n.symbol, ""), n.classes):
                own = {"param": n.text} if n.kind == "void" else {"grammata": self.held(solo, n.body)}
                return self.fill(solo, {**own, **self.notes(n)}, n.body)
        rule = self.rules.find(("within", "*paragraph", self.around[-1]), []) if self.around else None
        rule = rule or self.rule(("structure", "paragraph", ""), [])
        return self.fill(rule, {"grammata": self.held(rule, b.body)}, b.body)

    def element(self, b: Node) -> str:
        term = b.head[0].text.strip() if len(b.head) == 1 and b.head[0].kind == "text" else None
        rule = self.rules.find(("term", b.symbol, term), b.classes) if term is not None else None
        if rule is None and self.around:
            rule = self.rules.find(("within", b.symbol, self.around[-1]), b.classes)
        rule = rule or self.rule(("element", b.symbol, ""), b.classes)
        children, hosts, voids = list(b.body), list(b.head), rule.voids()
        if children and children[0].kind == "para":
            first = children[0].body
            lead = next((k for k, n in enumerate(first) if n.kind != "void"), len(first))
            hosts += first[:lead]
            if lead and voids:
                kept = [n for n in first if not (n.kind == "void" and n.symbol in voids)]
                if kept and kept[0].kind == "text":
                    kept = [n for n in (Node("text", text=kept[0].text.lstrip()), *kept[1:]) if n.kind != "text" or n.text]
                children[:1] = [Node("para", body=kept, is_block=True)] if kept else []
        self.around.append(b.symbol)
        body = self.quietly(rule.raw("grammata"), lambda: self.blocks(children))
        self.around.pop()
        head = self.quietly(rule.raw("lemma"), lambda: self.held(rule, b.head))
        tail = self.quietly(rule.raw("hypograph"), lambda: self.inlines(b.tail))
        number = "" if b.ordinal is None or b.ordinal < 0 else str(b.ordinal)
        return self.fill(rule, {"lemma": head, "grammata": body, "hypograph": tail, "taxis": number, **self.notes(b)}, hosts)

    def verse(self, b: Node) -> str:
        key: Key = ("element", b.symbol, "") if b.symbol else ("structure", "stichoi", "")
        rule, stanzas = self.rule(key, b.classes), []
        for stanza in b.body:
            if b.symbol and ("row", b.symbol, "") in self.rules.rules:
                stanzas.append("\n".join(self.rows(b.symbol, stanza)))
            else:
                line_rule = self.rule(("structure", "stichos", ""), [])
                lines = [self.fill(line_rule, {"grammata": self.inlines(x)}) for x in stanza]
                stanzas.append(self.fill(self.rule(("structure", "strophe", ""), []), {"grammata": "\n".join(lines)}))
        number = "" if b.ordinal is None or b.ordinal < 0 else str(b.ordinal)
        return self.fill(rule, {"lemma": self.inlines(b.head), "grammata": "\n".join(stanzas), "hypograph": self.inlines(b.tail), "taxis": number, **self.notes(b)})

    def rows(self, symbol: str, lines: list[list[Node]]) -> list[str]:
        """Lines as rows of cells; those above a line of dashes are headers, and that line goes."""
        from quire.model.tables import split_on

        mark = self.rules.rules["row", symbol, ""][0].separator
        is_rule = lambda x: all(n.kind == "text" for n in x) and re.fullmatch(rf"[-+{re.escape(mark)}\s]*-[-+{re.escape(mark)}\s]*", "".join(n.text for n in x))
        ruled = next((k for k, x in enumerate(lines) if is_rule(x)), None)
        out = []
        for k, line in enumerate(lines):
            if k == ruled:
                continue
            classes = ["header"] if ruled is not None and k < ruled else []
            cells = [c for c in split_on(line, mark)]
            for c in cells:
                if c and c[0].kind == "text":
                    c[0].text = c[0].text.lstrip()
                if c and c[-1].kind == "text":
                    c[-1].text = c[-1].text.rstrip()
            shown = "".join(self.fill(self.rule(("cell", symbol, ""), classes), {"grammata": self.inlines(c)}) for c in cells)
            out.append(self.fill(self.rule(("row", symbol, ""), classes), {"cells": shown}))
        return out

    def embed(self, b: Node) -> str:
        rule = self.rules.find(("englossis", b.text, ""), b.classes) or self.rules.find(("structure", "englossis", ""), b.classes) or self.rule(("englossis", "", ""), b.classes)
        beside = self.rules.beside.get(b.text)
        if b.text == self.rules.source and not beside:
            body = self.blocks(b.body)
        else:
            if self.others is None:
                raise DocumentError("UnresolvableExo", f"{b.text}=>{beside or self.rules.target}")
            inner = _Renderer(self.others(b.text, beside or self.rules.target), self.others)
            inner.raw = 0 if beside else self.raw
            inner.place(b.body)
            body = inner.blocks(b.body)
            self.beside += inner.beside
            if beside:
                self.beside.append((b.text, beside, body))
                body = ""
        return self.fill(rule, {"grammata": body, "dialect": b.text, **self.notes(b)})

    # Inlines.

    def held(self, rule: Rule, seq: list[Node]) -> str:
        """Inline content without the void elements that the rule takes as attributes."""
        voids = rule.voids()
        return self.inlines([n for n in seq if not (n.kind == "void" and n.symbol in voids)])

    def inlines(self, seq: list[Node]) -> str:
        return "".join(map(self.inline, seq))

    def inline(self, n: Node) -> str:
        if n.kind == "text":
            rule = self.rules.find(("structure", "text", ""), [])
            return self.fill(rule, {"content": n.text}) if rule else self.escaped(n.text)
        if n.kind == "span":
            rule = self.rule(("element", n.symbol, ""), n.classes)
            body = self.quietly(rule.raw("grammata"), lambda: self.held(rule, n.body))
            return self.fill(rule, {"grammata": body, **self.notes(n)}, n.body)
        if n.kind == "raw":
            return self.fill(self.rule(("structure", "verbatim-inline", ""), n.classes), {"content": n.text, **self.notes(n)})
        if n.kind == "wrap":
            rule = self.rules.find(("structure", "diaphane-inline", ""), n.classes)
            return self.fill(rule, {"grammata": self.held(rule, n.body), **self.notes(n)}, n.body) if rule else self.inlines(n.body)
        if n.kind == "void":
            return self.fill(self.rule(("element", n.symbol, ""), n.classes), {"param": n.text, **self.notes(n)})
        if n.kind == "point":
            rule = self.rules.find(("milestone", n.scheme, ""), n.classes) or self.rule(("milestone", "", ""), n.classes)
            return self.fill(rule, {"scheme": n.scheme, "value": n.text, "genoses": " ".join(n.classes)})
        if n.kind == "anchor":
            return self.fill(self.rule(("structure", "onym-anchor", ""), []), {"onym": n.anchor or ""})
        if n.kind == "ref":
            return self.fill(self.rule(("deixis", n.symbol, ""), n.classes), {"onym": n.text, "genoses": " ".join(n.classes)})
        raise DocumentError("Syntax", "rendering takes a canonical document")
