"""Schemas: element definitions, inheritance, vocabularies and localized names.

A definition file is read into a Schema by a catalog, which resolves parents by name: a file ``<id>.lektos``
or ``<id>.dia`` of the catalog first, then the built-in library.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from quire.model.names import ALIAS, SIGIL, symbolic, valid_name
from quire.model.tree import DocumentError, closing_symbol

REQUIRED, OPTIONAL, UNSUPPORTED = "required", "optional", "unsupported"
#: The keyword that files written here declare. Files read may declare any other: what they are shows by their suffix
#: (-hom, -iso, -exo) or by what they hold.
KEYWORD = "quire"
_DECLARATION = re.compile(r"(@@@|\\\\\\)!([^\W_]+)(-[a-z]+)?(?:@\S*)?\s*")
_DEFINES = re.compile(r"(?m)^(?:[@\\](?:=== |==% )|(?:@@|\\\\)::)")


def declared(line: str) -> tuple[str, str, str] | None:
    """(sigil, keyword, suffix) of the line that declares a definition or rule file."""
    m = _DECLARATION.fullmatch(line)
    return m and (m[1][0], m[2], m[3] or "")


def defines(source: str) -> bool:
    """Does a text hold elements, vocabularies or inheritance?"""
    return bool(_DEFINES.search(source))


@dataclass(frozen=True)
class Element:
    """form: span, void or block; the rest describes blocks."""

    name: str
    symbol: str
    form: str
    keyword: str = ""
    ordinal: str = UNSUPPORTED
    head: str = UNSUPPORTED
    tail: str = UNSUPPORTED
    body: str = "grammata"
    autonym: bool = False
    header: bool = False
    flips: bool = True
    parent: str | None = None
    head_vocabulary: str | None = None
    class_vocabulary: str | None = None
    short: str | None = None
    long: str | None = None

    def closing(self) -> str:
        return closing_symbol(self.symbol, self.flips)


@dataclass
class Schema:
    id: str
    elements: dict[str, Element] = field(default_factory=dict)
    lineage: list[tuple] = field(default_factory=list)
    vocabularies: dict[str, dict[str, set[str]]] = field(default_factory=dict)
    localized: dict[str, dict[str, str]] = field(default_factory=dict)

    def named(self, name: str) -> Element | None:
        """The element of that primary or localized name; an ambiguous name is an error."""
        found = {e.symbol for e in self.elements.values() if e.name == name}
        found |= {s for names in self.localized.values() for s, n in names.items() if n == name}
        if len(found) > 1:
            raise DocumentError("Syntax", f"element name `{name}` has several elements")
        return self.elements[found.pop()] if found else None

    def longest(self, run: str) -> Element | None:
        """The longest defined symbol that the text's run of symbolic characters starts with."""
        n = next((k for k, c in enumerate(run) if not symbolic(c)), len(run))
        return next((self.elements[run[:k]] for k in range(n, 0, -1) if run[:k] in self.elements), None)

    def term(self, vocabulary: str | None, value: str) -> str:
        """A vocabulary's term for a value: itself, or that of its alias in any case; else the value."""
        terms = self.vocabularies.get(vocabulary or "", {})
        if value in terms:
            return value
        low = value.lower()
        return next((t for t in sorted(terms) if low in terms[t]), value)


class Catalog:
    """Named texts, with schemas resolved from them; ``library`` makes those that no text defines."""

    def __init__(self, texts: Mapping[str, str] | None = None, library: Mapping[str, Callable[[Catalog], Schema]] | None = None):
        from quire.model import library as built_in

        self.texts = dict(texts or {})
        self.library = built_in.SCHEMAS if library is None else library
        self._known: dict[str, Schema] = {}

    def schema(self, name: str, stack: tuple[str, ...] = ()) -> Schema:
        name = name.split("@")[0]
        if name in stack:
            raise DocumentError("InvalidLektos", "inheritance cycle: " + " > ".join((*stack, name)))
        if name not in self._known:
            source = next((self.texts[f"{name}{e}"] for e in (".lektos", ".dia") if f"{name}{e}" in self.texts), None)
            if source is not None:
                self._known[name] = read_definition(source, name, self, (*stack, name))
            elif name in self.library:
                self._known[name] = self.library[name](self)
            else:
                raise DocumentError("UnresolvableDialektos", name)
        return self._known[name]


def _bad(message: str, line: int) -> DocumentError:
    return DocumentError("InvalidLektos", message, line, 1)


class _Lines:
    def __init__(self, text: str):
        self.all = [x.removesuffix("\r") for x in text.removeprefix("﻿").split("\n")]
        self.at = 0

    def more(self) -> bool:
        return self.at < len(self.all)

    def peek(self) -> str:
        return self.all[self.at].strip()

    def next(self) -> str:
        self.at += 1
        return self.all[self.at - 1].strip()


def read_definition(source: str, name: str, catalog: Catalog, stack: tuple[str, ...] = ()) -> Schema:
    src = _Lines(source)
    if src.more() and src.peek().startswith("#!"):
        src.next()
    opening = src.next() if src.more() else ""
    if not opening.startswith((SIGIL * 3 + "!", ALIAS * 3 + "!")):
        raise DocumentError("MissingDeclaration", "", src.at, 1)
    if (found := declared(opening)) is None or found[2]:
        raise _bad(f"`{opening[4:]}` declares no definition", src.at)
    sig = found[0]
    out = Schema(name)
    while src.more():
        line = src.next()
        if not line or (line.startswith(sig * 2 + "/") and not line.startswith(sig * 3)):
            continue
        if line.startswith(sig * 3 + "/"):
            _skip_comment(src, line, sig)
        elif line.startswith(sig * 2 + "::"):
            _inherit(out, line[4:], catalog, stack, src.at)
        elif line.startswith(f"{sig}==% "):
            _vocabulary(out, line[5:].strip(), src, sig)
        elif line.startswith(f"{sig}=== "):
            element = _element(line[5:].strip(), src, sig)
            _add(out, element, src.at)
        else:
            raise _bad(f"unexpected line `{line}`", src.at)
    for e in out.elements.values():
        for v in (e.head_vocabulary, e.class_vocabulary):
            if v and v not in out.vocabularies:
                raise _bad(f"element `{e.name}` binds the undefined vocabulary `{v}`", src.at)
    return out


def _skip_comment(src: _Lines, line: str, sig: str) -> None:
    close, at = "/" + sig * 3, src.at
    while not line[4:].endswith(close) if src.at == at else not line.endswith(close):
        if not src.more():
            raise DocumentError("UnmatchedSim", sig * 3 + "/", at, 1)
        line = src.next()


def _add(out: Schema, element: Element, line: int) -> None:
    if element.symbol in out.elements:
        raise DocumentError("SimConflict", element.symbol, line, 1)
    out.elements[element.symbol] = element


def _inherit(out: Schema, spec: str, catalog: Catalog, stack: tuple[str, ...], line: int) -> None:
    """``name``, ``name:-:[a b]``, ``name::a``, ``name::a alias`` or ``name::[a b]``."""
    parent_name, kind, rest = spec.strip(), "full", ""
    if ":-:" in spec:
        parent_name, _, rest = spec.partition(":-:")
        kind = "exclude"
    elif "::" in spec:
        parent_name, _, rest = spec.partition("::")
        kind = "list" if rest.strip().startswith("[") else "import"
    parent_name = parent_name.strip().split("@")[0]
    parent, rest = catalog.schema(parent_name, stack), rest.strip()
    listed: list[str] = []
    if kind in ("exclude", "list"):
        if not (rest.startswith("[") and rest.endswith("]")):
            raise _bad(f"expected a list of symbols, found `{rest}`", line)
        listed = rest[1:-1].split()
    if kind == "import":
        listed = rest.split()
        if not 1 <= len(listed) <= 2:
            raise _bad(f"malformed import `{rest}`", line)
        if len(listed) == 2 and not all(symbolic(c) and c not in "{}" for c in listed[1]):
            raise _bad(f"`{listed[1]}` cannot be a symbol", line)
    bring(out, parent, kind, tuple(listed), line)


def bring(out: Schema, parent: Schema, kind: str = "full", words: tuple[str, ...] = (), line: int = 0) -> None:
    """Takes over a parent's elements (kind: all, all but some, some, or one under a new symbol) with their names and terms."""
    if kind == "import":
        brought = {words[0]: words[-1]}
    elif kind == "list":
        brought = {s: s for s in words}
    else:
        brought = {s: s for s in parent.elements if s not in words}
    for old, new in brought.items():
        if old not in parent.elements:
            raise DocumentError("UndefinedSim", old, line, 1)
        _add(out, replace(parent.elements[old], symbol=new), line)
    for language, names in parent.localized.items():
        mine = out.localized.setdefault(language, {})
        for old, new in brought.items():
            if old in names:
                mine.setdefault(new, names[old])
    bound = {v for s in brought.values() for v in (out.elements[s].head_vocabulary, out.elements[s].class_vocabulary)}
    for v, terms in parent.vocabularies.items():
        if kind in ("full", "exclude") or v in bound:
            mine = out.vocabularies.setdefault(v, {})
            for t, aliases in terms.items():
                mine.setdefault(t, set()).update(aliases)
    out.lineage.append((parent.id, kind, words))


def _vocabulary(out: Schema, name: str, src: _Lines, sig: str) -> None:
    terms = out.vocabularies.setdefault(name, {})
    while True:
        if not src.more():
            raise _bad(f"unterminated vocabulary `{name}`", src.at)
        line = src.next()
        if line == f"%=={sig}":
            break
        if line:
            term, colon, aliases = line.partition(":")
            if not colon or not term.strip():
                raise _bad(f"vocabulary `{name}`: malformed line `{line}`", src.at)
            terms.setdefault(term.strip(), set()).update(a.lower() for a in aliases.split())
    owner: dict[str, str] = {}
    for t in sorted(terms):
        for a in terms[t]:
            if owner.setdefault(a, t) != t:
                raise _bad(f"vocabulary `{name}`: alias `{a}` is claimed by `{owner[a]}` and `{t}`", src.at)


_HEADS = {"": UNSUPPORTED, "lemma": REQUIRED, "[lemma]": OPTIONAL}
_TAILS = {"": UNSUPPORTED, "hypograph": REQUIRED, "[hypograph]": OPTIONAL}
_BODIES = ("grammata", "stichos", "rows", "cells")
_KEYWORD = re.compile(r"\((?!taxis\))([A-Za-z0-9-]+)\)\s*$")


def _element(name: str, src: _Lines, sig: str) -> Element:
    """An example of the element, then its properties, up to the block's close."""
    if not valid_name(name):
        raise _bad(f"`{name}` is no element name", src.at)
    while src.more() and not src.peek():
        src.next()
    if not src.more():
        raise _bad(f"element `{name}` has no example", src.at)
    shown, at = src.next(), src.at
    if not shown.startswith(sig):
        raise _bad(f"element `{name}`: its example starts with the sigil", at)
    shown, n = shown[1:], 0
    while n < len(shown) and symbolic(shown[n]):
        rest = shown[n:]
        if rest.startswith(("(taxis)", "[(taxis)]")) or _KEYWORD.match(rest):
            break
        n += 1
    symbol, rest = shown[:n], shown[n:]
    if not symbol or "{" in symbol or "}" in symbol:
        raise _bad(f"element `{name}`: no valid symbol", at)
    closers = [(closing_symbol(symbol, f) + sig, f) for f in (True, False)]
    if keyword := _KEYWORD.match(rest):
        made = Element(name, symbol, "void", keyword=keyword[1])
    elif flips := next(([f] for c, f in closers if rest.rstrip().endswith(c) and "grammata" in rest.rstrip()[: -len(c)]), None):
        made = Element(name, symbol, "span", flips=flips[0])
    else:
        made = _block_element(name, symbol, rest, closers, src, at)
    return _properties(made, src, sig, at)


def _block_element(name: str, symbol: str, rest: str, closers: list, src: _Lines, at: int) -> Element:
    ordinal = UNSUPPORTED
    for mark, value in (("(taxis)", REQUIRED), ("[(taxis)]", OPTIONAL)):
        if rest.startswith(mark):
            ordinal, rest = value, rest[len(mark) :]
    head, vocabulary = rest.strip(), None
    if bound := re.fullmatch(r"(\[?)lemma=(.*?)(\]?)", head):
        vocabulary, head = bound[2].strip(), f"{bound[1]}lemma{bound[3]}"
        if not vocabulary:
            raise _bad(f"element `{name}`: `lemma=` names no vocabulary", at)
    if head not in _HEADS:
        raise _bad(f"element `{name}`: unexpected header `{head}`", at)
    inside: list[str] = []
    while True:
        if not src.more():
            raise _bad(f"element `{name}`: its closing line is missing", at)
        line = src.next()
        if close := next(((c, f) for c, f in closers if line.startswith(c)), None):
            break
        if line:
            inside.append(line)
    body = inside[-1] if inside else ""
    marks = inside[:-1]
    header = "header" in marks
    if unknown := [m for m in marks if m not in ("autonym", "header")]:
        raise _bad(f"element `{name}`: unknown property `{unknown[0]}`", at)
    if body not in _BODIES and not header:
        raise _bad(f"element `{name}`: expected one of {', '.join(_BODIES)}", at)
    if header and body != "cells":
        raise _bad(f"element `{name}`: `header` belongs to cells", at)
    tail = line[len(close[0]) :].strip()
    if tail not in _TAILS:
        raise _bad(f"element `{name}`: unexpected content `{tail}` at its close", src.at)
    return Element(name, symbol, "block", ordinal=ordinal, head=_HEADS[head], tail=_TAILS[tail], body=body, autonym="autonym" in marks, header=header, flips=close[1], head_vocabulary=vocabulary)


def _properties(made: Element, src: _Lines, sig: str, at: int) -> Element:
    while src.more():
        line = src.next()
        if line == "===" + sig:
            return made
        if not line:
            continue
        if line.startswith(f"{sig}% "):
            if not line[2:].strip():
                raise _bad(f"element `{made.name}`: `{sig}%` names no vocabulary", src.at)
            made = replace(made, class_vocabulary=line[2:].strip())
        elif line.startswith(f'{sig}""'):
            close, text = f'""{sig}', line[3:]
            if text.endswith(close):
                made = replace(made, long=text.removesuffix(close).strip())
                continue
            kept: list[str] = []
            while True:
                if not src.more():
                    raise DocumentError("UnmatchedSim", f'{sig}""', src.at, 1)
                raw = src.all[src.at]
                if src.next() == close:
                    break
                kept.append(raw)
            made = replace(made, long="\n".join(kept).strip())
        elif line.startswith(f'{sig}"'):
            if not line.endswith(f'"{sig}') or len(line) < 4:
                raise _bad(f"element `{made.name}`: malformed description", src.at)
            made = replace(made, short=line[2:-2].strip())
        elif line.startswith(f"{sig}^("):
            if not line.endswith(")"):
                raise _bad(f"element `{made.name}`: malformed parent", src.at)
            made = replace(made, parent=line[3:-1])
        else:
            raise _bad(f"element `{made.name}`: unexpected content `{line}`", src.at)
    raise DocumentError("UnmatchedSim", f"{sig}=== {made.name}", at, 1)


def read_localized(source: str) -> tuple[str, str, dict[str, str]]:
    """(schema, language, symbol to name) of a glossary; no symbol or name occurs twice."""
    lines = [x.strip() for x in source.split("\n")]
    header = next((x for x in lines if "=>" in x), "")
    schema, _, language = header.lstrip("@\\=").partition("=>")
    names: dict[str, str] = {}
    for x in lines[lines.index(header) + 1 :] if header else []:
        if x and not x.startswith(("@@/", "\\\\/")):
            symbol, _, name = x.partition(" ")
            if symbol in names or name.strip() in names.values():
                raise DocumentError("InvalidGlossa", x)
            names[symbol] = name.strip()
    return schema.strip(), language.strip(), names


def write_definition(schema: Schema, keyword: str = KEYWORD) -> str:
    """The canonical definition: all elements, inherited ones included, by name and then symbol."""
    out = [f"{SIGIL * 3}!{keyword}\n"]
    for e in sorted(schema.elements.values(), key=lambda e: (e.name.encode(), e.symbol.encode())):
        out.append("\n".join(_shown(e)) + "\n")
    for name in sorted(schema.vocabularies):
        terms = schema.vocabularies[name]
        listed = "".join(f"{t}:{''.join(' ' + a for a in sorted(terms[t]))}\n" for t in sorted(terms))
        out.append(f"{SIGIL}==% {name}\n{listed}%=={SIGIL}\n")
    return "\n".join(out)


def _shown(e: Element) -> list[str]:
    close = e.closing() + SIGIL
    lines = [f"{SIGIL}=== {e.name}"]
    if e.form == "void":
        lines.append(f"{SIGIL}{e.symbol}({e.keyword})")
    elif e.form == "span":
        lines.append(f"{SIGIL}{e.symbol} grammata {close}")
    else:
        ordinal = {REQUIRED: "(taxis)", OPTIONAL: "[(taxis)]"}.get(e.ordinal, "")
        word = "lemma" + (f"={e.head_vocabulary}" if e.head_vocabulary else "")
        head = {REQUIRED: f" {word}", OPTIONAL: f" [{word}]"}.get(e.head, "")
        tail = {REQUIRED: " hypograph", OPTIONAL: " [hypograph]"}.get(e.tail, "")
        lines += [f"{SIGIL}{e.symbol}{ordinal}{head}", *(["autonym"] if e.autonym else []), *(["header"] if e.header else []), e.body, close + tail]
    if e.class_vocabulary:
        lines.append(f"{SIGIL}% {e.class_vocabulary}")
    if e.short is not None:
        lines.append(f'{SIGIL}"{e.short}"{SIGIL}')
    if e.long is not None:
        lines += [f'{SIGIL}""', *e.long.split("\n"), f'""{SIGIL}']
    if e.parent:
        lines.append(f"{SIGIL}^({e.parent})")
    return [*lines, f"==={SIGIL}"]
