"""The native markup: text to tree.

Lines are read by a cursor; what opens a block is decided by the run of sigils and the character after it.
Inline text is scanned once from left to right with a stack of open elements; the scanner jumps from one
character of interest to the next by a pattern per closing mark, so it is linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quire.model.names import ALIAS, SIGIL, alphanumeric, symbolic, valid_anchor, valid_class, valid_point
from quire.model.schema import KEYWORD, OPTIONAL, REQUIRED, UNSUPPORTED, Catalog, Element, Schema
from quire.model.tree import AUTO, Document, DocumentError, Node

DEPTH = 256


def parse(text: str, catalog: Catalog) -> Document:
    return Reader(text, catalog).document()


@dataclass
class _Found:
    """An element referred to after a sigil, the length of the reference and the spelled-out name, if it was one."""

    element: Element
    length: int
    name: str | None

    def closing(self, sig: str) -> str:
        return ("{" + self.name + "}" if self.name is not None else self.element.closing()) + sig


class Reader:
    def __init__(self, text: str, catalog: Catalog):
        self.lines = [x.rstrip("\r") for x in text.removeprefix("﻿").split("\n")]
        if self.lines and not self.lines[-1]:
            self.lines.pop()
        self.catalog, self.at, self.depth = catalog, 0, 0
        self.sig, self.other = SIGIL, ALIAS

    def fail(self, kind: str, message: str = "", line: int | None = None):
        raise DocumentError(kind, message, (self.at if line is None else line) + 1, 1)

    # The document's first lines.

    def document(self) -> Document:
        if self.lines and self.lines[0].startswith("#!"):
            self.at = 1
        if self.at >= len(self.lines):
            raise DocumentError("MissingDeclaration")
        line = self.lines[self.at]
        if not line.startswith((SIGIL * 3 + "!", ALIAS * 3 + "!")):
            self.fail("MissingDeclaration")
        if line[0] == ALIAS:
            self.sig, self.other = ALIAS, SIGIL
        name, mark, version = line[4:].rstrip().partition("@")
        if not re.fullmatch(r"[\w-]+", name) or (mark and not re.fullmatch(r"\d+(\.\d+)?", version)):
            self.fail("InvalidDeclaration", line)
        if name == KEYWORD:
            self.fail("InvalidDeclaration", "a definition is not a document")
        schema = self.catalog.schema(name)
        self.at += 1
        return Document(name, version or None, self.blocks(schema, None))

    # Blocks.

    def blocks(self, schema: Schema, close: str | None) -> list[Node]:
        self.depth += 1
        if self.depth > DEPTH:
            self.fail("Syntax", f"nesting exceeds {DEPTH} levels")
        out, opened = [], self.at
        while self.at < len(self.lines):
            line = self.lines[self.at].lstrip()
            if close is not None and line and line.startswith(close):
                break
            if not line:
                self.at += 1
                continue
            start = self.at
            made = self.block(schema, line)
            if made is None:
                made = self.paragraph(schema, close)
            elif made is False:
                continue
            made.start, made.end = start + 1, max(self.at, start + 1)
            out.append(made)
        else:
            if close is not None:
                self.fail("UnmatchedSim", close, max(0, opened - 1))
        self.depth -= 1
        return out

    def block(self, schema: Schema, line: str) -> Node | None | bool:
        """The block that the line opens; None if it is text; False if it was a comment."""
        n = len(line) - len(line.lstrip(self.sig))
        if n > 4:
            self.fail("SigilRunTooLong", str(n))
        rest = line[n:]
        if n in (0, 2):
            return None
        if n == 1:
            if rest.startswith("("):
                return None
            found = self.element(schema, rest, self.at + 1, 1)
            if found is None:
                self.fail("UndefinedSim", self.sig + _symbols(rest))
            if found.element.form != "block" or _points(found.element, rest[found.length :]):
                return None
            return self.element_block(schema, found, rest[found.length :])
        if n == 4:
            if not (rest.startswith("(") and rest.endswith(")")):
                self.fail("Syntax", "malformed media")
            out = Node("media", text=self.parameter(rest[1:-1]), is_block=True)
            self.at += 1
            return out
        return self.core_block(schema, rest)

    def core_block(self, schema: Schema, rest: str) -> Node | None | bool:
        mark, tri, start = rest[:1], self.sig * 3, self.at
        close = mark + tri
        if mark == "/":
            return self.comment(rest[1:].strip(), close)
        if mark == "(" or rest.startswith("+("):
            inner = rest.removeprefix("+")
            if not inner.endswith(")"):
                self.fail("Syntax", "malformed reference")
            target = self.parameter(inner[1:-1])
            self.at += 1
            used = re.fullmatch(r":(.*):", target)
            kind = "use" if used else "include_raw" if mark == "+" else "include"
            return Node(kind, text=used[1] if used else target, verbatim=mark == "+", is_block=True)
        if mark == '"':
            return self.verbatim(rest, close)
        if mark == "=":
            return self.verse(schema, Node("verse", is_block=True), rest[1:].strip(), close, OPTIONAL, start)
        if mark == "!":
            if not (rest.startswith("!(") and rest.endswith(")")):
                self.fail("Syntax", "a declaration stands on the first content line only")
            name = rest[2:-1]
            self.parameter(name)
            inner = self.catalog.schema(name)
            self.at += 1
            return self.closed(Node("embed", text=name, is_block=True, body=self.blocks(inner, close)), close)
        if mark == ".":
            self.at += 1
            return self.closed(Node("wrap", is_block=True, body=self.blocks(schema, close)), close)
        if mark == ":":
            self.at += 1
            body = self.blocks(schema, close)
            named = re.fullmatch(r"\((.*)\)", self.lines[self.at].lstrip()[len(close) :])
            if not named:
                self.fail("Syntax", "a macro names itself at its close")
            if not valid_anchor(named[1]):
                self.fail("InvalidOnym", named[1])
            self.at += 1
            return Node("macro", anchor=named[1], body=body, is_block=True)
        self.fail("UndefinedSim", tri + mark)

    def comment(self, first: str, close: str) -> None | bool:
        """A comment that stands alone is skipped; one with text after its close belongs to a paragraph."""
        if close in first:
            if not first.endswith(close):
                return None
            self.at += 1
            return False
        for k in range(self.at + 1, len(self.lines)):
            line = self.lines[k].strip()
            if close in line:
                if not line.endswith(close):
                    return None
                self.at = k + 1
                return False
        self.fail("UnmatchedSim", self.sig * 3 + "/")

    def verbatim(self, rest: str, close: str) -> Node:
        if rest[1:].strip():
            self.fail("Syntax", "content after a verbatim opener")
        start = self.at
        for k in range(start + 1, len(self.lines)):
            if self.lines[k].lstrip().startswith(close):
                self.at = k
                kept = self.lines[start + 1 : k]
                return self.closed(Node("raw", text="".join(x + "\n" for x in kept), is_block=True), close)
        self.fail("UnmatchedSim", self.sig * 3 + '"', start)

    def closed(self, node: Node, close: str) -> Node:
        scan = self.scanner(self.lines[self.at].lstrip()[len(close) :], self.at)
        scan.annotations(node)
        if scan.text[scan.pos :].strip():
            self.fail("Syntax", f"unexpected content after `{close}`")
        self.at += 1
        return node

    def element_block(self, schema: Schema, found: _Found, rest: str) -> Node:
        e, start = found.element, self.at
        node = Node("block", e.symbol, flips=e.flips, is_block=True)
        if number := re.match(r"\(([^)]*)\)", rest):
            if number[1] and not (number[1].isascii() and number[1].isdigit()):
                self.fail("Syntax", f"invalid ordinal `{number[1]}`")
            node.ordinal = int(number[1]) if number[1] else AUTO
            rest = rest[number.end() :]
        self.component(e, "ordinal", e.ordinal, node.ordinal is not None, start)
        self.component(e, "head", e.head, bool(rest.strip()), start)
        close = found.closing(self.sig)
        if e.body == "stichos":
            node.kind = "verse"
            return self.verse(schema, node, rest.strip(), close, e.tail, start, e)
        node.head = self.inlines(schema, rest.strip(), start)
        self.at += 1
        node.body = self.blocks(schema, close)
        self.close_line(schema, node, close, e.tail, e)
        return node

    def component(self, e: Element | None, what: str, rule: str, there: bool, line: int) -> None:
        if there and rule == UNSUPPORTED:
            self.fail("ComponentViolation", f"`{e.name}` does not support a {what}", line)
        if not there and rule == REQUIRED:
            self.fail("ComponentViolation", f"`{e.name}` requires a {what}", line)

    def close_line(self, schema: Schema, node: Node, close: str, tail: str, e: Element | None) -> None:
        scan = self.scanner(self.lines[self.at].lstrip()[len(close) :], self.at)
        scan.annotations(node)
        text = scan.text[scan.pos :].strip()
        self.component(e, "tail", tail, bool(text), self.at)
        node.tail = self.inlines(schema, text, self.at)
        self.at += 1

    def verse(self, schema: Schema, node: Node, head: str, close: str, tail: str, start: int, e: Element | None = None) -> Node:
        """Lines keep their leading and inner white space; blank lines break stanzas."""
        node.head = self.inlines(schema, head, start)
        stanza: list = []
        self.at += 1
        while True:
            if self.at >= len(self.lines):
                self.fail("UnmatchedSim", self.sig + (node.symbol or self.sig * 2 + "="), start)
            raw = self.lines[self.at]
            if raw.strip().startswith(close):
                break
            if not raw.strip():
                if stanza:
                    node.body.append(stanza)
                    stanza = []
            elif line := self.verse_line(schema, raw):
                stanza.append(line)
            self.at += 1
        if stanza:
            node.body.append(stanza)
        self.close_line(schema, node, close, tail, e)
        return node

    def verse_line(self, schema: Schema, raw: str) -> list[Node]:
        line = self.inlines(schema, raw.rstrip(), self.at)
        if line and line[-1].kind == "text":
            line[-1].text = line[-1].text.rstrip()
            if not line[-1].text:
                line.pop()
        return line

    def paragraph(self, schema: Schema, close: str | None) -> Node:
        start, kept = self.at, []
        while self.at < len(self.lines):
            line = self.lines[self.at].lstrip()
            if not line or (close is not None and line.startswith(close)) or (kept and self.opens(schema, line)):
                break
            kept.append(line)
            self.at += 1
        return Node("para", is_block=True, body=self.inlines(schema, "\n".join(kept), start))

    def opens(self, schema: Schema, line: str) -> bool:
        """Does the line open a block, so that a paragraph ends before it?"""
        n = len(line) - len(line.lstrip(self.sig))
        rest = line[n:]
        if n == 1 and not rest.startswith("("):
            try:
                found = self.element(schema, rest, 0, 0)
            except DocumentError:
                return False
            return found is not None and found.element.form == "block" and not _points(found.element, rest[found.length :])
        if n == 3 and rest[:1] == "/":
            close, first = "/" + self.sig * 3, rest[1:].strip()
            if close in first:
                return first.endswith(close)
            later = next((x.strip() for x in self.lines[self.at + 1 :] if close in x), None)
            return later is None or later.endswith(close)
        return n == 4 or (n == 3 and rest[:1] in tuple('!".:=(+') and rest[:1] != "")

    def parameter(self, raw: str) -> str:
        """A parameter as written outside inline text: escaped spaces decoded, brackets balanced."""
        out = raw.replace(self.other + " ", "\x00")
        if any(c.isspace() for c in out):
            self.fail("MonosimWhitespace", raw)
        depth = 0
        for c in out:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                break
        if depth:
            self.fail("Syntax", "unbalanced parentheses in a parameter")
        return out.replace("\x00", " ")

    # Inline text.

    def element(self, schema: Schema, rest: str, line: int, col: int) -> _Found | None:
        if rest.startswith("{"):
            name, close, _ = rest[1:].partition("}")
            if not close:
                raise DocumentError("Syntax", "unterminated name", line, col)
            e = schema.named(name)
            if e is None:
                raise DocumentError("UndefinedSim", "{" + name + "}", line, col)
            return _Found(e, len(name) + 2, name)
        e = schema.longest(rest)
        return e and _Found(e, len(e.symbol), None)

    def scanner(self, text: str, line: int) -> Scanner:
        return Scanner(self, text, line)

    def inlines(self, schema: Schema, text: str, line: int) -> list[Node]:
        return self.scanner(text, line).run(schema) if text else []


def _symbols(text: str) -> str:
    for k, c in enumerate(text):
        if not symbolic(c):
            return text[:k]
    return text


def _points(e: Element, rest: str) -> bool:
    """A group after a block's symbol that cannot be an ordinal is a cross-reference in running text."""
    group = re.match(r"\(([^)]+)\)", rest)
    return bool(group) and not (e.ordinal != UNSUPPORTED and group[1].isascii() and group[1].isdigit())


#: A parameter without blanks and brackets of its own.
_PLAIN = re.compile(r"([^\s()]*)\)")


class Scanner:
    def __init__(self, reader: Reader, text: str, line: int):
        self.reader, self.text, self.line, self.pos = reader, text, line, 0
        self.sig, self.other = reader.sig, reader.other
        self.patterns: dict[str, re.Pattern] = {}
        self.known: dict[tuple[str, str], _Found | None] = {}

    def fail(self, kind: str, message: str = ""):
        before = self.text[: self.pos]
        raise DocumentError(kind, message, self.line + 1 + before.count("\n"), self.pos - before.rfind("\n"))

    def until(self, mark: str, error: tuple[str, str]) -> str:
        end = self.text.find(mark, self.pos)
        if end < 0:
            self.pos = len(self.text)
            self.fail(*error)
        out = self.text[self.pos : end]
        self.pos = end + len(mark)
        return out

    def name(self, mark: str, what: str) -> str:
        found = self.until(mark, ("Syntax", f"unterminated {what}"))
        if not valid_anchor(found):
            self.fail("InvalidOnym", found)
        return found

    def annotations(self, node: Node) -> None:
        """``(anchor)``, then ``.class`` any number of times, then a separator."""
        if self.text.startswith("(", self.pos):
            self.pos += 1
            node.anchor = self.name(")", "anchor")
        while self.text.startswith(".", self.pos) and self.text[self.pos + 1 : self.pos + 2].isalpha():
            end = self.pos + 1
            while end < len(self.text) and (self.text[end] == "-" or alphanumeric(self.text[end])):
                end += 1
            found = self.text[self.pos + 1 : end]
            self.pos = end
            if not valid_class(found):
                self.fail("InvalidGenos", found)
            node.classes.append(found)
        if self.text.startswith("|", self.pos):
            self.pos += 1

    def run(self, schema: Schema) -> list[Node]:
        text, sig = self.text, self.sig
        top: list[Node] = []
        open_: list[tuple[Node, str, str]] = []  # node, its close, how an error names it
        out, kept, close = top, [], ""

        def flush():
            if kept:
                out.append(Node("text", text="".join(kept)))
                kept.clear()

        while self.pos < len(text):
            if close and text.startswith(close, self.pos):
                flush()
                node = open_.pop()[0]
                self.pos += len(close)
                out = open_[-1][0].body if open_ else top
                close = open_[-1][1] if open_ else ""
                if node.kind == "macro":
                    if not text.startswith("(", self.pos):
                        self.fail("Syntax", "a macro names itself at its close")
                    self.pos += 1
                    node.anchor = self.name(")", "macro name")
                else:
                    self.annotations(node)
                continue
            c = text[self.pos]
            if c == self.other:
                follows = text[self.pos + 1 : self.pos + 2]
                literal = follows in (sig, "|") and follows != ""
                kept.append(follows if literal else c)
                self.pos += 1 + literal
            elif c == "|" and text.startswith(sig, self.pos + 1):
                self.pos += 1
            elif c != sig:
                nxt = self.interest(close).search(text, self.pos + 1)
                end = nxt.start() if nxt else len(text)
                kept.append(text[self.pos : end])
                self.pos = end
            elif self.skipped(n := self.sigils()):
                pass
            else:
                if kept:
                    flush()
                node, mark, shown = self.opening(schema, n)
                out.append(node)
                if mark:
                    open_.append((node, mark, shown))
                    if len(open_) + self.reader.depth > DEPTH:
                        self.fail("Syntax", f"nesting exceeds {DEPTH} levels")
                    out, close = node.body, mark
        if open_:
            self.fail("UnmatchedSim", open_[-1][2])
        flush()
        return top

    def interest(self, close: str) -> re.Pattern:
        if close not in self.patterns:
            marks = {re.escape(self.sig), re.escape(self.other), r"\|"} | ({re.escape(close)} if close else set())
            self.patterns[close] = re.compile("|".join(sorted(marks)))
        return self.patterns[close]

    def sigils(self) -> int:
        n = 0
        while self.text.startswith(self.sig, self.pos + n):
            n += 1
        if n > 4:
            self.fail("SigilRunTooLong", str(n))
        return n

    def skipped(self, n: int) -> bool:
        """Comments inside text: to the end of the line with the white space after it, or up to a close."""
        if not self.text.startswith("/", self.pos + n):
            return False
        if n == 2:
            end = self.text.find("\n", self.pos)
            self.pos = len(self.text) if end < 0 else end
            while self.pos < len(self.text) and self.text[self.pos].isspace():
                self.pos += 1
            return True
        if n == 3:
            self.pos += 4
            self.until("/" + self.sig * 3, ("UnmatchedSim", self.sig * 3 + "/"))
            return True
        return False

    def opening(self, schema: Schema, n: int) -> tuple[Node, str, str]:
        """The node that a sigil opens; with its closing mark if content follows."""
        sig = self.sig
        mark = self.text[self.pos + n : self.pos + n + 1]
        if n == 1:
            return self.anchor() if mark == "(" else self.reference(schema)
        if n == 2:
            return self.core(mark)
        if n == 3 and mark in ("(", "+"):
            self.fail("AnaphorInEndoContext")
        self.fail("Syntax", "a block form inside text")

    def anchor(self) -> tuple[Node, str, str]:
        self.pos += 2
        if not self.text.startswith('"', self.pos):
            return Node("anchor", anchor=self.name(")", "anchor")), "", ""
        self.pos += 1
        scheme, colon, value = self.until('")', ("Syntax", "unterminated coordinate")).partition(":")
        if not colon or not valid_class(scheme) or not valid_point(value):
            self.fail("Syntax", f"invalid coordinate `{scheme}{colon}{value}`")
        node = Node("point", scheme=scheme, text=value)
        self.annotations(node)
        if node.anchor is not None:
            self.fail("Syntax", "a coordinate carries no anchor")
        return node, "", ""

    def reference(self, schema: Schema) -> tuple[Node, str, str]:
        tail = self.text[self.pos + 1 : self.pos + 2]
        if tail == "{":
            end = self.text.find("}", self.pos)
            rest = self.text[self.pos + 1 : end + 1 if end >= 0 else len(self.text)]
            found = self.reader.element(schema, rest, self.line + 1 + self.text.count("\n", 0, self.pos), self.pos + 1)
        else:
            rest = _symbols(self.text[self.pos + 1 : self.pos + 65])
            if (schema.id, rest) not in self.known:
                self.known[schema.id, rest] = self.reader.element(schema, rest, 0, 0)
            found = self.known[schema.id, rest]
        if found is None:
            self.fail("UndefinedSim", self.sig + rest)
        e = found.element
        self.pos += 1 + found.length
        if e.form == "span":
            return Node("span", e.symbol, flips=e.flips), found.closing(self.sig), self.sig + e.symbol
        if not self.text.startswith("(", self.pos):
            if e.form == "void":
                self.fail("Syntax", f"`{self.sig}{e.symbol}` requires a parameter")
            self.fail("EndoMimicsPara")
        self.pos += 1
        if e.form == "void":
            node = Node("void", e.symbol, text=self.parameter())
        else:
            node = Node("ref", e.symbol, text=self.name(")", "cross-reference"))
        self.annotations(node)
        return node, "", ""

    def parameter(self) -> str:
        """Up to the first closing bracket that is not nested; an escaped space is a space."""
        if (m := _PLAIN.match(self.text, self.pos)) and self.other not in m[1]:
            self.pos = m.end()
            return m[1]
        out, depth, bare = [], 0, False
        while self.pos < len(self.text):
            c = self.text[self.pos]
            if c == self.other and self.text.startswith(" ", self.pos + 1):
                out.append(" ")
                self.pos += 2
                continue
            self.pos += 1
            if c == ")" and not depth:
                if bare:
                    self.fail("MonosimWhitespace", "".join(out))
                return "".join(out)
            depth += (c == "(") - (c == ")")
            bare |= c.isspace()
            out.append(c)
        self.fail("Syntax", "unterminated parameter")

    def core(self, mark: str) -> tuple[Node, str, str]:
        two = self.sig * 2
        self.pos += 2 + len(mark)
        if mark == '"':
            node = Node("raw", text=self.until('"' + two, ("UnmatchedSim", two + '"')))
            self.annotations(node)
            return node, "", ""
        if mark in (".", ":"):
            return Node("wrap" if mark == "." else "macro"), mark + two, two + mark
        if mark in ("(", "+"):
            if mark == "+" and not self.text.startswith("(", self.pos):
                self.fail("Syntax", "malformed macro reference")
            self.pos += mark == "+"
            raw = self.until(")", ("Syntax", "unterminated macro reference"))
            used = re.fullmatch(r":(.*):", raw, re.S)
            if not used:
                self.fail("Syntax", f"expected a macro reference, found `({raw})`")
            return Node("use", text=used[1], verbatim=mark == "+"), "", ""
        self.fail("UndefinedSim", two + mark)
