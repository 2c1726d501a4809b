"""Org, Djot and reStructuredText to document trees: a table of block openers over a line cursor, a table of inline marks."""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Callable

from quire.model.tree import Document, DocumentError, Node

NESTING = 64
_OPENERS = " \t\n\r([{\"'"


class Lines:
    def __init__(self, text: str):
        self.all = [x.removesuffix("\r") for x in text.split("\n")]
        self.at = 0

    def __bool__(self) -> bool:
        return self.at < len(self.all)

    @property
    def now(self) -> str:
        return self.all[self.at].rstrip()

    def take(self) -> str:
        self.at += 1
        return self.all[self.at - 1].rstrip()

    def while_(self, test: Callable[[str], bool]) -> list[str]:
        out = []
        while self and test(self.all[self.at]):
            out.append(self.take())
        return out


def _block(symbol: str, body: list, **more) -> Node:
    return Node("block", symbol, body=body, is_block=True, **more)


def _para(run: list[Node]) -> Node:
    return Node("para", body=run, is_block=True)


def link(url: str) -> Node:
    return Node("span", "><", body=[Node("text", text=url)])


class Format:
    """Subclasses give ``openers`` (pattern, method) and ``marks`` (character, method)."""

    name = schema = ""
    openers: list[tuple[str, str]] = []
    marks: dict[str, list[str]] = {}

    def __init__(self, depth: int = 1):
        if depth > NESTING:
            self.fail(f"nesting exceeds {NESTING} levels")
        self.depth = depth
        self.stops = re.compile("[" + "".join(re.escape(c) for c in self.marks) + "]")
        self.compiled = [(re.compile(p), getattr(self, m)) for p, m in self.openers]

    def fail(self, message: str):
        raise DocumentError("Syntax", f"{self.name} import: {message}")

    def document(self, text: str) -> Document:
        return Document(self.schema, blocks=self.blocks(text))

    def inner(self, lines: list[str]) -> list[Node]:
        return type(self)(self.depth + 1).blocks("\n".join(lines))

    def blocks(self, text: str) -> list[Node]:
        lines, out, loose = Lines(text), [], []

        def settle() -> None:
            if loose and (run := self.inlines(" ".join(loose))):
                out.append(_para(run))
            loose.clear()

        while lines:
            line = lines.now
            if not line.strip():
                settle()
                lines.take()
                continue
            for pattern, f in self.compiled:
                if (m := pattern.match(line)) and (made := f(m, lines)) is not None:
                    settle()
                    out.extend(made)
                    break
            else:
                loose.append(lines.take().strip())
        settle()
        return out

    # Inline text.

    def inlines(self, text: str, depth: int = 1) -> list[Node]:
        if depth > NESTING:
            self.fail(f"nesting exceeds {NESTING} levels")
        scan = Scan(text, depth)
        out: list[Node] = []
        kept: list[str] = []
        at = 0
        while at < len(text):
            for f in self.marks.get(text[at], ()):
                found = getattr(self, f)(scan, at)
                if found is not None:
                    nodes, at = found
                    if isinstance(nodes, str):
                        kept.append(nodes)
                    else:
                        if kept:
                            out.append(Node("text", text="".join(kept)))
                            kept = []
                        out.extend(nodes)
                    break
            else:
                following = self.stops.search(text, at + 1)
                end = following.start() if following else len(text)
                kept.append(text[at:end])
                at = end
        if kept:
            out.append(Node("text", text="".join(kept)))
        return out

    def paired(self, scan: Scan, at: int):
        """A mark with its partner: opened after a blank or bracket, closed before a blank or punctuation."""
        text, mark = scan.text, scan.text[at]
        if (at and text[at - 1] not in _OPENERS) or text[at + 1 : at + 2].strip() in ("", mark):
            return None
        end = scan.closing(mark, at + 1)
        if end < 0:
            return None
        inside = text[at + 1 : end]
        if mark in self.literal:
            return [Node("raw", text=inside)], end + 1
        return [Node("span", mark, body=self.inlines(inside, scan.depth + 1))], end + 1

    literal = ""


class Scan:
    """Searches that remember, so that unclosed marks cost one pass in all."""

    def __init__(self, text: str, depth: int):
        self.text, self.depth = text, depth
        self.places: dict[str, list[int]] = {}
        self.gone: dict[str, int] = {}

    def find(self, mark: str, start: int) -> int:
        if start >= self.gone.get(mark, len(self.text) + 1):
            return -1
        at = self.text.find(mark, start)
        if at < 0:
            self.gone[mark] = start
        return at

    def closing(self, mark: str, start: int) -> int:
        """The next mark after a character that is no blank and before a blank, punctuation or the end."""
        return self.place(rf"(?<=\S){re.escape(mark)}(?=\s|[{re.escape(string.punctuation)}]|$)", start)

    def place(self, pattern: str, start: int) -> int:
        """The first match at or after a place; all matches are found once."""
        if pattern not in self.places:
            self.places[pattern] = [m.start() for m in re.finditer(pattern, self.text)]
        rest = self.places[pattern]
        k = bisect_left(rest, start)
        return rest[k] if k < len(rest) else -1


class Org(Format):
    name, schema = "org", "at-org"
    literal = "=~"
    openers = [
        (r"(\*{1,5}) (.*)", "heading"),
        (r"#\+(\w+):?\s*(.*)", "keyword"),
        (r"#\+", "skipped"),
        (r"\s*\[\[file:([^\]]+)\]\]$", "media"),
        (r"\s*\|", "table"),
        (r"\[fn:([A-Za-z0-9]+)\]\s*(.*)", "note"),
        (r"\s*- (.*)", "item"),
        (r"\s*([0-9]+)[.)] (.*)", "ordered"),
    ]
    marks = {"[": ["linked", "callout"], "<": ["anchor"], **{c: ["paired"] for c in "*/_+=~"}}

    def heading(self, m, lines):
        lines.take()
        return [_para([Node("span", "#" * len(m[1]), body=self.inlines(m[2].strip()))])]

    def skipped(self, m, lines):
        lines.take()
        return []

    def keyword(self, m, lines):
        word = m[1].upper()
        if m[1] in ("TITLE", "title"):
            lines.take()
            return [_para([Node("span", "#", body=self.inlines(m[2].strip()))])]
        if not word.startswith(("BEGIN_", "END_")):
            lines.take()
            return []
        kind = word.removeprefix("BEGIN_")
        if kind not in ("SRC", "EXAMPLE", "QUOTE", "VERSE"):
            self.fail(f"unsupported block `#+{m[1]}`")
        lines.take()
        body = self.body(lines, kind)
        if kind == "QUOTE":
            return [_block(">", self.inner(body), flips=False)]
        if kind == "VERSE":
            stanzas: list[list] = [[]]
            for line in body:
                if line.strip():
                    stanzas[-1].append(self.inlines(line))
                elif stanzas[-1]:
                    stanzas.append([])
            return [Node("verse", "~", body=[s for s in stanzas if s], is_block=True)]
        language = m[2].split()[:1] if kind == "SRC" else []
        return [Node("raw", text="\n".join(body), classes=[x.lower() for x in language], is_block=True)]

    def body(self, lines, kind):
        """Lines up to the end of the block; quotations nest."""
        out, depth = [], 0
        while lines:
            raw = lines.all[lines.at]
            lines.at += 1
            upper = raw.strip().upper()
            if upper.startswith(f"#+END_{kind}"):
                if not depth:
                    return out
                depth -= 1
            elif kind == "QUOTE" and upper.startswith("#+BEGIN_QUOTE"):
                depth += 1
            out.append(raw)
        self.fail(f"unterminated #+BEGIN_{kind}")

    def media(self, m, lines):
        lines.take()
        return [Node("media", text=m[1], is_block=True)]

    def table(self, m, lines):
        rows = lines.while_(lambda x: x.lstrip().startswith("|"))
        return [Node("verse", "|", body=[[[Node("text", text=r.strip())] for r in rows]], is_block=True)]

    def note(self, m, lines):
        lines.take()
        more = lines.while_(lambda x: x[:1].isspace() and bool(x.strip()))
        return [_block("^", [_para(self.inlines(" ".join([m[2].strip(), *[x.strip() for x in more]])))], anchor=m[1])]

    def rest(self, first, lines):
        lines.take()
        more = lines.while_(lambda x: x.startswith("  ") and x.strip() and not re.match(r"\s*(- |[0-9]+[.)] )", x))
        return " ".join([first.strip(), *[x.strip() for x in more]])

    def item(self, m, lines):
        text = self.rest(m[1], lines)
        term, colons, told = text.partition(" :: ")
        if colons:
            return [_block("::", [_para(self.inlines(told))], head=self.inlines(term))]
        return [_block("-", [_para(self.inlines(text))])]

    def ordered(self, m, lines):
        return [_block(".", [_para(self.inlines(self.rest(m[2], lines)))], ordinal=int(m[1]))]

    def linked(self, scan, at):
        if not scan.text.startswith("[[", at) or (end := scan.find("]]", at + 2)) < 0:
            return None
        middle = scan.find("][", at + 2)
        if 0 <= middle < end:
            target, told = scan.text[at + 2 : middle], scan.text[middle + 2 : end]
            return [Node("text", text=f"{told} ("), link(target), Node("text", text=")")], end + 2
        target = scan.text[at + 2 : end]
        return None if "]" in target else ([link(target)], end + 2)

    def callout(self, scan, at):
        m = re.compile(r"\[fn:([A-Za-z0-9]+)\]").match(scan.text, at)
        return m and ([Node("ref", "^", text=m[1])], m.end())

    def anchor(self, scan, at):
        m = re.compile(r"<<([^\s<>]+)>>(?!>)").match(scan.text, at)
        return ([Node("anchor", anchor=m[1])], m.end()) if m and scan.text[at - 1 : at] != "<" else None


class Djot(Format):
    name, schema = "djot", "at-djot"
    openers = [
        (r"(#{1,6}) (.*)", "heading"),
        (r"(`{3,})(.*)", "fence"),
        (r">", "quote"),
        (r"\[\^([^\s\[\]]+)\]:(.*)", "note"),
        (r"- (.*)", "item"),
        (r"([0-9]+)[.)] (.*)", "ordered"),
    ]
    marks = {"\\": ["escape"], "`": ["code"], "_": ["paired"], "*": ["paired"], "<": ["auto"], "[": ["callout", "linked"]}

    def heading(self, m, lines):
        lines.take()
        return [_para([Node("span", m[1], body=self.inlines(m[2].strip()))])]

    def fence(self, m, lines):
        lines.take()
        closes = lambda x: len(x.rstrip()) >= len(m[1]) and not x.rstrip().strip("`")
        start = lines.at
        lines.while_(lambda x: not closes(x))
        if not lines:
            self.fail("unterminated code fence")
        body = lines.all[start : lines.at]
        lines.take()
        return [Node("raw", text="\n".join(body), classes=[m[2].strip().lower()] if m[2].strip() else [], is_block=True)]

    def quote(self, m, lines):
        return [_block(">", self.inner([x[2:] if x.startswith("> ") else x[1:] for x in lines.while_(lambda x: x.startswith(">"))]), flips=False)]

    def note(self, m, lines):
        lines.take()
        inside, indented = [m[2].strip()], lambda x: x[:1] in (" ", "\t") and bool(x.strip())
        while lines:
            follows = lines.at + 1 < len(lines.all) and indented(lines.all[lines.at + 1])
            if not indented(lines.all[lines.at]) and (lines.now.strip() or not follows):
                break
            inside.append(lines.take().strip())
        return [_block("^", self.inner(inside), anchor=m[1])]

    def item(self, m, lines):
        lines.take()
        return [_block("-", [_para(self.inlines(m[1].strip()))])]

    def ordered(self, m, lines):
        lines.take()
        return [_block(".", [_para(self.inlines(m[2].strip()))], ordinal=int(m[1]))]

    def escape(self, scan, at):
        c = scan.text[at + 1 : at + 2]
        return (c, at + 2) if c and c in string.punctuation else None

    def code(self, scan, at):
        end = scan.find("`", at + 1)
        return None if end < 0 else ([Node("raw", text=scan.text[at + 1 : end])], end + 1)

    def auto(self, scan, at):
        m = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]+)>").match(scan.text, at)
        return m and ([link(m[1])], m.end())

    def callout(self, scan, at):
        m = re.compile(r"\[\^([^\s\[\]]+)\]").match(scan.text, at)
        return m and ([Node("ref", "^", text=m[1])], m.end())

    def linked(self, scan, at):
        text = scan.text
        if text[at - 1 : at] == "!" and at or text.startswith("[^", at):
            return None
        middle = scan.find("]", at + 1)
        if middle < 0 or not text.startswith("(", middle + 1) or (end := scan.find(")", middle + 2)) < 0:
            return None
        told, url = text[at + 1 : middle], text[middle + 2 : end].strip()
        if url and told.strip() in ("", url):
            return [link(url)], end + 1
        shown = self.inlines(told, scan.depth + 1)
        return (shown if not url else [*shown, Node("text", text=" ("), link(url), Node("text", text=")")]), end + 1


#: Underlines of headings by level (fixed values).
ADORNMENTS = "=-~^\"'"


class Rst(Format):
    name, schema = "rst", "at-rst"
    openers = [
        (r"\.\. (.*)", "directive"),
        (r":([^\s:]+): (.*)", "field"),
        (r"(?! )(.*)", "heading"),
        (r"- (.*)", "item"),
        (r"([0-9]+)\. (.*)", "ordered"),
        (r"::$", "literal"),
        (r"   ", "quote"),
        (r"(?! )(.*)", "definition"),
        (r" {1,2}(\S.*)", "alone"),
    ]
    marks = {"\\": ["escape"], "`": ["code", "linked"], "[": ["callout"], "*": ["stars"]}

    def indented(self, lines: Lines, skip_blank: bool = False, by: int = 3) -> list[str]:
        """The lines indented from here, single blank lines between them included, without the indent."""
        lead, out = " " * by, []
        if skip_blank and lines and not lines.now.strip():
            lines.at += 1
        while lines:
            raw = lines.all[lines.at]
            follows = lines.at + 1 < len(lines.all) and lines.all[lines.at + 1].startswith(lead)
            if not raw.startswith(lead) and (raw.strip() or not follows):
                break
            out.append(raw[by:] if raw.startswith(lead) else "")
            lines.at += 1
        return out

    def directive(self, m, lines):
        lines.take()
        rest = m[1]
        if rest in ("note::", "warning::"):
            return [_block("!" if rest[0] == "n" else "!!", self.inner(self.indented(lines, True)))]
        if rest.startswith("image:: "):
            return [Node("media", text=rest[8:].strip(), is_block=True)]
        if note := re.match(r"\[#(.*?)\] (.*)", rest):
            return [_block("^", self.inner([note[2], *self.indented(lines)]), anchor=note[1])]
        self.fail(f"unsupported directive `{m[0]}`")

    def field(self, m, lines):
        lines.take()
        return [_block(":", self.inner([m[2].strip(), *self.indented(lines)]), head=self.inlines(m[1]))]

    def heading(self, m, lines):
        under = lines.all[lines.at + 1] if lines.at + 1 < len(lines.all) else ""
        if len(under) < 3 or under[0] not in ADORNMENTS or under.strip(under[0]) or len(under) < min(4, len(m[1])):
            return None
        lines.at += 2
        return [_para([Node("span", "#" * (ADORNMENTS.index(under[0]) + 1), body=self.inlines(m[1]))])]

    def item(self, m, lines):
        lines.take()
        return [_block("-", self.inner([m[1], *self.indented(lines, by=2)]))]

    def ordered(self, m, lines):
        lines.take()
        return [_block(".", self.inner([m[2], *self.indented(lines)]), ordinal=int(m[1]))]

    def literal(self, m, lines):
        lines.take()
        return [Node("raw", text="".join(x + "\n" for x in self.indented(lines, True)), is_block=True)]

    def quote(self, m, lines):
        return [_block(">", self.inner(self.indented(lines)), flips=False)]

    def definition(self, m, lines):
        if lines.at + 1 >= len(lines.all) or not lines.all[lines.at + 1].startswith("   "):
            return None
        lines.take()
        return [_block("::", self.inner(self.indented(lines)), head=self.inlines(m[1]))]

    def alone(self, m, lines):
        return [_para(self.inlines(lines.take()))]

    escape = Djot.escape

    def code(self, scan, at):
        end = scan.find("``", at + 2) if scan.text.startswith("``", at) else -1
        return None if end < 0 else ([Node("raw", text=scan.text[at + 2 : end])], end + 2)

    def linked(self, scan, at):
        end = scan.find("`_", at + 1)
        m = re.fullmatch(r"(|[^`]*\s)<([^\s<>`]*[^\s<>`_])>", scan.text[at + 1 : end]) if end >= 0 else None
        if m is None:
            return None
        told, url = m[1].strip(), m[2]
        after = end + 2 + scan.text.startswith("_", end + 2)
        shown = [link(url)] if told in ("", url) else [*self.inlines(told, scan.depth + 1), Node("text", text=" ("), link(url), Node("text", text=")")]
        return shown, after

    def callout(self, scan, at):
        end = scan.find("]_", at + 2) if scan.text.startswith("[#", at) else -1
        return None if end < 0 else ([Node("ref", "^", text=scan.text[at + 2 : end])], end + 2)

    def stars(self, scan, at):
        n = 2 if scan.text.startswith("**", at) else 1
        end = scan.place(r"(?<=\S)(?=\*\*)" if n == 2 else r"(?<![\s*])(?<!^)\*(?!\*)", at + n)
        if end < 0 or scan.text[at + n : at + n + 1].isspace():
            return None
        return [Node("span", "*" * n, body=self.inlines(scan.text[at + n : end], scan.depth + 1))], end + n


def read_org(text: str) -> Document:
    return Org().document(text)


def read_djot(text: str) -> Document:
    return Djot().document(text)


def read_rst(text: str) -> Document:
    return Rst().document(text)
