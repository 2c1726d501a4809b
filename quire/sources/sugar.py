"""The short notation for literary text, compiled to native source; native source itself passes through unchanged.

Blocks are told by the first line's pattern. What a heading, an act, a scene or a speech opens has a rank, and closes
all that is open at its rank or below it; the rest closes at the end. Notes gather behind the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quire.model.markup import parse
from quire.model.schema import Catalog
from quire.model.tree import Document, DocumentError

#: Divisions from the highest down, and the rungs that a text can start on (fixed values).
RUNGS = ("==", "===", "#", "##", "###", "####")
BASES = {"part": 0, "chapter": 1, "section": 2}
ACT, SCENE, SPEECH = 6, 7, 8
#: Notes by their mark: the close, and the prefix of names that are made (fixed values). The longer marks come first.
NOTES = {"@^!": ("!^@", "atr-mn"), "@^^^": ("^^^@", "atr-en"), "@^^": ("^^@", "atr-ce"), "@^": ("^@", "atr-fn")}
#: Marks of emphasis: how one opens and closes, and what it becomes (fixed values). The longer one comes first.
EMPHASIS = (("*/", "/*", "@*/", "/*@"), ("*", "*", "@*", "*@"), ("/", "/", "@/", "/@"))
#: Native elements whose content is copied: their open and close.
COPIED = (('@@"', '"@@'), ("@$", "$@"), ("@><", "><@"), ("@*/", "/*@"), ("@/", "/@"), ("@*", "*@"), ("@,", ",@"), ("@%", "%@"), ("@>:", ":>@"), ("@:_", "_:@"))
FRONT = (("@=_", "_=@"), ("@=:", ":=@"), ("@=;", ";=@"), ("@=", "=@"))
_OPENING = "([{<\"'«„“‘¿¡-\u2014\u2013"
_TITLE = re.compile(r"(#{1,6})(!?) +(.*)")
_ITEM = re.compile(r"(?P<dash>- )(?P<a>.*)|(?P<number>[0-9]*)\. (?P<b>.*)|: (?P<term>.*?)(?: ::| :: (?P<c>.*))")
_FIGURE = re.compile(r"!\[(.*?)\]\(([^)|]*)(?:\|([^)]*))?\)")
_INLINE = re.compile(r"\\(?P<escaped>.)|(?P<ticks>`+)|<(?P<url>[a-z][a-z0-9+.-]*:[^\s<>]+)>|(?P<shown>\[[^\]\n]*\]\([^)\n]*\))|(?P<at>@)|(?P<mark>[*/])|(?P<dash>[\u2013\u2014])", re.S)


def fail(message: str):
    raise DocumentError("Syntax", f"compiler: {message}")


class Compiler:
    def __init__(self, source: str):
        self.lines = [x.removesuffix("\r") for x in source.split("\n")]
        if self.lines and not self.lines[-1]:
            self.lines.pop()
        self.at = 0
        self.out: list[str] = []
        self.open: list[tuple[int, str]] = []
        self.counts: dict[int, int] = {}
        self.base: int | None = None
        self.titled = False
        self.called: list[tuple[str, str]] = []
        self.notes: list[tuple[str, str, list[str]]] = []
        self.made: dict[str, int] = {}
        self.kinds: list[tuple[Callable[[str], bool], Callable[[str], None]]] = [
            (lambda x: not x.strip(), lambda x: self.put("")),
            (lambda x: any(c == x for _, c in self.open), self.closed_by_hand),
            (lambda x: x.startswith("@@@!("), lambda x: self.copy(lambda y: y == "!@@@", "an embedded part")),
            (lambda x: x.startswith("@@@!"), self.put),
            (lambda x: x.startswith('@@@"'), lambda x: self.copy(lambda y: y.lstrip().startswith('"@@@'), "a verbatim block", True)),
            (lambda x: x.startswith("@$$"), lambda x: self.copy(lambda y: y.lstrip().startswith("$$@"), "display math", True)),
            (lambda x: x.startswith("@@#("), self.set_base),
            (lambda x: x.startswith("```"), self.fence),
            (lambda x: x == "~" or x.startswith("~ "), self.verse),
            (lambda x: bool(_TITLE.fullmatch(x)), self.title),
            (lambda x: x.startswith(">"), self.quote),
            (lambda x: bool(_FIGURE.fullmatch(x)), self.figure),
            (lambda x: bool(re.fullmatch(r"@\|[a-z0-9-]+", x)), self.aside),
            (self.opens_list, self.list),
            (lambda x: self.definition(x) is not None, self.note),
            (lambda x: x.startswith("@:"), self.drama),
            (lambda x: self.front_matter(x) is not None, lambda x: self.put(self.front_matter(x))),
        ]

    # The lines.

    def put(self, line: str) -> None:
        self.out.append(line)

    def compile(self) -> str:
        while self.at < len(self.lines):
            line = self.lines[self.at].rstrip()
            self.at += 1
            if re.fullmatch(r"(?:={2,3}|#{1,4}|=:|#:)@", line) and not any(c == line for _, c in self.open):
                self.close(SPEECH)  # what is written out around a speech ends here
            in_verse = self.open and self.open[-1][1] == "~:@" and line.strip() and not any(c == line for _, c in self.open)
            if in_verse and not line.startswith("@:") and not _TITLE.fullmatch(line):
                self.put(self.inline(self.lines[self.at - 1]))
                continue
            handler = next((h for test, h in self.kinds if test(line)), self.paragraph)
            handler(line)
        self.close(0)
        for mark in reversed(NOTES):
            mine = [n for n in self.notes if n[0] == mark]
            order = {name: k for k, (m, name) in enumerate(self.called) if m == mark}
            for _, name, body in sorted(mine, key=lambda n: order.get(n[1], len(order))):
                self.out += ["", mark, *body, f"{NOTES[mark][0]}({name})"]
        text = "\n".join(self.out) + "\n"
        first = next((x for x in self.out if x.strip()), "")
        return text if first.startswith("@@@!") else "@@@!litogramma\n\n" + text

    def starts_block(self, line: str) -> bool:
        line = line.rstrip()
        if line.startswith("@@@") or any(c == line for _, c in self.open):
            return True
        tests = [t for t, h in self.kinds if h not in (self.note,)]
        return bool(line.strip()) and any(t(line) for t in tests[5:-1])

    def paragraph(self, line: str) -> None:
        start = self.at - 1
        while self.at < len(self.lines) and self.lines[self.at].strip() and not self.starts_block(self.lines[self.at]):
            self.at += 1
        self.out += self.inline("\n".join(self.lines[start : self.at])).split("\n")

    def copy(self, ends: Callable[[str], bool], what: str, behind_first: bool = False) -> None:
        start = self.at - 1
        stop = next((k for k in range(start + behind_first, len(self.lines)) if ends(self.lines[k].rstrip())), None)
        if stop is None:
            fail(f"unterminated {what}")
        self.out += self.lines[start : stop + 1]
        self.at = stop + 1

    # What is open.

    def close(self, rank: int) -> None:
        """Closes what is open at this rank or below; a close stands right behind the content."""
        while self.open and self.open[-1][0] >= rank:
            at = len(self.out)
            while at and not self.out[at - 1]:
                at -= 1
            self.out.insert(at, self.open.pop()[1])

    def enter(self, rank: int, close: str, line: str) -> None:
        self.close(rank)
        self.put(line)
        self.open.append((rank, close))

    def closed_by_hand(self, line: str) -> None:
        at = max(k for k, (_, c) in enumerate(self.open) if c == line)
        while len(self.open) > at + 1:
            self.close(self.open[-1][0])
        self.open.pop()
        self.put(line)

    def count(self, rank: int) -> int:
        self.counts[rank] = self.counts.get(rank, 0) + 1
        self.counts = {r: n for r, n in self.counts.items() if r <= rank}
        return self.counts[rank]

    # Blocks.

    def set_base(self, line: str) -> None:
        m = re.fullmatch(r"@@#\((\w+)\)", line)
        if not m or m[1] not in BASES:
            fail(f"malformed heading base `{line}` (part, chapter or section)")
        if self.titled or self.base is not None:
            fail("the heading base is declared once, before the first heading")
        self.base = BASES[m[1]]
        if self.at < len(self.lines) and not self.lines[self.at].strip():
            self.at += 1

    def title(self, line: str) -> None:
        marks, bare, shown = _TITLE.fullmatch(line).groups()
        rung = (2 if self.base is None else self.base) + len(marks) - 1
        if rung >= len(RUNGS):
            fail(f"heading `{marks}` is deeper than the divisions go")
        self.titled, symbol = True, RUNGS[rung]
        self.close(rung)
        number = ""
        if not bare:
            own = self.count(rung)
            above = [str(self.counts[r]) for r, _ in self.open if r < rung and r in self.counts]
            shown = shown.replace("@..@", f"@.{'.'.join([*above, str(own)])}.@").replace("@.@", f"@.{own}.@")
            number = f"({own})"
        self.enter(rung, symbol + "@", f"@{symbol}{number} {self.inline(shown.strip())}")

    def fence(self, line: str) -> None:
        ticks = len(line) - len(line.lstrip("`"))
        stop = next((k for k in range(self.at, len(self.lines)) if re.fullmatch("`{%d,}" % ticks, self.lines[k].rstrip())), None)
        if stop is None:
            fail("unterminated code fence")
        language = line.lstrip("`").strip()
        self.out += ['@@@"', *self.lines[self.at : stop], '"@@@' + (f".{language}" if language else "")]
        self.at = stop + 1

    def verse(self, line: str) -> None:
        stop = next((k for k in range(self.at, len(self.lines)) if re.match(r"~(?: |$)", self.lines[k].rstrip())), None)
        if stop is None:
            fail("unterminated verse")
        head, tail = line[1:].strip(), self.lines[stop][1:].strip()
        self.out += [f"@~ {head}".rstrip(), *(self.inline(x.replace("\t", "    ")) for x in self.lines[self.at : stop]), f"~@ {tail}".rstrip()]
        self.at = stop + 1

    def quote(self, line: str) -> None:
        self.at -= 1
        body: list[str] = []
        while self.at < len(self.lines) and self.lines[self.at].startswith(">"):
            body.append(self.lines[self.at].rstrip()[1:].removeprefix(" "))
            self.at += 1
        tail = body.pop()[2:].strip() if body[-1].startswith("--") else ""
        while body and not body[-1].strip():
            body.pop()
        self.out += ['@"', *map(self.inline, body), f'"@ {tail}'.rstrip()]

    def figure(self, line: str) -> None:
        caption, path, head = _FIGURE.fullmatch(line).groups()
        self.out += [f"@<() {head}" if head is not None else "@<()", f"@@@@({path})", self.inline(caption), "<@"]

    def aside(self, line: str) -> None:
        stop = next((k for k in range(self.at, len(self.lines)) if self.lines[k].rstrip() == "|@"), None)
        if stop is None:
            fail("unterminated aside")
        self.made["@|"] = self.made.get("@|", 0) + 1
        name = f"atr-as-{self.made['@|']}"
        self.out += [f"@|<({name})", "", "@|", *map(self.inline, self.lines[self.at : stop]), f"|@({name}).{line[2:]}"]
        self.at = stop + 1

    # Lists.

    def opens_list(self, line: str) -> bool:
        return bool(_ITEM.fullmatch(line)) or bool(re.fullmatch(r"@\.\. \S+|@(?:--|\.\.|::;)\.[a-z][a-z0-9-]*", line))

    def list(self, line: str) -> None:
        start, kind, first = self.at - 1, "", ""
        if not _ITEM.fullmatch(line):
            kind, first = (line[line.index(".", 2 if line.startswith(("@--", "@::")) else 3) :], "") if not line.startswith("@.. ") else ("", line[4:].strip())
            start = next((k for k in range(self.at, len(self.lines)) if self.lines[k].strip()), len(self.lines))
            if start == len(self.lines) or not _ITEM.fullmatch(self.lines[start].rstrip()):
                fail("a list head without a list")
        made, used = self.listed(self.lines[start:], kind, first)
        self.out += made
        self.at = start + used

    def listed(self, lines: list[str], classes: str = "", first: str = "") -> tuple[list[str], int]:
        """The list that the lines open with, and how many lines it takes."""
        shape = self.shape(lines[0])
        items: list[tuple[re.Match, list[str]]] = []
        at, column = 0, 2
        while at < len(lines):
            line = lines[at].rstrip()
            if line and self.shape(line) == shape:
                m = _ITEM.fullmatch(line)
                items.append((m, []))
                column = line.index(" ") + 1
            elif not line:
                behind = next((x for x in lines[at:] if x.strip()), "")
                if not behind[:1].isspace():
                    break
                items[-1][1].append("")
            elif line[0].isspace():
                indent = len(line) - len(line.lstrip())
                items[-1][1].append(line[min(indent, column) :])
            else:
                break
            at += 1
        mark = {"-": "--", ".": "..", ":": "::;"}[shape]
        close = mark[::-1]
        out = [f"@{mark}"]
        if shape == ":":
            for m, more in items:
                out += [f"@:: {m['term'].strip()}", *self.definitions(m["c"], more), "::@"]
        else:
            ordinals = self.ordinals(first or (items[0][0]["number"] or ""), len(items)) if shape == "." else [""] * len(items)
            for (m, more), ordinal in zip(items, ordinals):
                out += [f"@.-({ordinal})" if shape == "." else "@-", *self.item_body(m["b"] if shape == "." else m["a"], more), "-.@" if shape == "." else "-@"]
        return [*out, f"{close}@{classes}"], at

    @staticmethod
    def shape(line: str) -> str | None:
        m = _ITEM.fullmatch(line.rstrip())
        return None if not m else "-" if m["dash"] else ":" if m["term"] is not None else "."

    @staticmethod
    def ordinals(first: str, n: int) -> list[str]:
        """Numbers from the first, or capital letters from it."""
        if re.fullmatch("[A-Z]{1,4}", first):
            at = 0
            for c in first:
                at = at * 26 + ord(c) - 64
            return [letters(at + k) for k in range(n)]
        if not re.fullmatch("[0-9]{0,9}", first):
            fail(f"unrecognized list ordinal `{first}`")
        return [str(int(first or 1) + k) for k in range(n)]

    def item_body(self, first: str, more: list[str]) -> list[str]:
        out, at = [self.inline(first)], 0
        while at < len(more):
            if _ITEM.fullmatch(more[at].rstrip()):
                made, used = self.listed(more[at:])
                out += made
                at += used
            else:
                out.append(self.inline(more[at].rstrip()))
                at += 1
        return out

    def definitions(self, first: str | None, more: list[str]) -> list[str]:
        told: list[list[str]] = [[first.strip()]] if first else []
        for line in map(str.strip, more):
            if line.startswith(":: "):
                told.append([line[3:]])
            elif told:
                told[-1].append(line)
            elif line:
                told.append([line])
        return [x for t in told for x in ("@;", *map(self.inline, t), ";@")]

    # Notes.

    def definition(self, line: str) -> tuple[str, str, str] | None:
        """(mark, name, text) of a paragraph that defines a note."""
        mark = next((m for m in NOTES if line.startswith(m)), None)
        if mark is None or self.inline_note(line, len(mark), mark) is not None:
            return None
        m = re.match(r"([A-Za-z0-9-]+):? (.+)", line[len(mark) :])
        return m and (mark, m[1], m[2])

    @staticmethod
    def inline_note(text: str, at: int, mark: str) -> int | None:
        """Where a note that is written out closes: in its line, before another note opens."""
        end = text.find(NOTES[mark][0], at)
        line_end = text.find("\n", at)
        opens = [k for m in NOTES if (k := text.find(m, at)) >= 0]
        return end if end >= 0 and (line_end < 0 or end < line_end) and all(end < k for k in opens) else None

    def note(self, line: str) -> None:
        mark, name, shown = self.definition(line)
        body = [self.inline(shown)]
        while self.at < len(self.lines) and (x := self.lines[self.at].rstrip()).strip() and not self.starts_block(x) and self.definition(x) is None:
            body.append(self.inline(self.lines[self.at]))
            self.at += 1
        self.notes.append((mark, name, body))
        if self.out and not self.out[-1] and self.at < len(self.lines) and not self.lines[self.at].strip():
            self.at += 1

    def call(self, mark: str, name: str) -> str:
        if (mark, name) not in self.called:
            self.called.append((mark, name))
        return f"{mark}({name})"

    # Drama and front matter.

    def drama(self, line: str) -> None:
        head, _, rest = line.partition(" ")
        if head == "@:=" or line.startswith("@:=("):
            self.stage(ACT, "=:@", ":=", rest if head == "@:=" else None, line)
        elif head == "@:#" or line.startswith("@:#("):
            self.stage(SCENE, "#:@", ":#", rest if head == "@:#" else None, line)
        elif head == "@:!" and not rest.endswith("!:@"):
            self.put(f"@:! {self.inline(rest)} !:@")
        elif head in ("@:~", "@:") and rest:
            self.enter(SPEECH, "~:@" if head == "@:~" else ":@", f"{head} {self.inline(rest)}")
        elif head == "@:[":
            self.close(SPEECH)
            self.out += [line] if not rest else [self.inline(line)] if "]:@" in line else ["@:[", self.inline(rest), "]:@"]
        elif head == "@:-" and rest:
            start = self.at - 1
            while self.at < len(self.lines) and self.lines[self.at].strip():
                self.at += 1
            shown = [self.inline(x.rstrip()) for x in self.lines[start : self.at]]
            self.out += [*shown[:-1], shown[-1] if self.lines[self.at - 1].rstrip().endswith("-:@") else shown[-1] + " -:@"]
        elif head == "@:." and rest:
            self.put(line if line.endswith(".:@") else line + " .:@")
        else:
            self.put(self.inline(line))

    def stage(self, rank: int, close: str, symbol: str, shown: str | None, line: str) -> None:
        """Acts and scenes count on; one that is numbered by hand is taken as it is."""
        if shown is None:
            self.enter(rank, close, self.inline(line))
            return
        n = self.count(rank)
        shown = shown.replace("@..@", f"@.{n}.@").replace("@.@", f"@.{n}.@")
        self.enter(rank, close, f"@{symbol}({n}) {self.inline(shown)}")

    def front_matter(self, line: str) -> str | None:
        """A line of front matter, with its close if that was left out."""
        found = next(((o, c) for o, c in FRONT if line.startswith(o) and len(line) > len(o)), None)
        if found is None or (found[0] == "@=" and line[2] in '=#"'):
            return None
        return line if line.endswith(found[1]) else f"{found[0]} {self.inline(line[len(found[0]) :].strip())} {found[1]}"

    # Inline.

    def inline(self, text: str) -> str:
        out: list[str] = []
        open_: list[tuple] = []
        at, opened = 0, -1
        closers = {e[1]: [m.start() for m in re.finditer(re.escape(e[1]), text) if closes(text, m.start(), len(e[1]))] for e in EMPHASIS}
        while (m := _INLINE.search(text, at)) is not None:
            out.append(text[at : m.start()])
            k, at = m.start(), m.end()
            if m["escaped"] is not None:
                c = m["escaped"]
                out.append(c if c in "*/-.#>`~\\|:[]!<" else m[0])
            elif m["ticks"]:
                end = re.compile(f"(?<!`){m['ticks']}(?!`)").search(text, at)
                out.append(f'@@"{text[at : end.start()]}"@@' if end else m["ticks"])
                at = end.end() if end else at
            elif m["url"]:
                out.append(f"@><{m['url']}><@")
            elif m["shown"]:
                fail(f"`{m['shown'][:30]}`: a link shows its address: write <url>, or escape the bracket")
            elif m["dash"]:
                out.append("--" if m["dash"] == "\u2014" else "-")
            elif m["at"]:
                shown, at = self.element(text, k)
                out.append(shown)
            else:
                made, at, opened = self.emphasis(text, k, open_, closers, opened)
                out.append(made)
        if open_:
            fail(f"emphasis opened with `{open_[-1][0]}` is never closed in its paragraph")
        return "".join(out) + text[at:]

    @staticmethod
    def emphasis(text: str, k: int, open_: list[tuple], closers: dict[str, list[int]], opened: int) -> tuple[str, int, int]:
        """(what the mark becomes, where reading goes on, where the last opener ended)."""
        for e in EMPHASIS:
            opener, closer, made, end = e
            if open_ and open_[-1] is e and k in closers[closer]:
                open_.pop()
                return end, k + len(closer), opened
            before = text[k - 1] if k and k != opened else " "
            behind = text[k + len(opener) : k + len(opener) + 1]
            starts = text.startswith(opener, k) and behind and not behind.isspace() and (before.isspace() or before in _OPENING)
            if starts and e not in open_ and any(c >= k + len(opener) for c in closers[closer]):
                open_.append(e)
                return made, k + len(opener), k + len(opener)
        return text[k], k + 1, opened

    def element(self, text: str, k: int) -> tuple[str, int]:
        """A native element is copied; notes get their names."""
        for start, close in COPIED:
            if text.startswith(start, k):
                end = text.find(close, k + len(start))
                return (text[k : end + len(close)], end + len(close)) if end >= 0 else ("@", k + 1)
        if text.startswith("@:(", k):
            end, line_end = text.find("):@", k), text.find("\n", k)
            if end >= 0:
                return text[k : end + 3], end + 3
            stop = len(text) if line_end < 0 else line_end
            return text[k:stop] + " ):@", stop
        if re.match(r"@\|[a-z0-9-]+\|", text[k : k + 80]):
            fail("an aside stands in lines of its own")
        mark = next((m for m in NOTES if text.startswith(m, k)), None)
        if mark is None:
            return "@", k + 1
        at = k + len(mark)
        if m := re.compile(r"\(([^)]*)\)").match(text, at):
            return self.call(mark, m[1]), m.end()
        if (end := self.inline_note(text, at, mark)) is not None:
            self.made[mark] = self.made.get(mark, 0) + 1
            name = f"{NOTES[mark][1]}-{self.made[mark]}"
            body = self.inline(text[at:end])
            shown = self.call(mark, name)
            self.notes.append((mark, name, [body]))
            return shown, end + len(NOTES[mark][0])
        m = re.compile("[A-Za-z0-9-]+").match(text, at)
        return (self.call(mark, m[0]), m.end()) if m else ("@", k + 1)


def closes(text: str, k: int, width: int) -> bool:
    """Can a mark close here? Something stands before it, and a blank or a mark of punctuation behind."""
    before, behind = text[k - 1 : k], text[k + width : k + width + 1]
    return bool(before) and not before.isspace() and (not behind or behind.isspace() or not behind.isalnum())


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def compile_text(source: str) -> str:
    """Native source of a text in the short notation."""
    return Compiler(source).compile()


def read_short(source: str, catalog: Catalog | None = None) -> Document:
    return parse(compile_text(source), catalog or Catalog())
