"""DSL dictionaries: cards of headwords and marked bodies to dictionary entries."""

from __future__ import annotations

import gzip
import re
import unicodedata
import zlib
from dataclasses import dataclass, field

from quire.model.names import alphanumeric
from quire.model.tree import Document, DocumentError, Node, plain_text
from quire.sources.xmltree import alone, block, collapse, link, media, para, span, text, trimmed, void

#: Language codes by the names that headers use (fixed values); another name is shortened to itself in lower case.
LANGUAGES = {
    "english": "en", "russian": "ru", "german": "de", "germannewspelling": "de", "french": "fr", "spanish": "es", "spanishmodernsort": "es",
    "spanishtraditionalsort": "es", "italian": "it", "latin": "la", "greek": "el", "ukrainian": "uk", "polish": "pl", "portuguese": "pt",
    "portuguesestandard": "pt", "dutch": "nl", "swedish": "sv", "danish": "da", "norwegian": "no", "finnish": "fi", "turkish": "tr", "chinese": "zh",
    "chineseprc": "zh", "japanese": "ja", "hungarian": "hu", "czech": "cs", "bulgarian": "bg", "belarusian": "be", "kazakh": "kk", "tatar": "tt", "armenianeastern": "hy", "georgian": "ka",
}
#: Tags whose text stays and whose mark does not (fixed values).
DROPPED = ("c", "u", "sub", "sup", "com", "!trs")
ACUTE = "\u0301"
_TOKEN = re.compile(r"\\(.)|\[(/?)(\*|'|!?[a-z]+[0-9]?)(?:\s+([^\]]*))?\]|<<(.*?)>>|(~)", re.S)


def fail(message: str):
    raise DocumentError("Syntax", f"dsl import: {message}")


def decode(raw: bytes) -> str:
    """Gzip undone; then UTF-16 or UTF-8 by their marks, UTF-8 if it is that, else the code page that the header names."""
    if raw.startswith(b"\x1f\x8b"):
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error) as e:
            fail(f"not a whole gzip file: {e}")
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        out = raw.decode("utf-16", "replace")
    else:
        try:
            out = raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            head = raw[:2000].decode("latin-1")
            page = re.search(r'#SOURCE_CODE_PAGE\s+"?(\w+)', head)
            out = raw.decode("cp1251" if page and page[1].lower() == "cyrillic" else "latin-1", "replace")
    return out.replace("\r\n", "\n").replace("\r", "\n")


def language(name: str) -> str:
    key = re.sub(r"\W", "", name).lower()
    return LANGUAGES.get(key, key)


@dataclass
class Card:
    headwords: list[str]
    body: list[str]


@dataclass
class Sense:
    margin: int
    letter: bool
    blocks: list[Node] = field(default_factory=list)
    inner: list[Sense] = field(default_factory=list)


def cards_of(source: str) -> tuple[dict[str, str], list[Card]]:
    """Header fields, and cards: headwords at the margin, then an indented body. Comments go."""
    header: dict[str, str] = {}
    cards: list[Card] = []
    for line in re.sub(r"\{\{.*?\}\}", "", source, flags=re.S).split("\n"):
        if line.startswith("#"):
            name, _, value = line[1:].partition(" ")
            name, _, more = name.partition("\t")
            header[name.strip().upper()] = (more or value).strip().strip('"')
        elif line[:1] in (" ", "\t"):
            if cards and line.strip():
                cards[-1].body.append(line.strip())
        elif line.strip():
            if not cards or cards[-1].body:
                cards.append(Card([], []))
            cards[-1].headwords.append(line.strip())
    return header, [c for c in cards if c.headwords]


class Lower:
    """Marked lines to runs; ``refs`` gives the entry that a headword names."""

    def __init__(self, headword: str = "", contents: str = "", refs: dict[str, str] | None = None):
        self.headword, self.contents, self.refs = headword, contents, refs or {}

    def reference(self, shown: str) -> list[Node]:
        name = self.refs.get(collapse(shown).strip())
        return [void(">", name)] if name else [text(collapse(shown))]

    def line(self, source: str) -> tuple[int, list[Node], list[str]]:
        """(margin, run, files)."""
        margin, files = 0, []
        stack: list[tuple[str, str, list[Node]]] = [("", "", [])]
        at = 0

        def close() -> None:
            tag, argument, body = stack.pop()
            stack[-1][2].extend(self.closed(tag, argument, body, files))

        for m in _TOKEN.finditer(source):
            stack[-1][2].append(text(source[at : m.start()]))
            at = m.end()
            escaped, ending, tag, argument, shown, tilde = m.groups()
            if escaped is not None:
                stack[-1][2].append(text(escaped))
            elif tilde:
                stack[-1][2].append(text(self.headword or "~"))
            elif shown is not None:
                stack[-1][2].extend(self.reference(shown))
            elif re.fullmatch("m[0-9]?", tag):
                margin = margin if ending else int(tag[1:] or 0)
            elif not ending:
                stack.append((tag, argument or "", []))
            elif any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    close()
                close()
        stack[-1][2].append(text(source[at:]))
        while len(stack) > 1:
            close()
        return margin, trimmed([n for n in stack[0][2] if n.kind != "text" or n.text]), files

    def closed(self, tag: str, argument: str, body: list[Node], files: list[str]) -> list[Node]:
        shown = plain_text(body)
        if tag == "s":
            files.append(shown.strip())
            return []
        if tag == "'":
            return [text(shown[:1] + ACUTE + shown[1:])] if shown else []
        if tag == "ref":
            return self.reference(shown)
        if tag == "url":
            return link(shown.strip(), [])
        if tag == "*":
            return [Node("wrap", body=body, classes=["secondary"])]
        if tag == "lang":
            named = re.search(r'name="([^"]*)"', argument)
            return [span("=>", trimmed(body), *([language(named[1])] if named else []))]
        symbol = {"trn": "=>", "ex": "~", "p": "[", "t": "=%", "b": "*", "i": "/"}.get(tag)
        if symbol is None:
            return body
        return [span(symbol, inner, *([self.contents] if tag == "trn" and self.contents else []))] if (inner := trimmed(body)) else []


def forms(headword: str) -> tuple[str, str]:
    """(as displayed, as indexed): a part in braces is displayed and not indexed."""
    shown = plain_text(Lower().line(headword)[1])
    return tuple(" ".join(x.split()) for x in (re.sub("[{}]", "", shown), re.sub(r"\{[^}]*\}?", "", shown)))


def name_of(head: str, ordinal: int | None) -> str:
    words = "".join(c if alphanumeric(c) else " " for c in head).split()
    return "-".join([*words, *([str(ordinal)] if ordinal else [])])


def unstressed(word: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)))


def registry(cards: list[Card]) -> tuple[dict[str, str], list[int | None]]:
    """(entry names by headword, ordinals of the cards): displayed heads first, then indexed ones, then further ones."""
    heads = [forms(c.headwords[0]) for c in cards]
    many: dict[str, int] = {}
    for shown, _ in heads:
        many[shown] = many.get(shown, 0) + 1
    seen: dict[str, int] = {}
    ordinals: list[int | None] = []
    for shown, _ in heads:
        seen[shown] = seen.get(shown, 0) + 1
        ordinals.append(seen[shown] if many[shown] > 1 else None)
    names = [name_of(h[0], k) for h, k in zip(heads, ordinals)]
    refs: dict[str, str] = {}
    further = [(f, n) for c, n in zip(cards, names) for h in c.headwords[1:] for f in forms(h)]
    for key, name in [*((h[0], n) for h, n in zip(heads, names)), *((h[1], n) for h, n in zip(heads, names)), *further]:
        refs.setdefault(key, name)
        refs.setdefault(unstressed(key), name)
    return refs, ordinals


def numbering(run: list[Node]) -> tuple[bool, list[Node]] | None:
    """(is a letter, the rest) of a line that opens with a number or a letter and its bracket."""
    if not run or run[0].kind != "text":
        return None
    m = re.match(r"(?:[0-9]+[.)]|([^\W\d_])\))(?=\s|$)\s*", run[0].text.lstrip())
    if not m or (m[1] and not m[1].islower()):
        return None
    rest = run[0].text.lstrip()[m.end() :]
    return bool(m[1]), trimmed([*([text(rest)] if rest else []), *run[1:]])


def place(forest: list[Sense], path: list[Sense], made: Sense) -> None:
    """Letters divide the number before them, and a deeper margin divides what stands less deep."""
    while path and not (made.margin > path[-1].margin or (made.letter and not path[-1].letter and made.margin >= path[-1].margin)):
        path.pop()
    (path[-1].inner if path else forest).append(made)
    path.append(made)


def sense_block(s: Sense, number: int) -> Node:
    return block(":", [*s.blocks, *[sense_block(x, k) for k, x in enumerate(s.inner, 1)]], ordinal=number)


def entry(headwords: list[str], body: list[str], ordinal: int | None, lower: Lower) -> Node:
    shown, indexed = forms(headwords[0])
    lower = Lower(shown, lower.contents, lower.refs)
    out: list[Node] = [alone("=*", [text(indexed)], "sort")] if indexed and indexed != shown else []
    out += [alone("=~", [text(forms(h)[0])], "spelling") for h in headwords[1:]]
    forest, path, first, files, loose, below = [], [], [], [], [], []
    at = 0
    while at < len(body):
        if body[at].startswith("@"):
            stop = next((k for k in range(at + 1, len(body)) if body[k].startswith("@")), len(body))
            if name := body[at][1:].strip():
                below.append(entry([name], body[at + 1 : stop], None, lower))
            at = stop if name else at + 1
            continue
        margin, run, more = lower.line(body[at])
        files += more
        at += 1
        if not run:
            continue
        if (found := numbering(run)) is not None:
            place(forest, path, Sense(margin, found[0], [para(found[1])] if found[1] else []))
        elif path:
            path[-1].blocks.append(para(run))
        elif not loose and (furniture := opening(run, first)) is not None:
            first += furniture
        else:
            loose.append(para(run))
    out += first + [media(f) for f in files]
    if forest:
        out += loose + [sense_block(s, k) for k, s in enumerate(forest, 1)]
    elif loose:
        out.append(block(":", loose, ordinal=1))
    return block("!", out + below, [text(shown)], ordinal=ordinal)


def opening(run: list[Node], before: list[Node]) -> list[Node] | None:
    """The grammar line, the pronunciation or the etymology that a line before the first sense is."""
    kinds = {n.symbol for n in run if n.kind == "span"}
    bare = all(n.kind == "span" or (n.kind == "text" and n.text.strip() in ("", ",")) for n in run)
    if bare and kinds == {"=%"}:
        return [alone("=%", trimmed([n for k in run for n in (k.body if k.kind == "span" else [k])]))]
    labels = [k for k, n in enumerate(run) if n.kind == "span" and n.symbol == "["]
    if bare and kinds == {"["}:
        return [alone("=&", spaced([run[k] for k in labels]))]
    if any(b.body[0].symbol != "=%" for b in before) or not labels or labels[0] != 0:
        return None
    stop = next(k for k, n in enumerate(run) if not (n.kind == "span" and n.symbol == "[") and not (n.kind == "text" and not n.text.strip()))
    rest, marks = trimmed(run[stop:]), [n for n in run[:stop] if n.kind == "span"]
    origin = plain_text(marks[-1].body).strip().rstrip(":.").lower() in ("etym", "etymology", "этим", "этимология")
    marks = marks[:-1] if origin else marks
    return [*([alone("=&", spaced(marks))] if marks else []), alone("=<", rest) if origin else para(rest)]


def spaced(labels: list[Node]) -> list[Node]:
    return trimmed([n for k, x in enumerate(labels) for n in ([text(" ")] if k else []) + x.body])


def abbreviations(source: str, lower: Lower) -> list[Node]:
    items = []
    for c in cards_of(source)[1]:
        told = [run for x in c.body if (run := lower.line(x)[1])]
        items.append(block("::", [block(";", [para(r)]) for r in told], [text(", ".join(forms(h)[0] for h in c.headwords))]))
    return [block("[[", [block("::;", items)])] if items else []


def read_dsl(source: str | bytes, beside: str | bytes | None = None) -> Document:
    """beside: the dictionary of abbreviations that the header includes."""
    source, beside = (decode(x) if isinstance(x, bytes) else x for x in (source, beside))
    header, cards = cards_of(source.removeprefix("\ufeff"))
    if not cards and "NAME" not in header:
        fail("no cards and no #NAME header")
    codes = [language(header[k]) for k in ("INDEX_LANGUAGE", "CONTENTS_LANGUAGE") if header.get(k)]
    refs, ordinals = registry(cards)
    lower = Lower(contents=language(header.get("CONTENTS_LANGUAGE", "")), refs=refs)
    out = [alone("=", [text(header["NAME"])])] if header.get("NAME") else []
    out += [alone("=/", [text(" ".join(codes))])] if codes else []
    out += abbreviations(beside, lower) if beside else []
    return Document("lexigramma", blocks=[*out, *[entry(c.headwords, c.body, k, lower) for c, k in zip(cards, ordinals)]])
