"""Scripture: OSIS and USFM documents to trees, and verse marks to coordinates."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from quire.model.schema import Schema
from quire.model.tree import Document, DocumentError, Node, has_blocks, walk

#: Classes by a title's type, a highlight's type and a segment's type; phrases by element (fixed values).
TITLES = {"main": "mt1", "psalm": "d", "scope": "mr", "parallel": "r", "acrostic": "qa", "chapterLabel": "cl", "runningHead": "h"}
HIGHLIGHTS = {"bold": "bd", "italic": "it", "small-caps": "sc", "normal": "no"}
SEGMENTS = {"selah": "qs", "otPassage": "qt", "keyword": "k"}
PHRASES = {"divineName": "nd", "transChange": "add", "foreign": "tl", "signed": "sig"}
PERSON, TARGET = "?:", "?>"
_SKIPPED = ("milestone", "lb")


def fail(message: str):
    raise DocumentError("Syntax", f"osis import: {message}")


def _tree(text: str) -> ElementTree.Element:
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        fail(str(e))
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
        e.attrib = {k.rsplit("}", 1)[-1].lower(): v for k, v in e.attrib.items()}
    return root


def _collapse(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "")


def _number(e: ElementTree.Element) -> str | None:
    name = e.get("n") or (e.get("osisid") or e.get("sid") or "").rsplit(".", 1)[-1]
    return name if name and "eid" not in e.attrib else None


def trim(run: list[Node]) -> list[Node]:
    """Without blank text at the edges."""
    while run and run[0].kind == "text" and not run[0].text.strip():
        run = run[1:]
    while run and run[-1].kind == "text" and not run[-1].text.strip():
        run = run[:-1]
    if run and run[0].kind == "text":
        run[0].text = run[0].text.lstrip()
    if run and run[-1].kind == "text":
        run[-1].text = run[-1].text.rstrip()
    return run


def _span(symbol: str, kind: str, body: list[Node]) -> Node:
    return Node("span", symbol, body=body, classes=[kind])


def mark(symbol: str, value: str) -> Node:
    """An invisible mark on what follows it: white space in its key becomes hyphens."""
    return Node("void", symbol, text="-".join(value.strip().lstrip("#").split()))


def _line(kind: str, run: list[Node]) -> Node:
    return Node("para", body=[_span("_", kind, run)], is_block=True)


class _Run:
    """Inline content under construction: a space always stands between a verse mark and text."""

    def __init__(self):
        self.out: list[Node] = []

    def text(self, text: str | None) -> None:
        text = _collapse(text)
        if text:
            self.spaced(text)
            self.out.append(Node("text", text=text))

    def spaced(self, next_text: str = "") -> None:
        if self.out and self.out[-1].kind == "void" and not next_text.startswith(" "):
            self.out.append(Node("text", text=" "))

    def verse(self, e: ElementTree.Element) -> None:
        if n := _number(e):
            last = self.out[-1] if self.out else None
            if last is not None and not (last.kind == "text" and last.text[-1:].isspace()):
                self.out.append(Node("text", text=" "))
            self.out.append(Node("void", "|", text=n))


def read_osis(text: str) -> Document:
    """Book divisions with their code as head; chapters and verses as marks in the flow."""
    books: list[Node] = []

    def go(e) -> None:
        for c in e:
            if c.tag == "div" and c.get("type") == "book":
                if not c.get("osisid"):
                    fail("a book division without an id")
                books.append(Node("block", "#", head=[Node("text", text=c.get("osisid").lower())], body=blocks(c), is_block=True))
            elif c.tag in ("osis", "osisText", "div"):
                go(c)
            elif c.tag not in ("header", "title", ""):
                fail(f"unexpected <{c.tag}> at document level")

    go([_tree(text)])
    if not books:
        fail("no book division found")
    return Document("at-usfm", blocks=books)


def blocks(e: ElementTree.Element) -> list[Node]:
    out: list[Node] = []
    flow: _Run | None = None  # verses that stand between blocks gather into one paragraph

    def settle() -> None:
        nonlocal flow
        if flow is not None and (run := trim(flow.out)):
            out.append(Node("para", body=run, is_block=True))
        flow = None

    def loose(text: str | None) -> None:
        if text and text.strip():
            if flow is None:
                fail(f"bare text at block level: `{text.strip()[:40]}`")
            flow.text(text)

    loose(e.text)
    for c in e:
        if c.tag == "verse":
            flow = flow or _Run()
            flow.verse(c)
            if len(c) or c.text:
                inner = inlines(c)
                if inner and inner[0].kind == "text":
                    flow.spaced(inner[0].text)
                flow.out += inner
        else:
            settle()
            if c.tag == "chapter":
                if n := _number(c):
                    out.append(Node("para", body=[Node("void", "##", text=n)], is_block=True))
                out += blocks(c)
            elif c.tag == "title":
                kind = TITLES.get(c.get("type", ""), "s1")
                if kind == "mt1" and c.get("short"):
                    out.append(_line("h", [Node("text", text=c.get("short"))]))
                out.append(_line(kind, trim(inlines(c))))
            elif c.tag == "speaker":
                out.append(_line("sp", trim(inlines(c))))
            elif c.tag == "p":
                if run := trim(inlines(c)):
                    out.append(Node("para", body=run, is_block=True))
            elif c.tag == "lg":
                stanzas = lines(c)
                if stanzas and out and out[-1].kind == "verse":
                    out[-1].body += stanzas
                elif stanzas:
                    out.append(Node("verse", "~", body=stanzas, is_block=True))
            elif c.tag == "div":
                out += blocks(c)
            elif c.tag not in (*_SKIPPED, "") and not (c.tag == "q" and not len(c) and not c.text):
                fail(f"unexpected <{c.tag}> at block level")
        loose(c.tail)
    settle()
    return out


def lines(e: ElementTree.Element) -> list[list[list[Node]]]:
    """Stanzas of a line group; groups inside it are stanzas of their own."""
    out: list[list[list[Node]]] = []
    now: list[list[Node]] = []
    for c in e:
        if c.tag == "l":
            if len(c) or c.text:
                now.append([_span(",", "q" + c.get("level", "1"), trim(inlines(c)))])
        elif c.tag == "lg":
            out += [now] if now else []
            now = []
            out += lines(c)
        else:
            fail(f"unexpected <{c.tag}> in a line group")
    return out + ([now] if now else [])


def inlines(e: ElementTree.Element, note: str = "") -> list[Node]:
    """note: the kind of note that the content stands in, if any."""
    run = _Run()
    run.text(e.text)
    for c in e:
        empty = not len(c) and not c.text
        if c.tag == "verse":
            run.verse(c)
            run.out += inlines(c)
        elif c.tag == "note" and not empty:
            kind = "x" if c.get("type") == "crossReference" else "f"
            marks = [mark(TARGET, c.get("osisref"))] if c.get("osisref") else []
            run.out.append(_span("^", kind, marks + trim(inlines(c, kind))))
        elif not empty:
            run.spaced()
            run.out += element(c, note)
        elif c.tag not in (*_SKIPPED, "q", "note", "reference", ""):
            fail(f"unexpected <{c.tag}/> in inline content")
        run.text(c.tail)
    return run.out


def element(e: ElementTree.Element, note: str) -> list[Node]:
    inner, kind, marks = inlines(e, note), "", []
    if e.tag == "q" and e.get("who"):
        kind, marks = ("wj" if e.get("who") == "Jesus" else "said"), [mark(PERSON, e.get("who"))]
    elif e.tag == "reference" and (e.get("osisref") or note):
        kind, marks = ({"x": "xo", "f": "fr"}.get(note, "ref")), [mark(TARGET, e.get("osisref"))] if e.get("osisref") else []
    elif e.tag == "hi":
        kind = HIGHLIGHTS.get(e.get("type", ""), "em")
    elif e.tag == "seg":
        kind = SEGMENTS.get(e.get("type", ""), e.get("type", ""))
    elif e.tag == "name":
        kind = "bk" if e.get("type") == "x-workTitle" else ""
    elif e.tag in PHRASES:
        kind = PHRASES[e.tag]
    elif e.tag not in ("q", "reference", "w", "a", "catchWord", "rdg") and not note:
        fail(f"unsupported inline element <{e.tag}>")
    return [_span(",", kind, marks + trim(inner))] if kind else inner


def to_coordinates(doc: Document, scheme: str, schema: Schema) -> Document:
    """Chapter and verse marks become coordinates ``book.chapter`` and ``book.chapter.verse`` of the scheme.

    Books are named by the vocabulary's terms. Page and section coordinates join the scheme, with their old
    scheme as class, unless it is in use already.
    """
    taken = any(n.kind == "point" and n.scheme == scheme for n in walk(doc.blocks))
    place = {"book": "", "chapter": ""}

    def run(seq: list[Node]) -> None:
        for n in seq:
            if n.kind == "point" and n.scheme in ("page", "section") and not taken:
                n.scheme, n.classes = scheme, [n.scheme]
            elif n.kind == "void" and n.text and (n.symbol == "##" or (n.symbol == "|" and place["chapter"])):
                value = n.text if n.symbol == "##" else f"{place['chapter']}.{n.text}"
                if n.symbol == "##":
                    place["chapter"] = n.text
                n.kind, n.symbol, n.scheme, n.text = "point", None, scheme, f"{place['book']}.{value}"
            elif n.kind == "span":
                run(n.body)

    def go(seq: list[Node]) -> None:
        for b in seq:
            if b.kind == "block" and b.symbol == "#":
                before = dict(place)
                code = "".join(n.text for n in b.head if n.kind == "text").strip()
                place.update(book=schema.term("books", code), chapter="")
                go(b.body)
                place.update(before)
            elif b.kind == "para":
                run(b.body)
            elif b.kind == "verse":
                for stanza in b.body:
                    for line in stanza:
                        run(line)
            elif has_blocks(b) and b.kind != "embed":
                go(b.body)

    go(doc.blocks)
    return doc


# USFM: backslash markers in lines of text.

#: Other spellings of markers; markers of headings, of set paragraphs, and those that are not kept (fixed values).
SAME = {"mt": "mt1", "ms": "ms1", "s": "s1", "s4": "s3", "is": "is1", "imt": "imt1", "io": "io1", "pi": "pi1", "li": "li1", "ili": "ili1"}
HEADINGS = set("h toc1 toc2 toc3 mt1 mt2 mt3 ms1 ms2 mr s1 s2 s3 r d sp qa is1 lit cl cp imt1 imt2 imt3 io1 io2".split())
PARAGRAPHS = set(
    "m mi pi1 pi2 pi3 pc nb po ip li1 tr th1 th2 th3 tc1 tc2 tc3 thr1 thr2 thr3 tcr1 tcr2 tcr3 li2 li3 li4 ili1 ili2 lh lf "
    "pm pmo pmc pmr pr cls ph1 ph2 ipi".split()
)
UNKEPT = {"ide", "usfm", "sts", "rem", "iex", "im", "ie", "ib"}
NOTES = {"f", "fe", "x"}
TEXTUAL = {"ft", "xt", "fk", "fq", "fqa", "fl", "xq", "xo", "fr", "xk", "xta"}
_MARKER = re.compile(r"\\(\+?)([A-Za-z0-9]+)(\*?) ?")


def _usfm(message: str):
    raise DocumentError("Syntax", f"usfm import: {message}")


def _joined(text: str) -> list[str]:
    """Lines, with those inside a note put to the line where it opens."""
    out: list[str] = []
    open_ = 0
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if open_:
            out[-1] += " " + line.strip()
        else:
            out.append(line)
        open_ = max(0, open_ + sum(-1 if m[3] else 1 for m in _MARKER.finditer(line) if m[2] in NOTES))
    return out


class _Book:
    """A book's blocks: one paragraph or one run of poetry is open at a time."""

    def __init__(self, code: str):
        self.code, self.out = code, []
        self.run: list[Node] | None = None
        self.kind = ""
        self.stanzas: list[list[list[Node]]] = []

    def settle(self) -> None:
        stanzas = [s for s in self.stanzas if s]
        if stanzas:
            self.out.append(Node("verse", "~", body=stanzas, is_block=True))
        self.stanzas = []
        self.end_paragraph()

    def end_paragraph(self) -> None:
        run = self.run or []
        while run and run[-1].kind == "text" and not run[-1].text.strip():
            run.pop()
        if run:
            self.out.append(_line(self.kind, run) if self.kind else Node("para", body=run, is_block=True))
        self.run, self.kind = None, ""

    def paragraph(self, kind: str, run: list[Node]) -> None:
        self.settle()
        self.run, self.kind = run, kind

    def node(self) -> Node:
        self.settle()
        return Node("block", "#", head=[Node("text", text=self.code)], body=self.out, is_block=True)

    def last_line(self) -> Node | None:
        """The phrase of the last line of poetry."""
        stanza = next((s for s in reversed(self.stanzas) if s), None)
        return stanza[-1][0] if stanza and len(stanza[-1]) == 1 and stanza[-1][0].symbol == "," else None

    def add(self, run: list[Node], spaced: bool = True) -> None:
        """More text of what is open: an empty line of poetry takes it as its own."""
        if self.stanzas and self.stanzas[-1]:
            line, phrase = self.stanzas[-1][-1], self.last_line()
            if phrase is not None and not phrase.body and len(line) == 1:
                phrase.body = run
            else:
                line += [Node("text", text=" "), *run]
        elif self.run is not None:
            self.run += ([Node("text", text=" ")] if self.run and spaced else []) + run
        else:
            _usfm("stray text outside a paragraph")

    def verse(self, number: str, text: str) -> None:
        run = [Node("void", "|", text=number)]
        if text:
            run += [Node("text", text=" "), *usfm_inlines(text)]
        if not self.stanzas:
            self.run = [] if self.run is None else self.run
            return self.add(run)
        phrase = self.last_line()
        if phrase is not None and not phrase.body and self.stanzas[-1]:
            phrase.body = run
        else:
            level = phrase.classes[0] if phrase is not None and phrase.classes[0].startswith("q") else "q1"
            self.stanzas[-1].append([_span(",", level, run)])


def read_usfm(text: str) -> Document:
    books: list[_Book] = []
    for line in _joined(text):
        line = line.rstrip()
        if not line.strip():
            continue
        m = re.match(r"\\(\S+)\s*(.*)", line, re.S)
        marker, rest = (m[1], m[2].strip()) if m else ("", line.strip())
        marker = SAME.get(marker, marker)
        if marker == "id":
            if not rest:
                _usfm("\\id without a book code")
            books.append(_Book(rest.split()[0].lower()))
            continue
        if marker in UNKEPT:
            continue
        if not books:
            _usfm("missing \\id")
        book = books[-1]
        if not marker:
            book.add(usfm_inlines(rest))
        elif marker == "c":
            book.settle()
            if not rest:
                _usfm("\\c without a chapter number")
            book.out.append(Node("para", body=[Node("void", "##", text=rest.split()[0])], is_block=True))
        elif marker == "v":
            number, _, told = rest.partition(" ")
            book.verse(number, told.strip())
        elif marker == "p" or marker in PARAGRAPHS:
            book.paragraph("" if marker == "p" else marker, usfm_inlines(rest))
        elif marker == "b":
            if book.stanzas:
                book.stanzas.append([])
            else:
                book.end_paragraph()
        elif re.fullmatch(r"q[0-9]?|qr|qc|qm[1-3]?", marker):
            book.end_paragraph()
            run = usfm_inlines(rest)
            while run and run[-1].kind == "text" and not run[-1].text.strip():
                run.pop()
            book.stanzas = book.stanzas or [[]]
            book.stanzas[-1].append([_span(",", {"q": "q1", "qm": "qm1"}.get(marker, marker), run)])
        elif marker in HEADINGS:
            book.settle()
            book.out.append(_line(marker, trim(usfm_inlines(rest))))
        else:
            _usfm(f"unsupported marker \\{marker}")
    if not books:
        _usfm("missing \\id")
    return Document("at-usfm", blocks=[b.node() for b in books])


def _close(text: str, at: int, nested: str, marker: str) -> tuple[int, int]:
    """(end of the content, after the close) of a marker; a character style may run to the end."""
    for close in ([f"\\+{marker}*"] if nested else []) + [f"\\{marker}*"]:
        end = text.find(close, at)
        if end >= 0:
            return end, end + len(close)
    if marker in NOTES:
        _usfm(f"unterminated \\{marker}")
    return len(text), len(text)


def usfm_inlines(text: str) -> list[Node]:
    out: list[Node] = []
    plain: list[str] = []
    at = 0

    def settle(strip: bool = False) -> None:
        told = "".join(plain)
        plain.clear()
        told = told.rstrip() if strip else told
        if told:
            out.append(Node("text", text=told))

    while (m := _MARKER.search(text, at)) is not None:
        plain.append(text[at : m.start()])
        nested, marker = m[1], m[2]
        if m[3]:
            _usfm(f"unexpected inline marker \\{marker}*")
        if marker == "v":
            number = re.compile(r"\S*\s*").match(text, m.end())
            settle(strip=True)
            out += [Node("text", text=" ")] if out else []
            out += [Node("void", "|", text=number[0].strip()), Node("text", text=" ")]
            at = number.end()
            continue
        end, at = _close(text, m.end(), nested, marker)
        body = text[m.end() : end]
        if marker in ("w", "wh", "wg", "wa", "rb"):
            told = body.split("|")[0]
            if "\\" in told:
                settle()
                out += usfm_inlines(told)
            else:
                plain.append(told)
            continue
        settle()
        if marker in NOTES:
            body = body.strip()
            if not body.startswith("\\") and body[1:2].isspace():
                body = body[1:].lstrip()
            out.append(_span("^", marker, usfm_note(body)))
        elif marker not in ("va", "ca", "vp"):
            marks = [mark(PERSON, "Jesus")] if marker == "wj" else []
            out.append(_span(",", marker, marks + usfm_inlines(body.strip())))
    plain.append(text[at:])
    settle()
    return out


def usfm_note(body: str) -> list[Node]:
    """A note's parts: its reference as a phrase, the others as running text."""
    parts: list[tuple[str, int, int]] = []
    start, kind, at = 0, "", 0
    while (m := _MARKER.search(body, at)) is not None:
        if m[2] in TEXTUAL and not m[3]:
            parts.append((kind, start, m.start()))
            kind, start, at = m[2], m.end(), m.end()
        else:
            at = _close(body, m.end(), m[1], m[2])[1]
    parts.append((kind, start, len(body)))
    out: list[Node] = []
    for kind, a, b in parts:
        told = body[a:b].strip()
        if told and kind in ("fr", "xo"):
            out.append(_span(",", kind, usfm_inlines(told)))
        elif told:
            out += ([Node("text", text=" ")] if out else []) + usfm_inlines(told)
    return out


# USX: the same books as XML.

#: Styles of a note's parts that are running text (fixed values).
NOTE_TEXT = ("ft", "xt", "fk", "fq", "fqa", "fl", "xq", "w", "wh")
#: Words in lists and glosses, whose text stays.
WORDS = ("w", "wh", "wg", "wa", "rb")


class _Usx:
    def fail(self, message: str):
        raise DocumentError("Syntax", f"usx import: {message}")

    def style(self, e) -> str:
        if e.get("style") is None:
            self.fail(f"<{e.tag}> without a style")
        return e.get("style")

    def run(self, e, inside: str = "") -> list[Node]:
        """Text, verses, phrases, notes and references; a quotation runs from its opening to its closing mark."""
        out: list[Node] = []
        quoted: tuple[int, str] | None = None

        def end() -> None:
            nonlocal quoted
            if quoted is not None:
                at, who = quoted
                if body := trim(out[at:]):
                    out[at:] = [_span(",", "said", [*([mark(PERSON, who)] if who else []), *body])]
                else:
                    del out[at:]
                quoted = None

        def spaced(told: str = "") -> None:
            if out and out[-1].kind == "void" and not told.startswith(" "):
                out.append(Node("text", text=" "))

        for k in e.kids:
            if isinstance(k, str):
                told = _collapse(k)
                spaced(told)
                out.append(Node("text", text=told))
            elif k.tag == "verse":
                if k.get("number"):
                    if out and not (out[-1].kind == "text" and out[-1].text[-1:].isspace()):
                        out.append(Node("text", text=" "))
                    out.append(Node("void", "|", text=k.get("number")))
            elif k.tag == "char":
                style, body = self.style(k), self.run(k, inside)
                if style in WORDS or (inside and style in NOTE_TEXT):
                    out += body
                elif body := trim(body):
                    spaced()
                    out.append(_span(",", style, ([mark(PERSON, "Jesus")] if style == "wj" else []) + body))
            elif k.tag == "note":
                if k.kids:
                    kind = {"x": "x", "ex": "x", "fe": "fe"}.get(k.get("style") or "f", "f")
                    out.append(_span("^", kind, self.run(k, kind)))
            elif k.tag in ("ref", "optbreak"):
                out += [Node("text", text=" ")] if k.tag == "optbreak" else []
                body = self.run(k, inside)
                out += [_span(",", "ref", [mark(TARGET, _place(k.get("loc"))), *trim(body)])] if k.get("loc") else body
            elif k.tag == "ms":
                style = k.get("style") or ""
                if style.startswith("qt") and style.endswith("-s"):
                    end()
                    quoted = (len(out), k.get("who") or "")
                elif style.startswith("qt") and style.endswith("-e"):
                    end()
            else:
                self.fail(f"unexpected <{k.tag}> in inline content")
        end()
        return out

    def document(self, root) -> Document:
        books: list[_Book] = []
        for e in root.own():
            if e.tag == "book":
                if e.get("code") is None:
                    self.fail("<book> without a code")
                books.append(_Book(e.get("code").lower()))
                continue
            if not books:
                self.fail("missing <book code>")
            book = books[-1]
            if e.tag == "chapter":
                if e.get("number"):
                    book.settle()
                    book.out.append(Node("para", body=[Node("void", "##", text=e.get("number"))], is_block=True))
            elif e.tag == "para":
                self.paragraph(book, e)
            else:
                self.fail(f"unexpected <{e.tag}> at book level")
        if not books:
            self.fail("missing <book code>")
        return Document("at-usfm", blocks=[b.node() for b in books])

    def paragraph(self, book: _Book, e) -> None:
        style = self.style(e)
        style = SAME.get(style, style)
        run = trim(self.run(e))
        if style == "b" or not e.kids:
            if style == "b" and run:
                self.fail('<para style="b"> with content')
            if style == "b" and book.stanzas:
                book.stanzas.append([])
        elif re.fullmatch(r"q[0-9]?|qr|qc|qm[1-3]?", style):
            book.stanzas = book.stanzas or [[]]
            book.stanzas[-1].append([_span(",", {"q": "q1", "qm": "qm1"}.get(style, style), run)])
        elif style not in UNKEPT:
            book.settle()
            if style != "p" and style not in PARAGRAPHS and style not in HEADINGS:
                self.fail(f"unsupported para style `{style}`")
            if run:
                book.out.append(Node("para", body=run, is_block=True) if style == "p" else _line(style, run))


def _place(loc: str) -> str:
    """``GEN 1:2`` as ``Gen.1.2``."""
    book, _, rest = loc.strip().partition(" ")
    return ".".join(x for x in (book[:1].upper() + book[1:].lower(), *re.split(r"[:\s]+", rest)) if x)


def read_usx(text: str) -> Document:
    from quire.sources.xmltree import read_tree

    root = read_tree(text, "usx")
    if root.tag != "usx":
        _Usx().fail(f"unexpected <{root.tag}> at document level")
    return _Usx().document(root)


def read_numbered(text: str, scheme: str = "quran") -> Document:
    """Lines ``sura|aya|text``: suras run on from 1 to 114; verses are coordinates of the scheme."""

    def bad(message: str):
        raise DocumentError("Syntax", f"tanzil import: {message}")

    out: list[Node] = []
    at = 0
    for line in text.split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.fullmatch(r"([0-9]{1,9})\|([0-9]{1,9})\|(.*)", line)
        if not m:
            bad(f"malformed line: {line[:60]}")
        sura, aya = int(m[1]), int(m[2])
        if sura != at:
            if sura != at + 1:
                bad(f"sura {sura} after {at}")
            at = sura
            out.append(Node("para", body=[Node("point", scheme=scheme, text=str(sura))], is_block=True))
            out.append(Node("verse", "~", body=[[]], is_block=True))
        out[-1].body[0].append([Node("point", scheme=scheme, text=f"{sura}.{aya}"), Node("text", text=f" {m[3].strip()}")])
    if at != 114:
        bad(f"expected 114 suras, got {at}")
    return Document("at-usfm", blocks=[Node("block", "#", head=[Node("text", text="quran")], body=out, is_block=True)])
