"""Word documents (DOCX packages) to documents and back: declared structure only, never looks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from quire.model.names import valid_anchor
from quire.model.tree import Document, DocumentError, Node, plain_text
from quire.sources.xmltree import X, alone, block, collapse, embedded, field as named_field, link, media, para, raw, read_tree, span, text, trimmed, void

#: Most bytes that a package may unpack to.
MOST = 1 << 30
#: Style ids by what they mean (fixed values): front matter, quotes, code, and character styles.
FRONT = {"Title": "=", "Subtitle": "=_", "Author": "=:"}
ABSTRACT, QUOTES, CODE, CAPTION = "Abstract", ("Quote", "IntenseQuote", "BlockText", "Quotations"), "SourceCode", ("Caption", "ImageCaption", "TableCaption")
STRONG, EMPHASIS, VERBATIM = "Strong", "Emphasis", "VerbatimChar"
#: Bibliography fields by element of a source, and entry types by kind of source (fixed values).
SOURCE_FIELDS = {"Title": "title", "Year": "year", "JournalName": "journal", "BookTitle": "booktitle", "Publisher": "publisher", "City": "address", "Volume": "volume", "Issue": "number", "Pages": "pages", "Edition": "edition", "URL": "url", "StandardNumber": "isbn"}
SOURCE_KINDS = {"Book": "book", "JournalArticle": "article", "ArticleInAPeriodical": "article", "BookSection": "incollection", "ConferenceProceedings": "inproceedings", "Report": "techreport", "InternetSite": "online", "DocumentFromInternetSite": "online", "Patent": "patent"}
ASTERISM = " * * * "


def fail(message: str):
    raise DocumentError("Syntax", f"docx import: {message}")


def _on(e: X | None) -> bool:
    return e is not None and (e.get("val") or "1").lower() not in ("0", "false", "none", "off")


def _child(e: X | None, *path: str) -> X | None:
    for tag in path:
        e = next(iter(e.own(tag)), None) if e is not None else None
    return e


def _value(e: X | None, *path: str) -> str | None:
    found = _child(e, *path)
    return found.get("val") if found is not None else None


@dataclass
class _List:
    level: int
    ordered: bool
    items: list[Node] = field(default_factory=list)


class Package:
    """The parts of a package, and what they declare: styles, numbering, relations, notes."""

    def __init__(self, content: bytes):
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
            if sum(i.file_size for i in archive.infolist()) > MOST:
                fail(f"the package unpacks to over {MOST} bytes")
            self.parts = {i.filename: archive.read(i) for i in archive.infolist() if not i.is_dir()}
        except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError) as e:
            fail(f"not a readable package: {e}")
        if "word/document.xml" not in self.parts:
            fail("word/document.xml is missing")
        self.styles = {s.get("styleId"): s for s in self.tree("word/styles.xml").all("style")}
        numbering = self.tree("word/numbering.xml")
        formats = {a.get("abstractNumId"): {x.get("ilvl"): _value(x, "numFmt") for x in a.own("lvl")} for a in numbering.all("abstractNum")}
        self.formats = {n.get("numId"): formats.get(_value(n, "abstractNumId"), {}) for n in numbering.all("num")}
        self.relations = {r.get("Id"): r.get("Target") or "" for r in self.tree("word/_rels/document.xml.rels").all("Relationship")}
        self.bodies = {kind: {n.get("id"): n for n in self.tree(f"word/{kind}s.xml").all(kind)} for kind in ("footnote", "endnote", "comment")}

    def tree(self, name: str) -> X:
        found = self.parts.get(name)
        return read_tree(found.decode("utf-8-sig", "replace"), "docx") if found is not None else X("", {})

    def chain(self, style: str | None) -> Iterator[str]:
        """A style and those that it is based on."""
        seen: set[str] = set()
        while style and style not in seen:
            seen.add(style)
            yield style
            style = _value(self.styles.get(style), "basedOn")


class Word:
    def __init__(self, content: bytes):
        self.package = Package(content)
        root = self.package.tree("word/document.xml")
        self.body = root.first("body") or X("body", {})
        self.targets = {h.get("anchor") for h in self.body.all("hyperlink") if h.get("anchor")}
        self.called: list[tuple[str, str]] = []
        self.pictures: list[str] = []

    # Runs.

    def note(self, kind: str, e: X) -> list[Node]:
        key = (kind, e.get("id"))
        if e.get("id") not in self.package.bodies[kind]:
            return []
        if key not in self.called:
            self.called.append(key)
        return [Node("ref", "^!" if kind == "comment" else "^", text=f"n{self.called.index(key) + 1}")]

    def run(self, e: X) -> list[Node]:
        style = set(self.package.chain(_value(e, "rPr", "rStyle")))
        properties = _child(e, "rPr")
        bold = _on(_child(properties, "b")) or STRONG in style
        italic = _on(_child(properties, "i")) or EMPHASIS in style
        out: list[Node] = []
        for k in e.own():
            if k.tag == "t":
                out.append(text(k.text()))
            elif k.tag in ("tab", "br", "cr"):
                out.append(text(" "))
            elif k.tag in ("noBreakHyphen", "softHyphen"):
                out.append(text("-" if k.tag[0] == "n" else ""))
            elif k.tag.endswith("Reference") and k.tag.removesuffix("Reference") in self.package.bodies:
                out += self.note(k.tag.removesuffix("Reference"), k)
            elif k.tag in ("drawing", "pict"):
                for b in k.all("blip", "imagedata"):
                    target = self.package.relations.get(b.get("embed", "id"), "")
                    if name := posixpath.basename(target):
                        self.pictures.append(f"media/{name}")
        if VERBATIM in style:
            return [raw("".join(n.text for n in out if n.kind == "text"))] if out else []
        symbol = {(True, True): "*/", (True, False): "*", (False, True): "/"}.get((bold, italic))
        return [span(symbol, [n]) if symbol and n.kind == "text" and n.text.strip() else n for n in out]

    def pieces(self, e: X) -> list[Node]:
        """Runs, links, fields, insertions and anchors; what was deleted is left out."""
        out: list[Node] = []
        field_: list | None = None  # [instruction, shown, has begun to show]
        depth = 0
        for k in e.own():
            if k.tag == "r":
                mark = _child(k, "fldChar")
                kind = mark.get("fldCharType") if mark is not None else None
                if kind == "begin":
                    depth += 1
                    field_ = field_ if depth > 1 else ["", [], False]
                elif kind == "separate" and depth == 1:
                    field_[2] = True
                elif kind == "end" and depth:
                    depth -= 1
                    if not depth:
                        out += self.field(field_[0], field_[1])
                        field_ = None
                elif field_ is not None and not field_[2]:
                    field_[0] += "".join(x.text() for x in k.own("instrText"))
                else:
                    (field_[1] if field_ is not None else out).extend(self.run(k))
            elif k.tag == "hyperlink":
                shown = joined(self.pieces(k))
                target = self.package.relations.get(k.get("id"), "")
                name = k.get("anchor")
                made = link(target, shown) if target else [*shown, void(">", name)] if name and valid_anchor(name) else shown
                (field_[1] if field_ is not None else out).extend(made)
            elif k.tag == "fldSimple":
                out += self.field(k.get("instr") or "", self.pieces(k))
            elif k.tag == "bookmarkStart":
                if k.get("name") in self.targets and valid_anchor(k.get("name")):
                    out.append(Node("anchor", anchor=k.get("name")))
            elif k.tag in ("ins", "smartTag", "sdt", "sdtContent", "moveTo"):
                out += self.pieces(k)
        return out

    def field(self, instruction: str, shown: list[Node]) -> list[Node]:
        """Index marks, citations and the generated bibliography; any other field is what it shows."""
        words = re.findall(r'"([^"]*)"|(\S+)', instruction)
        words = [a or b for a, b in words]
        kind = words[0].upper() if words else ""
        if kind == "XE" and len(words) > 1:
            return [void("%%", "-".join(words[1].split()))]
        if kind == "CITATION" and len(words) > 1:
            body = trimmed(joined(shown))
            return [Node("wrap", body=[void(">[", words[1]), *body])] if body else [void(">[", words[1])]
        return [] if kind == "BIBLIOGRAPHY" else shown

    # Blocks.

    def outline(self, p: X, styles: list[str]) -> int | None:
        found = _value(p, "pPr", "outlineLvl") or next((v for s in styles if (v := _value(self.package.styles.get(s), "pPr", "outlineLvl"))), None)
        return int(found) if found and re.fullmatch("[0-8]", found) else None

    def listed(self, p: X, styles: list[str]) -> tuple[int, bool] | None:
        places = [_child(p, "pPr", "numPr"), *[_child(self.package.styles.get(s), "pPr", "numPr") for s in styles]]
        numbering = next((x for x in places if x is not None), None)
        name = _value(numbering, "numId")
        if not name or name == "0":
            return None
        level = _value(numbering, "ilvl") or "0"
        kind = self.package.formats.get(name, {}).get(level)
        return (int(level) if re.fullmatch("[0-8]", level) else 0, kind not in (None, "bullet", "none"))

    def content(self, e: X) -> list[Node]:
        """Blocks: headings hold what follows them, items of one list stand together, quoted paragraphs, too."""
        top: list[Node] = []
        open_: list[tuple[int, list[Node]]] = [(-1, top)]
        lists: list[_List] = []
        last = ""

        def here() -> list[Node]:
            return open_[-1][1]

        def put(made: list[Node], kind: str = "") -> None:
            nonlocal last
            lists.clear()
            here().extend(made)
            last = kind

        for p in flat_blocks(e):
            if p.tag == "tbl":
                put([self.table(p)])
                continue
            styles = list(self.package.chain(_value(p, "pPr", "pStyle")))
            run = trimmed(joined(self.pieces(p)))
            pictures = [media(x) for x in self.pictures]
            self.pictures = []
            level = self.outline(p, styles)
            front = next((s for s in styles if s in FRONT), None)
            if front:
                put([alone(FRONT[front], run)] if run else [])
            elif level is not None and run:
                while open_[-1][0] >= level:
                    open_.pop()
                made = block("#" * min(level + 1, 4), [], run)
                put([made])
                open_.append((level, made.body))
            elif (found := self.listed(p, styles)) and run:
                self.item(here(), lists, *found, run)
                last = "list"
            elif any(s in QUOTES for s in styles) and run:
                if last == "quote":
                    here()[-1].body.append(para(run))
                else:
                    put([block('"', [para(run)])], "quote")
            elif ABSTRACT in styles and run:
                if last == "abstract":
                    here()[-1].body.append(para(run))
                else:
                    put([block('="', [para(run)])], "abstract")
            elif CODE in styles:
                code = "".join(x.text() if x.tag == "t" else "\n" for x in p.all("t", "br")) + "\n"
                if last == "code":
                    here()[-1].text += code
                else:
                    put([raw(code, True)], "code")
            elif any(s in CAPTION for s in styles) and run and here() and here()[-1].kind in ("media", "block") and last in ("picture", "table"):
                shown = here().pop()
                put([block("<", [shown], run, flips=False)] if shown.kind == "media" else [_with_head(shown, run)])
            elif run or pictures:
                put([para(run)] if run else [])
            if pictures:
                put(pictures, "picture")
            elif not run and level is None and CODE not in styles:
                last = last if last == "list" else ""
        return top

    def item(self, out: list[Node], lists: list[_List], level: int, ordered: bool, run: list[Node]) -> None:
        while lists and (lists[-1].level > level or (lists[-1].level == level and lists[-1].ordered != ordered)):
            lists.pop()
        if not lists or lists[-1].level < level:
            made = block(".." if ordered else "--", [])
            (lists[-1].items[-1].body if lists else out).append(made)
            lists.append(_List(level, ordered, made.body))
        items = lists[-1].items
        items.append(block(".-" if ordered else "-", [para(run)], ordinal=len(items) + 1 if ordered else None))

    def table(self, e: X) -> Node:
        """Rows marked as headers are header rows; cells that a merge covers are left out."""
        grid: list[list[tuple[int, int, X]]] = []  # (column, width, cell)
        for r in e.own("tr"):
            at, row = 0, []
            for c in r.own("tc"):
                wide = _value(c, "tcPr", "gridSpan") or "1"
                width = max(1, int(wide)) if re.fullmatch("[0-9]{1,3}", wide) else 1
                row.append((at, width, c))
                at += width
            grid.append(row)

        def merges(k: int, column: int) -> bool:
            return any(a == column and (m := _child(c, "tcPr", "vMerge")) is not None and m.get("val") != "restart" for a, _, c in grid[k])

        rows = []
        for k, (r, row) in enumerate(zip(e.own("tr"), grid)):
            cells = []
            for column, width, c in row:
                if merges(k, column):
                    continue
                height = 1
                while _child(c, "tcPr", "vMerge") is not None and k + height < len(grid) and merges(k + height, column):
                    height += 1
                marks = [void(s, str(n)) for s, n in (("+>", width), ("+_", height)) if n > 1]
                inner = self.content(c)
                if marks and inner and inner[0].kind == "para":
                    inner[0].body[:0] = marks
                elif marks:
                    inner.insert(0, para(marks))
                cells.append(block("+:", inner))
            rows.append(block("+=" if _on(_child(r, "trPr", "tblHeader")) else "+-", cells))
        return block("+", rows)

    def sources(self) -> list[Node]:
        out = []
        for name in sorted(self.package.parts):
            if not re.fullmatch(r"customXml/item[0-9]+\.xml", name):
                continue
            for s in self.package.tree(name).all("Source"):
                own = {k.tag: k.flat() for k in s.own()}
                people = [", ".join(x for x in (p.first("Last") and p.first("Last").flat(), p.first("First") and p.first("First").flat()) if x) for a in s.own("Author") for p in a.all("Person")]
                fields = [("author", " and ".join(people))] * bool(people) + [(to, own[tag]) for tag, to in SOURCE_FIELDS.items() if own.get(tag)]
                if own.get("Tag"):
                    out.append(block("&", [named_field(*f) for f in fields], [text(own["Tag"])], classes=[SOURCE_KINDS.get(own.get("SourceType"), "misc")]))
        return out

    def document(self) -> Document:
        blocks = self.content(self.body)
        fronts = {b.body[0].symbol for b in blocks if b.kind == "para" and len(b.body) == 1 and b.body[0].kind == "span"}
        core = self.package.tree("docProps/core.xml")
        for symbol, tag in (("=:", "creator"), ("=", "title")):
            told = next((k.flat() for k in core.all(tag) if k.flat()), None)
            if told and symbol not in fronts:
                blocks.insert(1 if symbol == "=:" and "=" in fronts else 0, alone(symbol, [text(told)]))
        at = 0
        while at < len(self.called):  # notes can call notes
            kind, key = self.called[at]
            at += 1
            blocks.append(block("^!" if kind == "comment" else "^", self.content(self.package.bodies[kind][key]), anchor=f"n{at}"))
        entries = self.sources()
        return Document("litogramma", blocks=[*blocks, *([embedded("bibliogramma", entries)] if entries else [])])


def _with_head(b: Node, head: list[Node]) -> Node:
    b.head = head
    return b


def flat_blocks(e: X) -> Iterator[X]:
    for k in e.own():
        if k.tag in ("p", "tbl"):
            yield k
        elif k.tag in ("sdt", "sdtContent", "ins", "customXml", "txbxContent", "moveTo"):
            yield from flat_blocks(k)


def joined(run: list[Node]) -> list[Node]:
    """Neighbours of one look as one."""
    out: list[Node] = []
    for n in run:
        before = out[-1] if out else None
        if before is not None and n.kind == "text" and before.kind == "text":
            before.text = collapse(before.text + n.text)
        elif before is not None and n.kind == "span" and before.kind == "span" and before.symbol == n.symbol and n.symbol in ("*", "/", "*/"):
            before.body = joined([*before.body, *n.body])
        else:
            out.append(Node("text", text=collapse(n.text)) if n.kind == "text" else n)
    return out


def read_docx(content: bytes) -> Document:
    return Word(content).document()


def docx_media(content: bytes) -> list[tuple[str, bytes]]:
    return [(posixpath.basename(n), x) for n, x in sorted(Package(content).parts.items()) if n.startswith("word/media/")]


# Writing.

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml"}
_LEVELS = {"==": 0, "===": 1, "#": 0, "##": 1, "###": 2, "####": 3}


class _Writer:
    def __init__(self, images: dict[str, bytes]):
        self.images, self.links, self.files, self.notes, self.bodies = images, [], [], {}, {}

    def text(self, value: str, bold: bool = False, italic: bool = False, style: str = "") -> str:
        properties = (f'<w:rStyle w:val="{style}"/>' if style else "") + "<w:b/>" * bold + "<w:i/>" * italic
        return f'<w:r>{f"<w:rPr>{properties}</w:rPr>" if properties else ""}<w:t xml:space="preserve">{escape(value)}</w:t></w:r>'

    def run(self, seq: list[Node], bold: bool = False, italic: bool = False) -> str:
        out = []
        for n in seq:
            if n.kind == "text":
                out.append(self.text(n.text, bold, italic))
            elif n.kind == "raw":
                out.append(self.text(n.text, bold, italic, VERBATIM))
            elif n.kind == "span" and n.symbol == "><":
                self.links.append(plain_text(n.body))
                out.append(f'<w:hyperlink r:id="link{len(self.links)}">{self.run(n.body, bold, italic)}</w:hyperlink>')
            elif n.kind in ("span", "wrap"):
                out.append(self.run(n.body, bold or n.symbol in ("*", "*/"), italic or n.symbol in ("/", "*/")))
            elif n.kind == "ref" and n.symbol.startswith("^") and n.text in self.bodies:
                k = self.notes.setdefault(n.text, len(self.notes) + 2)
                out.append(f'<w:r><w:footnoteReference w:id="{k}"/></w:r>')
            elif n.kind == "anchor":
                out.append(f'<w:bookmarkStart w:id="0" w:name="{escape(n.anchor)}"/><w:bookmarkEnd w:id="0"/>')
            elif n.kind == "void" and n.symbol == ">":
                out.append(f'<w:hyperlink w:anchor="{escape(n.text)}">{self.text(n.text)}</w:hyperlink>')
            elif n.kind == "void" and n.symbol == ">[":
                out.append(f'<w:fldSimple w:instr="CITATION {escape(n.text)}">{self.text(f"[{n.text}]")}</w:fldSimple>')
        return "".join(out)

    def p(self, inner: str, style: str = "", more: str = "") -> str:
        properties = (f'<w:pStyle w:val="{style}"/>' if style else "") + more
        return f"<w:p>{f'<w:pPr>{properties}</w:pPr>' if properties else ''}{inner}</w:p>"

    def gather(self, seq: list[Node]) -> None:
        for b in seq:
            if b.kind == "block" and b.symbol in ("^", "^^", "^^^", "^!") and b.anchor:
                self.bodies[b.anchor] = b
            if b.kind in ("block", "wrap"):
                self.gather(b.body)

    def block(self, b: Node, style: str, depth: int) -> str:
        if b.kind == "para":
            only = b.body[0] if len(b.body) == 1 and b.body[0].kind == "span" else None
            front = next((s for s, m in FRONT.items() if only is not None and only.symbol == m), None)
            return self.p(self.run(only.body if front else b.body), front or style)
        if b.kind == "raw":
            return "".join(self.p(self.text(x), CODE) for x in b.text.rstrip("\n").split("\n"))
        if b.kind == "media":
            name = posixpath.basename(b.text)
            if b.text not in self.images:
                return self.p(self.text(f"[{name}]"), style)
            self.files.append(b.text)
            return self.p(f'<w:r><w:drawing><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" r:embed="file{len(self.files)}"/></w:drawing></w:r>')
        if b.kind == "verse":
            head = self.p(self.run(b.head, True)) if b.head else ""
            lines = ["<w:r><w:br/></w:r>".join(self.run(x) for x in s) for s in b.body]
            return head + "".join(self.p(x, style) for x in lines) + (self.p(self.run(b.tail)) if b.tail else "")
        if b.kind != "block":
            return self.blocks(b.body, style, depth) if b.kind == "wrap" else ""
        if b.symbol in _LEVELS and b.head:
            return self.p(self.run(b.head), f"Heading{_LEVELS[b.symbol] + 1}") + self.blocks(b.body, style, depth)
        if b.symbol in ("--", ".."):
            return "".join(self.item(x, 1 if b.symbol == "--" else 2, depth) for x in b.body if x.kind == "block")
        if b.symbol in ('"', '"/'):
            return self.blocks(b.body, "Quote", depth) + (self.p(self.run(b.tail), "Quote") if b.tail else "")
        if b.symbol == '="':
            return self.blocks(b.body, ABSTRACT, depth)
        if b.symbol == "+":
            return self.table(b)
        if b.anchor in self.bodies:
            return ""
        head = self.p(self.run(b.head, True), CAPTION[0] if b.symbol == "<" else style) if b.head else ""
        inner = self.blocks(b.body, style, depth)
        return inner + head if b.symbol == "<" else head + inner

    def item(self, b: Node, numbering: int, depth: int) -> str:
        out, first = "", True
        for k in b.body:
            if k.kind == "para":
                mark = f'<w:numPr><w:ilvl w:val="{min(depth, 8)}"/><w:numId w:val="{numbering}"/></w:numPr>' if first else ""
                out += self.p(self.run(k.body), "", mark)
                first = False
            else:
                out += self.block(k, "", depth + 1)
        return out

    def table(self, b: Node) -> str:
        out, below = "", {}  # below: column -> (rows to cover, width)
        for r in b.body:
            cells, at = "", 0

            def covered() -> None:
                nonlocal cells, at
                while below.get(at, (0, 1))[0]:
                    rows, width = below[at]
                    below[at] = (rows - 1, width)
                    cells += f'<w:tc><w:tcPr><w:gridSpan w:val="{width}"/><w:vMerge/></w:tcPr><w:p/></w:tc>'
                    at += width

            for c in r.body:
                covered()
                first = c.body[0].body if c.body and c.body[0].kind == "para" else []
                spans = {n.symbol: int(n.text) for n in first if n.kind == "void" and n.symbol in ("+>", "+_") and n.text.isascii() and n.text.isdigit()}
                width, height = spans.get("+>", 1), spans.get("+_", 1)
                properties = (f'<w:gridSpan w:val="{width}"/>' if width > 1 else "") + ('<w:vMerge w:val="restart"/>' if height > 1 else "")
                inner = self.blocks(c.body, "", 0) or "<w:p/>"
                cells += f"<w:tc><w:tcPr>{properties}</w:tcPr>{inner}</w:tc>"
                if height > 1:
                    below[at] = (height - 1, width)
                at += width
            covered()
            head = "<w:trPr><w:tblHeader/></w:trPr>" if r.symbol == "+=" else ""
            out += f"<w:tr>{head}{cells}</w:tr>"
        return f"<w:tbl><w:tblPr/>{out}</w:tbl>" + (self.p(self.run(b.head), CAPTION[0]) if b.head else "")

    def blocks(self, seq: list[Node], style: str = "", depth: int = 0) -> str:
        return "".join(self.block(b, style, depth) for b in seq)


def _styles() -> str:
    named = [*FRONT, ABSTRACT, QUOTES[0], CODE, CAPTION[0]]
    heads = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k + 1}"><w:name w:val="heading {k + 1}"/><w:pPr><w:outlineLvl w:val="{k}"/></w:pPr></w:style>' for k in range(4))
    plain = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{s}"/></w:style>' for s in named)
    characters = "".join(f'<w:style w:type="character" w:styleId="{s}"><w:name w:val="{s}"/></w:style>' for s in (STRONG, EMPHASIS, VERBATIM))
    return f"<w:styles {_W}>{heads}{plain}{characters}</w:styles>"


def _numbering() -> str:
    levels = lambda kind: "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="{kind}"/></w:lvl>' for k in range(9))
    kinds = [(1, "bullet"), (2, "decimal")]
    lists = "".join(f'<w:abstractNum w:abstractNumId="{n}">{levels(k)}</w:abstractNum>' for n, k in kinds)
    return f"<w:numbering {_W}>{lists}" + "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n, _ in kinds) + "</w:numbering>"


def write_docx(doc: Document, images: dict[str, bytes] | None = None) -> bytes:
    """A package with the same bytes for the same document. images: bytes by the name that the document refers to."""
    w = _Writer(images or {})
    w.gather(doc.blocks)
    body = w.blocks(doc.blocks)
    done, notes = 0, ""
    while done < len(w.notes):
        name, k = list(w.notes.items())[done]
        notes += f'<w:footnote w:id="{k}">{w.blocks(w.bodies[name].body)}</w:footnote>'
        done += 1
    relations = [("styles", "styles.xml", ""), ("numbering", "numbering.xml", ""), ("footnotes", "footnotes.xml", "")]
    listed = [f'<Relationship Id="{kind}" Type="{_REL}/{kind}" Target="{target}"/>' for kind, target, _ in relations]
    listed += [f'<Relationship Id="link{k}" Type="{_REL}/hyperlink" Target="{escape(u, {chr(34): "&quot;"})}" TargetMode="External"/>' for k, u in enumerate(w.links, 1)]
    listed += [f'<Relationship Id="file{k}" Type="{_REL}/image" Target="media/{escape(posixpath.basename(n))}"/>' for k, n in enumerate(w.files, 1)]
    package = "http://schemas.openxmlformats.org/package/2006"
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    types = "".join(f'<Default Extension="{e[1:]}" ContentType="{t}"/>' for e, t in _TYPES.items())
    overrides = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{main}.{t}+xml"/>' for n, t in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"), ("footnotes", "footnotes")))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}{overrides}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="main" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="{package}/relationships">{"".join(listed)}</Relationships>',
        "word/document.xml": f"{head}<w:document {_W}><w:body>{body}</w:body></w:document>",
        "word/footnotes.xml": f"{head}<w:footnotes {_W}>{notes}</w:footnotes>",
        "word/numbering.xml": head + _numbering(),
        "word/styles.xml": head + _styles(),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in [*parts.items(), *((f"word/media/{posixpath.basename(n)}", w.images[n]) for n in dict.fromkeys(w.files))]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, content)
    return out.getvalue()
