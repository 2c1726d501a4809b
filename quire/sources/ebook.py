"""FictionBook 2: e-books to documents and back."""

from __future__ import annotations

import base64
import binascii
import posixpath
import re
from xml.sax.saxutils import escape

from quire.model.names import valid_anchor
from quire.model.tree import Document, Node, plain_text
from quire.sources.xmltree import Reader, X, alone, block, collapse, link, media, para, raw, read_tree, span, text, trimmed, verse, void

ASTERISM = " * * * "
#: Content types by extension (fixed values).
TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp"}


def media_name(name: str | None) -> str | None:
    """A binary's id, if it is the name of a file and of nothing above it."""
    return name if name and not re.search(r"[/\\\s]|^\.", name) else None


class FictionBook(Reader):
    what = "fb2"

    def __init__(self):
        super().__init__()
        self.depth, self.notes_of, self.sections = 0, {}, set()
        self.title: list[Node] = []
        self.blocks_of = {
            "p": lambda e: [para(r)] if (r := self.run(e)) else [],
            "subtitle": lambda e: [alone("#_", r)] if (r := self.run(e)) else [],
            "section": self.section,
            "epigraph": lambda e: [self.quoted(e, '"/')],
            "cite": lambda e: [self.quoted(e, '"')],
            "poem": self.poem,
            "table": self.table,
            "empty-line": lambda e: [alone("**", [text(ASTERISM)])],
            "image": self.image,
            "title": lambda e: [],
            "text-author": lambda e: [],
            "annotation": lambda e: [],
        }
        self.inlines_of = {
            "emphasis": self.spanned("/"),
            "strong": self.spanned("*"),
            **{k: self.spanned(",", k) for k in ("strikethrough", "sub", "sup")},
            "code": lambda e: [raw(e.text())],
            "a": self.linked,
            "image": lambda e: [],
            "empty-line": lambda e: [],
        }
        self.other_block, self.other_inline = self.blocks, self.through

    def blocks(self, e: X, *skip: str) -> list[Node]:
        return [n for k in e.own() if k.tag not in skip for n in self.block(k)]

    def lines(self, e: X, tag: str = "title") -> list[Node]:
        """The paragraphs of an element's titles, or its authors, in one line."""
        out: list[Node] = []
        for t in e.own(tag):
            for p in t.own("p") or [t]:
                run = self.run(p)
                out += [text(" "), *run] if out and run else run
        return trimmed(out)

    def section(self, e: X) -> list[Node]:
        self.depth += 1
        head, inner = self.lines(e), self.blocks(e)
        symbol = "#" * min(self.depth, 4) if head else "_"
        self.depth -= 1
        name = e.get("id")
        return [block(symbol, inner, head, anchor=name if name and valid_anchor(name) else None)]

    def quoted(self, e: X, symbol: str) -> Node:
        return block(symbol, self.blocks(e), tail=self.lines(e, "text-author"))

    def poem(self, e: X) -> list[Node]:
        stanzas = [[self.run(v) for v in s.own("v")] for s in e.own("stanza")]
        before = [self.quoted(k, '"/') for k in e.own("epigraph")]
        after = [alone("-/", r) for k in e.own("date") if (r := self.run(k))]
        return [*before, verse("~", [s for s in stanzas if s], self.lines(e), tail=self.lines(e, "text-author")), *after]

    def table(self, e: X) -> list[Node]:
        rows = []
        for r in e.own("tr"):
            cells = []
            for c in r.own("td", "th"):
                spans = [void(s, c.get(a)) for a, s in (("colspan", "+>"), ("rowspan", "+_")) if (c.get(a) or "1") != "1"]
                run = [*spans, *self.run(c)]
                cells.append(block("+:", [para(run)] if run else []))
            heads = bool(r.own("th")) and not r.own("td")
            rows.append(block("+=" if heads else "+-", cells))
        return [block("+", rows)]

    def image(self, e: X) -> list[Node]:
        name = media_name((e.get("href") or "").removeprefix("#"))
        return [media(f"media/{name}")] if name else []

    def linked(self, e: X) -> list[Node]:
        target, shown = e.get("href") or "", self.run(e)
        if not target.startswith("#"):
            return link(target, shown)
        name = target[1:]
        if e.get("type") == "note":
            return [Node("ref", "^", text=name)] if name in self.notes_of else shown
        return [void(">", name)] if name in self.sections else shown

    def document(self, root: X) -> Document:
        info = root.first("title-info") or X("", {})
        bodies = root.own("body")
        main = [b for b in bodies if b.get("name") in (None, "main")]
        for b in bodies:
            if b not in main:
                self.notes_of |= {s.get("id"): s for s in b.all("section") if s.get("id") and valid_anchor(s.get("id"))}
        self.sections = {s.get("id") for b in main for s in b.all("section") if s.get("id") and valid_anchor(s.get("id"))}
        title = trimmed([n for t in info.own("book-title") for n in self.pieces(t.kids)])
        authors = [" ".join(k.flat() for k in a.own("first-name", "middle-name", "last-name", "nickname") if k.flat()) for a in info.own("author")]
        about = [n for a in info.own("annotation") for n in self.blocks(a)]
        body: list[Node] = []
        for b in main:
            found = self.blocks(b)
            title = title or self.lines(b)
            only = found[0] if len(found) == 1 else None
            if only is not None and only.symbol == "_" and not only.head and only.anchor is None and not any(k.symbol in ("_", "#", "##", "###", "####") for k in only.body):
                found = only.body
            body += found
        notes = [block("^", self.blocks(s, "title"), anchor=name) for name, s in self.notes_of.items()]
        out = [alone("=", title)] if title else []
        out += [alone("=:", [text(a)]) for a in authors if a]
        out += [block('="', about)] if about else []
        return Document("litogramma", blocks=[*out, *body, *notes])


def read_fb2(source: str) -> Document:
    return FictionBook().document(read_tree(source, "fb2"))


def fb2_media(source: str) -> list[tuple[str, str, bytes]]:
    """(name, content type, bytes) of the binaries that can be decoded."""
    out = []
    for e in read_tree(source, "fb2").own("binary"):
        try:
            body = base64.b64decode("".join(e.text().split()), validate=True)
        except (binascii.Error, ValueError):
            continue
        if name := media_name(e.get("id")):
            out.append((name, e.get("content-type") or "application/octet-stream", body))
    return out


class _Writer:
    """Sections hold all loose blocks; notes gather in a body of their own and are numbered by their first call."""

    def __init__(self, images: dict[str, bytes]):
        self.images, self.numbers, self.bodies = images, {}, {}

    def inline(self, n: Node) -> str:
        inner = lambda: self.run(n.body)
        if n.kind == "text":
            return escape(n.text)
        if n.kind == "raw":
            return f"<code>{escape(n.text)}</code>"
        if n.kind == "ref":
            if n.symbol != "^":
                return ""
            k = self.numbers.setdefault(n.text, len(self.numbers) + 1)
            return f'<a l:href="#{n.text}" type="note">[{k}]</a>'
        if n.kind == "void":
            return f'<a l:href="#{escape(n.text)}">{escape(n.text)}</a>' if n.symbol == ">" else ""
        if n.kind == "span":
            tag = {"/": "emphasis", "*": "strong"}.get(n.symbol)
            tag = tag or next((c for c in n.classes if c in ("strikethrough", "sub", "sup")), None)
            if n.symbol == "*/":
                return f"<strong><emphasis>{inner()}</emphasis></strong>"
            if n.symbol == "><":
                url = escape(plain_text(n.body), {'"': "&quot;"})
                return f'<a l:href="{url}">{inner()}</a>'
            return f"<{tag}>{inner()}</{tag}>" if tag else inner()
        return inner() if n.kind == "wrap" else ""

    def run(self, seq: list[Node]) -> str:
        return "".join(map(self.inline, seq))

    def block(self, b: Node) -> str:
        if b.kind == "para":
            only = b.body[0] if len(b.body) == 1 and b.body[0].kind == "span" else None
            if only is not None and only.symbol in ("=", "=:", "=_", "=;"):
                return ""
            if only is not None and only.symbol == "**":
                return "<empty-line/>\n"
            if only is not None and only.symbol == "#_":
                return f"<subtitle>{self.run(only.body)}</subtitle>\n"
            return f"<p>{self.run(b.body)}</p>\n"
        if b.kind == "raw":
            return "".join(f"<p><code>{escape(x)}</code></p>\n" for x in b.text.rstrip("\n").split("\n"))
        if b.kind == "media":
            name = posixpath.basename(b.text)
            return f'<image l:href="#{escape(name)}"/>\n'
        if b.kind == "verse":
            title = f"<title><p>{self.run(b.head)}</p></title>\n" if b.head else ""
            stanzas = "".join("<stanza>\n" + "".join(f"<v>{self.run(x)}</v>\n" for x in s) + "</stanza>\n" for s in b.body)
            return f"<poem>\n{title}{stanzas}{self.author(b)}</poem>\n"
        if b.kind == "embed":
            return ""
        if b.kind == "block" and b.symbol in ('"', '"/'):
            tag = "cite" if b.symbol == '"' else "epigraph"
            return f"<{tag}>\n{self.blocks(b.body)}{self.author(b)}</{tag}>\n"
        if b.kind == "block" and b.symbol == "^":
            self.bodies[b.anchor] = b
            return ""
        if b.kind == "block" and b.symbol == "+":
            rows = ""
            for r in b.body:
                tag = "th" if r.symbol == "+=" else "td"
                rows += "<tr>" + "".join(f"<{tag}>{self.run([n for p in c.body for n in p.body if n.kind != 'void'])}</{tag}>" for c in r.body) + "</tr>\n"
            return f"<table>\n{rows}</table>\n"
        if b.kind == "block" and self.is_section(b):
            return self.section(b)
        head = f"<p><strong>{self.run(b.head)}</strong></p>\n" if b.head else ""
        return head + self.blocks(b.body)

    def is_section(self, b: Node) -> bool:
        return b.kind == "block" and b.symbol in ("==", "===", "#", "##", "###", "####", "_")

    def author(self, b: Node) -> str:
        return f"<text-author>{self.run(b.tail)}</text-author>\n" if b.tail else ""

    def section(self, b: Node) -> str:
        name = f' id="{escape(b.anchor)}"' if b.anchor else ""
        title = f"<title><p>{self.run(b.head)}</p></title>\n" if b.head else ""
        return f"<section{name}>\n{title}{self.held(b.body)}</section>\n"

    def held(self, seq: list[Node]) -> str:
        """Content that mixes sections with loose blocks puts the loose ones into sections, too. A section without content
        holds an empty paragraph, which is read as nothing.
        """
        if not any(self.is_section(b) for b in seq):
            return self.blocks(seq) or "<p/>\n"
        out, loose = "", ""
        for b in seq:
            if self.is_section(b):
                out += f"<section>\n{loose}</section>\n" if loose else ""
                out, loose = out + self.section(b), ""
            else:
                loose += self.block(b)
        return out + (f"<section>\n{loose}</section>\n" if loose else "")

    def blocks(self, seq: list[Node]) -> str:
        return "".join(map(self.block, seq))


def write_fb2(doc: Document, images: dict[str, bytes] | None = None) -> str:
    """images: bytes by the name that the document refers to."""
    w = _Writer(images or {})
    fronts = {s: [b.body[0] for b in doc.blocks if b.kind == "para" and len(b.body) == 1 and b.body[0].kind == "span" and b.body[0].symbol == s] for s in ("=", "=:")}
    about = next((b for b in doc.blocks if b.kind == "block" and b.symbol == '="'), None)
    rest = [b for b in doc.blocks if b is not about]
    title = plain_text(fronts["="][0].body) if fronts["="] else ""
    authors = "".join(f"<author><nickname>{escape(plain_text(a.body))}</nickname></author>\n" for a in fronts["=:"])
    annotation = f"<annotation>\n{w.blocks(about.body)}</annotation>\n" if about is not None else ""
    main = w.held(rest)
    body = main if any(w.is_section(b) for b in rest) else f"<section>\n{main}</section>\n"
    notes = ""
    for name in sorted(w.bodies, key=lambda n: (n not in w.numbers, w.numbers.get(n, 0))):
        k = w.numbers.setdefault(name, len(w.numbers) + 1)
        notes += f'<section id="{escape(name or "")}">\n<title><p>{k}</p></title>\n{w.blocks(w.bodies[name].body)}</section>\n'
    notes = f'<body name="notes">\n{notes}</body>\n' if notes else ""
    binaries = "".join(f'<binary id="{escape(posixpath.basename(n))}" content-type="{TYPES.get(posixpath.splitext(n)[1].lower(), "application/octet-stream")}">{base64.b64encode(x).decode()}</binary>\n' for n, x in sorted(w.images.items()))
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink">\n'
        f"<description>\n<title-info>\n{authors}<book-title>{escape(title)}</book-title>\n{annotation}</title-info>\n</description>\n<body>\n{body}</body>\n{notes}{binaries}</FictionBook>\n"
    )
