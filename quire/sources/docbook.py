"""DocBook books and articles, and JATS articles."""

from __future__ import annotations

from quire.model.tree import Document, Node
from quire.sources.xmltree import Reader, X, alone, anchor_of, block, embedded, field, link, media, para, raw, read_tree, span, text, void

ROOTS = ("article", "book", "chapter")
SECTIONS = ("section", "sect1", "sect2", "sect3", "sect4", "sect5")
#: Fields of the publication statement by element (fixed values).
COLOPHON = {"publishername": "officina", "address": "locus", "pubdate": "datum"}


class DocBook(Reader):
    what = "docbook"

    def __init__(self):
        super().__init__()
        plain = lambda symbol, flips=True: lambda e: self.captioned(e, symbol, flips)
        self.blocks_of = dict.fromkeys(SECTIONS, self.section) | {
            "para": self.paragraph,
            "blockquote": plain(">", False),
            "note": plain("!"),
            "warning": plain("!!"),
            "itemizedlist": plain("--"),
            "orderedlist": plain(".."),
            "listitem": plain("-"),
            "footnote": lambda e: [block("^", self.blocks(e), anchor=anchor_of(e))],
            "programlisting": self.listing,
            "mediaobject": self.picture,
            "anchor": lambda e: [para(self.anchor(e))],
            "info": lambda e: [],
            "title": lambda e: self.settled(para(self.run(e))),
        }
        literal = lambda e: [raw(e.text())]
        self.inlines_of = {
            "emphasis": lambda e: [span("*" if e.get("role") in ("strong", "bold") else "/", self.run(e))],
            "literal": literal,
            "code": literal,
            "quote": self.spanned('""'),
            "footnote": self.note,
            "footnoteref": self.note_again,
            "anchor": self.anchor,
            "link": self.linked,
            "ulink": self.linked,
        }

    def heading(self, e: X) -> X | None:
        """An element's title: its own first element, or that of its information."""
        own = e.own()
        if own and own[0].tag == "title":
            return own[0]
        info = own[0] if own and own[0].tag == "info" else None
        return info and next(iter(info.own("title")), None)

    def section(self, e: X) -> list[Node]:
        title = self.heading(e)
        if title is None:
            self.fail("section without a title")
        head = self.run(title)
        before = self.settled()
        inner = self.blocks_without(e, title)
        return [block("#", [*before, *inner], head, anchor=anchor_of(e))]

    def blocks_without(self, e: X, title: X | None) -> list[Node]:
        rest = X(e.tag, e.attrs)
        rest.kids = [k for k in e.kids if k is not title]
        return self.blocks(rest)

    def captioned(self, e: X, symbol: str, flips: bool) -> list[Node]:
        return [block(symbol, self.blocks(e), flips=flips)]

    def listing(self, e: X) -> list[Node]:
        language = e.get("language")
        return [raw(e.text(), True, *([language.lower()] if language else []))]

    def picture(self, e: X) -> list[Node]:
        files = [d.get("fileref") for d in e.all("imagedata") if d.get("fileref")]
        if not files:
            self.fail("mediaobject without an imagedata fileref")
        return [media(files[0])]

    def anchor(self, e: X) -> list[Node]:
        if (name := e.get("xml:id", "id")) is None:
            self.fail("anchor without xml:id")
        return [Node("anchor", anchor=name)]

    def note_again(self, e: X) -> list[Node]:
        if (name := e.get("linkend")) is None:
            self.fail("footnoteref without linkend")
        return [Node("ref", "^", text=name)]

    def linked(self, e: X) -> list[Node]:
        return link((e.get("xlink:href", "url") or "").strip(), self.run(e))

    def colophon(self, root: X) -> list[Node]:
        info = next(iter(root.own("info")), None)
        if info is None:
            return []
        parts = [p for k in info.own() for p in (k.own() if k.tag == "publisher" else [k])]
        found = [(COLOPHON[p.tag], p.flat()) for p in parts if p.tag in COLOPHON and p.flat()]
        order = list(COLOPHON.values())
        fields = [field(name, value) for name, value in sorted(found, key=lambda f: order.index(f[0]))]
        return [embedded("kolophon", fields)] if fields else []

    def document(self, root: X) -> Document:
        if root.tag not in ROOTS:
            self.fail(f"unexpected <{root.tag}> at document level")
        title = self.heading(root)
        out = [alone("=", self.run(title))] if title is not None else []
        out += self.settled()
        return Document("at-docbook", blocks=[*out, *self.blocks_without(root, title), *self.colophon(root)])


def read_docbook(source: str) -> Document:
    return DocBook().document(read_tree(source, "docbook"))


#: Bibliography fields by element of a citation, and entry types by kind of publication (fixed values).
CITATION = {"article-title": "title", "source": "journal", "year": "year", "volume": "volume", "fpage": "pages", "lpage": "lpages", "publisher-name": "publisher"}
KINDS = {"journal": "article", "book": "book"}


class Jats(Reader):
    what = "jats"

    def __init__(self):
        super().__init__()
        self.depth = 0
        self.blocks_of = {"sec": self.section, "p": self.paragraph, "disp-quote": lambda e: [block('"', self.blocks(e))]}
        self.inlines_of = {
            "italic": self.spanned("/"),
            "bold": self.spanned("*"),
            "monospace": lambda e: [raw(e.text())],
            "xref": self.cited,
            "ext-link": lambda e: [span("><", [text(e.get("xlink:href", "href") or e.text())])],
            "fn": self.note,
        }

    def section(self, e: X) -> list[Node]:
        own = e.own()
        if not own or own[0].tag != "title":
            self.fail("sec without a title")
        head = self.run(own[0])
        before = self.settled()
        self.depth += 1
        inner = self.blocks(e, "title") if len(e.own("title")) == 1 else self.fail("<title> outside the head of a <sec>")
        self.depth -= 1
        return [block("#" * min(self.depth + 1, 4), [*before, *inner], head)]

    def cited(self, e: X) -> list[Node]:
        if e.get("ref-type") != "bibr" or not e.get("rid"):
            self.fail("only xref[ref-type=bibr] with a rid is supported")
        return [void(">[", e.get("rid"))]

    def front(self, e: X) -> list[Node]:
        out: list[Node] = []
        for k in e.all("article-title", "contrib", "abstract"):
            if k.tag == "article-title":
                out += self.settled(alone("=", self.run(k)))
            elif k.tag == "abstract":
                own = X(k.tag, k.attrs)
                heads = k.own("title")
                own.kids = [x for x in k.kids if not heads or x is not heads[0]]
                out += [block('="', self.blocks(own))]
            elif name := person(k, " ", False):
                out.append(alone("=:", [text(name)]))
        return out

    def reference(self, e: X) -> Node:
        if e.get("id") is None:
            self.fail("ref without id")
        kind, fields, authors = "misc", [], []
        for c in e.all("element-citation", "mixed-citation"):
            published = c.get("publication-type")
            kind = KINDS.get(published, published) if published else kind
            if c.tag == "mixed-citation":
                fields.append(("note", c.flat()))
                continue
            for k in c.all():
                if k.tag in ("name", "string-name"):
                    authors.append(person(k, ", ", True))
                elif k.tag in CITATION:
                    fields.append((CITATION[k.tag], k.text().strip("\n")))
        fields = [("author", " and ".join(authors))] * bool(authors) + [f for f in fields if f[1]]
        return block("&", [field(*f) for f in fields], [text(e.get("id"))], classes=[kind])

    def document(self, root: X) -> Document:
        if root.tag != "article":
            self.fail(f"unexpected <{root.tag}> at document level")
        out, entries = [], []
        for k in root.own():
            if k.tag == "front":
                out += self.front(k)
            elif k.tag == "body":
                out += self.blocks(k)
            elif k.tag == "back":
                entries += [self.reference(r) for r in k.all("ref")]
            else:
                self.fail(f"unexpected <{k.tag}> at document level")
        return Document("litogramma", blocks=[*out, *([embedded("bibliogramma", entries)] if entries else [])])


def person(e: X, between: str, surname_first: bool) -> str:
    """A name from its parts, or as it is printed."""
    if whole := (e.flat() if e.tag == "string-name" and not e.own("surname") else next((k.flat() for k in e.all("string-name")), "")):
        return whole
    part = lambda tag: next((k.flat() for k in e.all(tag)), "")
    names = [part("surname"), part("given-names")]
    return between.join(x for x in (names if surname_first else names[::-1]) if x)


def read_jats(source: str) -> Document:
    return Jats().document(read_tree(source, "jats"))
