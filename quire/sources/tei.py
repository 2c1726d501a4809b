"""TEI texts (prose, verse, drama, letters, notes, bibliographies) and TEI dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

from quire.model.names import alphanumeric, valid_class, valid_point
from quire.model.tree import Document, Node
from quire.sources.scripture import mark
from quire.sources.xmltree import Reader, X, alone, anchor_of, block, collapse, embedded, field, link, media, para, read_tree, span, text, trimmed, verse, void

#: Symbols of sections from the highest level down, and the levels that a division's type names (fixed values).
LADDER = ("==", "===", "#", "##", "###", "####")
LEVELS = {"part": 0, "book": 0, "chapter": 1, "canto": 1}
#: Elements that open a block; what stands between them is a paragraph (fixed values).
BLOCKS = (
    "div p ab head lg l sp speaker stage said quote q cit epigraph figure table list label note opener closer postscript dateline salute "
    "signed trailer listPerson listBibl castList noteGrp metamark milestone app interpGrp docAuthor space desc"
).split()
#: Inline elements whose text stays and whose markup does not (fixed values).
THROUGH = "add name persName placeName orgName rs date dateRange author time num measure mentioned seg forename surname roleName genName nameLink span s addName abbr ex expan w pc role roleDesc actor bibl cit quote unclear supplied orig reg sic corr".split()
#: Marks by the element that carries a pointer (fixed values).
POINTERS = {"persName": "?:", "name": "?:", "rs": "?:", "placeName": "?.", "orgName": "?&", "date": "?-", "dateRange": "?-"}
PREFERRED, OTHER = ("expan", "corr", "reg"), ("abbr", "sic", "orig")


def kebab(value: str | None) -> str | None:
    """A class or scheme spelled as the grammar has it, if it can be."""
    out = "-".join(re.findall(r"\w+", (value or "").lower().replace("_", "-")))
    return out if valid_class(out) else None


def pointed(value: str) -> str:
    return "-".join(value.strip().lstrip("#").split())


class Tei(Reader):
    what = "tei"

    def __init__(self, lines: str | None = None):
        super().__init__()
        self.lines, self.depth, self.keys, self.book = lines, 1, set(), []
        nothing = lambda e: []
        self.blocks_of = {
            "div": self.division,
            "p": self.prose,
            "ab": self.anonymous,
            "head": lambda e: self.settled(alone("#_", self.run(e))) if e.kids else [],
            "lg": lambda e: self.settled(self.poem(e)),
            "l": lambda e: self.settled(verse("~", [[self.line(e)]])),
            "sp": self.speech,
            "stage": lambda e: self.settled(block(":[", [para(self.run(e))])),
            "quote": lambda e: [block('"', self.content(e))],
            "q": lambda e: [block('"', self.content(e))],
            "cit": lambda e: [self.attributed(e, '"')],
            "epigraph": lambda e: [self.attributed(e, '"/')],
            "said": lambda e: self.settled(para(self.inline(e))),
            "figure": self.figure,
            "table": self.table,
            "list": self.list,
            "note": self.editorial,
            "label": self.labelled("label"),
            "speaker": self.labelled("speaker"),
            "dateline": self.own_line("-/"),
            "trailer": self.own_line("-/"),
            "salute": self.own_line("-="),
            "signed": self.own_line("-_"),
            "closer": self.content,
            "opener": self.content,
            "postscript": self.content,
            "noteGrp": self.content,
            "app": lambda e: self.content(next(iter(e.own("lem")), X("lem", {}))),
            "metamark": lambda e: [alone("**", [text(" * * * ")])] if e.get("function") == "line" else [],
            "milestone": lambda e: [para(p)] if (p := self.point(e)) else [],
            "castList": self.cast,
            "listPerson": self.cast,
            **dict.fromkeys(("listBibl", "interpGrp", "desc", "space", "docAuthor", "pb", "cb", "lb", "gap", "anchor", "delSpan", "addSpan", "fw"), nothing),
        }
        wrapped = lambda symbol, *classes: lambda e: [span(symbol, self.run(e), *classes)] if e.kids else []
        self.inlines_of = {
            **dict.fromkeys(THROUGH, self.through),
            **dict.fromkeys(POINTERS, self.named),
            **dict.fromkeys(("w", "pc", "s"), self.parsed),
            "seg": self.named,
            "emph": wrapped("/"),
            "hi": lambda e: [span("*" if e.get("rend") in ("bold", "b") else "/", self.run(e))] if e.kids else [],
            "foreign": lambda e: [span("/", self.run(e), "foreign", *([e.get("xml:lang").lower()] if e.get("xml:lang") else []))] if e.kids else [],
            "title": wrapped("/", "title"),
            "term": wrapped("/", "term"),
            "soCalled": wrapped('""'),
            "q": self.said,
            "said": self.said,
            "stage": wrapped(":("),
            "del": wrapped(",", "del"),
            "ref": self.pointer,
            "ptr": self.pointer,
            "choice": self.choice,
            "app": lambda e: self.pieces(next((k.kids for k in e.own("lem")), [])),
            "note": lambda e: self.note(e, self.content),
            "gap": lambda e: [text("[…]")],
            "milestone": lambda e: self.point(e) or [text(" ")],
            **dict.fromkeys(("lb", "pb", "cb"), lambda e: [text(" ")]),
            **dict.fromkeys(("idno", "metamark", "fw", "anchor", "space"), nothing),
        }

    # Blocks.

    def content(self, e: X) -> list[Node]:
        """Blocks; text and inline elements between them make paragraphs of their own."""
        out: list[Node] = []
        loose: list = []

        def settle() -> None:
            if run := trimmed(self.pieces(loose)):
                if not (len(run) == 1 and run[0].kind == "text" and re.fullmatch(r"[!-/:-@\[-`{-~\s]{1,3}", run[0].text)):
                    out.extend(self.settled(para(run)))
            loose.clear()

        for k in e.kids:
            inside = isinstance(k, str) or k.tag not in self.blocks_of or (loose and any(not isinstance(x, str) or x.strip() for x in loose) and k.tag in ("q", "said", "note", "stage", "pb", "lb", "gap", "anchor", "milestone", "metamark", "app", "space"))
            if inside:
                loose.append(k)
                continue
            settle()
            out += self.block(k)
        settle()
        return out

    blocks = content

    def division(self, e: X) -> list[Node]:
        above, self.depth = self.depth, LEVELS.get(e.get("type"), min(self.depth + 1, len(LADDER) - 1))
        own_book = re.fullmatch(r"\s*\d+\s*", e.get("n") or "") and "book" in ((e.get("type") or "").lower(), (e.get("subtype") or "").lower())
        self.book.append(str(int(e.get("n"))) if own_book else None)
        symbol = LADDER[self.depth]
        title = next((k for k in e.own() if k.tag not in ("milestone", "pb", "lb")), None)
        title = title if title is not None and title.tag == "head" and title.kids else None
        head = self.run(title) if title is not None else []
        before = self.settled()
        rest = X(e.tag, e.attrs)
        rest.kids = [k for k in e.kids if k is not title]
        inner = [*before, *self.content(rest)]
        self.depth = above
        self.book.pop()
        if not head:
            return inner
        return [block(symbol, inner, head)] if inner or not list(e.all("listBibl")) else []

    def prose(self, e: X) -> list[Node]:
        run = self.run(e)
        marks = [mark("?%", pointed(a)) for a in (e.get("ana") or "").split()]
        return self.settled(*([para([*marks, *run])] if run else []))

    def anonymous(self, e: X) -> list[Node]:
        first = next(iter(e.own()), None)
        if first is None or first.tag not in ("lg", "l"):
            return self.prose(e)
        classes = [c] if (c := kebab(e.get("type"))) else []
        return self.settled(verse("~", self.stanzas(e), classes=classes))

    def line(self, e: X) -> list[Node]:
        run = self.run(e)
        n = (e.get("n") or "").strip()
        if self.lines and re.fullmatch(r"\d{1,9}", n) and (int(n) == 1 or int(n) % 5 == 0) and int(n):
            book = next((b for b in reversed(self.book) if b), None)
            run.insert(0, Node("point", scheme=self.lines, text=f"{book}.{int(n)}" if book else str(int(n))))
        return run

    def stanzas(self, e: X) -> list[list[list[Node]]]:
        """Runs of lines, and groups of lines; a group's head is a line of its own."""
        out: list[list[list[Node]]] = [[]]
        for k in e.own():
            if k.tag == "l" and (k.kids or k.attrs):
                out[-1].append(self.line(k))
            elif k.tag in ("lg", "ab"):
                inner = self.stanzas(k)
                heads = [[span(",", self.run(h), "head")] for h in k.own("head")]
                if heads and inner:
                    inner[0] = [*heads, *inner[0]]
                out += [*inner, []]
            elif k.tag == "milestone" and (p := self.point(k)):
                out[-1].append(p)
            elif k.tag == "stage":
                out[-1].append([span(":(", self.run(k))])
            elif k.tag not in ("head", "pb", "lb", "gap", "note", "speaker"):
                self.fail(f"unsupported <{k.tag}> in verse")
        return [s for s in out if s]

    def poem(self, e: X) -> Node:
        heads = e.own("head")
        return verse("~", self.stanzas(e), self.run(heads[0]) if heads else [])

    def speech(self, e: X) -> list[Node]:
        speaker = next(iter(e.own()), None)
        speaker = speaker if speaker is not None and speaker.tag == "speaker" else None
        head = self.run(speaker) if speaker is not None else []
        if head and e.get("who"):
            head = [mark("?:", pointed(e.get("who"))), *head]
        called = self.settled()
        rest = X(e.tag, e.attrs)
        rest.kids = [k for k in e.kids if k is not speaker]
        tags = {k.tag for k in rest.all()}
        first = next(iter(rest.own()), None)
        if "l" in tags and not tags & {"p", "ab", "quote"} and first is not None and first.tag in ("l", "lg"):
            return [*self.settled(verse(":~" if head else "~", self.stanzas(rest), head)), *called]
        inner = self.content(rest)
        return [*([block(":", inner, head)] if head else inner), *called]

    def attributed(self, e: X, symbol: str) -> Node:
        """Quoted content; a citation beside it is its attribution."""
        tail: list[Node] = []
        inner: list[Node] = []
        parts = [k for c in e.own() for k in (c.own() if c.tag == "cit" else [c])]
        for k in parts:
            if k.tag == "bibl":
                tail = self.run(k) if k.kids else tail
                inner += self.settled()
            elif k.tag in ("quote", "q"):
                inner += self.content(k)
            elif k.tag not in ("pb", "gap", "lb"):
                inner += self.block(k)
        if any(isinstance(k, str) and k.strip() for k in e.kids):
            self.fail(f"bare text in <{e.tag}>")
        return block(symbol, inner, tail=tail)

    def figure(self, e: X) -> list[Node]:
        head, inner = [], []
        for k in e.own():
            if k.tag == "graphic" and k.get("url"):
                inner.append(media(k.get("url")))
            elif k.tag == "head" or (k.tag == "p" and not head):
                head = self.run(k)
            elif k.tag not in ("figDesc", "p", "graphic"):
                self.fail(f"unsupported <{k.tag}> in <figure>")
        return self.settled(block("<", inner, head, flips=False, anchor=anchor_of(e)))

    def table(self, e: X) -> list[Node]:
        heads = e.own("head")
        rows = []
        for r in e.own("row"):
            cells = []
            for c in r.own("cell"):
                spans = [void(s, c.get(a)) for a, s in (("cols", "+>"), ("rows", "+_")) if (c.get(a) or "1") != "1"]
                run = [*spans, *self.run(c)]
                cells.append(block("+:", [para(run)] if run else []))
            rows.append(block("+=" if r.get("role") == "label" else "+-", cells))
        return self.settled(block("+", rows, self.run(heads[0]) if heads else []))

    def list(self, e: X) -> list[Node]:
        ordered, term, items, number = e.get("type") == "ordered", [], [], 0
        for k in e.own():
            if k.tag == "label":
                term = self.run(k)
            elif k.tag == "head":
                items += [alone("#_", self.run(k))]
            elif k.tag == "item":
                inner = self.content(k)
                if term:
                    items.append(block("::", [block(";", inner)], term))
                    term = []
                    continue
                number += 1
                items.append(block(".-" if ordered else "-", inner, ordinal=number if ordered else None))
            elif k.tag not in ("pb", "lb", "milestone"):
                self.fail(f"unsupported <{k.tag}> in <list>")
        pairs = any(b.symbol == "::" for b in items)
        return self.settled(block("::;" if pairs else ".." if ordered else "--", items))

    def editorial(self, e: X) -> list[Node]:
        return [block("^!", self.content(e))] if e.kids else []

    def labelled(self, kind: str):
        return lambda e: self.settled(alone(",", self.run(e), kind))

    def own_line(self, symbol: str):
        return lambda e: self.settled(alone(symbol, self.run(e)))

    def cast(self, e: X) -> list[Node]:
        """Persons by name, with a description where there is one."""
        out: list[Node] = []
        for k in e.all("castItem", "person"):
            name = next(iter(k.all("role", "persName", "name")), None)
            about = next(iter(k.own("roleDesc", "note")), None)
            run = self.run(name) if name is not None else self.run(k)
            if about is not None and name is not None:
                out.append(block(":!!", [para(self.run(about))], run))
            elif run:
                out.append(alone(":!", run))
        return self.settled(*out)

    # Inline.

    def point(self, e: X) -> list[Node]:
        """A coordinate of the reference system that the milestone names."""
        named = kebab(e.get("resp")) or (kebab(e.get("ed")) if len(e.get("ed") or "") > 1 else None)
        unit = kebab(e.get("unit"))
        value = "|".join((e.get("n") or "").split())
        if not value or not valid_point(value):
            return []
        return [Node("point", scheme=named or unit or "milestone", text=value, classes=[unit] if named and unit else [])]

    def said(self, e: X) -> list[Node]:
        if not e.kids:
            return []
        who = e.get("who")
        marks = [mark("?:", pointed(who))] if who else []
        return [span('""', [*marks, *self.run(e)], *(["said"] if e.tag == "said" or who else []))]

    def named(self, e: X) -> list[Node]:
        """A name or date that points somewhere keeps its span, with the pointer as a mark inside."""
        key = e.get("ref", "key") or (e.get("when") if e.tag in ("date", "dateRange") else None)
        marks = [mark(POINTERS[e.tag], pointed(key))] if key and e.tag in POINTERS else []
        marks += [mark("?%", pointed(a)) for a in (e.get("ana") or "").split()]
        if not marks or not e.kids:
            return self.through(e)
        return [span(",", [*marks, *self.run(e)], e.tag.lower())]

    def parsed(self, e: X) -> list[Node]:
        """Words and sentences with an analysis: its marks stand before the text they are about."""
        found = [(s, e.get(a)) for a, s in (("lemma", "!="), ("pos", "!/"), ("msd", "!%"), ("ana", "!&"))] if e.tag != "s" else [("!.", e.get("n", "xml:id"))]
        marks = [void(s, pointed(v)) for s, v in found if v and pointed(v)]
        return [Node("wrap", body=[*marks, *self.run(e)])] if marks and e.kids else self.through(e)

    def pointer(self, e: X) -> list[Node]:
        target = e.get("target") or ""
        inside = [t[1:] for t in target.split()] if target and all(t.startswith("#") for t in target.split()) else []
        shown = self.run(e)
        if inside := [t for t in inside if t]:
            cited = e.get("type") == "bibr" or any(t in self.keys for t in inside)
            marks = [void(">[" if e.get("type") == "bibr" or t in self.keys else ">", t) for t in inside]
            if not cited:
                return [*shown, *marks]
            return [Node("wrap", body=[*marks, *shown])] if shown else marks
        if target and not re.search(r"[:/#]", target):
            return [span(",", [mark("?>", pointed(target)), *shown], "ref")]
        return link(target, shown)

    def choice(self, e: X) -> list[Node]:
        """The reading text; what the source has instead is a mark on it."""
        wanted = next((k for tag in PREFERRED for k in e.own(tag)), None)
        printed = next((k for tag in OTHER for k in e.own(tag)), None)
        if wanted is None or printed is None:
            return self.through(wanted or printed or X("", {}))
        return [Node("wrap", body=[mark("?~", pointed(printed.flat())), *self.run(wanted)])] if printed.flat() else self.through(wanted)

    # The document.

    def header(self, e: X) -> Iterator[Node]:
        """Titles, authors and editors, then the cast."""
        title = e.first("titleStmt") or X("", {})
        main = any(t.get("type") == "main" for t in title.own("title"))
        for k in title.own("title", "author", "editor"):
            if not k.kids:
                continue
            if k.tag != "title":
                yield from self.settled(alone("=:" if k.tag == "author" else "=;", self.run(k)))
            elif k.get("type") == "sub" or not main or k.get("type") == "main":
                yield from self.settled(alone("=_" if k.get("type") == "sub" else "=", self.run(k)))
        for k in e.all("particDesc"):
            for persons in k.own("listPerson"):
                yield from self.cast(persons)

    def front(self, e: X) -> list[Node]:
        out: list[Node] = []
        rest = X(e.tag, e.attrs)
        for k in e.kids:
            if isinstance(k, X) and k.tag in ("titlePage", "docTitle"):
                for t in k.all("titlePart", "docAuthor"):
                    out += self.settled(alone("=:" if t.tag == "docAuthor" else "=_" if t.get("type") == "sub" else "=", self.run(t)))
            elif not isinstance(k, X) or k.tag not in ("argument", "pb"):
                rest.kids.append(k)
            elif k.tag == "argument":
                out.append(block('="', self.content(k)))
        return out + self.content(rest)

    def entries(self, root: X) -> list[Node]:
        """The text's own bibliography: an entry of each citation in its lists, by its id."""
        out: list[Node] = []
        for part in root.own("text", "body", "back"):
            for found in part.all("listBibl"):
                for e in found.own("bibl", "biblStruct"):
                    key = e.get("xml:id", "id") or f"bibl-{len(out) + 1}"
                    if key not in self.keys:
                        self.keys.add(key)
                        out.append(bibliography_entry(e, key))
        return out

    def colophon(self, root: X) -> list[Node]:
        stated = root.first("publicationStmt") or X("", {})
        fields = [field(name, k.flat(), k.get("when") if tag == "date" and k.get("when") != k.flat() else None) for name, tag in (("officina", "publisher"), ("locus", "pubPlace"), ("datum", "date")) for k in list(stated.all(tag))[:1] if k.flat()]
        return [embedded("kolophon", fields)] if fields else []

    def document(self, root: X) -> Document:
        if root.tag not in ("TEI", "TEI.2"):
            self.fail(f"unexpected <{root.tag}> at document level")
        for e in root.all():
            if re.fullmatch(r"div[0-9]", e.tag):
                e.tag = "div"
        entries = self.entries(root)
        out = [n for h in root.own("teiHeader") for n in self.header(h)]
        for part in root.own("text"):
            for k in part.own():
                if k.tag == "front":
                    out += self.front(k)
                elif k.tag in ("body", "group"):
                    out += self.content(k)
                elif k.tag not in ("back", "pb", "gap", "interpGrp"):
                    self.fail(f"unexpected <{k.tag}> at document level")
        out += [embedded("bibliogramma", entries)] if entries else []
        return Document("litogramma", blocks=[*out, *self.colophon(root)])


def bibliography_entry(e: X, key: str) -> Node:
    """Fields of a citation; the levels of its titles name its kind."""
    titles = [(t.get("level") or "", t.flat()) for t in e.all("title")]
    analytic = next((k for k, t in enumerate(titles) if t[0] == "a"), None)
    if analytic is None and len(titles) > 1 and not titles[0][0] and any(t[0] for t in titles[1:]):
        analytic = 0
    kind, fields = "misc", {}

    def put(name: str, value: str, between: str = "; ") -> None:
        if value and value not in fields.get(name, "").split(between):
            fields[name] = fields[name] + between + value if name in fields else value

    for a in e.all("author"):
        put("author", a.flat(), " and ")
    for k, (level, shown) in enumerate(titles):
        if k == analytic or (analytic is None and "title" not in fields):
            fields.setdefault("title", shown)
            kind = kind if analytic is not None else {"m": "book", "j": "periodical"}.get(level, kind)
        elif analytic is not None and level in ("j", "m", ""):
            kind = "article" if level == "j" else "incollection"
            fields.setdefault("journal" if level == "j" else "booktitle", shown)
    for k in e.all("editor", "date", "publisher", "pubPlace", "biblScope", "note"):
        if k.tag == "editor":
            put("editor", k.flat(), " and ")
        elif k.tag == "date":
            when = k.get("when") or k.flat()
            put("year" if re.fullmatch(r"-?[0-9]+", when) else "date", when)
        elif k.tag == "biblScope":
            unit = k.get("unit", "type") or ""
            if name := {"page": "pages", "pp": "pages", "pages": "pages", "volume": "volume", "vol": "volume"}.get(unit):
                put(name, k.flat())
        else:
            put({"publisher": "publisher", "pubPlace": "location"}.get(k.tag) or k.get("type") or "note", k.flat())
    if not fields:
        put("note", e.flat())
    return block("&", [field(n, v) for n, v in fields.items()], [text(key)], classes=[kebab(e.get("type")) or kind])


#: Classes of usage labels and of cross-references by type (fixed values).
USAGES = {"dom": "domain hint dom", "reg": "register style plev reg", "geo": "geographic geo", "time": "temporal time", "lang": "language lang"}
RELATIONS = {"syn": "synonymy syn", "ant": "antonymy ant", "cf": "cf comparison", "see": "see seeAlso related"}


def _kind(table: dict[str, str], said: str | None) -> list[str]:
    return [k for k, names in table.items() if said in names.split()][:1]


def _name_of(head: str, ordinal: int | None) -> str:
    words = "".join(c if alphanumeric(c) else " " for c in head).split()
    return "-".join([*words, *([str(ordinal)] if ordinal else [])])


class Dictionary(Tei):
    """A body of entries: forms, grammar, etymology, senses, related entries."""

    def __init__(self):
        super().__init__()
        self.inlines_of |= {
            "usg": lambda e: [span("[", self.run(e), *_kind(USAGES, e.get("type")))],
            "lbl": lambda e: [span("&", self.run(e))],
            "gram": lambda e: [span("&", self.run(e))],
            "pos": lambda e: [span("&", self.run(e))],
            "xr": self.related,
            "lang": self.through,
            "def": self.through,
            "cit": self.example,
        }

    def related(self, e: X) -> list[Node]:
        return self.pieces(e.kids)

    def example(self, e: X) -> list[Node]:
        quoted = next(iter(e.own("quote", "form", "orth")), e)
        return [span("=>" if e.get("type") in ("translation", "translationEquivalent") else "~", self.run(quoted))]

    def entry(self, e: X) -> Node:
        head, inner, senses = "", [], 0
        for k in e.own():
            if k.tag == "form":
                for f in k.all("orth", "pron", "hyph", "syll"):
                    first = f.tag == "orth" and not head and k.get("type") in (None, "lemma", "simple", "compound")
                    head = f.flat() if first else head
                    symbol = {"pron": "=%", "hyph": "=-", "syll": "=-"}.get(f.tag, "=*" if k.get("type") == "inflected" else "=~")
                    inner += [] if first else [alone(symbol, self.run(f))]
                for g in k.own("gramGrp"):
                    inner += [alone("=&", [text(g.flat())])] if g.flat() else []
            elif k.tag == "gramGrp":
                inner += [alone("=&", [text(k.flat())])] if k.flat() else []
            elif k.tag == "etym":
                inner += self.settled(alone("=<", self.run(k)))
            elif k.tag == "sense":
                senses += 1
                inner.append(self.sense(k, senses))
            elif k.tag in ("re", "entry"):
                inner.append(self.entry(k))
            elif run := trimmed(self.inline(k) if k.tag in self.inlines_of else self.through(k)):
                inner += self.settled(para(run))
        n = e.get("n")
        return block("!", inner, [text(head)], ordinal=int(n) if n and re.fullmatch("[0-9]{1,9}", n) else None)

    def sense(self, e: X, number: int) -> Node:
        inner, run, inside = [], [], 0
        for k in e.kids:
            if isinstance(k, X) and k.tag == "sense":
                inner += [para(r)] if (r := trimmed(run)) else []
                run, inside = [], inside + 1
                inner.append(self.sense(k, inside))
            else:
                run += self.pieces([k])
        inner += [para(r)] if (r := trimmed(run)) else []
        return block(":", self.settled(*inner), ordinal=number)

    def document(self, root: X) -> Document:
        out = [n for h in root.own("teiHeader") for n in self.header(h)]
        ids: dict[str, Node] = {}
        for e in root.own("text") or [root]:
            for k in e.all("entry", "head", "p"):
                if k.tag == "entry":
                    out.append(made := self.entry(k))
                    if name := k.get("xml:id", "id"):
                        ids[name] = made
                elif not any(k is x for other in e.all("entry") for x in other.all(k.tag)):
                    out += self.settled(block("#", [], self.run(k)) if k.tag == "head" else para(self.run(k)))
        number_homographs(out)
        names = {k: _name_of(b.head[0].text, b.ordinal) for k, b in ids.items()}
        for b in out:
            _redirect(b, names)
        return Document("lexigramma", blocks=out)


def number_homographs(entries: list[Node]) -> None:
    """Entries of one head that are not numbered count from 1; a head of its own has no number."""
    by: dict[str, list[Node]] = {}
    for b in entries:
        if b.kind == "block" and b.symbol == "!":
            by.setdefault("".join(n.text for n in b.head), []).append(b)
    for same in by.values():
        if len(same) > 1:
            for k, b in enumerate((b for b in same if b.ordinal is None), 1):
                b.ordinal = k


def _redirect(n: Node, names: dict[str, str]) -> None:
    if n.kind == "void" and n.symbol == ">":
        n.text = names.get(n.text, n.text)
    for k in [*n.head, *n.body, *n.tail]:
        if isinstance(k, Node):
            _redirect(k, names)


def read_tei(source: str, lines: str | None = None) -> Document:
    """lines: a scheme under which every fifth numbered line of verse is a coordinate."""
    root = read_tree(source, "tei")
    return Dictionary().document(root) if root.first("entry") is not None else Tei(lines).document(root)


def read_xml(source: str) -> Document:
    """By the root element: TEI, DocBook, JATS (an article with front matter), OSIS or USX."""
    from quire.sources import docbook, scripture

    m = re.search(r"<(?:\w+:)?(\w[\w.]*)[\s/>]", re.sub(r"<!--.*?-->|<\?.*?\?>|<!.*?>", "", source, flags=re.S))
    root = m[1] if m else ""
    if root == "osis":
        return scripture.read_osis(source)
    if root == "usx":
        return scripture.read_usx(source)
    if root in docbook.ROOTS:
        return docbook.read_jats(source) if re.search(r"<front[\s>]", source) else docbook.read_docbook(source)
    return read_tei(source)
