"""HTML to a document tree. Strict: an element outside the subset, or bare text between blocks, is an error."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from quire.model.tree import Document, DocumentError, Node

NESTING = 64
_TAG = re.compile(r"<!--.*?-->|<![^>]*>|<\?.*?\?>|</([A-Za-z][\w:-]*)\s*>|<([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HEADINGS = {f"h{k}": "#" * k for k in range(1, 7)}
_SPANS = {"em": "/", "strong": "!", "span": ","}
_VOID = {"img", "br", "hr", "meta", "link", "input"}


def fail(message: str):
    raise DocumentError("Syntax", f"html import: {message}")


def tokens(text: str) -> Iterator[tuple]:
    """("open", name, attributes, closed), ("close", name) and ("text", text)."""
    at = 0
    for m in _TAG.finditer(text):
        if m.start() > at:
            yield ("text", unescape(text[at : m.start()]))
        at = m.end()
        if m[1]:
            yield ("close", m[1].lower())
        elif m[2]:
            attrs = {a[1].lower(): unescape(next((x for x in a.groups()[1:] if x is not None), "")) for a in _ATTRIBUTE.finditer(m[3])}
            yield ("open", m[2].lower(), attrs, bool(m[4]) or m[2].lower() in _VOID)
    if at < len(text):
        yield ("text", unescape(text[at:]))


class _Reader:
    def __init__(self, text: str):
        skip = False
        self.toks: list[tuple] = []
        for t in tokens(text):
            if t[0] != "text" and t[1] == "head":
                skip = t[0] == "open" and not t[3]
            elif not skip and not (t[0] != "text" and t[1] in ("html", "body")):
                self.toks.append(t)
        self.at = 0

    def blocks(self, end: str | None, depth: int) -> list[Node]:
        if depth > NESTING:
            fail(f"nesting exceeds {NESTING} levels")
        out: list[Node] = []
        while self.at < len(self.toks):
            t = self.toks[self.at]
            self.at += 1
            if t[0] == "text":
                if t[1].strip():
                    fail(f"bare text between blocks: `{t[1].strip()[:30]}`")
            elif t[0] == "close":
                if t[1] != end:
                    fail(f"unexpected </{t[1]}>")
                return out
            else:
                out.extend(self.block(t, depth))
        if end is not None:
            fail(f"<{end}> is not closed")
        return out

    def block(self, t: tuple, depth: int) -> list[Node]:
        _, name, attrs, closed = t
        notes = {"anchor": attrs.get("id"), "classes": attrs.get("class", "").split()}
        make = lambda symbol, body, flips=True, **k: [Node("block", symbol, body=body, flips=flips, is_block=True, **notes, **k)]
        if name in _HEADINGS:
            return [Node("para", body=[Node("span", _HEADINGS[name], body=self.run(name, depth), **notes)], is_block=True)]
        if name == "p":
            return [Node("para", body=self.run("p", depth), is_block=True)]
        if name == "blockquote":
            return make(">", self.blocks(name, depth + 1), False)
        if name == "div":
            return make("_", self.blocks(name, depth + 1))
        if name in ("ul", "ol"):
            return make("--" if name == "ul" else "..", self.items(name, depth + 1))
        if name == "pre":
            text = "".join(x.text for x in self.run("pre", depth, raw=True))
            return [Node("raw", text=text if text.endswith("\n") else text + "\n", is_block=True)]
        if name == "img":
            return [Node("media", text=attrs.get("src", ""), is_block=True)]
        if name == "table":
            return make("+", self.rows(depth + 1))
        fail(f"unsupported element <{name}>")

    def items(self, end: str, depth: int) -> list[Node]:
        out: list[Node] = []
        while True:
            t = self.next(end)
            if t[0] == "close" and t[1] == end:
                return out
            if t[0] == "text" and not t[1].strip():
                continue
            if t[:2] != ("open", "li"):
                fail(f"<{end}> holds something else than items")
            ordered = end == "ol"
            out.append(Node("block", "." if ordered else "-", ordinal=len(out) + 1 if ordered else None, body=self.flow("li", depth), is_block=True))

    def rows(self, depth: int) -> list[Node]:
        out: list[Node] = []
        while True:
            t = self.next("table")
            if t[0] == "close" and t[1] == "table":
                return out
            if t[0] == "text" and not t[1].strip() or t[1] in ("thead", "tbody", "tfoot"):
                continue
            if t[:2] != ("open", "tr"):
                fail("a table holds rows only")
            cells, heads = [], 0
            while (c := self.next("tr"))[:2] != ("close", "tr"):
                if c[0] == "text" and not c[1].strip():
                    continue
                if c[0] != "open" or c[1] not in ("td", "th"):
                    fail("a row holds cells only")
                heads += c[1] == "th"
                spans = [Node("void", s, text=c[2][a]) for a, s in (("colspan", "+>"), ("rowspan", "+_")) if c[2].get(a, "1") != "1"]
                body = self.flow(c[1], depth)
                if spans:
                    if body and body[0].kind == "para":
                        body[0].body[:0] = spans
                    else:
                        body.insert(0, Node("para", body=spans, is_block=True))
                cells.append(Node("block", "+:", body=body, is_block=True))
            out.append(Node("block", "+=" if cells and heads == len(cells) else "+-", body=cells, is_block=True))

    def flow(self, end: str, depth: int) -> list[Node]:
        """Blocks, or one run of inline content as a paragraph."""
        k = self.at
        while k < len(self.toks) and self.toks[k][0] == "text" and not self.toks[k][1].strip():
            k += 1
        t = self.toks[k] if k < len(self.toks) else ("close", "")
        if t[0] == "open" and t[1] not in (*_SPANS, "code", "a", "br"):
            return self.blocks(end, depth + 1)
        run = self.run(end, depth)
        return [Node("para", body=run, is_block=True)] if run else []

    def next(self, end: str) -> tuple:
        if self.at >= len(self.toks):
            fail(f"<{end}> is not closed")
        self.at += 1
        return self.toks[self.at - 1]

    def run(self, end: str, depth: int, raw: bool = False) -> list[Node]:
        out = self.inlines(end, depth, raw)
        if raw:
            return out
        for k, n in enumerate(out):
            if n.kind == "text":
                n.text = re.sub(r"\s+", " ", n.text)
                n.text = n.text.lstrip() if k == 0 else n.text
                n.text = n.text.rstrip() if k + 1 == len(out) else n.text
        return [n for n in out if n.kind != "text" or n.text]

    def inlines(self, end: str, depth: int, raw: bool) -> list[Node]:
        if depth > NESTING:
            fail(f"nesting exceeds {NESTING} levels")
        out: list[Node] = []
        while True:
            t = self.next(end)
            if t[0] == "text":
                out.append(Node("text", text=t[1]))
            elif t[0] == "close":
                if t[1] != end:
                    fail(f"unexpected </{t[1]}>")
                return out
            elif raw and t[1] == "code":
                out.extend(self.inlines("code", depth + 1, True))
            elif t[1] in _SPANS:
                out.append(Node("span", _SPANS[t[1]], body=self.inlines(t[1], depth + 1, raw), anchor=t[2].get("id"), classes=t[2].get("class", "").split()))
            elif t[1] == "code":
                out.append(Node("raw", text="".join(n.text for n in self.inlines("code", depth + 1, True))))
            elif t[1] == "a":
                href, shown = t[2].get("href", ""), self.inlines("a", depth + 1, raw)
                link = Node("span", "><", flips=True, body=[Node("text", text=href)])
                same = len(shown) == 1 and shown[0].text.strip() == href
                out.extend([link] if same or not shown else [*shown, Node("text", text=" ("), link, Node("text", text=")")] if href else shown)
            else:
                fail(f"unsupported element <{t[1]}>")


def read(text: str) -> Document:
    return Document("at-html", blocks=_Reader(text).blocks(None, 1))
