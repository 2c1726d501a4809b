"""Markdown to a document tree. Blocks are found line by line; inline marks by one scan with memoized searches."""

from __future__ import annotations

import re
import string
from bisect import bisect_left

from quire.model.tree import Document, DocumentError, Node

NESTING = 64
_HEADING = re.compile(r"(#{1,6}) (.*)", re.S)
_ORDERED = re.compile(r"([0-9]+)\. (.*)", re.S)
_NOTE = re.compile(r"\[\^([^\]]+?)\]: (.*)", re.S)
_IMAGE = re.compile(r"!\[\]\((.*)\)\s*")
_MARKS = re.compile(r"[\\`\[<*]")
_LINK = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<]+")


def read(text: str) -> Document:
    return Document("at-markdown", blocks=_blocks([x.removesuffix("\r") for x in text.split("\n")], 1))


def _block(symbol: str, body: list[Node], flips: bool = True, **more) -> Node:
    return Node("block", symbol, body=body, flips=flips, is_block=True, **more)


def _opens(line: str) -> bool:
    return line.startswith(("```", ">", "- ")) or bool(_HEADING.match(line) or _ORDERED.match(line))


def _item(lines: list[str], at: int, first: str, indent: int) -> tuple[list[str], int]:
    """An item's own lines: the first, and those indented after it, with single blank lines between them."""
    lead, kept, at = " " * indent, [first], at + 1
    while at < len(lines):
        if lines[at].startswith(lead):
            kept.append(lines[at][indent:])
        elif not lines[at].strip() and at + 1 < len(lines) and lines[at + 1].startswith(lead):
            kept.append("")
        else:
            break
        at += 1
    return kept, at


def _blocks(lines: list[str], depth: int) -> list[Node]:
    if depth > NESTING:
        raise DocumentError("Syntax", f"markdown import: nesting exceeds {NESTING} levels")
    out: list[Node] = []
    at = 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif line.startswith("```"):
            ticks = len(line) - len(line.lstrip("`"))
            end = next((k for k in range(at + 1, len(lines)) if len(lines[k].rstrip()) >= ticks and not lines[k].rstrip().strip("`")), len(lines))
            info = line[ticks:].strip()
            out.append(Node("raw", text="\n".join(lines[at + 1 : end]) + "\n", classes=[info] if info else [], is_block=True))
            at = end + 1
        elif m := _HEADING.match(line):
            out.append(Node("para", body=[Node("span", m[1], body=inlines(m[2].strip()))], is_block=True))
            at += 1
        elif line.startswith(">"):
            end = next((k for k in range(at, len(lines)) if not lines[k].startswith(">")), len(lines))
            out.append(_block(">", _blocks([x[2:] if x.startswith("> ") else x[1:] for x in lines[at:end]], depth + 1), flips=False))
            at = end
        elif line.startswith("- "):
            kept, at = _item(lines, at, line[2:], 2)
            out.append(_block("-", _blocks(kept, depth + 1)))
        elif m := _ORDERED.match(line):
            kept, at = _item(lines, at, m[2], 3)
            out.append(_block(".", _blocks(kept, depth + 1), ordinal=int(m[1])))
        elif m := _NOTE.match(line):
            kept, at = _item(lines, at, m[2], 4)
            out.append(_block("^", _blocks(kept, depth + 1), anchor=m[1]))
        elif m := _IMAGE.fullmatch(line):
            out.append(Node("media", text=m[1], is_block=True))
            at += 1
        else:
            end = next((k for k in range(at + 1, len(lines)) if not lines[k].strip() or _opens(lines[k])), len(lines))
            out.append(Node("para", body=inlines(" ".join(lines[at:end])), is_block=True))
            at = end
    return out


class _Search:
    """Next place of a mark; once it is known to be missing, it is not looked for again."""

    def __init__(self, text: str):
        self.text, self.gone = text, {}
        self.closers: dict[int, list[int]] = {}

    def __call__(self, mark: str, start: int) -> int:
        if start >= self.gone.get(mark, len(self.text) + 1):
            return -1
        at = self.text.find(mark, start)
        if at < 0:
            self.gone[mark] = start
        return at


#: Where a run of stars can close, by its length.
_CLOSERS = {1: re.compile(r"(?<![\s*])(?<!^)\*(?!\*)"), 2: re.compile(r"(?<=\S)(?=\*\*)"), 3: re.compile(r"(?<=\S)(?=\*\*\*)")}


def _star(text: str, search: _Search, at: int, n: int) -> int:
    """Start of the closing run of n stars, if content follows the opening one."""
    start = at + n
    if not text[start : start + 1].strip():
        return -1
    if n not in search.closers:
        search.closers[n] = [m.start() for m in _CLOSERS[n].finditer(text)]
    known = search.closers[n]
    k = bisect_left(known, start)
    return known[k] if k < len(known) else -1


def _link(url: str) -> Node:
    return Node("span", "><", flips=True, body=[Node("text", text=url)])


def inlines(text: str) -> list[Node]:
    search, out, kept, at = _Search(text), [], [], 0

    def put(*nodes: Node) -> None:
        if kept:
            out.append(Node("text", text="".join(kept)))
            kept.clear()
        out.extend(nodes)

    while at < len(text):
        c = text[at]
        if c == "\\" and text[at + 1 : at + 2] in string.punctuation and at + 1 < len(text):
            kept.append(text[at + 1])
            at += 2
        elif c == "`" and (end := search("`", at + 1)) >= 0:
            put(Node("raw", text=text[at + 1 : end]))
            at = end + 1
        elif c == "[" and text.startswith("[^", at) and (end := search("]", at + 2)) >= 0:
            put(Node("ref", "^", text=text[at + 2 : end]))
            at = end + 1
        elif c == "<" and (end := search(">", at + 1)) >= 0 and _LINK.fullmatch(text[at + 1 : end]):
            put(_link(text[at + 1 : end]))
            at = end + 1
        elif c == "[" and text[at - 1 : at] != "!" and (mid := search("]", at + 1)) >= 0 and text.startswith("(", mid + 1) and (end := search(")", mid + 2)) >= 0:
            shown, url = text[at + 1 : mid], text[mid + 2 : end].strip()
            if not url:
                put(*inlines(shown))
            elif shown.strip() in ("", url):
                put(_link(url))
            else:
                put(*inlines(shown), Node("text", text=" ("), _link(url), Node("text", text=")"))
            at = end + 1
        elif c == "*" and (found := _stars(text, search, at)):
            n, end = found
            body = inlines(text[at + n : end])
            for symbol in {3: ("**", "*"), 2: ("**",), 1: ("*",)}[n]:
                body = [Node("span", symbol, body=body)]
            put(*body)
            at = end + n
        else:
            following = _MARKS.search(text, at + 1)
            end = following.start() if following else len(text)
            kept.append(text[at:end])
            at = end
    put()
    return out


def _stars(text: str, search: _Search, at: int) -> tuple[int, int] | None:
    run = min(3, len(text[at : at + 3]) - len(text[at : at + 3].lstrip("*")))
    for n in {3: (3, 2), 2: (2,), 1: (1,)}[run]:
        if (end := _star(text, search, at, n)) >= 0:
            return n, end
    return None
