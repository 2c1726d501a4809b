"""The tree as canonical text."""

from __future__ import annotations

from quire.model.names import alphanumeric, opens_class
from quire.model.tree import AUTO, Document, DocumentError, Node, walk, runs

#: Blocks of one line, which stand without blank lines between them.
ONE_LINE = {"media", "media_hash", "include", "include_raw", "use"}
_ANNOTATED = {"span", "void", "ref", "raw", "wrap", "point"}


def write(doc: Document) -> str:
    head = f"@@@!{doc.schema}" + (f"@{doc.version}" if doc.version else "") + "\n"
    return head + ("\n" + blocks(doc.blocks) if doc.blocks else "")


def blocks(seq: list[Node]) -> str:
    out = []
    for k, b in enumerate(seq):
        if k and b.kind not in ONE_LINE and seq[k - 1].kind not in ONE_LINE:
            out.append("\n")
        out.append(block(b))
    return "".join(out)


def notes(n: Node) -> str:
    if n.anchor is None and not n.classes:
        return ""
    return (f"({n.anchor})" if n.anchor is not None else "") + "".join("." + c for c in n.classes)


def escape_parameter(text: str) -> str:
    return text.replace(" ", "\\ ") if " " in text else text


def block(n: Node) -> str:
    if n.kind == "para":
        return inlines(n.body) + "\n"
    if n.kind in ("block", "verse"):
        opening, closing = ("@" + n.symbol, n.closing() + "@") if n.symbol else ("@@@=", "=@@@")
        number = "" if n.ordinal is None else "()" if n.ordinal == AUTO else f"({n.ordinal})"
        head = " " + inlines(n.head) if n.head else ""
        body = blocks(n.body) if n.kind == "block" else "\n".join("".join(inlines(line) + "\n" for line in stanza) for stanza in n.body)
        tail = " " + inlines(n.tail) if n.tail else ""
        return f"{opening}{number}{head}\n{body}{closing}{notes(n)}{tail}\n"
    if n.kind == "raw":
        return '@@@"\n' + n.text + ("" if n.text.endswith("\n") else "\n") + f'"@@@{notes(n)}\n'
    if n.kind == "wrap":
        return f"@@@.\n{blocks(n.body)}.@@@{notes(n)}\n"
    if n.kind == "embed":
        return f"@@@!({n.text})\n{blocks(n.body)}!@@@{notes(n)}\n"
    if n.kind == "macro":
        return f"@@@:\n{blocks(n.body)}:@@@({n.anchor})\n"
    one = {
        "media": f"@@@@({escape_parameter(n.text)})",
        "media_hash": f"@@@@[SHA256:{n.text}]",
        "include": f"@@@({escape_parameter(n.text)})",
        "include_raw": f"@@@+({escape_parameter(n.text)})",
        "use": f"@@@{'+' if n.verbatim else ''}(:{n.text}:)",
    }
    return one[n.kind] + "\n"


def inlines(seq: list[Node], close: str | None = None) -> str:
    """close: the closing symbol of the element around, which text must not run into."""
    out = ""
    boundary = named = False
    for k, n in enumerate(seq):
        if n.kind == "text":
            t = n.text
            if named and t and (t[0] == "-" or alphanumeric(t[0])):
                out += "|"
            last = k + 1 == len(seq) or seq[k + 1].kind == "text"
            out += escaped(t, out, boundary, not last) if boundary or "@" in t or "|" in t else t
            if not last and close and out.endswith(close):
                out += "|"
            boundary = named = False
            continue
        if n.kind == "void" and n.anchor is None and not n.classes:
            out += f"@{n.symbol}({escape_parameter(n.text)})"
        else:
            out += inline(n)
        boundary = n.kind != "anchor"
        named = bool(n.classes) and n.kind in _ANNOTATED
    if named and close and (close[0] == "-" or alphanumeric(close[0])):
        out += "|"
    return out


def escaped(text: str, before: str, boundary: bool, element_follows: bool) -> str:
    lead = ""
    if boundary and text[:1] in ("(", ".") and (text.startswith("(") or (text[:1] == "." and len(text) > 1 and opens_class(text[1]))):
        lead = "|"
    if "@" not in text and "|" not in text:
        return lead + text
    out, last = [], (lead or before)[-1:]
    for i, c in enumerate(text):
        if c == "@":
            piece = "\\@"
        elif c == "|" and (last == "\\" or (i == 0 and boundary) or (i + 1 == len(text) and element_follows)):
            piece = "\\|"
        else:
            piece = c
        out.append(piece)
        last = piece[-1]
    return lead + "".join(out)


def inline(n: Node) -> str:
    if n.kind == "span":
        close = n.closing()
        return f"@{n.symbol}{inlines(n.body, close)}{close}@{notes(n)}"
    if n.kind == "raw":
        return f'@@"{n.text}"@@{notes(n)}'
    if n.kind == "wrap":
        return f"@@.{inlines(n.body, '.')}.@@{notes(n)}"
    if n.kind == "void":
        return f"@{n.symbol}({escape_parameter(n.text)}){notes(n)}"
    if n.kind == "anchor":
        return f"@({n.anchor})"
    if n.kind == "point":
        return f'@("{n.scheme}:{n.text}"){notes(n)}'
    if n.kind == "ref":
        return f"@{n.symbol}({n.text}){notes(n)}"
    if n.kind == "macro":
        return f"@@:{inlines(n.body, ':')}:@@({n.anchor})"
    return f"@@{'+' if n.verbatim else ''}(:{n.text}:)"


def check_writable(doc: Document) -> None:
    """A literal backslash right before an element cannot be spelled."""
    for b in walk(doc.blocks):
        for seq in runs(b):
            for n, after in zip(seq, seq[1:]):
                if n.kind == "text" and n.text.endswith("\\") and after.kind != "text":
                    raise DocumentError("Syntax", f"a backslash right before an element (text ends `{n.text[-12:]}`)")

