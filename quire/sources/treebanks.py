"""Annotated corpora (national-corpus XML, OpenCorpora, PROIEL, CoNLL-U) to documents and back.

A word with its analyses is a wrapper that opens with their marks; a sentence is a wrapper that opens with its id.
Both directions go through one model: a list of headings and paragraphs, paragraphs of sentences and text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain, count
from xml.sax.saxutils import escape, quoteattr

from quire.model.names import valid_point
from quire.model.tree import Document, DocumentError, Node, has_blocks, plain_text
from quire.sources.xmltree import X, alone, block, collapse, para, read_tree, text, void

#: Marks of an analysis in the order they are written, by their field (fixed values).
MARKS = {"lemma": "!=", "pos": "!/", "features": "!%", "meaning": "!&", "head": "!>", "relation": "!-"}
FIELD_OF = {symbol: name for name, symbol in MARKS.items()}
SENTENCE = "!."
HEADINGS = ("==", "===", "#", "##", "###", "####")


@dataclass
class Token:
    form: str
    parsings: list[dict[str, str]] = field(default_factory=list)
    name: str | None = None


@dataclass
class Sentence:
    """parts: tokens, texts between them, and (scheme, value) coordinates."""

    parts: list
    id: str | None = None

    def source(self) -> str:
        return "".join(p if isinstance(p, str) else p.form for p in self.parts if not isinstance(p, tuple))

    def tokens(self) -> list[Token]:
        return [p for p in self.parts if isinstance(p, Token)]


@dataclass
class Corpus:
    """blocks: (depth, heading) or a list of sentences and texts."""

    title: str | None = None
    author: str | None = None
    blocks: list = field(default_factory=list)

    def sentences(self):
        return (u for b in self.blocks if isinstance(b, list) for u in b if isinstance(u, Sentence))


# Model and document.


def _writable(value: str) -> bool:
    """Can a mark hold it? No white space but spaces, and balanced parentheses."""
    if value.isalnum():
        return True
    depth = 0
    for c in value:
        depth += (c == "(") - (c == ")")
        if depth < 0 or (c.isspace() and c != " "):
            return False
    return bool(value) and not depth


def _token_node(t: Token) -> Node:
    marks = [Node("void", symbol, v) for p in t.parsings for k, symbol in MARKS.items() if (v := p.get(k)) and (v.isalnum() or _writable(v))]
    shown = [text(t.form)] if t.form else []
    return Node("wrap", body=[*marks, *shown], anchor=t.name) if marks or t.name else text(t.form)


def _sentence_node(s: Sentence, number: int) -> Node:
    parts = [_token_node(p) if isinstance(p, Token) else Node("point", scheme=p[0], text=p[1]) if isinstance(p, tuple) else text(p) for p in s.parts]
    return Node("wrap", body=[void(SENTENCE, s.id if s.id and _writable(s.id) else str(number)), *parts])


def to_document(c: Corpus) -> Document:
    """Headings hold what follows them, down to the next heading of their depth."""
    out = [alone(symbol, [text(t)]) for symbol, t in (("=", c.title), ("=:", c.author)) if t]
    open_: list[tuple[int, list[Node]]] = [(0, out)]
    number = count(1)
    for b in c.blocks:
        if isinstance(b, tuple):
            depth, head = max(1, b[0]), b[1]
            while open_[-1][0] >= depth:
                open_.pop()
            made = block("#" * min(depth, 4), [], [text(head)])
            open_[-1][1].append(made)
            open_.append((depth, made.body))
        else:
            open_[-1][1].append(para([_sentence_node(u, next(number)) if isinstance(u, Sentence) else text(u) for u in b]))
    return Document("litogramma", blocks=out)


def _is_token(n: Node) -> bool:
    return n.kind == "wrap" and bool(n.body) and n.body[0].kind == "void" and n.body[0].symbol in FIELD_OF


def _is_sentence(n: Node) -> bool:
    return n.kind == "wrap" and (any(_is_token(k) for k in n.body) or (bool(n.body) and n.body[0].kind == "void" and n.body[0].symbol == SENTENCE))


def _token(n: Node) -> Token:
    """Marks make analyses: a lemma, or a mark that the one at hand has already, opens the next."""
    parsings: list[dict[str, str]] = []
    for k in n.body:
        if k.kind == "void" and k.symbol in FIELD_OF:
            name = FIELD_OF[k.symbol]
            if not parsings or name == "lemma" or name in parsings[-1]:
                parsings.append({})
            parsings[-1][name] = k.text
    return Token(plain_text([k for k in n.body if k.kind != "void"]), parsings, n.anchor)


def _joined(parts: list) -> list:
    out: list = []
    for p in parts:
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        elif p != "":
            out.append(p)
    return out


def _sentence(n: Node) -> Sentence:
    name = next((k.text for k in n.body if k.kind == "void" and k.symbol == SENTENCE), None)
    parts = [_token(k) if _is_token(k) else (k.scheme, k.text) if k.kind == "point" else plain_text([k]) for k in n.body if k.kind not in ("void", "anchor", "ref")]
    return Sentence(_joined(parts), name)


def _units(run: list[Node]) -> list:
    found = [Sentence([_token(n)]) if _is_token(n) else _sentence(n) if _is_sentence(n) else plain_text([n]) for n in run if n.kind not in ("void", "anchor", "ref", "point")]
    return _joined(found)


def from_document(doc: Document) -> Corpus:
    out = Corpus()

    def go(seq: list[Node], depth: int) -> None:
        for b in seq:
            if b.kind == "para":
                only = b.body[0] if len(b.body) == 1 and b.body[0].kind in ("span", "void") else None
                if only is not None and only.symbol == "=" and out.title is None:
                    out.title = plain_text(only.body)
                elif only is not None and only.symbol == "=:" and out.author is None:
                    out.author = plain_text(only.body)
                elif not (only is not None and only.symbol in ("=_", "=;", "=#=")) and (units := _units(b.body)):
                    out.blocks.append(units)
            elif b.kind == "verse":
                out.blocks.extend(u for s in b.body for line in s if (u := _units(line)))
            elif has_blocks(b):
                inside = b.kind == "block" and b.symbol in HEADINGS
                if inside:
                    out.blocks.append((depth + 1, plain_text(b.head)))
                go(b.body, depth + inside)

    go(doc.blocks, 0)
    return out


# National-corpus XML.


def _split_gram(value: str) -> dict[str, str]:
    """The part of speech, and the rest with its equals sign if that comes first."""
    m = re.fullmatch(r"([^,=]*)(?:,(.+)|(=.+))?[,=]?", value, re.S)
    pos, rest = (m[1], m[2] or m[3]) if m else (value, None)
    return {k: v for k, v in (("pos", pos), ("features", rest)) if v}


def read_rnc(source: str) -> Document:
    root = read_tree(source, "rnc")
    out = Corpus()
    for e in root.all("title", "meta", "p"):
        if e.tag == "title":
            out.title = out.title or e.flat() or None
        elif e.tag == "meta" and e.get("name") == "author":
            out.author = out.author or e.get("content")
        elif e.tag == "meta" and e.get("name") == "header":
            out.title = out.title or e.get("content")
        elif e.tag == "p":
            units = _joined([_rnc_sentence(k) if isinstance(k, X) and k.tag == "se" else collapse(k) for k in e.kids if not isinstance(k, X) or k.tag == "se"])
            while units and isinstance(units[-1], str) and not units[-1].strip():
                units.pop()
            if units and isinstance(units[0], str) and not units[0].strip():
                units = units[1:]
            if units:
                out.blocks.append(units)
    return to_document(out)


def _rnc_sentence(e: X) -> Sentence:
    parts = []
    for k in e.kids:
        if isinstance(k, str):
            parts.append(collapse(k))
        elif k.tag == "w":
            parsings = []
            for a in k.all("ana"):
                found = {"lemma": a.get("lex"), **_split_gram(a.get("gr") or ""), "meaning": "_".join((a.get("sem") or "").split())}
                parsings.append({n: v for n, v in found.items() if v})
            parts.append(Token(collapse(k.text()), parsings))
    return Sentence(_joined(parts))


def write_rnc(c: Corpus) -> str:
    def word(t: Token) -> str:
        out = ""
        for p in t.parsings:
            features = p.get("features", "")
            gram = p.get("pos", "") + ("" if features.startswith("=") or not features or "pos" not in p else ",") + (features if "pos" in p else features.lstrip(",="))
            listed = {"lex": p.get("lemma"), "gr": gram, "sem": p.get("meaning", "").replace("_", " ")}
            out += "<ana" + "".join(f" {k}={_quoted(v)}" for k, v in listed.items() if v) + "/>"
        return f"<w>{out}{_text(t.form)}</w>"

    def unit(u) -> str:
        if isinstance(u, str):
            return _text(u)
        return "<se>" + "".join(word(p) if isinstance(p, Token) else _text(p) for p in u.parts if not isinstance(p, tuple)) + "</se>"

    body = "".join(f"<p>{_text(b[1]) if isinstance(b, tuple) else ''.join(map(unit, b))}</p>\n" for b in c.blocks)
    author = f'<meta content={_quoted(c.author)} name="author"/>\n' if c.author else ""
    title = f"<title>{_text(c.title)}</title>\n" if c.title else ""
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html>\n<head>\n{author}{title}</head>\n<body>\n{body}</body>\n</html>\n'


def _text(value: str) -> str:
    return value if value.isalnum() else escape(value, {'"': "&quot;"})


def _quoted(value: str) -> str:
    return f'"{value}"' if value.isalnum() else '"' + quoteattr(value, {'"': "&quot;"})[1:-1] + '"'


# OpenCorpora.


def aligned(source: str, tokens: list[Token]) -> list:
    """The source's text around the tokens; one that is not found from here on stands without a gap."""
    parts, at = [], 0
    for t in tokens:
        found = source.find(t.form, at)
        if found >= 0:
            parts.append(source[at:found])
            at = found + len(t.form)
        parts.append(t)
    return _joined([*parts, source[at:]])


def read_opencorpora(source: str) -> Document:
    root = read_tree(source, "opencorpora")
    whole = next((e for e in chain([root], root.all("text")) if e.tag == "text" and e.get("name")), None)
    out = Corpus(title=whole.get("name") if whole is not None else None)
    for p in root.all("paragraph"):
        units: list = []
        for s in p.all("sentence"):
            tokens = []
            for t in s.all("token"):
                parsings = []
                for lemma in t.all("l"):
                    grams = [g.get("v") for g in lemma.all("g") if g.get("v")]
                    found = {"lemma": lemma.get("t"), "pos": grams[0] if grams else None, "features": ",".join(grams[1:])}
                    parsings.append({k: v for k, v in found.items() if v})
                tokens.append(Token(t.get("text") or "", parsings))
            told = s.first("source")
            units += [" "] if units else []
            units.append(Sentence(aligned(told.text() if told is not None else "", tokens), s.get("id")))
        if units:
            out.blocks.append(units)
    return to_document(out)


def write_opencorpora(c: Corpus) -> str:
    paragraphs, sentences, tokens, lemmas = count(1), count(1), count(1), count(1)
    out = []
    for b in c.blocks:
        units = [Sentence([b[1]])] if isinstance(b, tuple) else [u if isinstance(u, Sentence) else Sentence([u]) for u in b if isinstance(u, Sentence) or u.strip()]
        out.append(f'<paragraph id="{next(paragraphs)}">\n')
        for s in units:
            number = next(sentences)
            name = s.id if s.id and re.fullmatch("[0-9]+", s.id) else number
            out.append(f'<sentence id="{name}">\n<source>{_text(s.source())}</source>\n<tokens>\n')
            for t in s.tokens():
                k, form = next(tokens), _quoted(t.form)
                out.append(f'<token id="{k}" text={form}>\n<tfr rev_id="{k}" t={form}>\n')
                for p in t.parsings:
                    grams = [p["pos"]] * ("pos" in p) + [g for g in p.get("features", "").split(",") if g]
                    out.append(f'<v><l id="{next(lemmas)}" t={_quoted(p.get("lemma", t.form))}>' + "".join(f"<g v={_quoted(g)}/>" for g in grams) + "</l></v>\n")
                out.append("</tfr>\n</token>\n")
            out.append("</tokens>\n</sentence>\n")
        out.append("</paragraph>\n")
    top = f'<?xml version="1.0" encoding="UTF-8"?>\n<annotation version="2.0" revision="0">\n<text id="1" parent="0" name={_quoted(c.title or "")}>\n<paragraphs>\n'
    return top + "".join(out) + "</paragraphs>\n</text>\n</annotation>\n"


# PROIEL.


def read_proiel(source: str) -> Document:
    root = read_tree(source, "proiel")
    out, cited = Corpus(), None
    whole = next((e for e in [root, *root.all("source")] if e.own("title", "author")), root)
    out.title = next((t.flat() for t in whole.own("title") if t.flat()), None)
    out.author = next((t.flat() for t in whole.own("author") if t.flat()), None)

    def go(e: X, depth: int) -> None:
        nonlocal cited
        for k in e.own():
            if k.tag == "div":
                own = k.own()
                if own and own[0].tag == "title" and own[0].flat():
                    out.blocks.append((depth + 1, own[0].flat()))
                go(k, depth + 1)
            elif k.tag == "sentence":
                parts: list = [k.get("presentation-before") or ""]
                for t in k.own("token"):
                    if not t.get("form"):
                        continue
                    place = t.get("citation-part")
                    if place and place != cited:
                        cited = place
                        value = "_".join(place.split())
                        parts += [("proiel", value)] if valid_point(value) else []
                    found = {"lemma": t.get("lemma"), "pos": t.get("part-of-speech"), "features": t.get("morphology"), "head": t.get("head-id") and "t" + t.get("head-id"), "relation": t.get("relation")}
                    parts += [t.get("presentation-before") or "", Token(t.get("form"), [{n: v for n, v in found.items() if v}], t.get("id") and "t" + t.get("id")), t.get("presentation-after") or ""]
                parts = _joined([*parts, k.get("presentation-after") or ""])
                if parts and isinstance(parts[-1], str):
                    parts[-1] = parts[-1].rstrip()
                s = Sentence([p for p in parts if p != ""], k.get("id") or "0")
                _drop_lost_heads(s)
                out.blocks.append([s])
            elif k.tag != "annotation":
                go(k, depth)

    go(root, 0)
    return to_document(out)


def _drop_lost_heads(s: Sentence) -> None:
    here = {t.name for t in s.tokens()}
    for t in s.tokens():
        for p in t.parsings:
            if p.get("head") not in here:
                p.pop("head", None)


def write_proiel(c: Corpus, language: str = "und") -> str:
    names = {t.name: k for k, t in enumerate((t for s in c.sentences() for t in s.tokens()), 1) if t.name}
    token, sentence = count(1), count(1)
    out, open_, cited = [], 0, None
    for b in c.blocks:
        if isinstance(b, tuple):
            while open_ >= b[0]:
                out.append("</div>\n")
                open_ -= 1
            while open_ < b[0]:
                out.append("<div>\n")
                open_ += 1
            out.append(f"<title>{_text(b[1])}</title>\n")
            continue
        for s in (u for u in b if isinstance(u, Sentence)):
            if not open_:
                out.append("<div>\n")
                open_ = 1
            number = next(sentence)
            name = s.id if s.id and re.fullmatch("[0-9]+", s.id) else number
            out.append(f'<sentence id="{name}" status-kind="annotated">\n')
            before, begun = "", False
            for k, p in enumerate(s.parts):
                if isinstance(p, tuple):
                    cited = p[1].replace("_", " ") if p[0] == "proiel" else cited
                elif isinstance(p, str):
                    before = before if begun else p
                else:
                    begun = True
                    a = p.parsings[0] if p.parsings else {}
                    after = next((x for x in s.parts[k + 1 : k + 3] if not isinstance(x, tuple)), "")
                    listed = {"id": str(next(token)), "form": p.form, "citation-part": cited, "lemma": a.get("lemma"), "part-of-speech": a.get("pos"), "morphology": a.get("features"), "head-id": str(names[a["head"]]) if a.get("head") in names else None, "relation": a.get("relation"), "presentation-before": before, "presentation-after": after if isinstance(after, str) else ""}
                    out.append("<token" + "".join(f" {n}={_quoted(v)}" for n, v in listed.items() if v) + "/>\n")
                    before = ""
            out.append("</sentence>\n")
    out.append("</div>\n" * open_)
    heads = "".join(f"<{tag}>{_text(t)}</{tag}>\n" for tag, t in (("title", c.title), ("author", c.author)) if t)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<proiel schema-version="2.0">\n<source id="text" language="{language}">\n{heads}{"".join(out)}</source>\n</proiel>\n'


# CoNLL-U.


def read_conllu(source: str) -> Document:
    """Blank lines end sentences; rows of under eight fields, ranges and empty words are left out."""
    out, number = Corpus(), 0
    for part in re.split(r"\n\n", source.replace("\r\n", "\n")):
        lines = [x for x in part.split("\n") if x]
        told = {m[1]: m[2].strip() for x in lines if x[0] == "#" and (m := re.match(r"#\s*(sent_id|text)\b(?!_)[ =]*(.*)", x))}
        rows = [f for x in lines if not x.startswith("#") and len(f := x.split("\t")) >= 8]
        if not rows:
            continue
        number += 1
        tokens, glued = [], []
        for f in rows:
            if "-" in f[0] or "." in f[0]:
                continue
            lemma, pos, other, features, head, relation = ("" if x == "_" else x for x in f[2:8])
            found = {}
            if lemma:
                found["lemma"] = lemma
            if other:
                found["pos"] = f"{pos}/{other}"
            elif pos:
                found["pos"] = pos
            if features:
                found["features"] = features.replace("|", ",")
            if head and head != "0":
                found["head"] = f"t{number}-{head}"
            if relation:
                found["relation"] = relation
            tokens.append(Token(f[1], [found], f"t{number}-{f[0]}"))
            glued.append(len(f) > 9 and f[9] != "_" and "SpaceAfter=No" in f[9].split("|"))
        if "text" in told:
            parts = aligned(told["text"], tokens)
        else:
            parts = [p for k, t in enumerate(tokens) for p in ([t] if glued[k] or k + 1 == len(tokens) else [t, " "])]
        out.blocks.append([Sentence(parts, told.get("sent_id"))])
    return to_document(out)


def write_conllu(c: Corpus) -> str:
    out = []
    for number, s in enumerate((s for s in c.sentences() if s.tokens()), 1):
        places = {t.name: k for k, t in enumerate(s.tokens(), 1) if t.name}
        out.append(f"# sent_id = {s.id or number}\n# text = {s.source()}\n")
        k = 0
        for at, t in enumerate(s.parts):
            if not isinstance(t, Token):
                continue
            k += 1
            p = t.parsings[0] if t.parsings else {}
            pos, _, other = p.get("pos", "").partition("/")
            after = s.parts[at + 1] if at + 1 < len(s.parts) else " "
            spaced = isinstance(after, str) and after[:1].isspace()
            row = [k, t.form, p.get("lemma"), pos, other, p.get("features", "").replace(",", "|"), places.get(p.get("head"), 0), p.get("relation"), "_", "_" if spaced else "SpaceAfter=No"]
            out.append("\t".join("_" if x in (None, "") else str(x) for x in row) + "\n")
        out.append("\n")
    return "".join(out)


WRITERS = {"rnc": write_rnc, "opencorpora": write_opencorpora, "proiel": write_proiel, "conllu": write_conllu}


def export(doc: Document, target: str) -> str:
    if target not in WRITERS:
        raise DocumentError("UnresolvableExo", target)
    return WRITERS[target](from_document(doc))
