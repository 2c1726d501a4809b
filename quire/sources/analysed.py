"""Annotated corpora in their plain form, text to text: a sentence is one list of matches, and no tree is built.

A file is plain if its words have one analysis, one blank between them and no character that any of the formats
spells in a way of its own. Marks of analyses are few, so each kind of them is read once, by the readers and writers of
``treebanks``, which files of any other form go through whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from quire.model.canon import canonicalize, canonicalize_tree, composed
from quire.model.schema import Catalog
from quire.model.tree import DocumentError
from quire.sources import treebanks


class Unusual(Exception):
    """The file is not plain."""


#: Kinds of marks that are kept; beyond it they are read anew.
KEPT = 10_000

_OUT = r"\x00-\x20\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ud800-\udfff\ufffe\uffff@|\\()&<>\"'="
_VALUE = rf"[^{_OUT}]+"
_MARKS = rf"(?:@![/%&-]\({_VALUE}\))*"
_OTHER = r"|([\s\S])"
#: A full stop that a word begins with may open a class.
_DOTTED = re.compile(r"(?:^| )[.][^ ]")
#: Values that may be the name of a token, which a parameter can refer to.
_NAMED = re.compile(r"\(t[0-9]+(?:-[0-9]+)?\)")
_DECLARED = r'(?:<\?xml version="1\.0" encoding="(?:utf|UTF)-8"\?>[ \n]*)?'
_HEAD = "@@@!litogramma\n"


class Kinds(dict):
    """What ``made`` gives for a kind of marks, by how they are written; it gives None if they are not plain."""

    def __init__(self, made: Callable[[str], str | None]):
        self.made = made

    def __missing__(self, raw: str) -> str:
        try:
            found = self.made(raw)
        except (DocumentError, ValueError, KeyError):
            found = None
        if found is None:
            raise Unusual
        if len(self) >= KEPT:
            self.clear()
        self[raw] = found
        return found


def _between(text: str, before: str, after: str) -> str | None:
    inner = len(text) >= len(before) + len(after) and text.startswith(before) and text.endswith(after)
    return text[len(before) : len(text) - len(after)] if inner else None


def _plain(source: str) -> bool:
    return source.isascii() or unicodedata.is_normalized("NFC", source)


# Reading.


def _marks(read: Callable, file: str, rest: str = "") -> Callable[[str], str | None]:
    """Marks in canonical form of a word ``a``, whose attributes replace ``%s`` in the file."""

    def made(raw: str) -> str | None:
        text = canonicalize_tree(composed(read(file.replace("%s", raw))), Catalog({})).text
        found = _between(text, f"{_HEAD}\n@@.@!.(1)@@.@!=(a)", f"a.@@{rest}.@@\n")
        return found if found is not None and re.fullmatch(_MARKS, found) and not _NAMED.search(found) else None

    return made


def _pair(name: str, words: list[str], pieces: list[str]) -> tuple[str, str]:
    """A sentence in canonical form, and its text."""
    return f"@@.@!.({name}){' '.join(pieces)}.@@", _bare(words)


def _bare(words: list[str]) -> str:
    """The text of words; one of them is empty where something else was matched."""
    made = " ".join(words)
    if not made or "  " in made or made[0] == " " or made[-1] == " ":
        raise Unusual
    if (" ." in made or made.startswith(".")) and _DOTTED.search(made):
        raise Unusual
    return made


_CONLLU_HEAD = re.compile(rf"(?:# sent_id = (?!t[0-9]+-[0-9]+\n)({_VALUE})\n)?(?:# text = ([^\n]+)\n)?")
_CONLLU = re.compile(rf"[0-9]+\t({_VALUE})\t(?!t[0-9]+-[0-9]+\t)([^{_OUT}_][^{_OUT}]*)\t([^\n]*)\n{_OTHER}")
_CONLLU_KINDS = Kinds(_marks(treebanks.read_conllu, "1\ta\ta\t%s\n2\tb\tb\tX\t_\t_\t_\t_\t_\t_\n", " @@.@!=(b)@!/(X)b.@@"))


def _conllu(source: str):
    kinds, number = _CONLLU_KINDS, 0
    for part in source.split("\n\n"):
        if not part:
            continue
        number += 1
        told = _CONLLU_HEAD.match(part)
        found = _CONLLU.findall(part[told.end() :] + "\n" * (part[-1] != "\n"))
        pieces = [f"@@.@!=({lemma}){kinds[m]}{w}.@@" for w, lemma, m, _ in found]
        made = _pair(told[1] or str(number), [f[0] for f in found], pieces)
        if not found or told[2] not in (None, made[1]):
            raise Unusual
        yield made


def _laid_out(template: str) -> dict[bool, re.Pattern]:
    """A word's pattern: with ``~`` as line breaks and with ids, as files are written, or without."""
    return {
        True: re.compile(template.replace("~", "\n").replace("{id}", ' id="[0-9]+"').replace("{rev}", ' rev_id="[0-9]+" t="\\1"') + _OTHER),
        False: re.compile(template.replace("~", "").replace("{id}", "").replace("{rev}", "") + _OTHER),
    }


def _parts(source: str, before: str, head: re.Pattern, between: re.Pattern, last: re.Pattern, close: str):
    """(inside, what follows it is not more of the same) of what stands from ``before`` to ``close``, again and again."""
    first, *rest = source.split(before)
    if not rest or not head.fullmatch(first):
        raise Unusual
    for k, part in enumerate(rest, 1):
        inside, found, after = part.partition(close)
        follows = (last if k == len(rest) else between).fullmatch(after) if found else None
        if follows is None:
            raise Unusual
        yield inside, follows


_PROIEL_TOP = re.compile(rf'{_DECLARED}<proiel(?: schema-version="[0-9.]+")?>[ \n]*<source(?: id="[a-z]+" language="[a-z]+")?>[ \n]*(?:<div>[ \n]*)?')
_PROIEL_NEXT, _PROIEL_LAST = re.compile("[ \n]*"), re.compile("[ \n]*(</div>)?[ \n]*</source>[ \n]*</proiel>[ \n]*")
_PROIEL_HEAD = re.compile(rf'(?!t[0-9]+")({_VALUE})"(?: status-kind="[a-z]+")?>\n?')
_PROIEL = _laid_out(r'<token{id} form="(V)" lemma="(?!t[0-9]+")(V)"([^<>/]*)/>~'.replace("V", _VALUE))
_PROIEL_FILE = '<proiel><source><sentence id="1"><token form="a" lemma="a"%s/>{}</sentence></source></proiel>'
_PROIEL_KINDS = Kinds(_marks(treebanks.read_proiel, _PROIEL_FILE.format('<token form="b" lemma="b"/>'), " @@.@!=(b)b.@@"))
_PROIEL_ENDS = Kinds(_marks(treebanks.read_proiel, _PROIEL_FILE.format("")))


def _proiel(source: str):
    kinds = _PROIEL_KINDS
    if source.count("<div>") != source.count("</div>"):
        raise Unusual
    for inside, _ in _parts(source, '<sentence id="', _PROIEL_TOP, _PROIEL_NEXT, _PROIEL_LAST, "</sentence>"):
        told = _PROIEL_HEAD.match(inside)
        found = _PROIEL[inside.startswith("<token id=", told.end())].findall(inside, told.end()) if told else []
        if not found:
            raise Unusual
        pieces = [f"@@.@!=({lemma}){kinds[m]}{w}.@@" for w, lemma, m, _ in found[:-1]]
        w, lemma, m, _ = found[-1]
        yield _pair(told[1], [f[0] for f in found], [*pieces, f"@@.@!=({lemma}){_PROIEL_ENDS[m]}{w}.@@"])


_OPEN_PARAGRAPH = r'[ \n]*<paragraph(?: id="[0-9]+")?>[ \n]*'
_OPENCORPORA_TOP = re.compile(rf'{_DECLARED}<annotation(?: version="[0-9.]+" revision="[0-9]+")?>[ \n]*<text(?: id="[0-9]+" parent="[0-9]+" name="")?>[ \n]*<paragraphs>{_OPEN_PARAGRAPH}')
_OPENCORPORA_NEXT = re.compile(rf"[ \n]*</sentence>[ \n]*(</paragraph>{_OPEN_PARAGRAPH})?")
_OPENCORPORA_LAST = re.compile("[ \n]*</sentence>[ \n]*(</paragraph>)[ \n]*</paragraphs>[ \n]*</text>[ \n]*</annotation>[ \n]*")
_OPENCORPORA_HEAD = re.compile(rf'({_VALUE})">[ \n]*<source>([^<]+)</source>[ \n]*<tokens>\n?')
_OPENCORPORA = _laid_out(r'<token{id} text="(V)">~<tfr{rev}>~<v><l{id} t="(V)">((?:<g v="[^<>"]*"/>)*)</l></v>~</tfr>~</token>~'.replace("V", _VALUE, 2))
_OPENCORPORA_FILE = '<annotation><text><paragraphs><paragraph><sentence id="1"><source>a</source><tokens><token text="a"><tfr><v><l t="a">%s</l></v></tfr></token></tokens></sentence></paragraph></paragraphs></text></annotation>'
_OPENCORPORA_KINDS = Kinds(_marks(treebanks.read_opencorpora, _OPENCORPORA_FILE))


def _opencorpora(source: str):
    kinds, paragraph = _OPENCORPORA_KINDS, []
    for inside, follows in _parts(source, '<sentence id="', _OPENCORPORA_TOP, _OPENCORPORA_NEXT, _OPENCORPORA_LAST, "</tokens>"):
        told = _OPENCORPORA_HEAD.match(inside)
        found = _OPENCORPORA[inside.startswith("<token id=", told.end())].findall(inside, told.end()) if told else []
        pieces = [f"@@.@!=({lemma}){kinds[m]}{w}.@@" for w, lemma, m, _ in found]
        if not found or (made := _pair(told[1], [f[0] for f in found], pieces))[1] != told[2]:
            raise Unusual
        paragraph.append(made)
        if follows[1]:
            yield tuple(map(" ".join, zip(*paragraph)))
            paragraph = []


_RNC_TOP = re.compile(rf"{_DECLARED}<html>[ \n]*(?:<head>[ \n]*</head>[ \n]*)?<body>[ \n]*")
_RNC_NEXT, _RNC_LAST = re.compile("[ \n]*"), re.compile("[ \n]*</body>[ \n]*</html>[ \n]*")
_RNC = re.compile(rf'<w><ana lex="({_VALUE})"([^<>/]*)/>({_VALUE})</w> {_OTHER}')
_RNC_KINDS = Kinds(_marks(treebanks.read_rnc, '<html><body><p><se><w><ana lex="a"%s/>a</w></se></p></body></html>'))


def _rnc(source: str):
    kinds = _RNC_KINDS
    for number, (inside, _) in enumerate(_parts(source, "<p><se>", _RNC_TOP, _RNC_NEXT, _RNC_LAST, "</se></p>"), 1):
        found = _RNC.findall(inside + " ")
        yield _pair(str(number), [f[2] for f in found], [f"@@.@!=({lemma}){kinds[m]}{w}.@@" for lemma, m, w, _ in found])


READ = {"conllu": _conllu, "conll": _conllu, "proiel": _proiel, "opencorpora": _opencorpora, "oc": _opencorpora, "rnc": _rnc}


def canonical(source: str, extension: str) -> tuple[str, str] | None:
    """A plain file's canonical text and the text that its content id is taken of."""
    if extension not in READ or not _plain(source):
        return None
    try:
        marked, bare = zip(*READ[extension](source), strict=True)
    except (Unusual, ValueError):  # a file without sentences is not plain
        return None
    return tuple(_HEAD + "".join([f"\n{p}\n" for p in paragraphs]) for paragraphs in (marked, bare))


# Writing.

_NATIVE_HEAD = re.compile(rf"@@\.@!\.\(({_VALUE})\)")
_NATIVE = re.compile(rf"@@\.@!=\(({_VALUE})\)((?:[^ ]*\))?)({_VALUE})\.@@ {_OTHER}")


def _spelled(target: str, before: str, after: str) -> Kinds:
    """What a target's writer makes of a word's marks, between its lemma ``a`` and its end."""

    def made(raw: str) -> str | None:
        if not re.fullmatch(_MARKS, raw):
            return None
        text = treebanks.export(canonicalize(f"{_HEAD}\n@@.@!.(1)@@.@!=(a){raw}a.@@.@@\n", Catalog({})).document, target)
        start = text.find(before)
        end = text.find(after, start + len(before))
        return text[start + len(before) : end] if 0 <= start < end else None

    return Kinds(made)


def _frame(target: str) -> tuple[str, str]:
    """What a target's writer puts before and behind the sentences."""
    opens, closes = _FRAMED[target]
    text = treebanks.export(canonicalize(f"{_HEAD}\n@@.@!.(1)@@.@!=(a)@!/(X)a.@@.@@\n", Catalog({})).document, target)
    return text[: text.index(opens)], text[text.index(closes) + len(closes) :]


_FRAMED = {"proiel": ("<sentence ", "</sentence>\n"), "opencorpora": ("<paragraph ", "</paragraph>\n"), "rnc": ("<p>", "</p>\n"), "conllu": ("# sent_id", "\n\n")}
_SPELLED = {
    "conllu": _spelled("conllu", "1\ta\ta\t", "\n"),
    "proiel": _spelled("proiel", 'lemma="a"', "/>"),
    "opencorpora": _spelled("opencorpora", '<l id="1" t="a">', "</tokens>"),
    "rnc": _spelled("rnc", '<ana lex="a"', "/>"),
}


def _number(name: str, number: int) -> str | int:
    return name if re.fullmatch("[0-9]+", name) else number


def _to_conllu(sentences, kinds: Kinds):
    for name, bare, found in sentences:
        yield f"# sent_id = {name}\n# text = {bare}\n"
        yield "".join([f"{k}\t{w}\t{lemma}\t{kinds[m]}\n" for k, (lemma, m, w, _) in enumerate(found, 1)]) + "\n"


def _to_proiel(sentences, kinds: Kinds):
    at = 1
    for number, (name, bare, found) in enumerate(sentences, 1):
        words = [f'<token id="{k}" form="{w}" lemma="{lemma}"{kinds[m]}' for k, (lemma, m, w, _) in enumerate(found, at)]
        at += len(words)
        yield f'<sentence id="{_number(name, number)}" status-kind="annotated">\n' + ' presentation-after=" "/>\n'.join(words) + "/>\n</sentence>\n"


def _to_opencorpora(sentences, kinds: Kinds):
    at = 1
    for number, (name, bare, found) in enumerate(sentences, 1):
        yield f'<paragraph id="{number}">\n<sentence id="{_number(name, number)}">\n<source>{bare}</source>\n<tokens>\n'
        yield "".join([f'<token id="{k}" text="{w}">\n<tfr rev_id="{k}" t="{w}">\n<v><l id="{k}" t="{lemma}">{kinds[m]}' for k, (lemma, m, w, _) in enumerate(found, at)])
        yield "</tokens>\n</sentence>\n</paragraph>\n"
        at += len(found)


def _to_rnc(sentences, kinds: Kinds):
    for _, _, found in sentences:
        words = [f'<w><ana lex="{lemma}"{kinds[m]}/>{w}</w>' for lemma, m, w, _ in found]
        yield f"<p><se>{' '.join(words)}</se></p>\n"


WRITE = {"conllu": _to_conllu, "proiel": _to_proiel, "opencorpora": _to_opencorpora, "rnc": _to_rnc}
_FRAMES: dict[str, tuple[str, str]] = {}


def _sentences(source: str):
    """(id, text, matches of words) of native source whose paragraphs are a sentence each."""
    if not source.startswith(_HEAD + "\n"):
        raise Unusual
    for p in source[len(_HEAD) :].strip("\n").split("\n\n"):
        told = _NATIVE_HEAD.match(p)
        if not told or not p.endswith(".@@"):
            raise Unusual
        found = _NATIVE.findall(p[told.end() : -3] + " ")
        yield told[1], _bare([f[2] for f in found]), found


def written(source: str, target: str) -> str | None:
    """Plain native source in a target format."""
    if target not in WRITE or not _plain(source):
        return None
    try:
        body = "".join(WRITE[target](_sentences(source), _SPELLED[target]))
    except Unusual:
        return None
    if target not in _FRAMES:
        _FRAMES[target] = _frame(target)
    before, after = _FRAMES[target]
    return before + body + after
