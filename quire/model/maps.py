"""Built-in mappings between the built-in schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from quire.model.mapping import DROP, EXTRACT, RENAME, UNWRAP, Region, Rule, SchemaMap, checked, with_identities
from quire.model.schema import Catalog


@dataclass(frozen=True)
class Moves:
    """What becomes of symbols: ``renamed`` to another (and classes), ``unwrapped``, ``dropped``, heads ``extracted``.

    ``wrapped`` are lone headings that open a region. ``marks`` are schemas whose void elements are dropped.
    """

    renamed: dict[str, str] = field(default_factory=dict)
    unwrapped: str = ""
    dropped: str = ""
    extracted: dict[str, str] = field(default_factory=dict)
    wrapped: dict[str, str] = field(default_factory=dict)
    marks: tuple[str, ...] = ()
    both_ways: bool = False


_GRID = "+ +- += +: +> +_"
_LISTS = "-- .."
_MARKS = ("at-aphanes", "at-epimerismos")

# The mappings that documents in circulation are carried with. A target is a symbol, then classes.

_MOVES: dict[tuple[str, str], Moves] = {
    ("at-djot", "at-markdown"): Moves({"_": "*", "*": "**", "><": "><", "^": "^"}, both_ways=True),
    ("at-html", "at-markdown"): Moves({"/": "*", "!": "**"}, unwrapped=f"{_LISTS} , _", dropped=f"~ {_GRID}"),
    ("at-html", "at-org"): Moves({"!": "*", "######": "#####"}, unwrapped=f"{_LISTS} , _", dropped=_GRID),
    ("at-html", "at-rst"): Moves({"/": "*", "!": "**", "><": "><"}, unwrapped=f"{_LISTS} , _", dropped=f"~ {_GRID}"),
    ("at-org", "at-html"): Moves({"*": "!", "_": ", underline", "+": ", strike", "|": "~ table", "><": "><"}, unwrapped="^", extracted={"::": "!"}),
    ("at-rst", "at-html"): Moves({"*": "/", "**": "!", "!": "_ note", "!!": "_ warning"}, unwrapped="^", dropped=":", extracted={"::": "!"}),
    ("at-docbook", "litogramma"): Moves({"!": "_ note", "!!": "_ warning", ">": '"'}),
    ("litogramma", "at-html"): Moves(
        renamed={
            # front matter and emphasis
            "=": "#", "=_": ", subtitle", "=:": ", author", "=;": ", editor", '="': "_ abstract", "#_": "!", "*": "!", "*/": "!", ".": ", ordinal", "$": ", math",
            # items, quotations, links
            ".-": ".", "|": "_ aside", '"': ">", '""': ", quotation", "><": "><", ">:": ", standards-ref",
            # drama and letters
            ":~": "~ dialogue", ":!": "!", ":(": "/", ":[": "_ stage-direction", ":-": ", dialogue-line", ":_": ", dialogue-tag", ":.": ", pause",
            "-/": ", date", "-:": ", addressee", "-=": ", salutation", "-_": ", signature",
        },
        unwrapped='$$ ::; ; ^ ^^ ^^^ ^! "/ %',
        dropped="=#= ** > >> >>> >>>> >[ %%",
        extracted={"==": "#", "===": "##", "#": "###", "##": "####", "###": "#####", "####": "######", "::": "!", ":=": "##", ":#": "###", ":": "!", ":!!": "!", "<": "!", **dict.fromkeys(("_", "_=", "_-", "_:", "_/"), "!")},
        marks=_MARKS,
    ),
    ("litogramma", "at-docbook"): Moves(
        renamed={
            "=": "=", "==": "#", "===": "#", "##": "#", "###": "#", "####": "#", "#_": "*", "*/": "*",
            ".-": "-", '"': ">", '"/': ">", '""': '""', "|": ">", "^^": "^", "^^^": "^", "^!": "^", "><": "><", ">:": "*",
            ":!": "*", ":(": "/", ":[": "! stage", ":_": "/", ":.": "/", "-/": "/", "-:": "/", "-=": "/", "-_": "/",
            "_": "!", "_=": "! theorema", "_-": "! propositio", "_:": "! lemma", "_/": "! demonstratio",
        },
        unwrapped='=_ =: =; =" . , $ $$ ::; ; :- < %',
        dropped=f"=#= ** ~ :~ {_GRID} > >> >>> >>>> >[ %%",
        extracted=dict.fromkeys(("::", ":=", ":#", ":", ":!!"), "*"),
        marks=_MARKS,
    ),
    ("litogramma", "at-tei"): Moves(
        wrapped={"=": "_ text"},
        renamed={
            "=_": ", title", "=:": ", persname", "=;": ", persname", '="': "_ argument",
            "==": "# part", "===": "# chapter", "#": "# section", "##": "# subsection", "###": "# subsection", "####": "# subsection",
            "#_": ", hi", ".": ", num", "/": ", emph", "*": ", hi", "*/": ", emph", ",": ",", "$": ", formula", "$$": "_ formula",
            "--": "-- bulleted", "..": "-- ordered", ".-": "-", "::;": "-- gloss", "::": "-",
            ":~": "~", ":=": "# act", ":#": "# scene", ":!": ", name", ":!!": ":", ":[": "_ stage", ":-": ", said", ":_": ", seg", ":.": ", seg",
            "^": "^ foot", "^^": "^ end", "^^^": "^ end", "^!": "^ editorial", "|": "^ margin", '"': "_ quote", '"/': "_ epigraph", '""': ", q",
            "-/": ", date", "-:": ", addressee", "-=": ", salute", "-_": ", signed",
            "_": "_ floatingtext", "_=": "_ theorema", "_-": "_ propositio", "_:": "_ lemma-block", "_/": "_ demonstratio",
            ">>": ">", ">>>": ">", ">>>>": ">", ">[": ">[", ">:": ", name", "%": ", term",
        },
        unwrapped=";",
        dropped="=#= ** %%",
        marks=("at-epimerismos",),
    ),
}


def _made(moves: Moves, source: str, target: str, catalog: Catalog, reverse: bool) -> SchemaMap:
    a, b = catalog.schema(target if reverse else source), catalog.schema(source if reverse else target)
    rules: dict[str, Rule] = {}
    for old, said in moves.renamed.items():
        new, *classes = said.split()
        rules |= {new: Rule(RENAME, old)} if reverse else {old: Rule(RENAME, new, tuple(classes))}
    rules |= dict.fromkeys(moves.unwrapped.split(), Rule(UNWRAP)) | dict.fromkeys(moves.dropped.split(), Rule(DROP))
    rules |= {old: Rule(EXTRACT, head) for old, head in moves.extracted.items()}
    for marks in moves.marks:
        rules |= {s: Rule(DROP) for s in catalog.schema(marks).elements}
    regions = [Region(old, "wrap", said.split()[0], tuple(said.split()[1:]), rank) for rank, (old, said) in enumerate(moves.wrapped.items())]
    return checked(with_identities(SchemaMap(a, b, rules, regions)), moves.both_ways)


def built_in(source: str, target: str, catalog: Catalog) -> SchemaMap | None:
    """The mapping that goes directly from one schema to the other."""
    if (moves := _MOVES.get((source, target))) is not None:
        return _made(moves, source, target, catalog, False)
    moves = _MOVES.get((target, source))
    return _made(moves, target, source, catalog, True) if moves is not None and moves.both_ways else None


