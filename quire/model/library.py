"""Built-in schemas, made from elements when a catalog first asks for them.

Names, symbols, forms and vocabulary terms are those that documents in circulation are written with, so they are
fixed values of the format. Families that repeat (heading ladders, table parts, marks of metadata, numbered books) are
made by rules. Vocabularies hold the terms with their English and technical names; a catalog's own texts can extend
a schema with further aliases by inheriting from it.
"""

from __future__ import annotations

from collections.abc import Callable

from quire.model.schema import OPTIONAL, REQUIRED, Catalog, Element, Schema, bring


def span(name: str, symbol: str, **more) -> Element:
    return Element(name, symbol, "span", **more)


def void(name: str, symbol: str, keyword: str, **more) -> Element:
    return Element(name, symbol, "void", keyword=keyword, **more)


def block(name: str, symbol: str, **more) -> Element:
    return Element(name, symbol, "block", **more)


def headed(name: str, symbol: str, **more) -> Element:
    """A block that needs a head and may be numbered."""
    return block(name, symbol, ordinal=OPTIONAL, head=REQUIRED, **more)


def open_headed(name: str, symbol: str, **more) -> Element:
    """A block that may have a head and a number."""
    return block(name, symbol, ordinal=OPTIONAL, head=OPTIONAL, **more)


def numbered(name: str, symbol: str, **more) -> Element:
    return block(name, symbol, ordinal=REQUIRED, **more)


def headings(levels: int) -> list[Element]:
    return [span(f"heading-{k}", "#" * k) for k in range(1, levels + 1)]


def ladder() -> list[Element]:
    """Sections within sections, down to the third level."""
    return [headed("sub" * k + "section", "#" * (k + 1), parent="#" * k or None) for k in range(3)]


def grid(cell_head: bool = True, **table) -> list[Element]:
    """A table, its rows and cells, and the marks of cells that span."""
    inner = {"head": OPTIONAL} if cell_head else {}
    return [
        open_headed("table", "+", body="rows", **table),
        block("row", "+-", body="cells", parent="+"),
        block("header-row", "+=", body="cells", header=True, parent="+"),
        block("cell", "+:", parent="+-", **inner),
        void("hspan", "+>", "columns", parent="+:"),
        void("vspan", "+_", "rows", parent="+:"),
    ]


def flat_items(**item) -> list[Element]:
    """List items that stand alone, without a list around them."""
    return [block("unordered-item", "-", **item), numbered("ordered-item", ".", **item)]


_PLAIN_QUOTE = block("blockquote", ">", flips=False)
_FOOTNOTE = block("footnote", "^")
_LINK = span("link", "><")

# The elements of each schema.

_ELEMENTS: dict[str, list[Element]] = {
    # The literary base and its packs.
    "koine": [
        *[span("title", "="), span("subtitle", "=_"), span("author", "=:"), span("editor", "=;")],
        *ladder(),
        span("run-in-heading", "#_"),
        span("section-break", "**"),
        *[span("emphasis", "/"), span("strong", "*"), span("strong-emphasis", "*/"), span("annotation", ",")],
        block("unordered-list", "--"),
        block("unordered-item", "-", parent="--"),
        block("ordered-list", ".."),
        numbered("ordered-item", ".-", parent=".."),
        block("definition-list", "::;"),
        block("definition-item", "::", head=REQUIRED, parent="::;"),
        block("definition", ";", parent="::"),
        _FOOTNOTE,
        block("blockquote", '"', tail=OPTIONAL),
        span("quotation", '""'),
        void("ref", ">", "onym"),
        _LINK,
    ],
    "at-prosa": [
        headed("part", "=="),
        headed("chapter", "==="),
        headed("subsubsubsection", "####", parent="###"),
        span("ordinal", "."),
        block("abstract", '="'),
        void("toc", "=#=", "depth"),
        block("epigraph", '"/', tail=OPTIONAL),
        block("aside", "|"),
        block("chapter-endnote", "^^"),
        block("endnote", "^^^"),
        span("index", "%"),
        void("index-hidden", "%%", "keyword"),
    ],
    "at-poesia": [block("verse", "~", head=OPTIONAL, body="stichos", tail=OPTIONAL)],
    "at-epistole": [span("addressee", "-:"), span("salutation", "-="), span("signature", "-_"), span("composition-date", "-/")],
    "at-drama": [
        open_headed("act", ":="),
        open_headed("scene", ":#"),
        block("dialogue", ":", head=REQUIRED),
        block("verse-dialogue", ":~", head=REQUIRED, body="stichos"),
        span("dramatis-persona", ":!"),
        block("character", ":!!", head=REQUIRED),
        span("stage-direction", ":("),
        block("stage-direction-block", ":["),
        span("dialogue-line", ":-"),
        span("dialogue-tag", ":_", parent=":-"),
        span("pause", ":."),
    ],
    # Marks of metadata, which show nothing.
    "at-aphanes": [
        void("prosopon", "?:", "who"),
        void("chora", "?.", "where"),
        void("syllogos", "?&", "which"),
        void("skopos", "?>", "target"),
        void("chronos", "?-", "when"),
        void("eidos", "?%", "category"),
        void("paradosis", "?~", "reading"),
    ],
    "at-epimerismos": [
        void("periodos", "!.", "id"),
        void("lexema", "!=", "lemma"),
        void("meros", "!/", "pos"),
        void("parepomena", "!%", "features"),
        void("semasia", "!&", "class"),
        void("kephale", "!>", "onym"),
        void("schesis", "!-", "relation"),
    ],
    # Literary works and dictionaries.
    "litogramma": [
        span("math", "$"),
        block("math-block", "$$", ordinal=OPTIONAL),
        block("manuscript-note", "^!"),
        open_headed("figure", "<", flips=False),
        *grid(tail=OPTIONAL),
        *[open_headed(name, f"_{mark}") for name, mark in (("container", ""), ("theorema", "="), ("propositio", "-"), ("lemma", ":"), ("demonstratio", "/"))],
        *[void(name, ">" * k, "onym") for k, name in ((2, "heading-ref"), (3, "page-ref"), (4, "line-ref"))],
        void("cite", ">[", "key"),
        span("standards-ref", ">:"),
    ],
    "lexigramma": [
        headed("entry", "!", autonym=True),
        block("sense", ":", ordinal=REQUIRED, head=OPTIONAL),
        *[span(name, f"={mark}") for name, mark in (("variant", "~"), ("pronunciation", "%"), ("syllabification", "-"), ("grammar", "&"), ("etymology", "<"), ("equivalent", ">"), ("inflection", "*"), ("languages", "/"))],
        span("grammar-label", "&"),
        span("usage-label", "["),
        span("citation", "~"),
        block("citation-block", "=~~"),
        block("abbreviations", "[["),
    ],
    "bibliogramma": [
        block("entry", "&", head=REQUIRED, class_vocabulary="genera"),
        block("field", ":", head=REQUIRED, head_vocabulary="campi"),
    ],
    "kolophon": [block("field", ":", head=REQUIRED, head_vocabulary="campi")],
    # Other formats, each in its own shape.
    "at-html": [
        *headings(6),
        *[span("emphasis", "/"), span("strong", "!"), span("span", ","), _LINK],
        _PLAIN_QUOTE,
        block("division", "_"),
        open_headed("verse", "~", body="stichos", tail=OPTIONAL),
        *[block("unordered-list", "--"), block("ordered-list", "..")],
        *flat_items(),
        *grid(tail=OPTIONAL),
    ],
    "at-djot": [*headings(6), span("emphasis", "_"), span("strong", "*"), _LINK, _PLAIN_QUOTE, *flat_items(), _FOOTNOTE],
    "at-org": [
        *headings(5),
        *[span("emphasis", "/"), span("strong", "*"), span("underline", "_"), span("strike", "+"), _LINK],
        _PLAIN_QUOTE,
        block("verse", "~", body="stichos"),
        block("table", "|", body="stichos"),
        *flat_items(),
        block("definition-item", "::", head=REQUIRED),
        _FOOTNOTE,
    ],
    "at-rst": [
        *headings(6),
        *[span("emphasis", "*"), span("strong", "**"), _LINK],
        _PLAIN_QUOTE,
        *flat_items(),
        *[block("definition-item", "::", head=REQUIRED), block("field", ":", head=REQUIRED)],
        *[block("note", "!"), block("warning", "!!")],
        _FOOTNOTE,
    ],
    "at-docbook": [
        span("title", "="),
        block("section", "#", head=REQUIRED),
        *[span("emphasis", "/"), span("strong", "*"), span("quotation", '""'), _LINK],
        _PLAIN_QUOTE,
        *[block("note", "!"), block("warning", "!!")],
        *[block("unordered-list", "--"), block("ordered-list", ".."), block("list-item", "-")],
        _FOOTNOTE,
    ],
    "at-tei": [
        open_headed("division", "#", class_vocabulary="divisions"),
        block("verse", "~", head=OPTIONAL, body="stichos", tail=OPTIONAL),
        block("speech", ":", head=OPTIONAL),
        span("stage-direction", ":("),
        open_headed("block", "_", tail=OPTIONAL, class_vocabulary="blocks"),
        span("phrase", ",", class_vocabulary="phrases"),
        block("note", "^", class_vocabulary="notes"),
        block("list", "--", class_vocabulary="lists"),
        block("item", "-", head=OPTIONAL),
        *grid(),
        open_headed("figure", "<", flips=False),
        _LINK,
        void("ref", ">", "target"),
        void("cite", ">[", "key"),
        void("milestone", "|", "n", class_vocabulary="milestones"),
        block("field", "=", head=REQUIRED, head_vocabulary="fields"),
    ],
    "at-usfm": [
        block("book", "#", head=REQUIRED, head_vocabulary="books"),
        void("chapter", "##", "n"),
        void("verse", "|", "n"),
        span("block", "_", class_vocabulary="markers"),
        block("poetry", "~", body="stichos"),
        span("phrase", ",", class_vocabulary="chars"),
        span("note", "^", class_vocabulary="notes"),
    ],
    "at-markdown": [_FOOTNOTE],
}

#: What a schema takes over, as (parent, kind, symbols).
_PARENTS: dict[str, list[tuple]] = {
    "litogramma": [(p,) for p in ("koine", "at-prosa", "at-poesia", "at-epistole", "at-drama", "at-aphanes", "at-epimerismos")],
    "lexigramma": [("koine",)],
    "kolophon": [("at-aphanes",)],
    "at-tei": [("at-aphanes",)],
    "at-usfm": [("at-aphanes",)],
    "at-markdown": [
        ("at-html", "exclude", ("-- .. , _ / ! ~ + +- += +: +> +_").split()),
        ("at-html", "import", ["/", "*"]),
        ("at-html", "import", ["!", "**"]),
    ],
}

# Vocabularies. A line is a term, then its aliases; terms without aliases stand in one line.

_GENERA = """
commentarius article
liber book
libellus booklet
collectio collection
membrum incollection in-collection
acta proceedings
relatio inproceedings conference conference-paper
renuntiatio techreport report
enchiridion manual handbook
miscellanea misc miscellaneous
interretialis online electronic web webpage www
diploma patent
periodicum periodical
dissertatio thesis phdthesis mastersthesis
ineditum unpublished
data dataset
programma software
liber-multiplex mvbook multivolume-book
pars-libri inbook in-book
liber-in-libro bookinbook book-in-book
supplementum-libri suppbook supplemental-book-material
collectio-multiplex mvcollection multivolume-collection
supplementum-collectionis suppcollection
acta-multiplex mvproceedings multivolume-proceedings
supplementum-periodici suppperiodical
thesaurus reference dictionary encyclopedia
thesaurus-multiplex mvreference multivolume-reference
pars-thesauri inreference reference-entry
complexus set entry-set
xdata
artificium artwork
audio audio-recording
pellicula movie film
video video-recording
musica music
spectaculum performance
epistula letter
recensio review
norma standard
lex legislation
iudicium jurisdiction court-decision
iuridicum legal legal-document
scholia commentary
imago image picture
"""
_CAMPI = """
auctor author authors
editor editors
interpres translator
titulus title
subtitulus subtitle
ephemeris journal journaltitle
titulus-libri booktitle
annus year
datum date
volumen volume
numerus number
paginae pages
editio edition
series
officina publisher
locus address location
institutum school institution
capitulum chapter
genus type
lingua language
nota note
summarium abstract
doi
url
isbn
issn
titulus-operis maintitle main-title
subtitulus-operis mainsubtitle
additamentum-tituli titleaddon
additamentum-tituli-operis maintitleaddon
additamentum-tituli-libri booktitleaddon
subtitulus-libri booksubtitle
titulus-brevis shorttitle short-title
titulus-originis origtitle original-title
titulus-fasciculi issuetitle
subtitulus-fasciculi issuesubtitle
subtitulus-ephemeridis journalsubtitle
auctor-libri bookauthor book-author
annotator
commentator
praefatio foreword preface
postfatio afterword
introductio introduction
possessor holder
societas organization
titulus-eventus eventtitle event-title
datum-eventus eventdate event-date
sedes venue
fasciculus issue
mensis month
datum-originis origdate original-date
lingua-originis origlanguage original-language
locus-originis origlocation original-location
officina-originis origpublisher original-publisher
status-editionis pubstate publication-state
pars part
volumina volumes
summa-paginarum pagetotal total-pages
paginatio pagination
paginatio-libri bookpagination
versio version
addendum addenda
annotatio annotation
bibliotheca library
modus howpublished how-published
claves keywords
sigla shorthand
eid
eprint
langid
genus-eprint eprinttype eprint-type
classis-eprint eprintclass eprint-class
datum-url urldate url-date
isan
ismn
isrn
iswc
"""
#: Books by their three-letter code, their abbreviation in OSIS and their names. A name after a digit stands for
#: ``1-name`` and ``first-name``.
_BOOKS = """
gen Gen Genesis
exo Exod Exodus
lev Lev Leviticus
num Num Numbers
deu Deut Deuteronomy
jos Josh Joshua
jdg Judg Judges
rut Ruth Ruth
1sa 1Sam 1 Samuel
2sa 2Sam 2 Samuel
1ki 1Kgs 1 Kings
2ki 2Kgs 2 Kings
1ch 1Chr 1 Chronicles
2ch 2Chr 2 Chronicles
ezr Ezra Ezra
neh Neh Nehemiah
est Esth Esther
job Job Job
psa Ps Psalms, Psalm, Psalter
pro Prov Proverbs
ecc Eccl Ecclesiastes, Qoheleth
sng Song Song of Songs, Song of Solomon, Canticles
isa Isa Isaiah
jer Jer Jeremiah
lam Lam Lamentations
ezk Ezek Ezekiel
dan Dan Daniel
hos Hos Hosea
jol Joel Joel
amo Amos Amos
oba Obad Obadiah
jon Jonah Jonah
mic Mic Micah
nam Nah Nahum
hab Hab Habakkuk
zep Zeph Zephaniah
hag Hag Haggai
zec Zech Zechariah
mal Mal Malachi
mat Matt Matthew
mrk Mark Mark
luk Luke Luke
jhn John John
act Acts Acts, Acts of the Apostles
rom Rom Romans
1co 1Cor 1 Corinthians
2co 2Cor 2 Corinthians
gal Gal Galatians
eph Eph Ephesians
php Phil Philippians
col Col Colossians
1th 1Thess 1 Thessalonians
2th 2Thess 2 Thessalonians
1ti 1Tim 1 Timothy
2ti 2Tim 2 Timothy
tit Titus Titus
phm Phlm Philemon
heb Heb Hebrews
jas Jas James
1pe 1Pet 1 Peter
2pe 2Pet 2 Peter
1jn 1John 1 John
2jn 2John 2 John
3jn 3John 3 John
jud Jude Jude
rev Rev Revelation, Apocalypse
tob Tob Tobit
jdt Jdt Judith
esg EsthGr Greek Esther, Esther Greek
wis Wis Wisdom, Wisdom of Solomon
sir Sir Sirach, Ecclesiasticus, Ben Sira
bar Bar Baruch
lje EpJer Letter of Jeremiah, Epistle of Jeremiah
s3y PrAzar Song of the Three Young Men, Prayer of Azariah
sus Sus Susanna
bel Bel Bel and the Dragon
1ma 1Macc 1 Maccabees
2ma 2Macc 2 Maccabees
3ma 3Macc 3 Maccabees
4ma 4Macc 4 Maccabees
1es 1Esd 1 Esdras
2es 2Esd 2 Esdras
man PrMan Prayer of Manasseh, Manasses
ps2 AddPs Psalm 151
oda Odes Odes, Odae
pss PssSol Psalms of Solomon
dag DanGr Greek Daniel, Daniel Greek
"""
_ORDINALS = {"1": "first", "2": "second", "3": "third", "4": "fourth"}
#: Markers of lines. Those of a family are numbered; a family's first marker may lack its number.
_MARKERS = "h toc1 toc2 toc3 mt1 mt2 mt3 ms1 ms2 mr s1 s2 s3 r d sp qa ip is1 is2 pc m mi pi1 nb po lit li1 ili1 cl cp"
_UNNUMBERED = "mt ms s is pi li ili"


#: Localized element names by schema and language, in the order of the schema's elements.
_NAMES: dict[str, dict[str, str]] = {
    "at-aphanes": {"en": "person place organisation target date category original", "ru": "лицо место организация цель дата категория оригинал"},
    "at-epimerismos": {"en": "sentence lexeme part-of-speech features semantics head relation", "ru": "предложение лексема часть-речи граммемы семантика вершина отношение"},
    "at-epistole": {"en": "addressee salutation signature composition-date", "ru": "адресат обращение подпись дата-написания"},
}


def _terms(text: str) -> dict[str, set[str]]:
    return {words[0]: set(words[1:]) for words in map(str.split, text.strip().split("\n"))}


def _bare(words: str) -> dict[str, set[str]]:
    return {w: set() for w in words.split()}


def _books() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for line in _BOOKS.strip().split("\n"):
        code, short, names = line.split(" ", 2)
        aliases = {short.lower(), *("-".join(n.lower().split()) for n in names.split(","))}
        if names[0] in _ORDINALS:
            aliases.add(_ORDINALS[names[0]] + "-" + names[2:].lower())
        out[code] = aliases - {code}
    return out


def _markers() -> dict[str, set[str]]:
    return {m: {m[:-1]} if m.endswith("1") and m[:-1] in _UNNUMBERED.split() else set() for m in _MARKERS.split()}


_VOCABULARIES: dict[str, dict[str, Callable[[], dict[str, set[str]]]]] = {
    "bibliogramma": {"genera": lambda: _terms(_GENERA), "campi": lambda: _terms(_CAMPI)},
    "kolophon": {"campi": lambda: {t: a for t, a in _terms(_CAMPI).items() if t in ("officina", "locus", "datum")}},
    "at-usfm": {
        "books": _books,
        "markers": _markers,
        "chars": lambda: _bare("wj nd add em bd it sc no qs qt tl k w sig bk fr xo"),
        "notes": lambda: _terms("f footnote\nfe endnote\nx crossreference cross-reference"),
    },
    "at-tei": {
        "divisions": lambda: _bare("front back book part chapter section subsection act scene dedication preface foreword afterword appendix colophon prologue epilogue index glossary bibliography"),
        "blocks": lambda: _bare("teiheader text quote cit epigraph argument stage postscript salute signed opener closer trailer dateline byline address floatingtext formula"),
        "phrases": lambda: _bare("emph hi foreign term mentioned socalled said q persname placename orgname name rs date time num measure title gloss distinct abbr expan sic corr reg orig add del unclear supplied seg code formula ref"),
        "fields": lambda: _bare("title author editor translator publisher pubplace date idno extent edition series language source funder sponsor licence note"),
        "notes": lambda: _bare("foot end margin inline gloss editorial"),
        "lists": lambda: _bare("ordered bulleted simple gloss castlist"),
        "milestones": lambda: _bare("lb pb cb milestone"),
    },
}


def _maker(name: str) -> Callable[[Catalog], Schema]:
    def make(catalog: Catalog) -> Schema:
        out = Schema(name)
        for parent, *how in _PARENTS.get(name, []):
            bring(out, catalog.schema(parent), *([how[0], tuple(how[1])] if how else []))
        out.elements |= {e.symbol: e for e in _ELEMENTS[name]}
        out.vocabularies |= {v: terms() for v, terms in _VOCABULARIES.get(name, {}).items()}
        for language, names in _NAMES.get(name, {}).items():
            out.localized.setdefault(language, {}).update(zip((e.symbol for e in _ELEMENTS[name]), names.split()))
        return out

    return make


SCHEMAS: dict[str, Callable[[Catalog], Schema]] = {name: _maker(name) for name in _ELEMENTS}
