"""Built-in rule tables: how documents of the built-in schemas are written in other formats.

Tables are made from patterns and templates when they are first asked for. Families that repeat (headings, tags, marks
that show nothing) are made by rules. A table may lack patterns that a schema's parents bring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from quire.model.names import ALIAS, SIGIL
from quire.model.rendering import Rule, RuleTable, read_pattern, read_template
from quire.model.schema import Catalog
from quire.model.tree import DocumentError

XML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
BODY, HEAD, TAIL = "@(grammata)", "@(lemma)", "@(hypograph)"
KEPT = {"*document": BODY, "*paragraph": BODY, "*strophe": BODY, "*stichos": BODY, "*englossis kolophon": BODY}
ID, CLASS = '@[ id="@(onym)"]@', '@[ class="@(genoses)"]@'

Rules = dict[str, str]


def tag(name: str, attributes: str = "", inner: str = BODY) -> str:
    """An element in a line."""
    return f"<{name}{attributes}>{inner}</{name}>"


def box(name: str, attributes: str = "", inner: str = BODY) -> str:
    """An element with its content on lines of its own."""
    return f"<{name}{attributes}>\n{inner}\n</{name}>"


def over(name: str, slot: str = HEAD) -> str:
    """A line above the content, if there is something to say."""
    return f"@[<{name}>{slot}</{name.split()[0]}>\n]@"


def under(name: str, slot: str = TAIL) -> str:
    return f"@[\n<{name}>{slot}</{name.split()[0]}>]@"


def attribute(name: str, slot: str, before: str = "") -> str:
    return f'@[ {name}="{before}@({slot})"]@'


# HTML.


def _html(page: str = "<!doctype html>\n<html>\n<body>\n@(grammata)\n</body>\n</html>") -> Rules:
    heads = {f"*solo {'#' * k}": tag(f"h{k}") for k in range(1, 7)} | {"#" * k: BODY for k in range(1, 7)}
    spans = {mark: attribute(name, word) for mark, name, word in (("+>", "colspan", "hspan"), ("+_", "rowspan", "vspan"))}
    return heads | {
        "*document": page,
        "*paragraph": tag("p"),
        "/": tag("em"),
        "!": tag("strong"),
        ",": tag("span", CLASS),
        "><": '<a href="@(grammata)">@(grammata)</a>',
        ">": box("blockquote"),
        "--": box("ul"),
        "..": box("ol"),
        "-": tag("li"),
        ".": tag("li", attribute("value", "taxis")),
        "_": box("div", ID + CLASS),
        "~": box("div", ' class="verse"', over('p class="verse-title"') + BODY + under('p class="verse-attribution"', TAIL)),
        "*strophe": box("p"),
        "*stichos": BODY + "<br>",
        "+": box("table", ID, over("caption") + BODY),
        "+-": box("tr"),
        "+=": box("tr"),
        "+: in +=": tag("th", "".join(spans.values())),
        "+:": tag("td", "".join(spans.values())),
        "*paragraph in +:": BODY,
        **dict.fromkeys(spans, ""),
        "*verbatim": f"<pre{CLASS}><code>@(content)</code></pre>",
        "*verbatim-inline": tag("code", CLASS, "@(content)"),
        "*diaphane-inline": tag("span", ID + CLASS),
        "*media": '<img src="@(param)" alt="">',
        "*milestone": '<a id="@(scheme)-@(value)"></a>',
        "*onym-anchor": '<a id="@(onym)"></a>',
        "*deixis _": '<a class="pointer" href="#@(onym)">&#8224;</a>',
        "*englossis kolophon": box("footer"),
    }


_XHTML_PAGE = '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<body>\n@(grammata)\n</body>\n</html>'


def _markdown_in_html() -> Rules:
    """What Markdown has besides: notes, and its own marks of emphasis."""
    return {
        "*deixis ^": '<sup class="footnote-ref"><a href="#@(onym)">&#8224;</a></sup>',
        "^": box("aside", ' class="footnote"' + ID),
        "*": tag("em"),
        "**": tag("strong"),
    }


def _xhtml() -> Rules:
    return _html(_XHTML_PAGE) | {"*stichos": BODY + "<br/>", "*media": '<img src="@(param)" alt=""/>'}


#: Spans of the literary schema that HTML shows as a classed span, and blocks that it shows as a classed division.
_CLASSED = {".": "ordinal", "$": "math", ":-": "dialogue-line", ":_": "dialogue-tag", ":.": "pause", "-/": "date", "-:": "addressee", "-=": "salutation", "-_": "signature", ">:": "standards-ref", "%": "index"}
_DIVIDED = {'="': "abstract", "|": "aside", "$$": "math", ":[": "stage-direction"}


def _literary_html(page: str = "<!doctype html>\n<html>\n<body>\n@(grammata)\n</body>\n</html>") -> Rules:
    plain = _html(page)
    shared = ("*document *paragraph / , >< -- .. - ~ *strophe *stichos + +- += +: +> +_ *verbatim *verbatim-inline *media *milestone *onym-anchor").split()
    out = {k: plain[k] for k in shared} | {k: plain[k] for k in ("+: in +=", "*paragraph in +:", "*englossis kolophon", "*diaphane-inline")}
    levels = {"==": 1, "===": 2, "#": 2, "##": 3, "###": 4, "####": 5}
    out |= {s: box("section", ID + CLASS, f"<h{k}>{HEAD}</h{k}>\n{BODY}") for s, k in levels.items()}
    out |= {f"*solo {s}": tag(t, c) for s, t, c in (("=", "h1", ""), ("=_", "p", ' class="subtitle"'), ("=:", "p", ' class="author"'), ("=;", "p", ' class="editor"'), ("**", "p", ' class="section-break"'), ("#_", "h4", ""))}
    out |= {s: tag("span", f' class="{c}"') for s, c in _CLASSED.items()}
    out |= {s: box("div", f' class="{c}"' + ID) for s, c in _DIVIDED.items()}
    out |= {s: BODY for s in ("=", "=_", "=:", "=;", "**")}
    out |= {s: box("div", f' class="{n}"' + ID, over(f'p class="{n}-title"') + BODY) for s, n in (("_", "container"), ("_=", "theorema"), ("_-", "propositio"), ("_:", "lemma"), ("_/", "demonstratio"), (":=", "act"), (":#", "scene"))}
    out |= {s: box("aside", ' class="footnote"' + ID) for s in ("^", "^^", "^^^", "^!")}
    out |= {f"*deixis {s}": '<sup class="footnote-ref"><a href="#@(onym)">&#8224;</a></sup>' for s in ("^", "^^", "^^^", "^!")}
    out |= {f"*deixis {s}": '<a href="#@(onym)">&#8224;</a>' for s in ("|", "<", "+", *levels)}
    out |= {s: '<a href="#@(param)">@(param)</a>' for s in (">", ">>", ">>>", ">>>>")}
    return out | {
        "*": tag("strong"),
        "*/": "<strong><em>@(grammata)</em></strong>",
        '""': tag("q", CLASS),
        "#_": tag("strong"),
        ".-": tag("li", attribute("value", "taxis")),
        "::;": box("dl"),
        "::": f"<dt>{HEAD}</dt>\n{BODY}",
        ";": tag("dd"),
        '"': box("blockquote", ID, BODY + under("footer")),
        '"/': box("blockquote", ' class="epigraph"', BODY + under("footer")),
        "<": box("figure", ID, BODY + under("figcaption", HEAD)),
        ":": box("div", ' class="dialogue"', f'<p class="speaker">{HEAD}</p>\n{BODY}'),
        ":~": box("div", ' class="dialogue verse"', f'<p class="speaker">{HEAD}</p>\n{BODY}'),
        ":!": tag("span", ' class="persona"'),
        ":!!": box("div", ' class="persona"', f"<p>{HEAD}</p>\n{BODY}"),
        ":(": tag("i", ' class="stage-direction"'),
        "*stichoi": box("div", ' class="verse"'),
        "=#=": "",
        "%%": "",
        ">[": '<cite>[<a href="#@(param)">@(param)</a>]</cite>',
        "*englossis bibliogramma": box("section", ' class="bibliography"'),
    }


# Light markup.


def _marked(prefix: str, emphasis: str, strong: str, link: str, extra: Rules) -> Rules:
    """A flat format: headings by a repeated mark, a blank line after each block."""
    heads = {f"*solo {'#' * k}": f"{prefix * k} {BODY}\n" for k in range(1, 7)} | {"#" * k: BODY for k in range(1, 7)}
    return (
        KEPT
        | heads
        | {
            "*paragraph": BODY + "\n",
            emphasis[0]: f"{emphasis[1]}{BODY}{emphasis[1]}",
            strong[0]: f"{strong[1]}{BODY}{strong[1]}",
            "><": link,
            "*onym-anchor": "",
            "*milestone": "",
        }
        | extra
    )


def _fenced(fence: str = "```") -> Rules:
    return {
        ">": "> @(grammata:> )",
        "-": "- @(grammata:  )",
        ".": "@(taxis). @(grammata:    )",
        "*verbatim": f"{fence}@((genoses))\n@((content)){fence}\n",
        "*verbatim-inline": "`@((content))`",
        "*media": "![](@((param)))\n",
        "*deixis ^": "[^@((onym))]",
        "^": "[^@((onym))]: @(grammata:    )",
    }


def _md() -> Rules:
    return _marked("#", "**", ("**", "**"), "<@((grammata))>", _fenced()) | {"*": f"*{BODY}*", "**": f"**{BODY}**"}


def _dj() -> Rules:
    return _marked("#", "__", "**", "<@((grammata))>", _fenced())


def _org() -> Rules:
    heads = {f"*solo {'#' * k}": f"{'*' * k} {BODY}\n" for k in range(1, 6)} | {"#" * k: BODY for k in range(1, 6)}
    quote = lambda name: f"#+BEGIN_{name}\n{BODY}#+END_{name}\n"
    return (
        KEPT
        | heads
        | {m: f"{m}{BODY}{m}" for m in "/*_+"}
        | {
            "*paragraph": BODY + "\n",
            "><": "[[@(grammata)]]",
            ">": quote("QUOTE"),
            "~": f"#+BEGIN_VERSE\n{BODY}\n#+END_VERSE\n",
            "|": BODY + "\n",
            "-": "- @(grammata:  )",
            ".": "@(taxis). @(grammata:   )",
            "::": "- @(lemma) :: @(grammata:  )",
            "^": "[fn:@(onym)] @(grammata)",
            "*deixis ^": "[fn:@(onym)]",
            "*verbatim": "#+BEGIN_SRC@[ @(genoses)]@\n@(content)#+END_SRC\n",
            "*verbatim-inline": "~@(content)~",
            "*media": "[[file:@((param))]]\n",
            "*onym-anchor": "<<@(onym)>>",
            "*milestone": "",
        }
    )


def _rst() -> Rules:
    lines = "=-~^\"'"
    heads = {f"*solo {'#' * k}": f"{BODY}\n{lines[k - 1] * 60}\n" for k in range(1, 7)} | {"#" * k: BODY for k in range(1, 7)}
    note = lambda name: f".. {name}::\n\n   @(grammata:   )"
    return (
        KEPT
        | heads
        | {
            "*paragraph": BODY + "\n",
            "*": f"*{BODY}*",
            "**": f"**{BODY}**",
            "><": "`@((grammata)) <@((grammata))>`_",
            ">": "   @(grammata:   )",
            "-": "- @(grammata:  )",
            ".": "@(taxis). @(grammata:   )",
            "::": "@(lemma)\n   @(grammata:   )",
            ":": ":@(lemma): @(grammata:   )",
            "!": note("note"),
            "!!": note("warning"),
            "^": ".. [#@(onym)] @(grammata:   )",
            "*deixis ^": "[#@(onym)]_",
            "*verbatim": "::\n\n   @((content:   ))",
            "*verbatim-inline": "``@((content))``",
            "*media": ".. image:: @((param))\n",
            "*onym-anchor": "",
            "*milestone": "",
        }
    )


def _gemtext() -> Rules:
    """A line a block; what stands inside a line shows as text."""
    levels = {"==": 1, "===": 2, "#": 2, "##": 3, "###": 3, "####": 3}
    inline = '/ * */ , "" . $ ** #_ = =_ =: =; % :( :- :_ :. :! -/ -: -= -_ >:'.split()
    blocks = '-- .. ::; ; "/ =" | ^ ^^ ^^^ ^! _ _= _- _: _/ := :# : :!! :[ $$ +- +='.split()
    return (
        KEPT
        | dict.fromkeys(inline, BODY)
        | {s: f"@[{HEAD}\n]@{BODY}" if s in ("_", "_=", "_-", "_:", "_/", ":=", ":#", ":", ":!!") else BODY for s in blocks}
        | {s: f"{'#' * k} {HEAD}\n\n{BODY}" for s, k in levels.items()}
        | {
            "*paragraph": BODY + "\n",
            "*solo =": f"# {BODY}\n",
            "*solo =_": BODY + "\n",
            "*solo **": "* * *\n",
            "-": "* " + BODY,
            ".-": "@(taxis). " + BODY,
            "::": f"{HEAD}:\n{BODY}",
            '"': "> @(grammata:> )",
            "><": "\n=> @((grammata))\n",
            "~": f"@[{HEAD}\n\n]@{BODY}@[\n{TAIL}]@\n",
            ":~": f"{HEAD}\n{BODY}\n",
            "<": f"{BODY}@[{HEAD}\n]@",
            "+": BODY + "\n",
            "+:": "| " + BODY,
            "*paragraph in +:": BODY,
            "*verbatim": "```@((genoses))\n@((content))```\n",
            "*verbatim-inline": "`@((content))`",
            "*media": "=> @((param))\n",
            "*stichoi": BODY,
            "*onym-anchor": "",
            "*milestone": "",
            **dict.fromkeys([f"*deixis {s}" for s in ("^", "^^", "^^^", "^!", "|", "<", "+", *levels)], "[@(onym)]"),
            **dict.fromkeys((">", ">>", ">>>", ">>>>", ">["), "[@(param)]"),
            **dict.fromkeys(("=#=", "%%", "+>", "+_"), ""),
            "*englossis bibliogramma": BODY,
        }
    )


#: Characters that LaTeX gives a meaning.
_TEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "_": r"\_", "%": r"\%", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def _latex() -> Rules:
    levels = {"==": "part", "===": "chapter", "#": "section", "##": "subsection", "###": "subsubsection", "####": "paragraph"}
    command = lambda name: f"\\{name}{{{BODY}}}"
    place = lambda name: f"\\begin{{{name}}}\n{BODY}\\end{{{name}}}\n"
    spans = {"/": "emph", "*": "textbf", "=": "title", "=:": "author", "#_": "textbf", "**": "centerline", '""': "enquote", ":(": "textit", "><": "url"}
    return (
        KEPT
        | {s: f"\\{c}{{{HEAD}}}@[\\label{{@(onym)}}]@\n\n{BODY}" for s, c in levels.items()}
        | {s: command(c) for s, c in spans.items()}
        | {s: place(c) for s, c in (("--", "itemize"), ("..", "enumerate"), ("::;", "description"), ('"', "quote"), ('"/', "quote"), ('="', "abstract"))}
        | dict.fromkeys(", . % =_ =; :- :_ :. :! -/ -: -= -_ >: ; | :[ +- += *strophe".split(), BODY)
        | {s: f"@[\\textbf{{{HEAD}}}\n]@{BODY}" for s in ("_", "_=", "_-", "_:", "_/", ":=", ":#", ":", ":!!")}
        | {
            "*document": "\\documentclass{article}\n\\usepackage{csquotes,hyperref,graphicx}\n\\begin{document}\n@(grammata)\n\\end{document}",
            "*paragraph": BODY + "\n",
            "*/": f"\\textbf{{\\emph{{{BODY}}}}}",
            "-": f"\\item {BODY}",
            ".-": f"\\item {BODY}",
            "::": f"\\item[{HEAD}] {BODY}",
            "~": f"\\begin{{verse}}\n@[\\textbf{{{HEAD}}}\\\\\n]@{BODY}@[\n{TAIL}]@\n\\end{{verse}}\n",
            ":~": f"\\textsc{{{HEAD}}}\\\\\n{BODY}\n",
            "*stichos": BODY + r"\\",
            "*stichoi": BODY,
            "$": "$@((grammata))$",
            "$$": "\\[\n@((grammata))\\]\n",
            "<": f"\\begin{{figure}}\n{BODY}@[\\caption{{{HEAD}}}\n]@\\end{{figure}}\n",
            "+": f"\\begin{{tabular}}{{}}\n{BODY}\n\\end{{tabular}}\n",
            "+:": BODY + " &",
            "*paragraph in +:": BODY,
            "*verbatim": "\\begin{verbatim}\n@((content))\\end{verbatim}\n",
            "*verbatim-inline": "\\texttt{@(content)}",
            "*media": "\\includegraphics{@((param))}\n",
            "*onym-anchor": "\\label{@(onym)}",
            "*milestone": "",
            **{s: f"\\footnotetext{BODY and '{' + BODY + '}'}\n" for s in ("^", "^^", "^^^", "^!")},
            **dict.fromkeys([f"*deixis {s}" for s in ("^", "^^", "^^^", "^!")], "\\footnotemark{}"),
            **dict.fromkeys([f"*deixis {s}" for s in ("|", "<", "+", *levels)], "\\ref{@(onym)}"),
            **dict.fromkeys((">", ">>", ">>>>"), "\\ref{@(param)}"),
            ">>>": "\\pageref{@(param)}",
            ">[": "\\cite{@(param)}",
            "=#=": "\\tableofcontents",
            **dict.fromkeys(("%%", "+>", "+_"), ""),
            "*englossis bibliogramma": "\\printbibliography\n",
        }
    )


# XML formats.

_XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def _docbook() -> Rules:
    same = {">": "blockquote", "!": "note", "!!": "warning", "--": "itemizedlist", "..": "orderedlist", "-": "listitem"}
    return {s: box(t) for s, t in same.items()} | {
        "*document": _XML_HEAD + box("article", ' xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.0"'),
        "*paragraph": tag("para"),
        "*solo =": tag("title") + "@[\n<info>\n@(!kolophon)\n</info>]@",
        "=": BODY,
        "#": box("section", attribute("xml:id", "onym"), f"<title>{HEAD}</title>\n{BODY}"),
        "/": tag("emphasis"),
        "*": tag("emphasis", ' role="strong"'),
        '""': tag("quote"),
        "><": '<link xlink:href="@(grammata)">@(grammata)</link>',
        "^": box("footnote", attribute("xml:id", "onym")),
        "*deixis ^": '<footnoteref linkend="@(onym)"/>',
        "*verbatim": tag("programlisting", attribute("language", "genoses"), "@(content)"),
        "*verbatim-inline": tag("literal", "", "@(content)"),
        "*media": '<mediaobject><imageobject><imagedata fileref="@((param))"/></imageobject></mediaobject>',
        "*onym-anchor": '<anchor xml:id="@(onym)"/>',
        "*milestone": "",
        "*englossis kolophon": BODY,
        "*englossis bibliogramma": box("bibliography"),
    }


#: Elements of TEI whose names have capitals, by their term (fixed values).
_CAPITALS = "floatingText persName placeName orgName soCalled"
_TEI_TAGS = {t.lower(): t for t in _CAPITALS.split()}
_TEI_BEFORE = "<teiHeader>\n<fileDesc>\n<titleStmt>\n{title}\n</titleStmt>\n<publicationStmt>\n<p>"
_TEI_AFTER = "</p>\n</publicationStmt>\n<sourceDesc>\n<p>Written from a document tree.</p>\n</sourceDesc>\n</fileDesc>\n</teiHeader>\n"
_TEI_OPEN = _XML_HEAD + '<TEI xmlns="http://www.tei-c.org/ns/1.0">\n'


def _tei(vocabularies: dict[str, dict]) -> Rules:
    """Blocks and phrases are the elements that their class names; divisions, notes and lists have it as their type."""
    xml_id = attribute("xml:id", "onym")
    who, what = attribute("who", "prosopon", "#"), attribute("ana", "eidos", "#")
    pointer = {"persname": ["prosopon"], "placename": ["chora"], "orgname": ["syllogos"], "name": ["prosopon", "chora", "syllogos"], "rs": ["prosopon", "chora", "syllogos"]}
    more = {k: "".join(attribute("ref", s, "#") for s in slots) for k, slots in pointer.items()}
    more |= {"date": attribute("when", "chronos"), "ref": attribute("target", "skopos"), "said": who + what, "q": who + what, "seg": what}
    held = over("head") + BODY + under("bibl")
    out = {f"_.{t}": box(_TEI_TAGS.get(t, t), xml_id, held) for t in vocabularies["blocks"] if t not in ("teiheader", "text", "formula")}
    out |= {f",.{t}": tag(_TEI_TAGS.get(t, t), more.get(t, "")) for t in vocabularies["phrases"]}
    out |= {f",.{a}.{b}": tag(_TEI_TAGS.get(b, b), more.get(b, "")) for a, b in (("emph", "foreign"), ("emph", "title"), ("emph", "term"), ("q", "said"))}
    out |= {f"#.{t}": box(t, xml_id, over("head") + BODY) for t in ("front", "back")}
    out |= {f"|.{t}": f'<{t}@[ n="@(param)"]@/>' for t in ("lb", "pb", "cb")}
    titled = _TEI_BEFORE.format(title="<title>@(lemma)</title>")
    body = f"<text>\n<body>\n{BODY}\n</body>\n</text>"
    return out | {
        "*document": _TEI_OPEN + _TEI_BEFORE.format(title="<title/>") + "@(!kolophon)" + _TEI_AFTER + f"{body}\n</TEI>",
        "*document.text": f"{_TEI_OPEN}{BODY}\n</TEI>",
        "*document.teiheader.text": f"{_TEI_OPEN}{BODY}\n</TEI>",
        "_.teiheader": box("teiHeader", "", box("fileDesc")),
        "_.text": f"@[{titled}]@@[@(?lemma)@(!kolophon)]@@[@(?lemma){_TEI_AFTER}]@{body}",
        "_.formula": box("formula", xml_id),
        "_": box("ab", attribute("type", "genoses") + xml_id, held),
        "#": box("div", xml_id + attribute("type", "genoses") + attribute("n", "taxis"), over("head") + BODY),
        "*paragraph": tag("p", what),
        ",": tag("seg", attribute("type", "genoses") + what),
        ":(": tag("stage"),
        ":": box("sp", who, over("speaker") + BODY),
        "~": box("lg", xml_id, over("head") + BODY + under("bibl")),
        "*strophe": box("lg"),
        "*stichos": tag("l"),
        "*stichoi": box("lg"),
        "^": box("note", xml_id + attribute("place", "genoses")),
        "*deixis ^": '<ref target="#@(onym)"/>',
        **{f"*deixis {s}": '<ref target="#@(onym)"/>' for s in ("#", "_", "<", "+")},
        "--": box("list", attribute("type", "genoses")),
        "-": "@[<label>@(lemma)</label>\n]@" + box("item"),
        "+": box("table", xml_id, over("head") + BODY),
        "+-": box("row"),
        "+=": box("row", ' role="label"'),
        "+:": tag("cell", attribute("cols", "hspan") + attribute("rows", "vspan")),
        "*paragraph in +:": BODY,
        **dict.fromkeys(("+>", "+_"), ""),
        "<": box("figure", xml_id, over("head") + BODY),
        "*media": '<graphic url="@((param))"/>',
        "><": '<ref target="@(grammata)">@(grammata)</ref>',
        ">": '<ref target="#@(param)"/>',
        ">[": '<ref type="bibr" target="#@(param)"/>',
        "|": '<milestone@[ unit="@(genoses)"]@@[ n="@(param)"]@/>',
        "=": "<@((lemma))>@(grammata)</@((lemma))>",
        "*paragraph in =": BODY,
        "*verbatim": box("ab", ' type="code"', "@(content)"),
        "*verbatim-inline": tag("code", "", "@(content)"),
        "*diaphane-inline": BODY,
        "*milestone": '<milestone unit="@(scheme)" n="@(value)"/>',
        "*onym-anchor": '<anchor xml:id="@(onym)"/>',
        "*englossis kolophon": BODY,
        "*englossis bibliogramma": box("listBibl"),
    }


#: Elements of a TEI citation by field, and BibTeX names of fields and entry types (fixed values).
_TEI_FIELDS = {"auctor": "author", "editor": "editor", "titulus": "title", "annus": "date", "datum": "date", "officina": "publisher", "locus": "pubPlace"}
_TEI_LEVELS = {"titulus-libri": "m", "ephemeris": "j"}
_TEI_SCOPES = {"volumen": "volume", "paginae": "page"}


def _bibliography_tei() -> Rules:
    return {
        "*document": box("listBibl"),
        "*paragraph": BODY,
        "&": '<bibl xml:id="@(lemma)"' + attribute("type", "genoses") + f">\n{BODY}\n</bibl>",
        ":": '<note type="@(lemma)">@(grammata)</note>',
        **{f":({f})": tag(t) for f, t in _TEI_FIELDS.items()},
        **{f":({f})": tag("title", f' level="{level}"') for f, level in _TEI_LEVELS.items()},
        **{f":({f})": tag("biblScope", f' unit="{unit}"') for f, unit in _TEI_SCOPES.items()},
    }


def _bibliography_docbook() -> Rules:
    names = {"titulus": "title", "officina": "publishername", "locus": "address", "annus": "pubdate", "datum": "pubdate", "editio": "edition", "volumen": "volumenum", "numerus": "issuenum", "paginae": "pagenums"}
    return {
        "*paragraph": BODY,
        "&": box("biblioentry", ' xml:id="@(lemma)"' + attribute("role", "genoses")),
        ":": tag("bibliomisc", ' role="@(lemma)"'),
        ":(auctor)": "<author><personname>@(grammata)</personname></author>",
        **{f":({f})": tag(t) for f, t in names.items()},
    }


def _bibliography_html() -> Rules:
    return {"*paragraph": BODY, "&": box("p", ' class="entry" id="@(lemma)"'), ":": tag("span", ' class="@(lemma)"')}


def _bibliography_text() -> Rules:
    return {"*paragraph": BODY, "&": f"* {BODY}\n", ":": f"{HEAD}: {BODY}"}


def _bib(vocabularies: dict[str, dict]) -> Rules:
    """Terms go back to their first technical name; a term without one is its own."""
    first = lambda term, names: next((n for n in _TECHNICAL.split() if n in names), term)
    kinds = {f"&.{t}": f"@{first(t, names)}" for t, names in vocabularies["genera"].items()}
    entry = "{@(lemma),\n@(grammata)\n}"
    return (
        {"*document": BODY, "*paragraph": BODY, "&": "\\@misc" + entry, ":": "  @(lemma) = {@(grammata)},"}
        | {p: "\\" + kind + entry for p, kind in kinds.items()}
        | {f":({t})": f"  {first(t, names)} = {{{BODY}}}," for t, names in vocabularies["campi"].items()}
    )


#: Names that bibliography files use, for the terms that have several (fixed values).
_TECHNICAL = (
    "article book booklet collection incollection proceedings inproceedings techreport manual misc online patent periodical thesis unpublished dataset software "
    "mvbook inbook bookinbook suppbook mvcollection suppcollection mvproceedings suppperiodical reference mvreference inreference set artwork audio movie video music "
    "performance letter review standard legislation jurisdiction legal commentary image author editor translator title subtitle journal booktitle year date volume number "
    "pages edition publisher address institution chapter type language note abstract maintitle mainsubtitle titleaddon maintitleaddon booktitleaddon booksubtitle shorttitle "
    "origtitle issuetitle issuesubtitle journalsubtitle bookauthor foreword afterword introduction holder organization eventtitle eventdate venue issue month origdate "
    "origlanguage origlocation origpublisher pubstate part volumes pagetotal pagination bookpagination version addenda annotation library howpublished keywords shorthand "
    "eprinttype eprintclass urldate"
)


def _colophon(target: str) -> Rules:
    if target == "tei":
        return {"*paragraph": BODY, ":": "", ":(officina)": tag("publisher"), ":(locus)": tag("pubPlace"), ":(datum)": tag("date", attribute("when", "chronos"))}
    if target == "docbook":
        return {"*paragraph": BODY, ":": "", ":(officina)": box("publisher", "", tag("publishername")), ":(locus)": tag("address"), ":(datum)": tag("pubdate")}
    if target in ("html", "xhtml"):
        return {"*paragraph": BODY, ":": tag("p", ' class="colophon"')}
    return {"*paragraph": BODY, ":": BODY + "\n"}


# Scripture.


def _other_sigil(template: str) -> str:
    """A template in which the backslash is the sigil, so that a literal one is written with the other before it."""
    return template.replace("\\", "@\\").replace("@(", "\\(").replace("@[", "\\[").replace("]@", "]\\")


def _usfm() -> Rules:
    return {
        "*document": BODY,
        "*paragraph": f"\\p {BODY}",
        "#": f"\\id @(lemma)\n{BODY}",
        "*solo ##": "\\c @(param)",
        "##": "\\c @(param)",
        "|": "\n\\v @(param)",
        "*solo _": f"\\@(genoses) {BODY}",
        "_": f"\\@(genoses) {BODY}",
        "~": BODY,
        "*strophe": BODY + "\n\\b",
        "*stichos": BODY,
        ",": f"\\@(genoses) {BODY}\\@(genoses)*",
        **{f",.q{k}": f"\\q{k} {BODY}" for k in range(1, 4)},
        "^": f"\\@(genoses) + {BODY}\\@(genoses)*",
        ",.fr": f"\\fr {BODY} \\ft ",
        ",.xo": f"\\xo {BODY} \\xt ",
        "*milestone": "",
        "*onym-anchor": "",
        "*englossis kolophon": "",
    }


def _usx() -> Rules:
    return {
        "*document": _XML_HEAD + box("usx", ' version="3.0"'),
        "*paragraph": tag("para", ' style="p"'),
        "#": f'<book code="@(lemma)" style="id"/>\n{BODY}',
        "*solo ##": '<chapter number="@(param)" style="c"/>',
        "##": '<chapter number="@(param)" style="c"/>',
        "|": '<verse number="@(param)" style="v"/>',
        "*solo _": tag("para", ' style="@(genoses)"'),
        "_": tag("para", ' style="@(genoses)"'),
        "~": BODY,
        "*strophe": f'{BODY}\n<para style="b"/>',
        "*stichos": BODY,
        ",": tag("char", ' style="@(genoses)"'),
        **{f",.q{k}": tag("para", f' style="q{k}"') for k in range(1, 4)},
        ",.ref": tag("ref", attribute("loc", "skopos")),
        ",.said": '<ms style="qt-s"' + attribute("who", "prosopon") + f'/>{BODY}<ms style="qt-e"/>',
        "^": tag("note", ' style="@(genoses)" caller="+"'),
        "*milestone": "",
        "*onym-anchor": "",
        "*englossis kolophon": "",
    }


def _osis() -> Rules:
    from quire.sources.scripture import HIGHLIGHTS, PHRASES, SEGMENTS, TITLES

    titles = {f"*solo _.{c}": tag("title", f' type="{t}"') for t, c in TITLES.items()}
    phrases = {f",.{c}": tag(t) for t, c in PHRASES.items()}
    phrases |= {f",.{c}": tag("hi", f' type="{t}"') for t, c in HIGHLIGHTS.items()}
    phrases |= {f",.{c}": tag("seg", f' type="{t}"') for t, c in SEGMENTS.items()}
    return (
        titles
        | phrases
        | {
            "*document": _XML_HEAD + box("osis", ' xmlns="http://www.bibletechnologies.net/2003/OSIS/namespace"', box("osisText", "", f"<header/>\n{BODY}")),
            "*paragraph": tag("p"),
            "#": box("div", ' type="book" osisID="@(lemma)"'),
            "*solo ##": '<chapter n="@(param)"/>',
            "##": '<chapter n="@(param)"/>',
            "|": '<verse n="@(param)"/>',
            "*solo _": tag("title"),
            "_": BODY,
            "~": BODY,
            "*strophe": box("lg"),
            "*stichos": BODY,
            ",": tag("seg", ' type="x-@(genoses)"'),
            ",.wj": tag("q", attribute("who", "prosopon")),
            ",.said": tag("q", attribute("who", "prosopon")),
            ",.ref": tag("reference", attribute("osisRef", "skopos")),
            ",.fr": tag("reference"),
            ",.xo": tag("reference"),
            **{f",.q{k}": tag("l", f' level="{k}"') for k in range(1, 4)},
            "^": tag("note"),
            "^.x": tag("note", ' type="crossReference"'),
            "*milestone": "",
            "*onym-anchor": "",
            "*englossis kolophon": "",
        }
    )


def _usfm_latex() -> Rules:
    heads = {m: f"\\section*{{{BODY}}}\n" for m in ("s1", "s2", "s3", "ms1", "ms2")} | {"mt1": f"\\part*{{{BODY}}}\n", "mt2": f"\\part*{{{BODY}}}\n", "h": "", "toc1": "", "toc2": "", "toc3": ""}
    return {
        "*document": "\\documentclass{book}\n\\begin{document}\n@(grammata)\n\\end{document}",
        "*paragraph": BODY + "\n",
        "#": BODY,
        "*solo ##": "\\chapter*{@(param)}\n",
        "##": "\\textbf{@(param)} ",
        "|": "\\textsuperscript{@(param)}",
        "*solo _": BODY + "\n",
        **{f"*solo _.{m}": t for m, t in heads.items()},
        "_": BODY,
        "~": f"\\begin{{verse}}\n{BODY}\n\\end{{verse}}\n",
        "*strophe": BODY + "\n",
        "*stichos": BODY + r"\\",
        ",": BODY,
        **{f",.{m}": f"\\{c}{{{BODY}}}" for m, c in (("nd", "textsc"), ("add", "textit"), ("em", "emph"), ("bd", "textbf"), ("it", "textit"), ("sc", "textsc"), ("qs", "textit"), ("tl", "textit"))},
        "^": f"\\footnote{{{BODY}}}",
        "*milestone": "",
        "*onym-anchor": "",
        "*englossis kolophon": "",
    }


#: Variants of a table: what they say otherwise.
_VARIANTS: dict[tuple[str, str, str], Callable[[], Rules]] = {
    ("at-usfm", "latex", "a5"): lambda: {"*document": "\\documentclass[a5paper]{book}\n\\begin{document}\n@(grammata)\n\\end{document}"},
    ("at-usfm", "latex", "redletter"): lambda: {",.wj": f"\\textcolor{{red}}{{{BODY}}}"},
    ("at-usfm", "latex", "ru"): lambda: {"*document": "\\documentclass{book}\n\\usepackage[russian]{babel}\n\\begin{document}\n@(grammata)\n\\end{document}"},
}


def _dictionary_latex() -> Rules:
    return _latex() | {
        "!": f"\\textbf{{{HEAD}}}@[\\label{{@(onym)}}]@ {BODY}",
        "*paragraph in !": BODY,
        ":": f"@[\\textbf{{@(taxis)}} ]@{BODY}",
        **{f"*solo {s}": BODY for s in ("=~", "=%", "=-", "=&", "=<", "=>", "=*", "=/")},
        **{s: BODY for s in ("=~", "=%", "=-", "=&", "=<", "=>", "=*", "=/", "&", "[[", "=~~")},
        "[": f"\\textit{{{BODY}}}",
        "~": f"\\textit{{{BODY}}}",
    }


def _dictionary_kindle() -> Rules:
    heads = {s: tag("span", f' class="{n}"') for s, n in (("=~", "variant"), ("=%", "pronunciation"), ("=-", "syllables"), ("=&", "grammar"), ("=<", "etymology"), ("=>", "equivalent"), ("=*", "inflection"), ("=/", "languages"), ("&", "label"), ("[", "usage"), ("~", "citation"))}
    shared = _literary_html()
    return {k: v for k, v in shared.items() if k in _KINDLE_SHARED} | heads | {
        "!": '<idx:entry name="default" scriptable="yes">\n<idx:orth value="@(lemma)"@[ id="@(onym)"]@><b>@(lemma)</b></idx:orth>\n@(grammata)\n</idx:entry>',
        ":": box("div", ' class="sense"', "@[<b>@(taxis)</b> ]@" + BODY),
        "=~~": box("div", ' class="citation"'),
        "[[": box("div", ' class="abbreviations"'),
    }


_KINDLE_SHARED = (
    "*document *paragraph / * */ , >< -- .. - .- ::; :: ; ^ # ## ### #_ ** \"\" > *verbatim *verbatim-inline *media *milestone *onym-anchor = =_ =: =;".split()
    + ["*solo =", "*solo =_", "*solo =:", "*solo =;", "*solo **", "*solo #_", "*deixis ^", '"', "*englossis kolophon"]
)


# The book of tables.

_PLAIN: dict[str, str] = {}
_MARKDOWN = {c: "\\" + c for c in "\\`*_#>-"}
_RST = {c: "\\" + c for c in "\\*`_|"}
_NO_MARKS = ("at-aphanes", "at-epimerismos")

_TABLES: dict[tuple[str, str], tuple[dict[str, str], Callable[[dict], Rules]]] = {
    ("at-html", "html"): (XML, lambda v: _html()),
    ("at-html", "xhtml"): (XML, lambda v: _xhtml()),
    ("at-markdown", "html"): (_PLAIN, lambda v: _markdown_in_html()),
    ("at-markdown", "md"): (_MARKDOWN, lambda v: _md()),
    ("at-djot", "dj"): (_MARKDOWN, lambda v: _dj()),
    ("at-org", "org"): (_PLAIN, lambda v: _org()),
    ("at-rst", "rst"): (_RST, lambda v: _rst()),
    ("at-docbook", "docbook"): (XML, lambda v: _docbook()),
    ("at-tei", "tei"): (XML, _tei),
    ("bibliogramma", "tei"): (XML, lambda v: _bibliography_tei()),
    ("bibliogramma", "docbook"): (XML, lambda v: _bibliography_docbook()),
    ("bibliogramma", "html"): (XML, lambda v: _bibliography_html()),
    ("bibliogramma", "xhtml"): (XML, lambda v: _bibliography_html()),
    ("bibliogramma", "gemtext"): (_PLAIN, lambda v: _bibliography_text()),
    ("bibliogramma", "bib"): (_PLAIN, _bib),
    ("bibliogramma", "bibtex"): (_PLAIN, _bib),
    ("litogramma", "html"): (XML, lambda v: _literary_html()),
    ("litogramma", "gemtext"): (_PLAIN, lambda v: _gemtext()),
    ("litogramma", "latex"): (_TEX, lambda v: _latex()),
    ("lexigramma", "latex"): (_TEX, lambda v: _dictionary_latex()),
    ("lexigramma", "kindle"): (XML, lambda v: _dictionary_kindle()),
    ("at-usfm", "latex"): (_TEX, lambda v: _usfm_latex()),
    ("at-usfm", "usfm"): (_PLAIN, lambda v: _usfm()),
    ("at-usfm", "usx"): (XML, lambda v: _usx()),
    ("at-usfm", "osis"): (XML, lambda v: _osis()),
}
#: Targets whose pages hold colophons and marks of metadata.
TARGETS = ("html", "xhtml", "md", "dj", "org", "rst", "docbook", "tei", "gemtext", "latex", "usfm", "usx", "osis", "kindle", "epub")


def variant_of(source: str, target: str, variant: str, catalog: Catalog) -> RuleTable | None:
    """What a named variant of a table says otherwise."""
    rules = _VARIANTS.get((source, target, variant))
    return None if rules is None else _compiled(source, target, {}, rules(), SIGIL, catalog)


def built_in(source: str, target: str, catalog: Catalog) -> RuleTable | None:
    """The table of a schema's own rules for a target."""
    schema = catalog.schema(source)
    if source in _NO_MARKS and target in TARGETS:
        escapes, rules = _PLAIN, dict.fromkeys((s for s, e in schema.elements.items() if e.form == "void"), "")
    elif source == "kolophon" and target in TARGETS:
        escapes, rules = {"html": XML, "xhtml": XML, "tei": XML, "docbook": XML}.get(target, _PLAIN), _colophon(target)
    elif (source, target) in _TABLES:
        escapes, made = _TABLES[source, target]
        rules = made(schema.vocabularies)
    else:
        return None
    sigil = SIGIL
    if target == "usfm":
        rules, sigil = {p: _other_sigil(t) for p, t in rules.items()}, ALIAS
    out = _compiled(source, target, escapes, rules, sigil, catalog)
    if (source, target) == ("litogramma", "latex"):
        out.beside["bibliogramma"] = "bib"  # a bibliography is a file of its own there
    return out


def _compiled(source: str, target: str, escapes: dict[str, str], rules: Rules, sigil: str, catalog: Catalog) -> RuleTable:
    schema = catalog.schema(source)
    out = RuleTable(source, target, escape=dict(escapes))
    for pattern, template in rules.items():
        try:
            key, classes, separator = read_pattern(pattern, schema)
        except DocumentError:
            if (source, target) not in _LENT:
                raise
            continue  # a pattern lent by another schema's table that this one has no element for
        out.add(key, Rule(classes, read_template(template, sigil, schema), separator))
    return out


#: Tables that start from those of the literary schema.
_LENT = (("lexigramma", "latex"), ("lexigramma", "kindle"))


def named(target: str) -> Iterator[str]:
    """Schemas with a table of their own for a target."""
    return (s for s, t in _TABLES if t == target)
