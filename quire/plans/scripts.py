"""Queries that run the document operators over whole tables, beside SQL that builds their results from the same rows.

A script turns a document's lines into a file of some format. Its pieces are SQL expressions that Spark and the
checking engine both read; they are written once, with the few spellings that differ taken from an Engine. Lines
keep ASCII letters, digits and single blanks, so that no character of theirs is markup anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import documents
from quire.operators.rows import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NL = "chr(10)"


@dataclass(frozen=True)
class Engine:
    """``n`` is the number of the line at hand, from 1."""

    name: str
    n: str
    lines: str

    def each(self, what: str, over: str = "ls", names: str = "l, i") -> str:
        if self.name == "spark":
            return f"transform({over}, ({names}) -> {what})"
        return f"list_transform({over}, lambda {names}: {what})"

    def join(self, what: str, between: str) -> str:
        return f"array_join({what}, {between})" if self.name == "spark" else f"array_to_string({what}, {between})"

    def words(self, what: str, between: str, line: str = "l") -> str:
        """What each word ``w`` (number ``j``, from 0 or 1 as the engine counts) of a line makes."""
        split = f"split({line}, ' ')" if self.name == "spark" else f"string_split({line}, ' ')"
        return self.join(self.each(what, split, "w, j"), between)

    @property
    def word_no(self) -> str:
        return "(j + 1)" if self.name == "spark" else "j"

    def count(self, what: str = "ls") -> str:
        return f"size({what})" if self.name == "spark" else f"len({what})"

    def upto(self, last: str) -> str:
        return f"sequence(1, {last})" if self.name == "spark" else f"range(1, {last} + 1)"


SPARK = Engine("spark", "(i + 1)", r"filter(transform(split(coalesce(text, ''), '\n'), x -> trim(regexp_replace(x, '[^A-Za-z0-9]+', ' '))), x -> x <> '')")
DUCK = Engine("duckdb", "i", "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g'))), lambda x: x <> '')")


def cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def lit(text: str) -> str:
    """A literal that both engines read alike."""
    pieces = text.replace("'", "''").split("\n")
    shown = [" || chr(92) || ".join(f"'{x}'" for x in p.split("\\")) for p in pieces]
    return "(" + f" || {NL} || ".join(shown) + ")"


def text(template: str, **more: str) -> str:
    """A template whose ``{l}`` is the line, ``{n}`` its number, and other names what is given."""
    out = []
    for k, part in enumerate(re.split(r"\{(\w+)\}", template)):
        out.append(lit(part) if k % 2 == 0 else {"l": "l", **more}[part])
    return cat(*[o for o in out if o != "('')"] or ["''"])


def turns(e: Engine, *templates: str, **more: str) -> str:
    """Line n takes the template n modulo their number, the first one at 1."""
    size = len(templates)
    cases = [f"WHEN {(k + 1) % size} THEN {text(t, n=f'CAST({e.n} AS STRING)', **more)}" for k, t in enumerate(templates)]
    return f"CASE {e.n} % {size} {' '.join(cases)} END"


def files(spark: SparkSession, sf_dir: str, extension: str, source: Callable[[Engine], str], **more: str) -> DataFrame:
    """documents as files of a format. They are spread as they are read: files are several times their size."""
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("doc_id", f"{SPARK.lines} AS ls", *[f"{v} AS {k}" for k, v in more.items()])
    return rows.selectExpr("doc_id", f"'{extension}' AS extension", f"{source(SPARK)} AS text", *more)


def base() -> str:
    return f"(SELECT doc_id, {DUCK.lines} AS ls FROM documents) AS d"


def document(e: Engine, head: str, pieces: str, tail: str = "", between: str = NL) -> str:
    """A whole text: what stands before, the pieces, what stands behind."""
    return cat(lit(head), e.join(e.each(pieces), between), lit(tail))


def canonical(e: Engine, schema: str, pieces: str, before: str = "", after: str = "", first: str = "") -> str:
    """A canonical text: the declaration, then blocks with a blank line between them.

    ``before`` and ``after`` enclose the blocks; ``first`` is a block ahead of the pieces.
    """
    inner = e.join(e.each(pieces), NL)
    some = f"CASE WHEN {e.count()} = 0 THEN '' ELSE {{}} END"
    blocks = cat(lit(first), some.format(cat(NL, inner))) if first else inner
    body = cat(NL, lit(before), blocks) if before or first else some.format(cat(NL, inner))
    return cat(lit(f"@@@!{schema}\n"), body, lit(after))


def script(
    name: str,
    extension: str,
    source: Callable[[Engine], str],
    wanted: Callable[[Engine], str],
    doc: str,
    texts: dict[str, str] | None = None,
    essence: Callable[[Engine], str] | None = None,
) -> None:
    """Registers the canonical form of files, with its id, under a name.

    ``essence`` is the text that the id is taken of, where metadata makes it differ from the canonical one.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = documents.canonical(files(spark, sf_dir, extension, source), texts)
        return made.select("doc_id", "status", F.md5("canonical").alias("canonical_md5"), "content_id")

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, 'ok' AS status, md5({wanted(DUCK)}) AS canonical_md5, sha256({(essence or wanted)(DUCK)}) AS content_id FROM {base()}"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Readers: five kinds of lines in turn, in each format.


def reader(
    name: str,
    extension: str,
    schema: str,
    head: str,
    tail: str,
    source: list[str],
    wanted: list[str],
    between: str = "\n",
    before: str = "",
    after: str = "",
    doc: str = "",
    essence: list[str] | None = None,
    first: str = "",
) -> None:
    script(
        name,
        extension,
        lambda e: document(e, head, turns(e, *source), tail, lit(between)),
        lambda e: canonical(e, schema, turns(e, *wanted), before, after, first),
        doc or f"Documents as .{extension} files, read to canonical form.",
        essence=None if essence is None else lambda e: canonical(e, schema, turns(e, *essence), before, after),
    )


_FLAT = ["@#{l}#@\n", "@>\n{l}\n>@\n", "@-\n{l}\n-@\n", "so @%s{l}%s@ ends\n", "{l}\n"]


def _flat(mark: str) -> list[str]:
    return [t.replace("%s", mark) for t in _FLAT]


reader("markdown_files", "md", "at-markdown", "", "\n", ["# {l}", "> {l}", "- {l}", "so *{l}* ends", "{l}"], _flat("*"), "\n\n")
reader("djot_files", "dj", "at-djot", "", "\n", ["# {l}", "> {l}", "- {l}", "so _{l}_ ends", "{l}"], _flat("_"), "\n\n")
reader("org_files", "org", "at-org", "", "\n", ["* {l}", "#+BEGIN_QUOTE\n{l}\n#+END_QUOTE", "- {l}", "so /{l}/ ends", "{l}"], _flat("/"), "\n\n")
script(
    "rst_files",
    "rst",
    lambda e: document(e, "", turns(e, "{l}\n{rule}", "   {l}", "- {l}", "so *{l}* ends", "{l}", rule="repeat('=', length(l) + 4)"), "\n", lit("\n\n")),
    lambda e: canonical(e, "at-rst", turns(e, *_flat("*"))),
    "Documents as .rst files, read to canonical form.",
)
reader(
    "html_files",
    "html",
    "at-html",
    "<html><head><title>t</title></head><body>",
    "</body></html>",
    ["<h1>{l}</h1>", "<blockquote><p>{l}</p></blockquote>", "<ul><li>{l}</li></ul>", "<p>so <em>{l}</em> ends</p>", "<p>{l}</p>"],
    ["@#{l}#@\n", "@>\n{l}\n>@\n", "@--\n@-\n{l}\n-@\n--@\n", "so @/{l}/@ ends\n", "{l}\n"],
)
_BOOKISH = ["@# {l}\n{l}\n#@\n", "@%s\n{l}\n%s@\n", "@--\n@-\n{l}\n-@\n--@\n", "so @/{l}/@ ends\n", "{l}\n"]
reader(
    "docbook_files",
    "dbk",
    "at-docbook",
    '<article xmlns="http://docbook.org/ns/docbook">',
    "</article>",
    ["<section><title>{l}</title><para>{l}</para></section>", "<blockquote><para>{l}</para></blockquote>", "<itemizedlist><listitem><para>{l}</para></listitem></itemizedlist>", "<para>so <emphasis>{l}</emphasis> ends</para>", "<para>{l}</para>"],
    [t.replace("%s", ">") for t in _BOOKISH],
)
reader(
    "tei_files",
    "tei",
    "litogramma",
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>',
    "</body></text></TEI>",
    ["<div><head>{l}</head><p>{l}</p></div>", "<quote><p>{l}</p></quote>", "<list><item>{l}</item></list>", "<p>so <emph>{l}</emph> ends</p>", "<p>{l}</p>"],
    [t.replace("%s", '"') for t in _BOOKISH],
)
reader(
    "tei_verse_files",
    "xml",
    "litogramma",
    "<TEI><text><body>",
    "</body></text></TEI>",
    ["<lg><l>{l}</l><l>{l}</l></lg>", '<sp who="#p{n}"><speaker>A</speaker><p>{l}</p></sp>', '<p><persName ref="#p{n}">{l}</persName></p>', "<stage>{l}</stage>"],
    ["@~\n{l}\n{l}\n~@\n", "@: @?:(p{n})A\n{l}\n:@\n", "@,@?:(p{n}){l},@.persname\n", "@:[\n{l}\n]:@\n"],
    doc="TEI verse, speeches, names that point and stage directions.",
    essence=["@~\n{l}\n{l}\n~@\n", "@: A\n{l}\n:@\n", "@,{l},@\n", "@:[\n{l}\n]:@\n"],
)
reader(
    "jats_files",
    "jats",
    "litogramma",
    "<article><body>",
    "</body></article>",
    ["<sec><title>{l}</title><p>{l}</p></sec>", "<disp-quote><p>{l}</p></disp-quote>", "<p>so <italic>{l}</italic> ends</p>", "<p>{l}</p>"],
    ["@# {l}\n{l}\n#@\n", '@"\n{l}\n"@\n', "so @/{l}/@ ends\n", "{l}\n"],
)
reader(
    "fb2_files",
    "fb2",
    "litogramma",
    "<FictionBook><body>",
    "</body></FictionBook>",
    ["<section><title><p>{l}</p></title><p>{l}</p></section>", "<cite><p>{l}</p></cite>", "<subtitle>{l}</subtitle>", "<p>so <emphasis>{l}</emphasis> ends</p>", "<p>{l}</p>"],
    ["@# {l}\n{l}\n#@\n", '@"\n{l}\n"@\n', "@#_{l}_#@\n", "so @/{l}/@ ends\n", "{l}\n"],
)
_VERSES = ["@_{l}_@\n", "{l}\n", "@~\n@,{l},@\n~@\n", "{l}\n"]
_SCRIPTURE = ["@_{l}_@.s1\n", "@|({n}) {l}\n", "@~\n@,{l},@.q1\n~@\n", "{l}\n"]
reader("usfm_files", "usfm", "at-usfm", "\\id GEN\n", "\n", ["\\s {l}", "\\p\n\\v {n} {l}", "\\q1 {l}", "\\p {l}"], _SCRIPTURE, before="@# gen\n", after="#@\n", essence=_VERSES)
reader(
    "usx_files",
    "usx",
    "at-usfm",
    '<usx version="3.0"><book code="GEN" style="id"/>',
    "</usx>",
    ['<para style="s">{l}</para>', '<para style="p"><verse number="{n}"/>{l}</para>', '<para style="q1">{l}</para>', '<para style="p">{l}</para>'],
    _SCRIPTURE,
    before="@# gen\n",
    after="#@\n",
    essence=_VERSES,
)
reader(
    "osis_files",
    "osis",
    "at-usfm",
    '<osis><osisText><div type="book" osisID="Gen"><chapter n="1">',
    "</chapter></div></osisText></osis>",
    ["<title>{l}</title>", '<p><verse n="{n}"/>{l}</p>', '<lg><l level="1">{l}</l></lg>', "<p>{l}</p>"],
    _SCRIPTURE,
    before="@# gen\n",
    after="#@\n",
    essence=_VERSES,
    first="@##(1)\n",
)
script(
    "bibliography_files",
    "bib",
    lambda e: document(e, "", text("@article(k{n}, title = \"{l}\", year = 1999)", n=f"CAST({e.n} AS STRING)"), "\n"),
    lambda e: canonical(e, "bibliogramma", text("@& k{n}\n@: titulus\n{l}\n:@\n\n@: annus\n1999\n:@\n&@.commentarius\n", n=f"CAST({e.n} AS STRING)")),
    "Bibliography files: entry types and field names in any language become terms.",
)
script(
    "dictionary_files",
    "dsl",
    lambda e: document(e, '#NAME "Words"\n', text("w{n}x\n\t[m1]1) {l}[/m]\n\t[m1]2) [b]{l}[/b][/m]", n=f"CAST({e.n} AS STRING)"), "\n"),
    lambda e: canonical(e, "lexigramma", text("@! w{n}x\n@:(1)\n{l}\n:@\n\n@:(2)\n@*{l}*@\n:@\n!@(w{n}x)\n", n=f"CAST({e.n} AS STRING)"), first="@=Words=@\n"),
    "Dictionary cards: senses by number, entries anchored by their head.",
)
#: Analyses are no part of a text's essence.
_BARE = lambda e: canonical(e, "litogramma", text("{l}\n"))
_WORD = "@@.@!=({w})@!/(X)@!-(dep){w}.@@"
_PARSED = lambda e: cat(lit("@@.@!.(s"), f"CAST({e.n} AS STRING)", lit(")"), e.words(text(_WORD, w="w"), "' '"), lit(".@@\n"))
script(
    "conllu_files",
    "conllu",
    lambda e: document(e, "", cat(lit("# sent_id = s"), f"CAST({e.n} AS STRING)", NL, e.words(cat(f"CAST({e.word_no} AS STRING)", "chr(9)", "w", "chr(9)", "w", "chr(9)", "'X'", "chr(9)", "'_'", "chr(9)", "'_'", "chr(9)", "'0'", "chr(9)", "'dep'", "chr(9)", "'_'", "chr(9)", "'_'"), NL), NL), "\n"),
    lambda e: canonical(e, "litogramma", _PARSED(e)),
    "Treebank files, a line of text a sentence, every word analysed.",
    essence=_BARE,
)
script(
    "proiel_files",
    "proiel",
    lambda e: document(e, "<proiel><source>", cat(lit('<sentence id="s'), f"CAST({e.n} AS STRING)", lit('">'), e.words(text('<token form="{w}" lemma="{w}" part-of-speech="X" relation="dep" presentation-after=" "/>', w="w"), "''"), lit("</sentence>")), "</source></proiel>"),
    lambda e: canonical(e, "litogramma", _PARSED(e)),
    "Treebank XML with the text between tokens in attributes.",
    essence=_BARE,
)
script(
    "opencorpora_files",
    "opencorpora",
    lambda e: document(e, "<annotation><text><paragraphs>", cat(lit('<paragraph><sentence id="s'), f"CAST({e.n} AS STRING)", lit('"><source>'), "l", lit("</source><tokens>"), e.words(text('<token text="{w}"><tfr><v><l t="{w}"><g v="X"/><g v="y"/></l></v></tfr></token>', w="w"), "''"), lit("</tokens></sentence></paragraph>")), "</paragraphs></text></annotation>"),
    lambda e: canonical(e, "litogramma", cat(lit("@@.@!.(s"), f"CAST({e.n} AS STRING)", lit(")"), e.words(text("@@.@!=({w})@!/(X)@!%(y){w}.@@", w="w"), "' '"), lit(".@@\n"))),
    "Corpus XML whose tokens are aligned to the sentence's text.",
    essence=_BARE,
)
script(
    "rnc_files",
    "rnc",
    lambda e: document(e, "<html><body>", cat(lit("<p><se>"), e.words(text('<w><ana lex="{w}" gr="X,y" sem="a b"/>{w}</w>', w="w"), "' '"), lit("</se></p>")), "</body></html>"),
    lambda e: canonical(e, "litogramma", cat(lit("@@.@!.("), f"CAST({e.n} AS STRING)", lit(")"), e.words(text("@@.@!=({w})@!/(X)@!%(y)@!&(a_b){w}.@@", w="w"), "' '"), lit(".@@\n"))),
    "National-corpus XML with analyses inside words.",
    essence=_BARE,
)
script(
    "numbered_files",
    "tanzil",
    lambda e: e.join(e.each("CAST(k AS STRING) || '|1|verse ' || CAST(doc_id AS STRING)", e.upto("114"), "k, z"), NL),
    lambda e: cat(lit("@@@!at-usfm\n\n@# quran\n"), e.join(e.each(cat(lit('@("quran:'), "CAST(k AS STRING)", lit('")\n\n@~\n@("quran:'), "CAST(k AS STRING)", lit('.1") verse '), "CAST(doc_id AS STRING)", lit("\n~@\n")), e.upto("114"), "k, z"), NL), lit("#@\n")),
    "Numbered verses: suras and verses as coordinates.",
)


reader(
    "short_files",
    "atr",
    "litogramma",
    "",
    "\n",
    ["- {l}", "> {l}", "so /{l}/ ends", "{l}"],
    ["@--\n@-\n{l}\n-@\n--@\n", '@"\n{l}\n"@\n', "so @/{l}/@ ends\n", "{l}\n"],
    "\n\n",
    doc="Texts in the short notation, compiled and brought to canonical form.",
)


# Native source: what canonical form does to it.

#: A schema of our own for native sources.
SCHEMA = """@@@!quire

@=== passage
@# [lemma]
grammata
#@ [hypograph]
@% kinds
===@

@=== place
@=[(taxis)] lemma
grammata
=@
===@

@=== mark
@: grammata :@
===@

@=== see
@^(param)
===@

@=== song
@~ [lemma]
stichos
~@ [hypograph]
===@

@=== headword
@![(taxis)] lemma
autonym
grammata
!@
===@

@=== topic
@& lemma=topics
grammata
&@
===@

@=== grid
@+
rows
+@
===@

@=== line
@+-
cells
-+@
@^(+)
===@

@=== headline
@+=
header
cells
=+@
@^(+)
===@

@=== box
@+:
grammata
:+@
@^(+-)
===@

@==% kinds
main: chief principal
side: minor
%==@

@==% topics
sea: ocean main
land: shore
%==@
"""
TEXTS = {"log.dia": SCHEMA, "shared.atd": "@@@!log\n\nshared @:words:@\n", "plain.txt": "as it is\n"}


def native(name: str, source: list[str], wanted: list[str], doc: str, head: str = "", before: str = "", essence: list[str] | None = None, essence_before: str = "") -> None:
    """Documents as native source; ``essence``: what the content id is taken of, if not the canonical text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = documents.canonical(files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n" + head, turns(e, *source), "\n", lit("\n\n"))), TEXTS)
        return made.select("doc_id", "status", F.md5("canonical").alias("canonical_md5"), "content_id")

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    shown = canonical(DUCK, "log", turns(DUCK, *wanted), before)
    kept = shown if essence is None else canonical(DUCK, "log", turns(DUCK, *essence), essence_before)
    ORACLE_SQL[name] = f"SELECT doc_id, 'ok' AS status, md5({shown}) AS canonical_md5, sha256({kept}) AS content_id FROM {base()}"


native("native_layout", ["{l}\n  {l}\t\t{l}", "@:{l}\n   {l}:@"], ["{l} {l} {l}\n", "@:{l} {l}:@\n"], "White space of layout collapses, in text and in spans.")
native("native_comments", ["{l} @@/ not for readers", "@@@/ all of\nthis goes /@@@\n{l}"], ["{l}\n", "{l}\n"], "Comments of a line and of a block are not content.")
native("native_verse", ["@~ {l}\n  {l}\n\n{l}\n~@ {l}"], ["@~ {l}\n  {l}\n\n{l}\n~@ {l}\n"], "Lines of verse keep their indents, stanzas their blank lines.")
native("native_verbatim", ['@@@"\n{l}\n  {l}\n"@@@.sql', 'so @@"{l}"@@ ends'], ['@@@"\n{l}\n  {l}\n"@@@.sql\n', 'so @@"{l}"@@ ends\n'], "Verbatim blocks and spans are kept as they are; a block's class is metadata.", essence=['@@@"\n{l}\n  {l}\n"@@@\n', 'so @@"{l}"@@ ends\n'])
native("native_wrappers", ["@@.{l}.@@", "@@@.\n{l}\n\n{l}\n.@@@"], ["{l}\n", "{l}\n\n{l}\n"], "Wrappers without annotations dissolve.")
native("native_classes", ["@# {l}\n{l}\n#@.chief.loud", "@:{l}:@.soft"], ["@# {l}\n{l}\n#@.main.loud\n", "@:{l}:@.soft\n"], "Class tags become the vocabulary's terms; others stay, and are no part of the essence.", essence=["@# {l}\n{l}\n#@.main\n", "@:{l}:@\n"])
native("native_terms", ["@& Ocean\n{l}\n&@", "@& shore\n{l}\n&@", "@& reef\n{l}\n&@"], ["@& sea\n{l}\n&@\n", "@& land\n{l}\n&@\n", "@& reef\n{l}\n&@\n"], "Heads bound to a vocabulary become its terms, in any case.")
native("native_points", ['@("v:{n}"){l}', "{l}"], ['@("v:{n}"){l}\n', "{l}\n"], "Coordinates stand in the text.")
native("native_tables", ["@+\n| {l} | {l} |\n|---+---|\n| {l} |\n+@"], ["@+\n@+=\n@+:\n{l}\n:+@\n\n@+:\n{l}\n:+@\n=+@\n\n@+-\n@+:\n{l}\n:+@\n\n@+:\n:+@\n-+@\n+@\n"], "Shorthand rows become cells, rows above the line of dashes headers, and short rows are filled.")
native("native_inclusions", ["@@@(shared.atd)", "@@@+(plain.txt)", "{l}"], ["shared @:words:@\n", '@@@"\nas it is\n"@@@\n', "{l}\n"], "Included sources are part of the text; included files are verbatim.")
native("native_macros", ["@@@(:m:)", "{l} @@(:w:)"], ["one @:two:@\n", "{l} small\n"], "Uses take the definition that stands before them.", head="@@@:\none @:two:@\n:@@@(m)\n\n@@:small:@@(w)\n\n")


def _anchor_source(e: Engine) -> str:
    made = text("@= {l}\n{l}\n=@(p{n})\n\nsee @=(p{n}) and @:{l}:@(q{n})", n=f"CAST({e.n} AS STRING)")
    return document(e, "@@@!log\n\n", made, "\n", lit("\n\n"))


def _anchor_wanted(e: Engine) -> str:
    made = text("@= {l}\n{l}\n=@(o{n})\n\nsee @=(o{n}) and @:{l}:@\n", n=f"CAST({e.n} AS STRING)")
    return canonical(e, "log", made)


script("native_references", "atd", _anchor_source, _anchor_wanted, "Anchors that are referred to are numbered in order, others go; references follow.", TEXTS)
script(
    "native_ordinals",
    "atd",
    lambda e: document(e, "@@@!log\n\n", text("@=() {l}\na\n=@\n\n@=() {l}\nb\n=@\n\n{l}"), "\n", lit("\n\n")),
    lambda e: canonical(e, "log", text("@=(1) {l}\na\n=@\n\n@=(2) {l}\nb\n=@\n\n{l}\n")),
    "Ordinals count up within a run of siblings and start again behind another block.",
    TEXTS,
)
script(
    "native_homographs",
    "atd",
    lambda e: document(e, "@@@!log\n\n", text("@!() ebb tide\n{l}\n!@"), "\n", lit("\n\n")),
    lambda e: canonical(e, "log", text("@!({n}) ebb tide\n{l}\n!@(ebb-tide-{n})\n", n=f"CAST({e.n} AS STRING)")),
    "Entries anchor themselves by their head, homographs by their number besides.",
    TEXTS,
)
script(
    "native_copied_blocks",
    "atd",
    lambda e: document(e, "@@@!log\n\n@@@+(:late:)\n\n", text("{l}"), "\n\n@# head\nbody\n#@(late)\n", lit("\n\n")),
    lambda e: cat(lit('@@@!log\n\n@@@"\n@# head\nbody\n#@(late)\n"@@@\n'), f"CASE WHEN {e.count()} = 0 THEN '' ELSE {cat(NL, e.join(e.each(text('{l}' + chr(10))), NL))} END", lit("\n@# head\nbody\n#@\n")),
    "A verbatim copy of an anchored block, which may come later.",
    TEXTS,
)

# Errors: each kind rejects the file that has it, and no other.

ERRORS = {
    "MissingDeclaration": "plain {l}",
    "UnresolvableDialektos": "@@@!nowhere\n\n{l}",
    "UndefinedSim": "@@@!log\n\n@%{l}%@",
    "UnmatchedSim": "@@@!log\n\n@:{l}",
    "DeixisUndefinedOnym": "@@@!log\n\n{l} @=(nothing)",
    "DeixisTargetMismatch": "@@@!log\n\n{l} @=(x)\n\n@# h\nb\n#@(x)",
    "InvalidGenos": "@@@!log\n\n@:{l}:@.Bad",
    "InvalidOnym": "@@@!log\n\n{l} @(b--c)",
    "TransclusionCycle": "@@@!log\n\n@@@(self.atd)\n\n{l}",
    "MissingResource": "@@@!log\n\n@@@+(gone.txt)\n\n{l}",
    "AxiomaBeforeDefinition": "@@@!log\n\n@@@(:late:)\n\n{l}",
    "TaxisInconsistent": "@@@!log\n\n@=(2) {l}\na\n=@",
    "ComponentViolation": "@@@!log\n\n@=\n{l}\n=@",
    "Syntax": '@@@!log\n\n@("v:1"){l} @("v:1")',
}
_ERROR_TEXTS = TEXTS | {"self.atd": "@@@!log\n\n@@@(self.atd)\n"}


def _error_case(e: Engine, what: Callable[[str, str], str]) -> str:
    kinds = list(ERRORS)
    cases = " ".join(f"WHEN {k} THEN {what(kind, ERRORS[kind])}" for k, kind in enumerate(kinds))
    return f"CASE doc_id % {len(kinds) + 1} {cases} ELSE {what('', '')} END"


@query(f"SELECT doc_id, CASE WHEN doc_id % {len(ERRORS) + 1} = {len(ERRORS)} THEN 'ok' ELSE 'error' END AS status, NULLIF({_error_case(DUCK, lambda kind, _: lit(kind))}, '') AS error_kind FROM documents")
def native_errors(spark, sf_dir):
    """Documents with one fault each, by their id, and one in fifteen without."""
    whole = lambda e: e.join("ls", "' '")
    made = lambda e: _error_case(e, lambda kind, t: text(t or "@@@!log\n\n{l}", l=f"coalesce(nullif({whole(e)}, ''), 'x')"))
    return documents.canonical(files(spark, sf_dir, "atd", made), _ERROR_TEXTS).select("doc_id", "status", "error_kind")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'ok' ELSE 'error' END AS status, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE 'Syntax' END AS error_kind FROM documents""")
def reader_errors(spark, sf_dir):
    """Strict readers: elements outside the subset, bare text, an unclosed element, too deep a nesting; and none."""
    faults = [lit("<p><video></video></p>"), lit("bare"), lit("<div><p>open</p>"), lit("<div>" * 80 + "</div>" * 80)]
    body = lambda e: f"CASE doc_id % 5 {' '.join(f'WHEN {k} THEN {f}' for k, f in enumerate(faults))} ELSE {cat(lit('<p>'), e.join('ls', NL), lit('</p>'))} END"
    return documents.canonical(files(spark, sf_dir, "html", body)).select("doc_id", "status", "error_kind")


# The node table.


@query(
    f"""SELECT doc_id, kind, symbol, slot, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS chars FROM (
  SELECT doc_id, unnest([{{'kind': 'block', 'symbol': '#', 'slot': 'body', 'n': len(ls), 'm': 0}},
    {{'kind': 'text', 'symbol': NULL, 'slot': 'head', 'n': len(ls), 'm': t}}, {{'kind': 'para', 'symbol': NULL, 'slot': 'body', 'n': len(ls), 'm': 0}},
    {{'kind': 'span', 'symbol': ':', 'slot': 'body', 'n': len(ls), 'm': 0}}, {{'kind': 'text', 'symbol': NULL, 'slot': 'content', 'n': len(ls), 'm': t}}], recursive := true)
  FROM (SELECT doc_id, ls, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS t FROM {base()}) WHERE len(ls) > 0)"""
)
def native_nodes(spark, sf_dir):
    """Rows of the interval-encoded tree by kind, symbol and place, with the characters they hold."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n", text("@# {l}\n@:{l}:@\n#@"), "\n", lit("\n\n")))
    found = documents.nodes(made, TEXTS).where("status = 'ok' AND pre IS NOT NULL")
    return found.groupBy("doc_id", "kind", "symbol", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"SELECT doc_id, CAST(len(ls) * 2 AS BIGINT) AS inside FROM {base()} WHERE len(ls) > 0")
def native_descendants(spark, sf_dir):
    """Spans and their texts inside paragraphs, by the intervals of the tree."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n", text("@# {l}\n@:{l}:@\n#@"), "\n", lit("\n\n")))
    nodes = documents.nodes(made, TEXTS).where("status = 'ok'")
    a, d = nodes.where("kind = 'para'").select("doc_id", F.col("pre").alias("a"), F.col("post").alias("b")), nodes.select("doc_id", "pre", "post")
    return a.join(d, "doc_id").where("a < pre AND post < b").groupBy("doc_id").agg(F.count(F.lit(1)).alias("inside"))


@query(f"""SELECT doc_id, CAST(4 * n - 1 AS INTEGER) AS start, CAST(4 * n + 1 AS INTEGER) AS "end", 'passage' AS name, l AS head FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM {base()})""")
def native_outline(spark, sf_dir):
    """Named blocks with the lines they span and their heads."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n", text("@# {l}\nx\n#@"), "\n", lit("\n\n")))
    return documents.outlines(made, TEXTS).where("status = 'ok'").select("doc_id", "start", "end", "name", "head")


@query(f"""SELECT doc_id, 'ok' AS status, md5({cat(lit('@@@!log' + chr(10) + chr(10)), DUCK.join(DUCK.each(text('@{lb}passage{rb} {l}' + chr(10) + 'x @{lb}mark{rb}{l}{lb}mark{rb}@' + chr(10) + '{lb}passage{rb}@' + chr(10), lb="'{'", rb="'}'")), NL))}) AS spelled_md5 FROM {base()} WHERE len(ls) > 0""")
def native_spelled(spark, sf_dir):
    """Elements spelled out by their names."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n", text("@# {l}\nx @:{l}:@\n#@"), "\n", lit("\n\n")))
    return documents.respelled(made.where("length(text) > 12"), None, TEXTS).select("doc_id", "status", F.md5("spelled").alias("spelled_md5"))


_PASSAGES = lambda e: document(e, "@@@!log\n\n", text("@# {l}\nx\n#@"), "\n", lit("\n\n"))
_EACH = f"(SELECT doc_id, unnest(ls) AS l, CAST(generate_subscripts(ls, 1) AS INTEGER) AS n FROM {base()})"


@query(f"SELECT doc_id, 'milestone' AS kind, 'v:' || n AS key, 2 * n + 1 AS line FROM {_EACH}")
def native_points_listed(spark, sf_dir):
    """Coordinates with the lines they stand in."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n", text('@("v:{n}"){l}', n=f"CAST({e.n} AS STRING)"), "\n", lit("\n\n")))
    return documents.points(made, TEXTS).where("status = 'ok'").select("doc_id", "kind", "key", "line")


@query(f"SELECT doc_id, 'p' || n AS key, 6 * n + 1 AS line, 6 * n - 1 AS target FROM {_EACH}")
def native_lookups(spark, sf_dir):
    """References with the line of the anchor that they name."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n", text("@= {l}\nx\n=@(p{n})\n\nsee @=(p{n})", n=f"CAST({e.n} AS STRING)"), "\n", lit("\n\n")))
    return documents.lookups(made, TEXTS).select("doc_id", "key", "line", "target")


@query(f"""SELECT doc_id, 4 * n - 1 AS start, 4 * n + 1 AS "end" FROM {_EACH}""")
def native_folds(spark, sf_dir):
    """Blocks that span lines."""
    return documents.folds(files(spark, sf_dir, "atd", _PASSAGES), TEXTS)


@query(
    f"""SELECT doc_id, 'ok' AS status, md5('.!kaiv' || repeat(chr(10), 2) || 'dialektos=log' || chr(10) || {DUCK.join(DUCK.each(cat(lit(chr(10) + '[/@blocks]' + chr(10) + 'kind=para' + chr(10) + 'symbol=#' + chr(10) + 'name=passage' + chr(10) + 'depth=0' + chr(10) + 'start='), 'CAST(4 * i - 1 AS STRING)', lit(chr(10) + 'end='), 'CAST(4 * i + 1 AS STRING)', lit(chr(10) + 'lemma='), 'l', NL)), "''")}) AS outline_md5 FROM {base()}"""
)
def native_outline_texts(spark, sf_dir):
    """Outlines written as table texts."""
    return documents.outline_texts(files(spark, sf_dir, "atd", _PASSAGES), TEXTS).select("doc_id", "status", F.md5("outline").alias("outline_md5"))


@query(
    f"""SELECT doc_id, kind, n FROM (SELECT doc_id, unnest([{{'kind': 'macro', 'n': 1}}, {{'kind': 'namespace', 'n': 1}}, {{'kind': 'keyword', 'n': len(ls)}}, {{'kind': 'operator', 'n': len(ls)}}, {{'kind': 'variable', 'n': len(ls)}}], recursive := true)
  FROM {base()}) WHERE n > 0"""
)
def native_highlights(spark, sf_dir):
    """Marks of sources by kind: an element that is not defined is an operator, its parameter a variable."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n", text("@^(k) {l} \\@"), "\n", lit("\n\n")))
    found = documents.highlights(made, TEXTS).where("status = 'ok'")
    return found.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, 'ok' AS status, md5({canonical(DUCK, 'litogramma', text('@{lb}annotation{rb}@{lb}лицо{rb}(k){l}{lb}annotation{rb}@' + chr(10), lb="'{'", rb="'}'"))}) AS spelled_md5 FROM {base()}""")
def spelled_in_russian(spark, sf_dir):
    """Elements spelled out in a language in which they have names."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!litogramma\n\n", text("@,@?:(k){l},@"), "\n", lit("\n\n")))
    return documents.respelled(made, "ru").select("doc_id", "status", F.md5("spelled").alias("spelled_md5"))


@query(None)
def subdivided_in_place(spark, sf_dir):
    """Two witnesses of each document cut in step, in place, until nothing between two coordinates has over 80 characters."""
    one = lambda name, word: files(spark, sf_dir, "atd", lambda e: _witness(e, word(e))).withColumn("witness", F.lit(name))
    return documents.subdivided(one("B", _plain).unionByName(one("T", _changed)), None, 80, TEXTS)


# Writers and exports.


def exported(name: str, source: list[str], target: str, head: str, wanted: list[str], tail: str, between: str, extension: str = "md", doc: str = "") -> None:
    """Documents read, carried to the nearest schema that is written so, and written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = documents.export(files(spark, sf_dir, extension, lambda e: document(e, "", turns(e, *source), "\n", lit("\n\n"))), None, target)
        return made.select("doc_id", "status", F.md5("rendered").alias("rendered_md5"))

    run.__name__, run.__doc__ = name, doc or f"Documents written as {target} by the built-in tables."
    QUERIES[name] = run
    shown = document(DUCK, head, turns(DUCK, *wanted), tail, lit(between))
    ORACLE_SQL[name] = f"SELECT doc_id, 'ok' AS status, md5({shown}) AS rendered_md5 FROM {base()}"


_MD = ["# {l}", "> {l}", "- {l}", "so *{l}* ends", "{l}"]
exported("export_markdown", _MD, "md", "", ["# {l}\n", "> {l}\n", "- {l}\n", "so *{l}* ends\n", "{l}\n"], "", "\n")
exported("export_djot", _MD, "dj", "", ["# {l}\n", "> {l}\n", "- {l}\n", "so _{l}_ ends\n", "{l}\n"], "", "\n", doc="Markdown carried to Djot's schema by the mapping that goes both ways, and written.")
exported(
    "export_html",
    _MD,
    "html",
    "<!doctype html>\n<html>\n<body>\n",
    ["<h1>{l}</h1>", "<blockquote>\n<p>{l}</p>\n</blockquote>", "<li><p>{l}</p></li>", "<p>so <em>{l}</em> ends</p>", "<p>{l}</p>"],
    "\n</body>\n</html>",
    "\n",
)
exported("export_org", _MD, "org", "", ["* {l}\n", "#+BEGIN_QUOTE\n{l}\n#+END_QUOTE\n", "- {l}\n", "so /{l}/ ends\n", "{l}\n"], "", "\n", doc="Markdown carried over HTML's schema to Org's, and written.")


def _export_rst() -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = documents.export(files(spark, sf_dir, "md", lambda e: document(e, "", turns(e, *_MD), "\n", lit("\n\n"))), None, "rst")
        return made.select("doc_id", "status", F.md5("rendered").alias("rendered_md5"))

    run.__name__, run.__doc__ = "export_rst", "Markdown carried over HTML's schema to reStructuredText's, and written."
    QUERIES["export_rst"] = run
    shown = document(DUCK, "", turns(DUCK, "{l}\n{rule}\n", "   {l}\n", "- {l}\n", "so *{l}* ends\n", "{l}\n", rule="repeat('=', 60)"), "", lit("\n"))
    ORACLE_SQL["export_rst"] = f"SELECT doc_id, 'ok' AS status, md5({shown}) AS rendered_md5 FROM {base()}"


_export_rst()


def scripture(name: str, target: str, head: str, wanted: list[str], tail: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = ["\\s {l}", "\\p\n\\v {n} {l}", "\\q1 {l}", "\\p {l}"]
        made = files(spark, sf_dir, "usfm", lambda e: document(e, "\\id GEN\n", turns(e, *source), "\n"))
        return documents.export(made, None, target).select("doc_id", "status", F.md5("rendered").alias("rendered_md5"))

    run.__name__, run.__doc__ = name, f"Scripture written as {target}."
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, 'ok' AS status, md5({document(DUCK, head, turns(DUCK, *wanted), tail)}) AS rendered_md5 FROM {base()}"


scripture(
    "export_usx",
    "usx",
    '<?xml version="1.0" encoding="UTF-8"?>\n<usx version="3.0">\n<book code="gen" style="id"/>\n',
    ['<para style="s1">{l}</para>', '<para style="p"><verse number="{n}" style="v"/> {l}</para>', '<para style="q1">{l}</para>\n<para style="b"/>', '<para style="p">{l}</para>'],
    "\n</usx>",
)
scripture(
    "export_osis",
    "osis",
    '<?xml version="1.0" encoding="UTF-8"?>\n<osis xmlns="http://www.bibletechnologies.net/2003/OSIS/namespace">\n<osisText>\n<header/>\n<div type="book" osisID="gen">\n',
    ["<title>{l}</title>", '<p><verse n="{n}"/> {l}</p>', '<lg>\n<l level="1">{l}</l>\n</lg>', "<p>{l}</p>"],
    "\n</div>\n</osisText>\n</osis>",
)
scripture("export_usfm", "usfm", "\\id gen\n", ["\\s1 {l}", "\\p \n\\v {n} {l}", "\\q1 {l}\n\\b", "\\p {l}"], "")


@query(f"""SELECT doc_id, 'ok' AS status, md5({DUCK.join(DUCK.each(cat(lit('@article{k'), 'CAST(i AS STRING)', lit(',' + chr(10) + '  title = {'), 'l', lit('},' + chr(10) + '  year = {1999},' + chr(10) + '}'))), NL)}) AS rendered_md5 FROM {base()}""")
def export_bibliography(spark, sf_dir):
    """Bibliography files read and written: terms go back to the names that such files use."""
    made = files(spark, sf_dir, "bib", lambda e: document(e, "", text('@article(k{n}, title = "{l}", year = 1999)', n=f"CAST({e.n} AS STRING)"), "\n"))
    return documents.export(made, None, "bib").select("doc_id", "status", F.md5("rendered").alias("rendered_md5"))


def literary(name: str, target: str, head: str, wanted: list[str], tail: str, between: str, doc: str) -> None:
    """TEI files to litogramma, and on to a target."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = ["<div><head>{l}</head><p>{l}</p></div>", "<quote><p>{l}</p></quote>", "<list><item>{l}</item></list>", "<p>so <emph>{l}</emph> ends</p>", "<p>{l}</p>"]
        made = files(spark, sf_dir, "tei", lambda e: document(e, "<TEI><text><body>", turns(e, *source), "</body></text></TEI>"))
        return documents.export(made, None, target).select("doc_id", "status", F.md5("rendered").alias("rendered_md5"))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, 'ok' AS status, md5({document(DUCK, head, turns(DUCK, *wanted), tail, lit(between))}) AS rendered_md5 FROM {base()}"


literary(
    "export_literary_html",
    "html",
    "<!doctype html>\n<html>\n<body>\n",
    ["<section>\n<h2>{l}</h2>\n<p>{l}</p>\n</section>", "<blockquote>\n<p>{l}</p>\n</blockquote>", "<ul>\n<li><p>{l}</p></li>\n</ul>", "<p>so <em>{l}</em> ends</p>", "<p>{l}</p>"],
    "\n</body>\n</html>",
    "\n",
    "Literary documents as HTML, by their own table.",
)
literary(
    "export_docbook",
    "docbook",
    '<?xml version="1.0" encoding="UTF-8"?>\n<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.0">\n',
    ["<section>\n<title>{l}</title>\n<para>{l}</para>\n</section>", "<blockquote>\n<para>{l}</para>\n</blockquote>", "<itemizedlist>\n<listitem>\n<para>{l}</para>\n</listitem>\n</itemizedlist>", "<para>so <emphasis>{l}</emphasis> ends</para>", "<para>{l}</para>"],
    "\n</article>",
    "\n",
    "Literary documents carried to DocBook's schema, the nearest that is written so.",
)
literary(
    "export_tei",
    "tei",
    '<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="http://www.tei-c.org/ns/1.0">\n<teiHeader>\n<fileDesc>\n<titleStmt>\n<title/>\n</titleStmt>\n<publicationStmt>\n<p></p>\n</publicationStmt>\n<sourceDesc>\n<p>Written from a document tree.</p>\n</sourceDesc>\n</fileDesc>\n</teiHeader>\n<text>\n<body>\n',
    ['<div type="section">\n<head>{l}</head>\n<p>{l}</p>\n</div>', "<quote>\n<p>{l}</p>\n</quote>", '<list type="bulleted">\n<item>\n<p>{l}</p>\n</item>\n</list>', "<p>so <emph>{l}</emph> ends</p>", "<p>{l}</p>"],
    "\n</body>\n</text>\n</TEI>",
    "\n",
    "Literary documents carried to TEI's schema, and written.",
)
literary("export_gemtext", "gemtext", "", ["## {l}\n\n{l}\n", "> {l}\n", "* {l}\n", "so {l} ends\n", "{l}\n"], "", "\n", "Literary documents as gemtext.")


def round_trip(name: str, target: str, doc: str, source: list[str] | None = None, wanted: list[str] | None = None) -> None:
    """Native source written as bytes of another format and read back: nothing is lost."""
    pieces = source or ["@# {l}\n{l}\n#@", '@"\n{l}\n"@', "so @/{l}/@ and @*{l}*@ end", "{l}"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = documents.write_files(files(spark, sf_dir, "atd", lambda e: document(e, "@@@!litogramma\n\n", turns(e, *pieces), "\n", lit("\n\n"))), target)
        back = documents.canonical(made.selectExpr("doc_id", f"'{target}' AS extension", "content AS text"))
        return back.select("doc_id", "status", F.md5("canonical").alias("canonical_md5"))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    shown = canonical(DUCK, "litogramma", turns(DUCK, *(wanted or [p + "\n" for p in pieces])))
    ORACLE_SQL[name] = f"SELECT doc_id, 'ok' AS status, md5({shown}) AS canonical_md5 FROM {base()}"


round_trip("docx_round_trip", "docx", "Word documents written and read: sections, quotes, strong and emphasis.", ['@"\n{l}\n"@', "so @/{l}/@ and @*{l}*@ end", "@--\n@-\n{l}\n-@\n--@", "{l}", "@# {l}\n{l}\n#@"][:4])
round_trip("fb2_round_trip", "fb2", "E-books written and read.", ['@"\n{l}\n"@', "so @/{l}/@ and @*{l}*@ end", "@~\n{l}\n{l}\n~@", "{l}"])


def _treebank_round_trip(target: str, reads_id: bool) -> None:
    name = f"{target}_round_trip"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = lambda e: document(e, "@@@!litogramma\n\n", _words(e, True), "\n", lit("\n\n"))
        back = documents.rewritten(files(spark, sf_dir, "atd", source), target)
        return back.select("doc_id", "status", F.md5("canonical").alias("canonical_md5"))

    run.__name__, run.__doc__ = name, f"Analysed sentences written as {target} and read back."
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, 'ok' AS status, md5({canonical(DUCK, 'litogramma', cat(_words(DUCK, reads_id), NL))}) AS canonical_md5 FROM {base()}"


def _words(e: Engine, with_id: bool) -> str:
    return cat(lit("@@.@!.("), f"CAST({e.n} AS STRING)", lit(")"), e.words(text("@@.@!=({w})@!/(X)@!%(y){w}.@@", w="w"), "' '"), lit(".@@"))


for _target in ("conllu", "proiel", "opencorpora", "rnc"):
    _treebank_round_trip(_target, True)


@query(
    f"""SELECT doc_id, member, sha256(body) AS sha256 FROM (SELECT doc_id, unnest([{{'member': 'document.atk', 'body': t}}, {{'member': 'media-manifest.json', 'body': '[]'}}], recursive := true)
  FROM (SELECT doc_id, {canonical(DUCK, 'log', text('{l}' + chr(10)))} AS t FROM {base()}))"""
)
def bundle_members(spark, sf_dir):
    """Canonical documents bundled as reproducible archives, and the archives' members."""
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!log\n\n", "l", "\n", lit("\n\n")))
    return documents.bundle_members(documents.bundles(made, TEXTS)).select("doc_id", "member", "sha256")


# Mappings.


@query(f"SELECT doc_id, 'ok' AS status, md5({canonical(DUCK, 'at-html', turns(DUCK, '@#{l}#@' + chr(10), '@>' + chr(10) + '{l}' + chr(10) + '>@' + chr(10), '@-' + chr(10) + '{l}' + chr(10) + '-@' + chr(10), 'so @/{l}/@ ends' + chr(10), '{l}' + chr(10)))}) AS translated_md5 FROM {base()}")
def mapped_by_lineage(spark, sf_dir):
    """Markdown carried to the schema that it inherits from: its own marks of emphasis go back under their old symbols."""
    made = files(spark, sf_dir, "md", lambda e: document(e, "", turns(e, *_MD), "\n", lit("\n\n")))
    return documents.translate(made, "at-html").select("doc_id", "status", F.md5("translated").alias("translated_md5"))


_DEEP = "@@@!quire\n\n@=== part\n@#[(taxis)] [lemma]\ngrammata\n#@\n===@\n\n@=== sub\n@##[(taxis)] [lemma]\ngrammata\n##@\n===@\n\n@=== soft\n@/ grammata /@\n===@\n"
_SHALLOW = "@@@!quire\n\n@=== h1\n@# grammata #@\n===@\n\n@=== h2\n@## grammata ##@\n===@\n\n@=== soft\n@* grammata *@\n===@\n\n@=== gone\n@- grammata -@\n===@\n\n@=== frame\n@_\ngrammata\n_@\n===@\n"
_MAP_TEXTS = {"deep.dia": _DEEP, "flat.dia": _SHALLOW}
_MAP_FILES = {"flat.deep.hom": "@@@!quire-hom\n@=flat=>deep\n\n@># # # .top\n@># ## ##\n@:: * /\n@-- -\n@<< _\n"}


@query(
    f"SELECT doc_id, 'ok' AS status, md5({canonical(DUCK, 'deep', text(chr(10).join(['@# {l}', 'a @/{l}/@  z', '', '@## {l}', '{l}', '##@', '#@.top', '']).replace('  z', ' z')))}) AS translated_md5 FROM {base()}"
)
def mapped_by_rules(spark, sf_dir):
    """Lone headings open regions by rank, and a span is renamed, another dropped, a frame unwrapped."""
    pieces = text("@#{l}#@\n\na @*{l}*@ @-{l}-@z\n\n@##{l}##@\n\n@_\n{l}\n_@")
    made = files(spark, sf_dir, "atd", lambda e: document(e, "@@@!flat\n\n", pieces, "\n", lit("\n\n")))
    return documents.translate(made, "deep", _MAP_TEXTS, _MAP_FILES).select("doc_id", "status", F.md5("translated").alias("translated_md5"))


# Witnesses.



def _witness(e: Engine, word: str) -> str:
    """A line a coordinate; each word is told apart by its number, so that words never repeat within a line."""
    return document(e, "@@@!log\n\n", cat(lit('@("v:'), f"CAST({e.n} AS STRING)", lit('")'), e.words(word, "' '")), "\n", lit("\n\n"))


def _plain(e: Engine) -> str:
    return f"w || CAST({e.word_no} AS STRING)"


def _changed(e: Engine) -> str:
    """Every seventh word reads otherwise."""
    return f"CASE WHEN {e.word_no} % 7 = 3 THEN 'zz' ELSE w END || CAST({e.word_no} AS STRING)"


def _slices(spark, sf_dir):
    one = lambda name, word: files(spark, sf_dir, "atd", lambda e: _witness(e, word(e))).withColumn("witness", F.lit(name))
    made = one("B", _plain).unionByName(one("T", _changed))
    return documents.slices(made, "v", TEXTS).where("error IS NULL AND coord IS NOT NULL")


@query(f"SELECT doc_id AS work, 'B' AS witness, CAST(n AS STRING) AS coord, {DUCK.words(_plain(DUCK), chr(39) + ' ' + chr(39))} AS text FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM {base()})")
def document_slices(spark, sf_dir):
    """Documents cut at their coordinates."""
    return _slices(spark, sf_dir).where("witness = 'B'").select("work", "witness", "coord", "text")


@query(
    f"""SELECT CAST(doc_id AS STRING) AS work, CAST(n AS STRING) AS coord, j AS place,
  CAST(n AS STRING) || ' ' || w || CAST(j AS STRING) || ' B : zz' || CAST(j AS STRING) || ' T' AS text
FROM (SELECT doc_id, n, unnest(ws) AS w, CAST(generate_subscripts(ws, 1) AS INTEGER) AS j FROM (SELECT doc_id, string_split(l, ' ') AS ws, n FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM {base()})))
WHERE j % 7 = 3 AND w <> 'zz'"""
)
def document_collation(spark, sf_dir):
    """Witnesses of one work compared word by word: each changed word is a note after it."""
    from quire.operators import witnesses

    return witnesses.collate(_slices(spark, sf_dir), "B").select("work", "coord", "place", "text")


@query(f"""SELECT CAST(doc_id AS STRING) AS work, CAST(n AS STRING) AS coord, CAST(n - 1 AS INTEGER) AS "rank" FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n FROM {base()})""")
def document_order(spark, sf_dir):
    """The order of coordinates that agrees with every witness."""
    from quire.operators import witnesses

    return witnesses.aligned_order(_slices(spark, sf_dir)).where("error IS NULL").select("work", "coord", "rank")


@query(f"SELECT CAST(doc_id AS STRING) AS work, CAST(n AS STRING) AS coord, unnest(['B', 'T']) AS witness FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n FROM {base()})")
def document_weave(spark, sf_dir):
    """Slices of both witnesses side by side at their coordinates."""
    from quire.operators import witnesses

    return witnesses.weave(_slices(spark, sf_dir)).select("work", "coord", "witness")


@query(
    f"""SELECT doc_id, sent, CAST(j AS INTEGER) AS tok, w AS form, w AS lemma, 'X' AS pos, CASE WHEN j > 1 THEN CAST(j - 1 AS INTEGER) END AS head FROM (
  SELECT doc_id, CAST(n - 1 AS INTEGER) AS sent, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM (SELECT doc_id, string_split(l, ' ') AS ws, n FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM {base()})))"""
)
def document_tokens(spark, sf_dir):
    """Analysed words of documents as rows, each headed by the one before it."""
    tab = "chr(9)"
    row = lambda e: f" || {tab} || ".join([f"CAST({e.word_no} AS STRING)", "w", "w", "'X'", "'_'", "'_'", f"CAST({e.word_no} - 1 AS STRING)", "'dep'", "'_'", "'_'"])
    made = files(spark, sf_dir, "conllu", lambda e: document(e, "", cat(e.words(row(e), NL), NL), "\n"))
    return documents.tokens(made).where("status = 'ok' AND tok IS NOT NULL").select("doc_id", "sent", "tok", "form", "lemma", "pos", "head")


# Schemas.


@query(
    """SELECT n_regionkey + 1 AS doc_id, name, symbol, form FROM (
  SELECT n_regionkey, translate(lower(n_name), ' _', '--') AS name, repeat('%', CAST(k AS INTEGER)) AS symbol, CASE WHEN k % 3 = 0 THEN 'void' WHEN k % 3 = 1 THEN 'span' ELSE 'block' END AS form
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation))
UNION ALL SELECT r_regionkey + 1, 'base', '+', 'span' FROM region"""
)
def schema_elements(spark, sf_dir):
    """Definitions with a parent, read and resolved: a region's nations as elements of three forms."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    shown = "concat('@=== ', translate(lower(x.n_name), ' _', '--'), '\\n', CASE (k + 1) % 3 WHEN 1 THEN concat('@', repeat('%', k + 1), ' grammata ', repeat('%', k + 1), '@') WHEN 2 THEN concat('@', repeat('%', k + 1), '\\ngrammata\\n', repeat('%', k + 1), '@') ELSE concat('@', repeat('%', k + 1), '(key)') END, '\\n===@\\n')"
    by = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("xs"))
    made = by.selectExpr("CAST(n_regionkey + 1 AS BIGINT) AS doc_id", "'dia' AS extension", f"concat('@@@!quire\\n\\n@@::parent\\n\\n', array_join(transform(xs, (x, k) -> {shown}), '\\n')) AS text")
    found = documents.definitions(made, {"parent.dia": "@@@!quire\n\n@=== base\n@+ grammata +@\n===@\n"})
    return found.where("status = 'ok'").select("doc_id", "name", "symbol", "form")
