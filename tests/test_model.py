"""The document model: golden texts, errors and laws."""

import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import alignment
from quire.model.canon import canonicalize
from quire.model.essence import essence
from quire.model.markup import parse
from quire.model.schema import Catalog, read_localized, write_definition
from quire.model.tree import DocumentError, encode
from quire.model.writer import write
from quire.sources import corpora, html, markdown

SCHEMA = """@@@!quire

@=== passage
@# lemma
grammata
#@
@"a passage under a heading"@
===@

@=== exhibit
@=[(taxis)] lemma
grammata
=@
===@

@=== legend
@: grammata :@
===@

@=== cited
@< grammata <@
===@

@=== see
@^(param)
===@

@=== song
@~ [lemma]
stichos
~@ [hypograph]
===@
"""
SOURCE = """#!/usr/bin/env tool
\\\\\\!harbour

\\\\/ not for readers

\\# Low water
The pier\tstands   dry
at noon, as \\^(the-gauge) shows. Write
(to pilot@example.com).
#\\(noon).daily

\\=() The gauge
\\\\\\\\(gauge.svg)
\\:Marks in feet.:\\
=\\(the-gauge).drawing

\\\\\\+(log.txt)
"""
#: Fixed by the format: the source above in canonical form.
CANONICAL = """@@@!harbour

@# Low water
The pier stands dry at noon, as @^(o1) shows. Write (to pilot\\@example.com).
#@.daily

@=(1) The gauge
@@@@(media/m1.svg)
@:Marks in feet.:@
=@(o1).drawing

@@@"
ebb -> flood
"@@@
"""


def catalog(**texts):
    return Catalog({"harbour.lektos": SCHEMA, "log.txt": "ebb -> flood\n", **texts})


def svg(name):
    return b"<svg/>"


def test_canonical_form_and_media():
    made = canonicalize(SOURCE, catalog(), media=svg)
    assert made.text == CANONICAL
    assert made.media == [("m1.svg", "gauge.svg", hashlib.sha256(b"<svg/>").hexdigest())]
    assert canonicalize(made.text, catalog(), media=svg).text == made.text


def test_content_id_drops_metadata():
    made = canonicalize(SOURCE, catalog(), media=svg)
    text, digest = essence(made.document, catalog(), svg)
    assert "as shows. Write" in text and "daily" not in text and "[SHA256:" in text
    assert digest == hashlib.sha256(text.encode()).hexdigest()
    plain = canonicalize(SOURCE.replace(".daily", "").replace("(noon)", ""), catalog(), media=svg)
    assert essence(plain.document, catalog(), svg)[1] == digest


BODY = "@@@!harbour\n\n"


@pytest.mark.parametrize(
    "text, kind",
    [
        ("plain", "MissingDeclaration"),
        ("@@@!nowhere\n", "UnresolvableDialektos"),
        (BODY + "@@@@@\n", "SigilRunTooLong"),
        (BODY + "@%x%@\n", "UndefinedSim"),
        (BODY + "a @:b\n", "UnmatchedSim"),
        (BODY + "@# x\ny\n", "UnmatchedSim"),
        (BODY + "a @#b\n", "EndoMimicsPara"),
        (BODY + "a @^(b c)\n", "MonosimWhitespace"),
        (BODY + "a @(b--c)\n", "InvalidOnym"),
        (BODY + "a @:b:@.Bad\n", "InvalidGenos"),
        (BODY + "@@@(:m:)\n", "AxiomaBeforeDefinition"),
        (BODY + "a @=(nope)\n", "DeixisUndefinedOnym"),
        (BODY + "a @=(x)\n\n@# h\nb\n#@(x)\n", "DeixisTargetMismatch"),
        (BODY + "a @@@(x)\n", "AnaphorInEndoContext"),
        (BODY + "@@@+(gone.txt)\n", "MissingResource"),
        (BODY + "@@@(self.atd)\n", "TransclusionCycle"),
        (BODY + "@#\nx\n#@\n", "ComponentViolation"),
        (BODY + "@=(2) a\n=@\n", "TaxisInconsistent"),
        (BODY + '@("s:1") a @("s:1")\n', "Syntax"),
        (BODY + "a\\@@:b:@ @@.c\\.@@\n", None),
    ],
)
def test_errors(text, kind):
    cat = catalog(**{"self.atd": BODY + "@@@(self.atd)\n"})
    if kind is None:
        canonicalize(text, cat)
        return
    with pytest.raises(DocumentError) as e:
        canonicalize(text, cat)
    assert e.value.kind == kind


def test_schema_inheritance_and_order():
    base = "\\\\\\!quire\n\n\\=== zeta\n\\! grammata !\\\n===\\\n\n\\=== aside\n\\< grammata <\\\n===\\\n"
    child = "@@@!quire\n\n@@::base\n\n@@::base::! ?\n\n@=== mid\n@- grammata -@\n===@\n"
    cat = Catalog({"base.dia": base, "child.dia": child})
    text = write_definition(cat.schema("child"))
    assert [x[5:] for x in text.split("\n") if x.startswith("@=== ")] == ["aside", "mid", "zeta", "zeta"]
    assert "@< grammata <@" in text and text.index("@! grammata") < text.index("@? grammata")
    assert write_definition(Catalog({"c.dia": text}).schema("c")) == text
    for bad in ("@@::base\n\n@@::base\n", "@==% v\na: x\nb: x\n%==@\n", "@=== e\n@& lemma=v\ngrammata\n&@\n===@\n", "junk\n"):
        with pytest.raises(DocumentError):
            Catalog({"base.dia": base, "x.dia": "@@@!quire\n\n" + bad}).schema("x")
    assert read_localized("@@@=at-x=>ru\n\n! имя\n? другое\n")[2] == {"!": "имя", "?": "другое"}


def test_vocabularies_cannot_fork_the_id():
    dia = "@@@!quire\n\n@=== entry\n@& lemma\ngrammata\n&@\n@% genera\n===@\n\n@=== field\n@: lemma=campi\ngrammata\n:@\n===@\n\n@==% genera\nliber: tome bok\n%==@\n\n@==% campi\nauctor: writer skribent\n%==@\n"
    cat = Catalog({"shelf.dia": dia})
    one, two = (canonicalize(f"@@@!shelf\n\n@& k1\n@: {w}\nIda Lund\n:@\n&@.{c}\n", cat) for w, c in (("skribent", "bok"), ("Writer", "tome")))
    assert one.text == two.text and "@: auctor" in one.text and "&@.liber" in one.text
    assert essence(one.document, cat) == essence(two.document, cat) and "&@.liber" in essence(one.document, cat)[0]


LEX = "@@@!quire\n\n@=== entry\n@![(taxis)] lemma\nautonym\ngrammata\n!@\n===@\n"


def test_auto_anchors():
    cat = Catalog({"lex.dia": LEX})
    text = "@@@!lex\n\n@! θάλασσα\none.\n!@\n\n@!(1) ebb tide\na.\n!@\n\n@!(2) ebb tide\nb.\n!@\n\n@!() gull\nc.\n!@\n"
    made = canonicalize(text, cat)
    assert "(θάλασσα)" in made.text and "(ebb-tide-2)" in made.text and "(gull-1)" in made.text
    assert canonicalize(made.text, cat).text == made.text
    for bad, told in (("@! a\nx\n!@\n\n@! a\ny\n!@", "duplicate onym"), ("@! a\nx\n!@(b)", "contradicts"), ("@! a\nx\n!@\n\n@!(2) a\ny\n!@", "must all carry a taxis"), ("@!(1) a\nx\n!@\n\n@!(3) a\ny\n!@", "1..n")):
        with pytest.raises(DocumentError, match=told):
            canonicalize(f"@@@!lex\n\n{bad}\n", cat)


def test_table_forms_agree():
    cat = Catalog()
    short = "@@@!at-html\n\n@+\n| a | b @!c!@ |\n|---+---|\n| d |\n+@\n"
    made = canonicalize(short, cat)
    assert made.text.count("@+:\n") == 4 and "@+=\n" in made.text
    assert canonicalize(made.text, cat).text == made.text
    with pytest.raises(DocumentError, match="exceed"):
        canonicalize("@@@!at-html\n\n@+\n| a |\n|---|\n| d | e |\n+@\n", cat)


def test_macros_and_copies():
    text = BODY + "@@@:\none @:two:@\n:@@@(m)\n\n@@@(:m:)\n\n@@:in:@@(w) a @@(:w:) b @@+(:w:)\n\n@@@+(:m:)\n\n@@@+(:late:)\n\n@# h\nx\n#@(late)\n"
    out = canonicalize(text, catalog()).text
    assert out.startswith(BODY + "one @:two:@\n\na in b @@\"in\"@@\n\n@@@\"\none @:two:@\n\"@@@\n")
    assert "@# h\nx\n#@" in out


def test_verse_keeps_its_white_space():
    text = BODY + "@~ Head\n  two  spaces @@/ gone\n\n\nnext\n~@ tail\n"
    assert canonicalize(text, catalog()).text == BODY + "@~ Head\n  two  spaces\n\nnext\n~@ tail\n"


pieces = st.lists(st.sampled_from(["a", " ", "b|", "\\", "\\@", "@:", ":@", "@<", "<@", "@@.", ".@@", ".x", "(o)", "|", "@^(p)", '@@"', '"@@', "(", "\n", "@(k)", "@\"", "-", ".", "Q"]), max_size=14)


@given(pieces)
@settings(max_examples=500, deadline=None)
def test_written_trees_parse_back(parts):
    cat = catalog()
    try:
        made = canonicalize(BODY + "x" + "".join(parts) + "\n", cat)
    except DocumentError:
        return
    assert write(parse(made.text, cat)) == made.text
    assert canonicalize(made.text, cat).text == made.text


def test_intervals_nest():
    rows = list(encode(1, parse(CANONICAL, catalog())))
    by = {r[1]: r for r in rows}
    for r in rows:
        assert r[1] < r[2]
        if r[3]:
            assert by[r[3]][1] < r[1] and r[2] < by[r[3]][2] and by[r[3]][4] == r[4] - 1
    assert sorted(x for r in rows for x in (r[1], r[2])) == list(range(1, 2 * len(rows) + 1))


MD = "# Moorings\n\nRopes of *hemp*, **wire**, and `nylon`.\n\n> Mind the swell.\n>\n> Twice.\n\n- bow\n- stern *last*\n\n1. haul\n2. belay\n\n```sql\nSELECT 1\n```\n"
MD_NATIVE = '@@@!at-markdown\n\n@#Moorings#@\n\nRopes of @*hemp*@, @**wire**@, and @@"nylon"@@.\n\n@>\nMind the swell.\n\nTwice.\n>@\n\n@-\nbow\n-@\n\n@-\nstern @*last*@\n-@\n\n@.(1)\nhaul\n.@\n\n@.(2)\nbelay\n.@\n\n@@@"\nSELECT 1\n"@@@.sql\n'


def test_markdown():
    assert write(markdown.read(MD)) == MD_NATIVE
    assert canonicalize(MD_NATIVE, Catalog()).text == MD_NATIVE
    note = write(markdown.read("A[^n] <http://x.y> [t](http://u) ***b***\n\n[^n]: body\n    more\n\n![](i.png)\n"))
    assert note == "@@@!at-markdown\n\nA@^(n) @><http://x.y><@ t (@><http://u><@) @*@**b**@*@\n\n@^\nbody more\n^@(n)\n@@@@(i.png)\n"


def test_unclosed_marks_are_fast():
    began = time.time()
    for mark in ("*", "[", "`", "<", "**", "***", "[^"):
        markdown.read((mark + "a ") * 10_000)
    assert time.time() - began < 5


def test_stars():
    shown = lambda s: write(markdown.read(s)).split("\n")[2]
    assert shown("a *b **c** d* e") == "a @*b @**c**@ d*@ e"
    assert shown("***b***") == "@*@**b**@*@" and shown("*a b") == "*a b" and shown("2 * 3 * 4") == "2 * 3 * 4"


def test_html():
    doc = write(html.read("<html><head><title>t</title></head><body><h1>A &amp; b</h1><p>x <em>y</em> <a href='http://u'>t</a></p><ul><li>i</li></ul><ol><li>j</li></ol><pre>c\n</pre><img src='m.png'></body></html>"))
    assert "@#A & b#@" in doc and "x @/y/@ t (@><http://u><@)" in doc and "@--\n@-\ni\n-@\n--@" in doc and "@..\n@.(1)\nj\n.@\n..@" in doc
    for bad in ("<nav></nav>", "text", "<p><video></video></p>", "<div>"):
        with pytest.raises(DocumentError):
            html.read(bad)


def test_bibtex():
    doc = corpora.read_bibtex('@article{k1, author = {A {B} C}, title = "T" # { U},\n year = 1999}\n@comment{x}\n@book(k2, title={V})')
    assert [(b.head[0].text, b.classes, [(f.head[0].text, f.body[0].body[0].text) for f in b.body]) for b in doc.blocks] == [("k1", ["article"], [("author", "A B C"), ("title", "TU"), ("year", "1999")]), ("k2", ["book"], [("title", "V")])]
    with pytest.raises(DocumentError):
        corpora.read_bibtex('@string{a = "b"}')


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=300, deadline=None)
def test_hunks_rebuild_the_other_text(a, b):
    hunks = alignment.word_hunks(a, b)
    out, at, kept = [], 0, 0
    for start, end, variant in hunks:
        out += a[at:start] + variant
        kept += start - at
        at = end
    assert out + a[at:] == b and kept + len(a) - at == plain_lcs(a, b)


def test_merged_order():
    assert alignment.merged_order([["a", "b", "d"], ["b", "c", "d"]]) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="disagree on coordinate order"):
        alignment.merged_order([["a", "b"], ["b", "a"]])


def sentences(n, stem):
    return " ".join(f"{stem} reading {i} of the gauge, taken at slack water." for i in range(1, n + 1))


def test_cut_plans_are_binary_and_in_step():
    plans = alignment.plan_cuts([sentences(8, "Morning"), sentences(8, "Abend")], 120)
    labels = [[p for p, _ in plan] for plan in plans]
    assert labels[0] == labels[1] and {"1", "0.1", "1.1"} <= set(labels[0])
    text = sentences(8, "Morning")
    assert all(text[at:].startswith("Morning") for _, at in plans[0])
    rounds = alignment.subdivide([("A", sentences(4, "One")), ("B", sentences(4, "Eins"))], 60)
    assert len(rounds) == 4 and all(t.startswith(("One", "Eins")) for r in rounds for _, t in r)


def test_apparatus_text():
    base, one, two = "a small grey boat drifts".split(), "a small blue boat drifts".split(), "a small grey boat".split()
    notes = alignment.apparatus("1a", "B", base, [("T", *h) for h in alignment.word_hunks(base, one)] + [("W", *h) for h in alignment.word_hunks(base, two)])
    assert notes == [(3, "app-1a-1", "1a grey B : blue T"), (5, "app-1a-2", "1a drifts B : om. W")]
    base = "past the old pier today".split()
    assert alignment.apparatus("1b", "B", base, [("T", *h) for h in alignment.word_hunks(base, "so past the old pier lamp today".split())]) == [(4, "app-1b-1", "1b post pier add. lamp T")]


def test_archive_is_reproducible():
    import gzip
    import io
    import tarfile

    from quire.model.bundle import archive, check_any, is_definition

    made = canonicalize(SOURCE, catalog(), media=svg)
    one, two = archive(made, "noon.atk", svg), archive(canonicalize(SOURCE, catalog(), media=svg), "noon.atk", svg)
    assert one == two
    tar = tarfile.open(fileobj=io.BytesIO(gzip.decompress(one)))
    assert tar.getnames() == ["noon.atk", "media-manifest.json", "media/m1.svg"] and {m.mtime for m in tar} == {0}
    assert tar.extractfile("noon.atk").read().decode() == made.text
    assert is_definition(SCHEMA) and is_definition("#!x\n@@@!quire@0.1\n") and not is_definition(SOURCE)
    assert set(check_any(SCHEMA, "harbour", catalog()).elements) == {"#", "=", ":", "<", "^", "~"}


def test_order_only():
    from quire.model.canon import order_only

    cat = Catalog({"lex.dia": LEX})
    doc = order_only(parse("@@@!lex\n\n@!() a\nx @(k)\n!@\n\n@!() a\ny\n!@\n", cat), cat)
    assert write(doc) == "@@@!lex\n\n@!(1) a\nx @(k)\n!@(a-1)\n\n@!(2) a\ny\n!@(a-2)\n"
