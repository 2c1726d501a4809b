"""Rule tables: patterns, templates, specificity, inheritance, placement."""

import pytest

from quire.model.canon import canonicalize
from quire.model.rendering import hang, inherit, read_pattern, read_rules, render
from quire.model.schema import Catalog
from quire.model.tree import DocumentError

DIA = "@@@!quire\n\n@=== section\n@# lemma\ngrammata\n#@\n===@\n\n@=== figure\n@=[(taxis)] [lemma]\ngrammata\n=@\n===@\n\n@=== em\n@: grammata :@\n===@\n\n@=== ref\n@^(param)\n===@\n\n@=== width\n@>(width)\n===@\n\n@=== table\n@+ [lemma]\nstichos\n+@\n===@\n"
HTML = """@@@!quire-exo
@=doc=>html

@%
& &amp;
< &lt;
%@

@-> *document
<body@[ class="@(genoses)"]@>
@(grammata)
</body>
>-@

@-> *paragraph
<p>@(grammata)</p>
>-@

@-> *paragraph in =
<figcaption>@(grammata)</figcaption>
>-@

@-> #
<section@[ class="@(genoses)"]@>
<h1>@(lemma)</h1>
@(grammata:  )
</section>
>-@

@-> #.big
<section id="@(onym)">@(lemma)@(grammata)</section>
>-@

@-> #(Note)
<aside>@(grammata)</aside>
>-@

@-> =
<figure@[ n="@(taxis)"]@@[ width="@(width)"]@>@(grammata)</figure>
>-@

@-> :
<em>@(grammata)</em>
>-@

@-> *solo :
<h2>@(grammata)</h2>
>-@

@-> ^
<a href="#@(param)">\\@</a>
>-@

@-> *deixis =
<a href="#@(onym)"/>
>-@

@-> *milestone
[@(scheme):@(value)]
>-@

@-> *milestone line
{@(value)}
>-@

@-> *media
<img src="@((param))"/>
>-@

@-> *verbatim
<pre>@(content)</pre>
>-@

@-> *verbatim-inline
<code>@((content))</code>
>-@

@-> +
<table>@(grammata)</table>
>-@

@-> *row + |
<tr>@(cells)</tr>
>-@

@-> *cell +
<td>@(grammata)</td>
>-@

@-> *cell +.header
<th>@(grammata)</th>
>-@
"""
CAT = Catalog({"doc.dia": DIA, "heir.dia": "@@@!quire\n\n@@::doc:-:[:]\n\n@@::doc::: ~\n"}, library={})


def shown(body, rules=HTML):
    doc = canonicalize("@@@!doc\n\n" + body, CAT).document
    return render(doc, read_rules(rules, CAT.schema("doc")))[0]


def test_rendering():
    out = shown('@# A & B\na @:x < y:@ @@"<&>"@@ @("p:1")@("line:2") see @=(f)\n\nb\n#@.wide\n\n@=(1)\n@>(30)\ncap @^(f)\n=@(f)\n\n@:alone:@\n\n@@@"\n<\n"@@@\n\n@@@@(a&b.png)\n')
    assert out == (
        '<body class="wide">\n<section class="wide">\n<h1>A &amp; B</h1>\n<p>a <em>x &lt; y</em> <code><&></code> [p:1]{2} see <a href="#o1"/></p>\n  <p>b</p>\n</section>\n'
        '<figure n="1" width="30"><figcaption>cap <a href="#o1">@</a></figcaption></figure>\n<h2>alone</h2>\n<pre>&lt;\n</pre>\n<img src="a&b.png"/>\n</body>'
    )


def test_most_specific_rule_wins():
    assert shown("@# A\nb\n#@.big").startswith('<body class="big">\n<section id="">A<p>b</p>')
    assert "<aside><p>b</p></aside>" in shown("@# Note\nb\n#@")
    tied = HTML + "\n@-> #.other\nx\n>-@\n"
    with pytest.raises(DocumentError) as e:
        shown("@# A\nb\n#@.big.other", tied)
    assert e.value.kind == "ExoAmbiguous"


def test_rows_and_headers():
    assert "<table><tr><th>a</th><th>b</th></tr>\n<tr><td>c</td><td>d</td></tr></table>" in shown("@+\na | b\n--|--\nc | d\n+@\n")


def test_missing_and_malformed_rules():
    with pytest.raises(DocumentError) as e:
        shown("@@@.\nx\n.@@@.k\n\n@(here) a @^(here)\n")
    assert e.value.kind == "ExoUnhandled"
    for bad in ("junk\n", "@-> #\nx\n>-@\n\n@-> #\ny\n>-@\n", "@-> *nothing\nx\n>-@\n", "@-> #\n@(nope)\n>-@\n", "@-> #\n@[x]@\n>-@\n", "@-> #\n@(?taxis)\n>-@\n", "@-> #\nx\n"):
        with pytest.raises(DocumentError):
            read_rules("@@@!quire-exo\n@=doc=>html\n" + bad, CAT.schema("doc"))
    assert read_pattern("= in #.a.b".replace(".a.b", ""), CAT.schema("doc"))[0] == ("within", "=", "#")


def test_rules_follow_the_lineage():
    tables = {"doc.html": read_rules(HTML, CAT.schema("doc")), "heir.html": read_rules("@@@!quire-exo\n@=heir=>html\n\n@-> *paragraph\n<div>@(grammata)</div>\n>-@\n", CAT.schema("heir"))}
    rules = inherit(tables, CAT.schema("heir"), CAT, "html")
    doc = canonicalize("@@@!heir\n\na @~b~@ <\n", CAT).document
    assert render(doc, rules)[0] == "<body>\n<div>a <em>b</em> &lt;</div>\n</body>"
    assert ("element", ":", "") not in rules.rules


def test_embedded_parts_are_placed_or_go_beside():
    inner = read_rules("@@@!quire-exo\n@=meta=>html\n\n@-> *paragraph\n(@(grammata))\n>-@\n", CAT.schema("doc"))
    cat = Catalog({"doc.dia": DIA, "meta.dia": "@@@!quire\n"}, library={})
    doc = canonicalize("@@@!doc\n\nx\n\n@@@!(meta)\ny\n!@@@\n", cat).document
    base = "@@@!quire-exo\n@=doc=>html\n\n@-> *paragraph\n@(grammata)\n>-@\n\n@-> *englossis\n<@(dialect)>@(grammata)\n>-@\n"
    assert render(doc, read_rules(base, cat.schema("doc")), lambda a, b: inner)[0] == "x\n<meta>(y)"
    put = read_rules(base + "\n@-> *document\n@(!meta)|@(grammata)\n>-@\n", cat.schema("doc"))
    assert render(doc, put, lambda a, b: inner)[0] == "<meta>(y)|x"
    aside = read_rules(base.replace("html\n\n", "html\n@+meta=>side\n\n", 1), cat.schema("doc"))
    assert render(doc, aside, lambda a, b: inner) == ("x\n<meta>", [("meta", "side", "(y)")])


def test_hanging_prefix():
    assert [hang(x, "> ") for x in ("a\nb\n", "a\n\nb\n", "a", "a\n")] == ["a\n> b\n", "a\n>\n> b\n", "a", "a\n"]
