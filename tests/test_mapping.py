"""Mappings: checks, routes, fusion, regions."""

import pytest

from quire.model.mapping import Atlas, apply, apply_route, compose, read_mapping, write_mapping
from quire.model.markup import parse
from quire.model.schema import KEYWORD, Catalog
from quire.model.tree import DocumentError
from quire.model.writer import write
from quire.sources import markdown

FLAT = "@@@!quire\n\n@=== h1\n@# grammata #@\n===@\n\n@=== h2\n@## grammata ##@\n===@\n\n@=== em\n@* grammata *@\n===@\n"
DEEP = "@@@!quire\n\n@=== sec\n@#[(taxis)] [lemma]\ngrammata\n#@\n===@\n\n@=== sub\n@##[(taxis)] [lemma]\ngrammata\n##@\n===@\n\n@=== em\n@/ grammata /@\n===@\n"
TWIN = FLAT.replace("*", "_")
FILES = {
    "flat.deep.hom": "@@@!quire-hom\n@=flat=>deep\n\n@># # # .top\n@># ## ##\n@:: * /\n",
    "deep.flat.hom": "@@@!quire-hom\n@=deep=>flat\n@<# # #\n@<# ## ##\n@:: / *\n",
    "flat.twin.iso": "@@@!quire-iso\n@=flat<=>twin\n@:: * _\n",
}


def atlas(**more):
    cat = Catalog({"flat.dia": FLAT, "deep.dia": DEEP, "twin.dia": TWIN}, library={})
    return Atlas(cat, {**FILES, **more})


TEXT = "@@@!flat\n\nlead\n\n@#One#@\n\na @*b*@\n\n@##Two##@\n\nc\n\n@#Three#@\n\nd\n"


def test_regions_nest_by_rank():
    a = atlas()
    out = apply_route(parse(TEXT, a.catalog), a.route("flat", "deep"), a.catalog)
    assert write(out) == "@@@!deep\n\nlead\n\n@# One\na @/b/@\n\n@## Two\nc\n##@\n#@.top\n\n@# Three\nd\n#@.top\n"
    assert write(apply_route(out, a.route("deep", "flat"), a.catalog)) == TEXT


def test_reversed_and_fused_routes_agree():
    a = atlas()
    back = a.route("twin", "flat")
    doc = parse(TEXT.replace("!flat", "!twin").replace("*", "_"), a.catalog)
    assert write(apply_route(doc, back, a.catalog)) == TEXT
    there = [*back, *a.route("flat", "twin")]
    assert compose(*there).only_renames() and write(apply_route(doc, there, a.catalog)) == write(apply_route(doc, there, a.catalog, fuse=False)) == write(doc)
    assert compose(back[0], a.route("flat", "deep")[0]) is None


def test_rules_are_checked_before_documents():
    cat = atlas().catalog
    head = "@@@!quire-hom\n@=flat=>deep\n"
    for rules, kind in (("@:: * #\n", "InvalidMorph"), ("@:: * /\n", "MorphIncomplete"), ("@:: ? /\n", "InvalidMorph"), ("junk\n", "InvalidMorph"), ("@-- #\n@-- #\n", "InvalidMorph")):
        with pytest.raises(DocumentError) as e:
            read_mapping(head + rules, cat)
        assert e.value.kind == kind
    with pytest.raises(DocumentError):
        read_mapping("@@@!quire-iso\n@=flat<=>twin\n@-- *\n", cat)


def test_routes():
    a = atlas()
    assert [m.target.id for m in a.route("twin", "deep")] == ["flat", "deep"]
    with pytest.raises(DocumentError) as e:
        a.route("deep", "nowhere")
    assert e.value.kind == "UnresolvableMorph"
    other = atlas(**{"twin.mid.hom": "x", "mid.deep.hom": "x"})
    other.catalog.texts["mid.dia"] = TWIN
    other.files["twin.mid.hom"] = "@@@!quire-hom\n@=twin=>mid\n"
    other.files["mid.deep.hom"] = "@@@!quire-hom\n@=mid=>deep\n@-- #\n@-- ##\n@:: _ /\n"
    with pytest.raises(DocumentError) as e:
        other.route("twin", "deep")
    assert e.value.kind == "AmbiguousMorphRoute"


def test_lineage_implies_an_embedding():
    a = Atlas(Catalog(), {})
    (m,) = a.route("at-markdown", "at-html")
    doc = markdown.read("# T\n\na *b* **c**\n\n> q\n")
    assert write(apply(doc, m, a.catalog)) == "@@@!at-html\n\n@#T#@\n\na @/b/@ @!c!@\n\n@>\nq\n>@\n"
    with pytest.raises(DocumentError) as e:
        apply(markdown.read("a[^n]\n\n[^n]: b\n"), m, a.catalog)
    assert e.value.kind == "MorphUnmapped"


def test_normal_form():
    a = atlas()
    m = a.direct("flat", "deep")
    text = write_mapping(m)
    assert text == f"@@@!{KEYWORD}-hom\n@=flat=>deep\n\n@># # # .top\n@># ## ##\n@:: * /\n"
    assert write_mapping(read_mapping(text, a.catalog)) == text
