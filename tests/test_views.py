"""Slices, weaving, outlines, spelling, and the stream."""

import datetime

import pytest

from quire.model.markup import parse
from quire.model.canon import canonicalize
from quire.model.schema import Catalog
from quire.model.slicing import slices, weave, words
from quire.model.tree import DocumentError
from quire.model.views import outline, points, spelled, unresolved_labels
from quire.model.writer import blocks, write

DIA = "@@@!quire\n\n@=== section\n@# [lemma]\ngrammata\n#@ [hypograph]\n===@\n\n@=== em\n@: grammata :@\n===@\n\n@=== poem\n@~ [lemma]\nstichos\n~@ [hypograph]\n===@\n\n@=== label\n@! grammata !@\n===@\n"
CAT = Catalog({"doc.dia": DIA}, library={})


def doc(body):
    return parse("@@@!doc\n\n" + body, CAT)


def cut(body):
    return [(s.point and s.point.text, blocks(s.nodes)) for s in slices(doc(body).blocks, "v")]


def test_slices():
    assert cut('a @("v:1")b @:c @("v:2")d:@(k) @("w:9")e\n') == [(None, "a \n"), ("1", "b @:c :@(k)\n"), ("2", '@:d:@ @("w:9")e\n')]
    assert cut('@# h\n@("v:1")a\n\nb @("v:2")c\n#@(x).k tail\n') == [(None, ""), ("1", "@# h\na\n\nb \n#@(x).k\n"), ("2", "c\n\ntail\n")]
    assert cut('@~ h\none @("v:1")two\n\nthree\n~@(x).k t\n') == [(None, "@~ h\none \n~@(x).k\n"), ("1", "@~\ntwo\n\nthree\n~@.k t\n")]
    assert cut('@@@.\na\n\n@("v:1")b\n.@@@(x).k\n') == [(None, "@@@.\na\n.@@@(x).k\n"), ("1", "@@@.\nb\n.@@@.k\n")]
    assert words(doc("a@:b:@c d\n").blocks) == ["a", "b", "c", "d"]


def test_weave():
    one, two = doc('p\n\n@("v:1")a @("v:2")b\n'), doc('@("v:1")A @("v:3")C\n')
    assert write(weave([("x", one), ("y", two)], "v")) == '@@@!doc\n\n@@@.\np\n.@@@.zyg-x\n\n@("v:1")\n\n@@@.\na \n.@@@.zyg-x\n\n@@@.\nA \n.@@@.zyg-y\n\n@("v:2")\n\n@@@.\nb\n.@@@.zyg-x\n\n@("v:3")\n\n@@@.\nC\n.@@@.zyg-y\n'
    for bad in ([("x", one)], [("x", one), ("x", two)], [("x", one), ("Y", two)], [("x", one), ("y", doc('@("v:2")a @("v:1")b\n'))]):
        with pytest.raises(DocumentError):
            weave(bad, "v")


def test_weave_in_step():
    text = lambda w: '@("v:1")' + " ".join(f"{w} reading {k} taken at slack water." for k in range(4)) + "\n"
    woven = write(weave([("x", doc(text("One"))), ("y", doc(text("Eins")))], "v", 60))
    parts = [b.split("\n")[1] for b in woven.split("@@@.\n")[0:0] or woven.split(".@@@")[:-1]]
    assert woven.count(".zyg-x") == woven.count(".zyg-y") == 4 and len(parts) == 8


def test_many_coordinates_are_linear():
    body = "\n\n".join(f'@("v:{i}")Entry {i} of the log, some words long.' for i in range(5000)) + "\n"
    woven = weave([("x", doc(body)), ("y", doc(body))], "v", 200)
    assert len(woven.blocks) == 15_000


def test_outline_and_points():
    source = '@@@!doc\n\n@# Head @:x:@\na @("v:1")\n\n@#\nb\n#@\n#@(k).c\n'
    made = outline(parse(source, CAT), CAT.schema("doc"))
    assert [(x["name"], x["depth"], x["start"], x["end"], x["head"]) for x in made] == [("section", 0, 3, 9, "Head x"), ("section", 1, 6, 8, "")]
    assert list(points(parse(source, CAT), source)) == [{"kind": "onym", "key": "k", "line": 9}, {"kind": "milestone", "key": "v:1", "line": 4}]


def test_spelling_round_trip():
    made = canonicalize("@@@!doc\n\n@# h @:x:@\n@~\nl\n~@\n#@.k\n", CAT)
    text = spelled(made.document, CAT.schema("doc"))
    assert text == "@@@!doc\n\n@{section} h @{em}x{em}@\n@{poem}\nl\n{poem}@\n{section}@.k\n"
    assert write(parse(text, CAT)) == made.text
    with pytest.raises(DocumentError):
        spelled(made.document, CAT.schema("doc"), "xx")


def test_unresolved_labels():
    d = doc("@# quay\na @!naut!@ @!x!@ @!naut!@\n#@\n\n@!y!@\n")
    assert unresolved_labels(d, "!", "#", {"x"}) == [("quay", "naut"), ("", "y")]


def test_stream_keeps_each_content_once(spark, tmp_path):
    from quire.streaming import ingest

    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "md", "# A\n\nb", t), (2, "md", "#  A\n\nb\n\n", t), (3, "md", "c", t), (4, "html", "<nav>", t), (5, "md", "c", t)]
    spark.createDataFrame(rows, ingest.FILE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = ingest.new_content(ingest.read_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("kept_content").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    kept = spark.table("kept_content").collect()
    assert len(kept) == 2 and len({r.content_id for r in kept}) == 2


def test_slices_feed_the_witness_operators(spark):
    from quire.operators import documents, witnesses

    text = lambda a, b: f'@@@!doc\n\n@("v:1")a small {a} boat @("v:2")past {b} pier\n'
    files = spark.createDataFrame([(1, "B", "atd", text("grey", "the old")), (1, "T", "atd", text("blue", "the old")), (1, "W", "atd", text("grey", "old"))], "doc_id long, witness string, extension string, text string")
    parts = documents.slices(files, "v", {"doc.dia": DIA})
    notes = witnesses.collate(parts.where("coord is not null"), "B").collect()
    assert sorted(r.text for r in notes) == ["1 grey B : blue T", "2 the B : om. W"]
    assert witnesses.weave(parts.where("coord is not null")).count() == 6
