"""Token tables and numbered verses, as DataFrame functions."""

from quire.operators import documents
from quire.sources import corpora

CONLLU = "# sent_id = s1\n# text = Hi there.\n1\tHi\thi\tINTJ\tUH\t_\t0\troot\t_\t_\n1-2\tHi there\t_\t_\t_\t_\t_\t_\t_\t_\n2\tthere\tthere\tADV\t_\tA=b\t1\tadvmod\t_\tSpaceAfter=No\n3\t.\t.\tPUNCT\t.\t_\t9\tpunct\t_\t_\n\n1\tx\t_\t_\t_\t_\t_\t_\t_\t_\nshort\trow\n"


def test_conllu(spark):
    files = spark.createDataFrame([(1, CONLLU), (2, ""), (3, None)], "doc long, text string")
    rows = sorted(corpora.conllu_tokens(files).collect(), key=lambda r: (r.sent, r.tok))
    assert [tuple(r) for r in rows] == [
        (1, 0, "s1", 1, "Hi", True, "hi", "INTJ/UH", None, None, "root"),
        (1, 0, "s1", 2, "there", False, "there", "ADV", "A=b", 1, "advmod"),
        (1, 0, "s1", 3, ".", True, ".", "PUNCT/.", None, 9, "punct"),
        (1, 1, None, 1, "x", True, None, None, None, None, None),
    ]
    heads = {(r.sent, r.tok): r.head_form for r in corpora.token_heads(corpora.conllu_tokens(files)).collect()}
    assert heads == {(0, 1): None, (0, 2): "Hi", (0, 3): None, (1, 1): None}


def test_conllu_round_trip(spark):
    files = spark.createDataFrame([(1, CONLLU)], "doc long, text string")
    text = corpora.conllu_text(corpora.conllu_tokens(files)).first().text
    assert text == "# sent_id = s1\n1\tHi\thi\tINTJ\tUH\t_\t0\troot\t_\t_\n2\tthere\tthere\tADV\t_\tA=b\t1\tadvmod\t_\tSpaceAfter=No\n3\t.\t.\tPUNCT\t.\t_\t0\tpunct\t_\t_\n\n1\tx\t_\t_\t_\t_\t0\t_\t_\t_\n"
    again = spark.createDataFrame([(1, text)], "doc long, text string")
    assert corpora.conllu_text(corpora.conllu_tokens(again)).first().text == text


def test_numbered_verses(spark):
    good = "# note\n1|1|a\n1|2|b|c\n\n2|1|d\n"
    bad = "1|1|a\n3|1|b\n"
    rows = corpora.numbered_verses(spark.createDataFrame([(1, good), (2, bad), (3, "x")], "doc long, text string")).collect()
    assert sorted((r.sura, r.aya, r.text) for r in rows if r.doc == 1 and r.error is None) == [(1, 1, "a"), (1, 2, "b|c"), (2, 1, "d")]
    assert [r.error for r in rows if r.doc == 2 and r.error] == ["line 2 is out of order"] and [r.error for r in rows if r.doc == 3] == ["line 1 is out of order"]


def test_node_table_and_status(spark):
    files = spark.createDataFrame([(1, "md", "# A\n\nb *c*\n"), (2, "html", "<nav>"), (3, "org", "* T\n"), (4, "nope", "x"), (5, "rst", None)], "doc_id long, extension string, text string")
    status = {r.doc_id: (r.status, r.error_kind) for r in documents.check(files).collect()}
    assert status == {1: ("ok", None), 2: ("error", "Syntax"), 3: ("ok", None), 4: ("error", "Syntax"), 5: ("ok", None)}
    nodes = documents.nodes(files)
    nodes.createOrReplaceTempView("n")
    inside = spark.sql("SELECT count(*) AS c FROM n a JOIN n d ON a.doc_id = d.doc_id AND a.pre < d.pre AND d.post < a.post WHERE a.kind = 'para' AND d.kind = 'text' AND a.doc_id = 1").first().c
    assert inside == 3
    assert {r.doc_id: r.native for r in documents.to_native(files).collect()}[3] == "@@@!at-org\n\n@#T#@\n"
    heads = documents.outlines(spark.createDataFrame([(1, "md", "> q\n\n- i\n")], "doc_id long, extension string, text string")).collect()
    assert [r.name for r in heads] == ["blockquote", "unordered-item"]
