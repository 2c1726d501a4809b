"""Collation notes in the base text."""

import pytest

from quire.model.collation import collate
from quire.model.tree import Document, DocumentError, Node
from quire.model.writer import write


def doc(a, b, schema="lit"):
    point = lambda v: Node("point", scheme="mark", text=v)
    text = lambda t: Node("text", text=t)
    return Document(schema, blocks=[Node("para", body=[point("1a"), text(a), point("1b"), text(b)], is_block=True)])


def test_replacement_omission_and_addition():
    base = doc("a small grey boat drifts", "past the old pier today")
    out = write(collate([("B", base), ("T", doc("a small blue boat drifts", "past the old pier lamp today")), ("W", doc("a small grey boat", "past the old pier today"))], "mark", "B"))
    for part in ("1a grey B : blue T", "1a drifts B : om. W", "1b post pier add. lamp T", "grey@^!(app-1a-1)", "drifts@^!(app-1a-2)", "pier@^!(app-1b-1)", "@^!\n1a grey B : blue T\n!^@(app-1a-1)"):
        assert part in out, out
    assert base.blocks[0].body[1].text == "a small grey boat drifts"


def test_heads_belong_to_the_slice_that_they_open():
    def headed(head, body):
        p = Node("para", body=[Node("point", scheme="s", text="1"), Node("text", text=body)], is_block=True)
        return Document("lit", blocks=[Node("block", "#", head=[Node("text", text=head)], body=[p], is_block=True)])

    out = write(collate([("B", headed("one two", "three four")), ("T", headed("one zwei", "three vier"))], "s", "B"))
    assert "@# one two@^!(app-1-1)\n" in out and "four@^!(app-1-2)" in out and "1 two B : zwei T" in out


def test_checks():
    one = doc("x", "y")
    flipped = doc("x", "y")
    flipped.blocks[0].body[0].text, flipped.blocks[0].body[2].text = "1b", "1a"
    for witnesses, base, told in (
        ([("B", one), ("T", one)], "Z", "not among"),
        ([("B", one), ("B", one)], "B", "duplicate witness siglum"),
        ([("B 1", one), ("T", one)], "T", "not a valid siglum"),
        ([("B", one), ("T", doc("x", "y", "other"))], "B", "one dialektos per collation"),
        ([("B", one), ("T", flipped)], "B", "disagree on coordinate order"),
        ([("B", one)], "B", "at least two"),
    ):
        with pytest.raises(DocumentError, match=told):
            collate(witnesses, "mark", base)
    led = write(collate([("B", one), ("T", doc("new x", "y"))], "mark", "B"))
    assert "app-" not in led
