"""OSIS, USFM and coordinates."""

import time

import pytest

from quire.model.canon import canonicalize
from quire.model.schema import Catalog
from quire.model.slicing import slices
from quire.model.tree import DocumentError
from quire.model.writer import write
from quire.sources.scripture import read_osis, read_usfm, to_coordinates

OSIS = """<?xml version="1.0"?><osis xmlns="http://www.bibletechnologies.net/2003/OSIS/namespace"><osisText><header><work/></header>
<div type="book" osisID="Gen"><title type="main" short="Songs">A Made <divineName>Name</divineName></title>
<chapter osisID="Gen.1"><title>Opening</title><p><verse sID="Gen.1.1" osisID="Gen.1.1"/>On the <hi type="italic">shore</hi><note type="crossReference">See <reference osisRef="Ruth.2.3">Ru 2</reference></note><verse eID="Gen.1.1"/><verse osisID="Gen.1.2" sID="x"/>Then <q who="Boaz">he called</q>.</p>
<lg><l level="1"><verse osisID="Gen.1.3" sID="y"/>Far out</l><l level="2">the boats</l></lg><lg><l>turn</l></lg></chapter>
<chapter n="2"><verse osisID="Gen.2.1">Rest.</verse> <verse osisID="Gen.2.2">Sail.</verse></chapter></div></osisText></osis>"""


def test_osis():
    """The marks and their order are fixed by the format."""
    text = write(read_osis(OSIS))
    assert text == """@@@!at-usfm

@# gen
@_Songs_@.h

@_A Made @,Name,@.nd_@.mt1

@##(1)

@_Opening_@.s1

@|(1) On the @,shore,@.it@^See @,@?>(Ruth.2.3)Ru 2,@.xo^@.x @|(2) Then @,@?:(Boaz)he called,@.said.

@~
@,@|(3) Far out,@.q1
@,the boats,@.q2

@,turn,@.q1
~@

@##(2)

@|(1) Rest. @|(2) Sail.
#@
"""
    for bad in ("<osis>", "<osis/>", "<osis><osisText><div type='book'/></osisText></osis>", "<osis><div type='book' osisID='Gen'>x</div></osis>", "<osis><div type='book' osisID='Gen'><p><blink>x</blink></p></div></osis>"):
        with pytest.raises(DocumentError):
            read_osis(bad)


def test_coordinates():
    schema = Catalog().schema("at-usfm")
    doc = to_coordinates(read_osis(OSIS), "bible", schema)
    made = canonicalize(write(doc), Catalog())
    assert '@("bible:gen.1.2") Then' in made.text and '@("bible:gen.2")' in made.text
    found = [s.point.text for s in slices(doc.blocks, "bible") if s.point]
    # a mark inside a phrase of a verse line does not cut
    assert found == ["gen.1", "gen.1.1", "gen.1.2", "gen.2", "gen.2.1", "gen.2.2"]


def test_large_book_is_linear():
    verses = "".join(f'<verse osisID="Ps.1.{k}">Verse {k} of many words in a row here.</verse> ' for k in range(20_000))
    began = time.time()
    doc = read_osis(f'<osis><div type="book" osisID="Ps"><chapter n="1">{verses}</chapter></div></osis>')
    assert len(doc.blocks[0].body[1].body) > 40_000 - 2 and time.time() - began < 5


USFM = r"""\id JHN a made book
\ide UTF-8
\h Harbours
\mt1 The Long Quay
\c 3
\s Boats
\p
\v 1 A rope lay there.
\v 2 It came
by boat.
\pi
\v 16 \wj Cast off\f + \fr 3:16 \ft "Let
go" \+nd Master\+nd*.\f* now.\wj*
\v 17 \w Oars|strong="H1"\w* bend.\x - \xo 3:17 \xt Ruth 2:4\x*
\q1 The sea,
\v 18
\q2
\v 19 all on it.
\b
\q Steer on
"""


def test_usfm():
    text = write(read_usfm(USFM))
    assert text == """@@@!at-usfm

@# jhn
@_Harbours_@.h

@_The Long Quay_@.mt1

@##(3)

@_Boats_@.s1

@|(1) A rope lay there. @|(2) It came by boat.

@_@|(16) @,@?:(Jesus)Cast off@^@,3:16,@.fr "Let go" @,Master,@.nd.^@.f now.,@.wj @|(17) Oars bend.@^@,3:17,@.xo Ruth 2:4^@.x_@.pi1

@~
@,The sea,,@.q1
@,@|(18),@.q1
@,@|(19) all on it.,@.q2

@,Steer on,@.q1
~@
#@
"""
    made = canonicalize(text, Catalog())
    assert canonicalize(made.text, Catalog()).text == made.text
    for bad in ("\\p x", "\\id GEN\n\\zz x", "\\id GEN\nstray", "\\id GEN\n\\p a \\f + x"):
        with pytest.raises(DocumentError):
            read_usfm(bad)
