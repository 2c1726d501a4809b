"""Org, Djot and reStructuredText readers."""

import time

import pytest

from quire.model.canon import canonicalize
from quire.model.mapping import Atlas, apply
from quire.model.schema import Catalog
from quire.model.tree import DocumentError
from quire.model.writer import write
from quire.sources.lightweight import read_djot, read_org, read_rst

ORG = """#+TITLE: Sailing log
#+AUTHOR: nobody

* Second watch

The mate calls for /less sail/ and *more rope*, under
_heavy_ cloud and +no moon+, as noted [fn:1] before.

[fn:1] Page nine
  of the log.

- halyard :: hoists a sail
- sheet
1. reef early

#+BEGIN_QUOTE
Reef when you first think of it.
#+END_QUOTE

#+BEGIN_VERSE
Wind from the west,

and never at rest.
#+END_VERSE

| Knots | Sail |
|------+------|

#+BEGIN_SRC sql
SELECT knots
#+END_SRC

See [[https://e.org/p][the chart]] and =soundings= <<spot>> a/b/c.
"""


def test_org():
    text = write(read_org(ORG))
    for part in ("@#Sailing log#@\n\n@#Second watch#@", "@/less sail/@ and @*more rope*@, under @_heavy_@ cloud and @+no moon+@, as noted @^(1) before.", "@^\nPage nine of the log.\n^@(1)", "@:: halyard\nhoists a sail\n::@", "@-\nsheet\n-@", "@.(1)\nreef early\n.@", "@>\nReef when you first think of it.\n>@", "@~\nWind from the west,\n\nand never at rest.\n~@", "@|\n| Knots | Sail |\n|------+------|\n|@", '@@@"\nSELECT knots\n"@@@.sql', 'the chart (@><https://e.org/p><@) and @@"soundings"@@ @(spot) a/b/c.'):
        assert part in text, part
    assert "nobody" not in text
    made = canonicalize(text, Catalog())
    assert canonicalize(made.text, Catalog()).text == made.text
    for bad in ("#+BEGIN_QUOTE\nx\n", "#+BEGIN_CENTER\nx\n#+END_CENTER\n"):
        with pytest.raises(DocumentError):
            read_org(bad)


DJOT = "# Knots\n\nTie a _bowline_, a *hitch*, and `2 < 3` turns, then\n\\*no more\\* of [it](http://u) <http://v>[^n].\n\n> Slack first.\n\n- over\n\n1. under\n2. through\n\n[^n]: from an\n  old hand\n\n``` sql\nSELECT 2\n```\n"
#: Fixed by the format: the text above as native source.
DJOT_NATIVE = '@@@!at-djot\n\n@#Knots#@\n\nTie a @_bowline_@, a @*hitch*@, and @@"2 < 3"@@ turns, then *no more* of it (@><http://u><@) @><http://v><@@^(n).\n\n@>\nSlack first.\n>@\n\n@-\nover\n-@\n\n@.(1)\nunder\n.@\n\n@.(2)\nthrough\n.@\n\n@^\nfrom an old hand\n^@(n)\n\n@@@"\nSELECT 2\n"@@@.sql\n'


def test_djot():
    assert write(read_djot(DJOT)) == DJOT_NATIVE
    with pytest.raises(DocumentError):
        read_djot("```\nx")


def test_one_file_maps_both_ways():
    a = Atlas(Catalog(), {"at-djot.at-markdown.iso": "@@@!quire-iso\n@=at-djot<=>at-markdown\n\n@:: _ *\n@:: * **\n"})
    doc = canonicalize(write(read_djot(DJOT)), a.catalog).document
    there = apply(doc, a.direct("at-djot", "at-markdown"), a.catalog)
    assert there.schema == "at-markdown" and "@**hitch**@" in write(there)
    assert write(apply(there, a.direct("at-markdown", "at-djot"), a.catalog)) == write(doc)


RST = """Tide tables
===========

Read *early*, read **often**, and keep ``h < 2`` in
mind [#fn]_ with `a chart <http://u>`_.

.. note::

   Times are local.

neap
   the least range

:Port: Narrow Sound

- flood
  and ebb

1. high

::

   h = range / 12

.. [#fn] Or ask the pilot.

   He knows.

.. image:: curve.svg
"""


def test_rst():
    text = write(read_rst(RST))
    assert text == """@@@!at-rst

@#Tide tables#@

Read @*early*@, read @**often**@, and keep @@"h < 2"@@ in mind @^(fn) with a chart (@><http://u><@).

@!
Times are local.
!@

@:: neap
the least range
::@

@: Port
Narrow Sound
:@

@-
flood and ebb
-@

@.(1)
high
.@

@@@"
h = range / 12
"@@@

@^
Or ask the pilot.

He knows.
^@(fn)
@@@@(curve.svg)
"""
    with pytest.raises(DocumentError):
        read_rst(".. raw:: html\n")


def test_unclosed_marks_are_fast():
    began = time.time()
    for mark in ("*", "_", "/", "[[", "<<", "=", "`", "[", "[^"):
        read_org(" " + (mark + "a ") * 10_000)
        read_djot(" " + (mark + "a ") * 10_000)
        read_rst("x " + (mark + "a ") * 10_000)
    assert time.time() - began < 10
