"""Plain files of annotated corpora, read and written without a tree, against the same files by way of one."""

import time

import pytest

from quire.model.canon import canonicalize_tree, composed
from quire.model.essence import essence
from quire.operators import documents
from quire.sources import analysed, treebanks

CAT = documents._atlas({}, {}).catalog


def by_tree(text, extension):
    doc = canonicalize_tree(composed(documents.READERS[extension](text)), CAT).document
    return documents.write(doc), essence(doc, CAT)[1]


def seconds(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


def opencorpora(*sentences):
    word = lambda w: f'<token text="{w}"><tfr><v><l t="{w}"><g v="X"/><g v="y"/></l></v></tfr></token>'
    made = "".join(f'<paragraph><sentence id="s{k}"><source>{s}</source><tokens>{"".join(map(word, s.split(" ")))}</tokens></sentence></paragraph>' for k, s in enumerate(sentences, 1))
    return f"<annotation><text><paragraphs>{made}</paragraphs></text></annotation>"


def test_plain_opencorpora_needs_no_tree():
    text = opencorpora(*["one two three t1 x"] * 2000)
    assert documents._canonical_pair(text, "opencorpora", CAT) == by_tree(text, "opencorpora")
    assert 4 * seconds(documents._canonical_pair, text, "opencorpora", CAT) < seconds(by_tree, text, "opencorpora")


@pytest.mark.parametrize("odd", ["a b", "a  b", "a .", "a .b", ". a", "a|b c", "a (b)", "ü a", "ü a", "á b", "a&amp;b c", "a@b c", "a b c", "a=b c", "\\ a"])
def test_odd_opencorpora(odd):
    text = opencorpora(odd, "c d")
    for given in (text, text.replace("</sentence></paragraph><paragraph>", "</sentence>"), text.replace("<source>", "<source>x "), text.replace("<v>", "junk<v>", 1), text.replace('<g v="y"/>', '<g v="y(z)"/><g v="t1"/>')):
        assert documents._canonical_pair(given, "opencorpora", CAT) == by_tree(given, "opencorpora")


def native(*sentences, mark="@!/(X)@!%(y)"):
    return "@@@!litogramma\n\n" + "\n\n".join(f"@@.@!.({k})" + " ".join(f"@@.@!=({w}){mark}{w}.@@" for w in s.split(" ")) + ".@@" for k, s in enumerate(sentences, 1)) + "\n"


def written_by_tree(text, target):
    return treebanks.export(documents.canonicalize(text, CAT).document, target).encode()


def there_and_back(text, target):
    return documents._canonical_pair(documents._written(text, "atd", target, CAT), target, CAT)


def by_tree_there_and_back(text, target):
    return by_tree(written_by_tree(text, target).decode(), target)


@pytest.mark.parametrize("target", sorted(analysed.WRITE))
def test_plain_round_trip_needs_no_tree(target):
    text = native(*["one two three t1x x"] * 2000)
    assert documents._written(text, "atd", target, CAT) == written_by_tree(text, target)
    assert there_and_back(text, target) == by_tree_there_and_back(text, target) == by_tree(written_by_tree(text, target).decode(), target)
    assert 4 * seconds(there_and_back, text, target) < seconds(by_tree_there_and_back, text, target)


@pytest.mark.parametrize("target", sorted(analysed.WRITE))
@pytest.mark.parametrize("odd", ["a b", "a .", "a .b", ". a", "# a", "_ a", "ü a", "a&b c", "t1 t2 t1-1", "a=b c", "a-b <c>", '"a" b'])
@pytest.mark.parametrize("mark", ["@!/(X)@!%(y)", "@!/(X)", "@!/(X)@!%(y,z)@!&(a_b)@!-(r)", "@!/(X)@!=(b)@!/(Y)", "@!/(X)@!>(t1)"])
def test_odd_round_trips(target, odd, mark):
    text = native(odd, "c d", mark=mark)
    for given in (text, text.replace(".@@ @@.", ".@@  x @@.", 1), text.replace("@@.@!.(2)", "@@.@!.(t1-1)"), text + "\n@# h\nb\n#@\n"):
        assert documents._written(given, "atd", target, CAT) == written_by_tree(given, target)
        assert there_and_back(given, target) == by_tree_there_and_back(given, target)
