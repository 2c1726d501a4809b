"""Subdivision in place: parallel documents get coordinates at the same depth between their own, in step.

Between two coordinates every document of a work has sites where it could be cut, in five tiers: heads of blocks that
stay whole and of stanzas, heads of paragraphs, ends of sentences (and lines of verse), of clauses, of words. A cut
takes the same one of equally many blocks, or else the block nearest to the middle; without blocks the same one of
equally many sentences, or the nearest site of the best tier. Its name is the coordinate and a binary path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from quire.functions.alignment import CLAUSE, SENTENCE, WORD, cuts
from quire.model.slicing import mass
from quire.model.tree import Document, DocumentError, Node, clone

BLOCK, HEAD, ENDS, CLAUSES, WORDS = range(5)


@dataclass
class Site:
    """at: characters since the coordinate. What is cut: before a block, a paragraph at a place in a text, or a line."""

    at: int
    tier: int
    rank: int
    siblings: list[Node]
    block: Node
    text: Node | None = None
    offset: int = 0
    line: list[Node] | None = None


@dataclass
class Span:
    """What stands between a coordinate and the next."""

    coord: str
    length: int = 0
    sites: list[Site] = field(default_factory=list)
    cut: bool = False


class _Walk:
    def __init__(self, scheme: str, refine: bool):
        self.scheme, self.refine, self.spans, self.rank = scheme, refine, [], 0

    @property
    def here(self) -> Span | None:
        return self.spans[-1] if self.spans else None

    def grow(self, n: int) -> None:
        if self.spans:
            self.spans[-1].length += n

    def site(self, tier: int, siblings: list[Node], block: Node, ahead: int = 0, **more) -> None:
        """A site inside the span; nothing is cut where it starts."""
        if self.here is not None and self.here.length + ahead > 0:
            self.rank += 1
            self.here.sites.append(Site(self.here.length + ahead, tier, self.rank, siblings, block, **more))

    def point(self, n: Node) -> None:
        mine = n.scheme == self.scheme or (n.text.startswith(f"{self.scheme}:") and "|" in n.text)
        if not mine:
            return
        if "|" in n.text and not self.refine:
            if self.here is not None:
                self.here.cut = True
        else:
            self.spans.append(Span(n.text))

    def whole(self, seq: list[Node]) -> None:
        """Content without sites of its own: a line of verse, or what is inside an element."""
        for n in seq:
            if n.kind == "point":
                self.point(n)
            elif n.kind in ("span", "wrap"):
                self.whole(n.body)
            else:
                self.grow(mass([n]))

    def blocks(self, seq: list[Node]) -> None:
        for b in seq:
            if b.kind == "para":
                self.site(HEAD, seq, b)
                for n in b.body:
                    if n.kind == "text":
                        for tier, marks in ((ENDS, SENTENCE), (CLAUSES, CLAUSE), (WORDS, WORD)):
                            for k in cuts(n.text, marks):
                                self.site(tier, seq, b, k, text=n, offset=k)
                    self.whole([n])
            elif b.kind in ("block", "wrap"):
                self.grow(mass(b.head))
                self.blocks(b.body)
                self.grow(mass(b.tail))
            elif b.kind == "verse":
                self.site(BLOCK, seq, b)
                self.grow(mass(b.head))
                for s, stanza in enumerate(b.body):
                    for k, line in enumerate(stanza):
                        if s or k:
                            self.site(ENDS if k else BLOCK, seq, b, line=line)
                        self.whole(line)
                self.grow(mass(b.tail))
            else:
                self.site(BLOCK, seq, b)
                self.grow(mass([b]))


def spans_of(doc: Document, scheme: str, refine: bool = False) -> list[Span]:
    """The spans of a document; one without coordinates is a single span under ``^``."""
    walk = _Walk(scheme, refine)
    walk.blocks(doc.blocks)
    if not walk.spans:
        walk = _Walk(scheme, refine)
        walk.spans.append(Span("^"))
        walk.blocks(doc.blocks)
    names = [s.coord for s in walk.spans]
    if len(set(names)) < len(names):
        raise DocumentError("Syntax", f"a coordinate of `{scheme}` stands twice")
    return walk.spans


def _inside(span: Span, tier: int, window: tuple[int, int]) -> list[Site]:
    return [s for s in span.sites if s.tier == tier and window[0] < s.at < window[1]]


def _choice(span: Span, window: tuple[int, int], same: dict[int, int | None]) -> Site | None:
    middle = (window[0] + window[1]) // 2
    tiers = {t: _inside(span, t, window) for t in range(5)}
    near = lambda sites: min(sites, key=lambda s: abs(s.at - middle))
    for tier in (BLOCK, ENDS):
        if tiers[tier] and same[tier] is not None:
            return tiers[tier][same[tier]]
        if tier == BLOCK and tiers[BLOCK]:
            return near(tiers[BLOCK])
    return next((near(tiers[t]) for t in (HEAD, ENDS, CLAUSES, WORDS) if tiers[t]), None)


def plan(spans: list[Span], most: int) -> Iterator[tuple[str, list[Site]]]:
    """(path, one site of each span): windows halved in step until all are short, or one has no site left."""
    todo = [("", [(0, s.length) for s in spans])]
    while todo:
        path, windows = todo.pop()
        if max(b - a for a, b in windows) <= most:
            continue
        same = {}
        for tier in (BLOCK, ENDS):
            counts = {len(_inside(s, tier, w)) for s, w in zip(spans, windows)}
            same[tier] = counts.copy().pop() // 2 if len(counts) == 1 and counts != {0} else None
        chosen = [_choice(s, w, same) for s, w in zip(spans, windows)]
        if None in chosen:
            continue
        yield (f"{path}.1" if path else "1"), chosen
        low, high = (f"{path}.0", f"{path}.1") if path else ("0", "1")
        todo.append((high, [(c.at, b) for c, (_, b) in zip(chosen, windows)]))
        todo.append((low, [(a, c.at) for c, (a, _) in zip(chosen, windows)]))


def _apply(site: Site, point: Node) -> None:
    if site.line is not None:
        site.line.insert(0, point)
        return
    at = next(k for k, b in enumerate(site.siblings) if b is site.block)
    if site.text is None:
        if site.block.kind == "para":
            site.block.body.insert(0, point)
        else:
            site.siblings.insert(at, Node("para", body=[point], is_block=True))
        return
    k = next(i for i, n in enumerate(site.block.body) if n is site.text)
    rest = [Node("text", text=site.text.text[site.offset :]), *site.block.body[k + 1 :]]
    site.text.text = site.text.text[: site.offset].rstrip()
    del site.block.body[k + 1 :]
    site.siblings.insert(at + 1, Node("para", body=[point, *rest], is_block=True))


def subdivide_in_place(docs: list[Document], scheme: str, most: int, refine: bool = False, namespace: str | None = None) -> tuple[list[Document], list[int], list[str]]:
    """(documents, cuts in each, coordinates left alone because they have cuts already).

    ``refine`` cuts between existing cuts as well. Under another ``namespace`` a cut's scheme is that, and its value
    starts with the scheme that it divides.
    """
    if most <= 0:
        raise DocumentError("Syntax", "the greatest length must be positive")
    docs = [Document(d.schema, d.version, clone(d.blocks)) for d in docs]
    spans = [{s.coord: s for s in spans_of(d, scheme, refine)} for d in docs]
    there = [{c.removeprefix(f"{scheme}:") for c in mine if "|" in c} for mine in spans]
    planned: list[list[tuple[Site, str]]] = [[] for _ in docs]
    skipped = []
    for coord in dict.fromkeys(c for mine in spans for c in mine):
        holders = [k for k, mine in enumerate(spans) if coord in mine]
        if any(spans[k][coord].cut for k in holders):
            skipped.append(coord)
            continue
        cut = list(plan([spans[k][coord] for k in holders], most))
        bare = coord.removeprefix(f"{scheme}:")
        stem = bare + ("." if "|" in bare else "|")
        # a name that stands already is made deeper, which keeps its order
        while any(f"{stem}{path}" in there[k] for path, _ in cut for k in holders):
            stem += "0."
        for path, sites in cut:
            for k, site in zip(holders, sites):
                planned[k].append((site, f"{stem}{path}"))
    own = namespace is None or namespace.rstrip(":") == scheme
    for mine in planned:
        for site, name in sorted(mine, key=lambda x: -x[0].rank):
            _apply(site, Node("point", scheme=scheme if own else namespace.rstrip(":"), text=name if own else f"{scheme}:{name}"))
    return docs, [len(mine) for mine in planned], skipped
