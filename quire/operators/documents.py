"""Documents as rows: parsing, canonical form, content ids and node tables, one document per call.

A document that fails becomes a row with its error; the job goes on. Each task maps its own Arrow batches, and
results leave it in batches of bounded size. Only inputs too small to fill the cores are shuffled, to spread them.
"""

from __future__ import annotations

import gc
import hashlib
import io
import tarfile
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quire.model import cutting, slicing, views
from quire.model.bundle import archive
from quire.model.canon import Canonical, canonicalize, canonicalize_tree, composed
from quire.model.choosing import Book
from quire.model.essence import essence
from quire.model.mapping import Atlas, apply_route
from quire.model.markup import parse
from quire.model.rendering import render
from quire.model.schema import Catalog, read_definition
from quire.model.tree import NODE_SCHEMA, Document, DocumentError, encode
from quire.model.views import outline, spelled
from quire.model.writer import write
from quire.operators.rows import spread
from quire.sources import analysed, corpora, dictionary, docbook, ebook, html, lightweight, markdown, office, scripture, sugar, tei, treebanks

#: Readers by file extension.
READERS: dict[str, Callable[[str], Document]] = {
    "md": markdown.read,
    "markdown": markdown.read,
    "html": html.read,
    "htm": html.read,
    "rst": lightweight.read_rst,
    "org": lightweight.read_org,
    "dj": lightweight.read_djot,
    "djot": lightweight.read_djot,
    "xml": tei.read_xml,
    "tei": tei.read_tei,
    "dbk": docbook.read_docbook,
    "docbook": docbook.read_docbook,
    "jats": docbook.read_jats,
    "bib": corpora.read_bibtex,
    "osis": scripture.read_osis,
    "usfm": scripture.read_usfm,
    "sfm": scripture.read_usfm,
    "usx": scripture.read_usx,
    "tanzil": scripture.read_numbered,
    "dsl": dictionary.read_dsl,
    "fb2": ebook.read_fb2,
    "rnc": treebanks.read_rnc,
    "opencorpora": treebanks.read_opencorpora,
    "oc": treebanks.read_opencorpora,
    "proiel": treebanks.read_proiel,
    "conllu": treebanks.read_conllu,
    "conll": treebanks.read_conllu,
}
#: Readers of bytes.
BINARY: dict[str, Callable[[bytes], Document]] = {"docx": office.read_docx, "dsl": dictionary.read_dsl, "dsl.dz": dictionary.read_dsl}
#: Formats that are written by code of their own.
WRITERS: dict[str, Callable[[Document], str | bytes]] = {
    "fb2": ebook.write_fb2,
    "docx": office.write_docx,
    **{name: (lambda doc, name=name: treebanks.export(doc, name)) for name in treebanks.WRITERS},
    "atd": write,
    "atk": write,
}
NATIVE = ("atd", "atk")


def read_document(text: str | bytes, extension: str, catalog: Catalog) -> Document:
    """A file's text, or its bytes: those of a text format are UTF-8."""
    if extension in BINARY and not (extension in READERS and isinstance(text, str)):
        return BINARY[extension](text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"))
    if isinstance(text, bytes):
        text = text.decode("utf-8-sig")
    text = text.removeprefix("\ufeff")
    if extension in NATIVE:
        return parse(text, catalog)
    if extension == "atr":
        return sugar.read_short(text, catalog)
    if extension not in READERS:
        raise DocumentError("Syntax", f"unknown extension `{extension}`")
    return READERS[extension](text)


def _mapped(df: DataFrame, columns: list[str], schema: str, f: Callable[..., Iterator[tuple]], size: int = 4_000_000) -> DataFrame:
    """f of each row's columns; its rows go out in batches of about ``size`` characters read."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(it):
        # trees are large and free of cycles: the default threshold walks them over and over
        before = gc.get_threshold()
        gc.set_threshold(500_000, 10, 10)
        try:
            yield from batches(it)
        finally:
            gc.set_threshold(*before)

    def batches(it):
        for b in it:
            out: list[tuple] = []
            seen = 0
            for at in range(0, b.num_rows, 256):
                for row in zip(*(b.slice(at, 256).column(c).to_pylist() for c in columns)):
                    out.extend(f(*row))
                    seen += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                    if seen > size:
                        yield from batch(out)
                        out, seen = [], 0
            yield from batch(out)

    def batch(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return spread(df.select(*columns)).mapInArrow(run, schema)


#: What an unreadable file raises besides typed errors: numbers and nestings beyond what can be held.
_UNREADABLE = (ValueError, RecursionError, OverflowError)
_STATUS = "doc_id long, status string, error_kind string, error string, line int, col int"
_FILE = ["doc_id", "extension", "text"]


def _told(e: Exception) -> tuple:
    """(kind, message, line, column) of an error."""
    if isinstance(e, DocumentError):
        return e.kind, e.message, e.line or None, e.col or None
    return "Syntax", f"{type(e).__name__}: {str(e)[:200]}", None, None


def _guarded(f: Callable[..., tuple], empty: tuple):
    def rows(doc_id, extension, text):
        try:
            yield (doc_id, "ok", None, None, None, None, *f(text or "", extension))
        except (DocumentError, *_UNREADABLE) as e:
            yield (doc_id, "error", *_told(e), *empty)

    return rows


def _several(f: Callable[..., Iterator[tuple]], width: int):
    """Rows (status, kind, message, ...) of f; of a file that cannot be read one row with its error."""

    def rows(doc_id, *args):
        try:
            found = [(doc_id, "ok", None, None, *r) for r in f(doc_id, *args)]
        except (DocumentError, *_UNREADABLE) as e:
            found = [(doc_id, "error", *_told(e)[:2], *[None] * width)]
        return found

    return rows


_SEVERAL = "doc_id long, status string, error_kind string, error string, "


def nodes(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """files: doc_id, extension, text. The interval-encoded node table, with an error row for each file that fails."""
    texts = dict(texts or {})

    def rows(doc_id, extension, text):
        return (r[1:] for r in encode(doc_id, read_document(text or "", extension, _atlas(texts, {}).catalog)))

    columns = NODE_SCHEMA.partition(", ")[2]
    return _mapped(files, _FILE, _SEVERAL + columns, _several(rows, len(_parse_datatype_string(columns))))


def check(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, status, error...) of reading each file."""
    texts = dict(texts or {})

    def one(text, extension):
        read_document(text, extension, _atlas(texts, {}).catalog)
        return ()

    return _mapped(files, _FILE, _STATUS, _guarded(one, ()))


def to_native(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """Each file as native source text."""
    texts = dict(texts or {})
    one = lambda text, extension: (write(read_document(text, extension, _atlas(texts, {}).catalog)),)
    return _mapped(files, _FILE, _STATUS + ", native string", _guarded(one, (None,)))


def _canonical(text: str, extension: str, catalog: Catalog) -> Canonical:
    """Native source is parsed with its inclusions; what another reader gives is brought to canonical form as it is."""
    if extension in NATIVE:
        return canonicalize(text.decode("utf-8-sig") if isinstance(text, bytes) else text, catalog)
    return canonicalize_tree(composed(read_document(text, extension, catalog)), catalog)


def _canonical_pair(text: str | bytes, extension: str, catalog: Catalog) -> tuple[str, str]:
    """Canonical text and content id. Plain files of annotated corpora need no tree for that."""
    if extension in analysed.READ and not catalog.texts:
        text = text.decode("utf-8-sig") if isinstance(text, bytes) else text
        if found := analysed.canonical(text.removeprefix("\ufeff"), extension):
            return found[0], hashlib.sha256(found[1].encode()).hexdigest()
    made = _canonical(text, extension, catalog)
    return made.text, essence(made.document, catalog)[1]


def canonical(files: DataFrame, texts: Mapping[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical text and content id of each file.

    keep: further columns that pass through, each as its name and type.
    """
    texts = dict(texts or {})

    def one(text, extension):
        return _canonical_pair(text, extension, _atlas(texts, {}).catalog)

    rows, schema = _guarded(one, (None, None)), _STATUS + ", canonical string, content_id string"
    if not keep:
        return _mapped(files, _FILE, schema, rows)
    kept = lambda doc_id, extension, text, *rest: ((*r, *rest) for r in rows(doc_id, extension, text))
    return _mapped(files, [*_FILE, *[k.split()[0] for k in keep]], ", ".join([schema, *keep]), kept)


def canonical_nodes(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """The node table of each file's canonical form."""
    texts = dict(texts or {})

    def rows(doc_id, extension, text):
        return (r[1:] for r in encode(doc_id, _canonical(text or "", extension, _atlas(texts, {}).catalog).document))

    columns = NODE_SCHEMA.partition(", ")[2]
    return _mapped(files, _FILE, _SEVERAL + columns, _several(rows, len(_parse_datatype_string(columns))))


def outlines(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, status..., kind, symbol, name, depth, start, end, head, anchor, classes) of native sources' blocks."""
    texts = dict(texts or {})

    def rows(doc_id, extension, text):
        catalog = _atlas(texts, {}).catalog
        doc = read_document(text or "", extension, catalog)
        return (tuple(x.values()) for x in outline(doc, catalog.schema(doc.schema)))

    columns = "kind string, symbol string, name string, depth int, start int, end int, head string, anchor string, classes array<string>"
    return _mapped(files, _FILE, _SEVERAL + columns, _several(rows, 9))


def definitions(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """The elements of definition files, inherited ones included: (doc_id, status..., name, symbol, form, body, parent)."""
    texts = dict(texts or {})

    def rows(doc_id, extension, text):
        schema = read_definition(text or "", f"file-{doc_id}", _atlas(texts, {}).catalog, (f"file-{doc_id}",))
        return ((e.name, e.symbol, e.form, e.body if e.form == "block" else None, e.parent) for e in schema.elements.values())

    return _mapped(files, _FILE, _SEVERAL + "name string, symbol string, form string, body string, parent string", _several(rows, 5))


def tokens(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """Analysed words of documents: a row for each with its first analysis, its head by place in its sentence."""
    texts = dict(texts or {})

    def rows(doc_id, extension, text):
        corpus = treebanks.from_document(read_document(text or "", extension, _atlas(texts, {}).catalog))
        for k, s in enumerate(corpus.sentences()):
            places = {t.name: j for j, t in enumerate(s.tokens(), 1) if t.name}
            for j, t in enumerate(s.tokens(), 1):
                p = t.parsings[0] if t.parsings else {}
                yield (k, s.id, j, t.form, p.get("lemma"), p.get("pos"), p.get("features"), places.get(p.get("head")), p.get("relation"), len(t.parsings))

    columns = "sent int, sent_id string, tok int, form string, lemma string, pos string, features string, head int, relation string, parsings int"
    return _mapped(files, _FILE, _SEVERAL + columns, _several(rows, 10))


def bundles(files: DataFrame, texts: Mapping[str, str] | None = None, media: Mapping[str, bytes] | None = None) -> DataFrame:
    """Each file's canonical form with its media as one archive (``content binary``), the same bytes for the same content."""
    texts, media = dict(texts or {}), dict(media or {})

    def read(name: str) -> bytes:
        if name not in media:
            raise DocumentError("MissingResource", name)
        return media[name]

    def one(text, extension):
        catalog = _atlas(texts, {}).catalog
        made = canonicalize(text, catalog, media=read) if extension in NATIVE else canonicalize_tree(composed(read_document(text, extension, catalog)), catalog, read)
        return (archive(made, "document.atk", read),)

    return _mapped(files, _FILE, _STATUS + ", content binary", _guarded(one, (None,)))


def bundle_members(bundled: DataFrame) -> DataFrame:
    """(doc_id, member, size, sha256, content) of archives in ``content``."""

    def rows(doc_id, content):
        if content is not None:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                for m in tar:
                    body = tar.extractfile(m).read()
                    yield (doc_id, m.name, len(body), hashlib.sha256(body).hexdigest(), body)

    return _mapped(bundled, ["doc_id", "content"], "doc_id long, member string, size long, sha256 string, content binary", rows)


def respelled(files: DataFrame, language: str | None = None, texts: Mapping[str, str] | None = None) -> DataFrame:
    """Each file as native source with its elements spelled out by name, in a language where names are localized."""
    texts = dict(texts or {})

    def one(text, extension):
        catalog = _atlas(texts, {}).catalog
        doc = read_document(text, extension, catalog)
        return (spelled(doc, catalog.schema(doc.schema), language),)

    return _mapped(files, _FILE, _STATUS + ", spelled string", _guarded(one, (None,)))


def points(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, status..., kind, key, line) of native sources' coordinates (milestone), anchors (onym) and references (deixis)."""
    texts = dict(texts or {})

    def rows(doc_id, extension, text):
        doc = read_document(text or "", extension, _atlas(texts, {}).catalog)
        return ((x["kind"], x["key"], x["line"]) for x in views.points(doc, text or ""))

    return _mapped(files, _FILE, _SEVERAL + "kind string, key string, line int", _several(rows, 3))


def lookups(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, key, line, target): each reference's line with that of the anchor it names (null, if there is none)."""
    found = points(files, texts).where("status = 'ok' AND kind IS NOT NULL")
    refs = found.where("kind = 'deixis'").select("doc_id", F.regexp_extract("key", r"\(([^)]*)\)$", 1).alias("key"), "line")
    anchors = found.where("kind = 'onym'").groupBy("doc_id", "key").agg(F.min("line").alias("target"))
    return refs.join(anchors, ["doc_id", "key"], "left")


def folds(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, start, end): blocks of more than a line."""
    return outlines(files, texts).where("status = 'ok' AND end > start").select("doc_id", "start", "end")


def highlights(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, status..., line, start, length, kind): marks of native sources, whether they can be read or not."""
    texts = dict(texts or {})

    def rows(doc_id, extension, text):
        name, catalog = views.declared_id(text or ""), _atlas(texts, {}).catalog
        try:
            schema = catalog.schema(name) if name else None
        except DocumentError:
            schema = None
        return views.highlights(text or "", schema)

    return _mapped(files, _FILE, _SEVERAL + "line int, start int, length int, kind string", _several(rows, 4))


def outline_texts(files: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """Each native source's outline as a table text."""
    texts = dict(texts or {})

    def one(text, extension):
        catalog = _atlas(texts, {}).catalog
        doc = read_document(text, extension, catalog)
        return (views.outline_text(doc, catalog.schema(doc.schema), text),)

    return _mapped(files, _FILE, _STATUS + ", outline string", _guarded(one, (None,)))


def compiled(files: DataFrame) -> DataFrame:
    """Texts in the short notation as native source."""
    return _mapped(files, _FILE, _STATUS + ", native string", _guarded(lambda text, extension: (sugar.compile_text(text),), (None,)))


def subdivided(files: DataFrame, scheme: str | None, most: int, texts: Mapping[str, str] | None = None) -> DataFrame:
    """files: doc_id (the work), witness, extension, text. Each work's documents cut in step, in place, as native source.

    A work's documents come together in one row; without a scheme it is the only one that their coordinates have.
    """
    texts = dict(texts or {})
    by = files.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("witness", "extension", "text"))).alias("parts"))

    def rows(doc_id, parts):
        try:
            catalog = _atlas(texts, {}).catalog
            docs = [read_document(p["text"] or "", p["extension"], catalog) for p in parts]
            made, n, _ = cutting.subdivide_in_place(docs, scheme or slicing.sole_scheme(docs), most)
            found = [(doc_id, p["witness"], "ok", None, None, write(d), k) for p, d, k in zip(parts, made, n)]
        except (DocumentError, *_UNREADABLE) as e:
            found = [(doc_id, p["witness"], "error", *_told(e)[:2], None, None) for p in parts]
        return found

    return _mapped(by, ["doc_id", "parts"], "doc_id long, witness string, status string, error_kind string, error string, native string, cuts int", rows)


def slices(files: DataFrame, scheme: str | None = None, texts: Mapping[str, str] | None = None) -> DataFrame:
    """files: doc_id (the work), witness, extension, text. (work, witness, pos, coord, text, error) for ``witnesses``.

    Without a scheme it is the only one that a file's coordinates have. The text of a slice is its words; what stands before the first coordinate has none. A file that cannot be read
    is one row with its error and no place.
    """
    texts = dict(texts or {})

    def rows(doc_id, witness, extension, text):
        try:
            doc = read_document(text or "", extension, _atlas(texts, {}).catalog)
            found = [(doc_id, witness, k, None if s.point is None else s.point.text, " ".join(slicing.words(s.nodes)), None) for k, s in enumerate(slicing.slices(doc.blocks, scheme or slicing.sole_scheme([doc])))]
        except (DocumentError, *_UNREADABLE) as e:
            found = [(doc_id, witness, None, None, None, ": ".join(_told(e)[:2]))]
        return found

    return _mapped(files, ["doc_id", "witness", "extension", "text"], "work long, witness string, pos int, coord string, text string, error string", rows)


def translate(files: DataFrame, target: str, texts: Mapping[str, str] | None = None, maps: Mapping[str, str] | None = None) -> DataFrame:
    """Each file, canonical, carried to the target schema along the shortest route of mappings."""
    texts, maps = dict(texts or {}), dict(maps or {})
    one = lambda text, extension: (write(_routed(text, extension, target, texts, maps)[0]),)
    return _mapped(files, ["doc_id", "extension", "text"], _STATUS + ", translated string", _guarded(one, (None,)))


def _routed(text: str, extension: str, target: str, texts: dict, maps: dict) -> tuple[Document, Catalog]:
    atlas = _atlas(texts, maps)
    doc = _canonical(text, extension, atlas.catalog).document
    return (doc if doc.schema == target else apply_route(doc, atlas.known_route(doc.schema, target), atlas.catalog)), atlas.catalog


_ATLASES: dict[tuple, Atlas] = {}


def _atlas(texts: dict, maps: dict) -> Atlas:
    """Schemas and routes are read once per worker and set of files."""
    key = (tuple(sorted(texts.items())), tuple(sorted(maps.items())))
    if key not in _ATLASES:
        _ATLASES.clear()
        _ATLASES[key] = Atlas(Catalog(texts), maps)
    return _ATLASES[key]


_BOOKS: dict[tuple, Book] = {}


def _book(rules: dict, atlas: Atlas) -> Book:
    key = (id(atlas), tuple(sorted(rules.items())))
    if key not in _BOOKS:
        _BOOKS.clear()
        _BOOKS[key] = Book(atlas.catalog, rules)
    return _BOOKS[key]


def _exported(text, extension: str, schema: str | None, target: str, variant: str | None, texts: dict, maps: dict, rules: dict) -> tuple[str, list[tuple]]:
    atlas = _atlas(texts, maps)
    book = _book(rules, atlas)
    if schema is None:
        doc = _canonical(text, extension, atlas.catalog).document
        route, table = book.choose(atlas, doc.schema, target, variant)
        doc = apply_route(doc, route, atlas.catalog) if route else doc
    else:
        doc, _ = _routed(text, extension, schema, texts, maps)
        table = book.table(schema, target, variant)
    return render(doc, table, book.table)


def export(
    files: DataFrame,
    schema: str | None,
    target: str,
    rules: Mapping[str, str] | None = None,
    texts: Mapping[str, str] | None = None,
    maps: Mapping[str, str] | None = None,
    variant: str | None = None,
) -> DataFrame:
    """Each file rendered for a target by rule tables: a caller's (``schema.target``) before the built-in ones.

    It is carried to ``schema`` first; without one, to the nearest schema that can be written so.
    """
    texts, maps, rules = dict(texts or {}), dict(maps or {}), dict(rules or {})

    def one(text, extension):
        body, beside = _exported(text, extension, schema, target, variant, texts, maps, rules)
        return body, [{"schema": a, "target": b, "text": t} for a, b, t in beside]

    more = ", rendered string, beside array<struct<schema: string, target: string, text: string>>"
    return _mapped(files, _FILE, _STATUS + more, _guarded(one, (None, None)))


def write_files(files: DataFrame, target: str, texts: Mapping[str, str] | None = None, maps: Mapping[str, str] | None = None, rules: Mapping[str, str] | None = None) -> DataFrame:
    """Each file as the bytes of another format (``content binary``): e-books, Word and annotated corpora are written by
    their own writers, anything else by rule tables.
    """
    texts, maps, rules = dict(texts or {}), dict(maps or {}), dict(rules or {})

    def one(text, extension):
        if target in WRITERS:
            return (_written(text, extension, target, _atlas(texts, maps).catalog),)
        made = _exported(text, extension, None, target, None, texts, maps, rules)[0]
        return (made if isinstance(made, bytes) else made.encode("utf-8", "surrogatepass"),)

    return _mapped(files, _FILE, _STATUS + ", content binary", _guarded(one, (None,)))


def _written(text: str | bytes, extension: str, target: str, catalog: Catalog) -> bytes:
    """A file as one of WRITERS makes it. Plain source of annotated corpora needs no tree for that."""
    made = analysed.written(text, target) if extension in NATIVE and isinstance(text, str) and not catalog.texts else None
    if made is None:
        made = WRITERS[target](_canonical(text, extension, catalog).document)
    return made if isinstance(made, bytes) else made.encode("utf-8", "surrogatepass")


def rewritten(files: DataFrame, target: str, texts: Mapping[str, str] | None = None) -> DataFrame:
    """Each file written as one of WRITERS makes it and read again: ``canonical`` of its bytes, which stay in the task."""
    texts = dict(texts or {})

    def one(text, extension):
        catalog = _atlas(texts, {}).catalog
        return _canonical_pair(_written(text, extension, target, catalog), target, catalog)

    return _mapped(files, _FILE, _STATUS + ", canonical string, content_id string", _guarded(one, (None, None)))
