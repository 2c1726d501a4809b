"""A canonical document with its media as one archive, the same bytes for the same content."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from collections.abc import Callable

from quire.model.canon import Canonical
from quire.model.schema import KEYWORD, Catalog, Schema, declared, defines, read_definition
from quire.model.markup import parse
from quire.model.tree import Document


def archive(made: Canonical, name: str, read: Callable[[str], bytes]) -> bytes:
    """A gzipped tar of the text, the media manifest and the media; times are zero and modes 644."""
    manifest = json.dumps([dict(zip(("name", "source", "sha256"), m)) for m in made.media], indent=2, ensure_ascii=False)
    parts = [(name, made.text.encode()), ("media-manifest.json", manifest.encode())]
    parts += [(f"media/{m}", read(source)) for m, source, _ in made.media]
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for path, body in parts:
            info = tarfile.TarInfo(path)
            info.size, info.mode, info.mtime = len(body), 0o644, 0
            tar.addfile(info, io.BytesIO(body))
    return gzip.compress(raw.getvalue(), mtime=0)


def is_definition(source: str, catalog: Catalog | None = None) -> bool:
    """Does the first content line declare a schema definition, not a document?

    It does with this library's own keyword; with another, if that names no schema and the text defines something.
    """
    lines = source.removeprefix("\ufeff").split("\n")
    found = declared((lines[1] if lines[0].startswith("#!") and len(lines) > 1 else lines[0]).strip())
    if found is None or found[2]:
        return False
    if found[1] == KEYWORD:
        return True
    catalog = catalog or Catalog()
    known = found[1] in catalog.library or any(f"{found[1]}{e}" in catalog.texts for e in (".lektos", ".dia"))
    return not known and defines(source)


def check_any(source: str, name: str, catalog: Catalog) -> Document | Schema:
    """The document or the definition that a source holds, checked against its schema."""
    return read_definition(source, name, catalog, (name,)) if is_definition(source, catalog) else parse(source, catalog)
