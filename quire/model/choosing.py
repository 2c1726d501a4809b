"""Which rules write a document in a format: a schema's own with those of its parents, or those of the nearest schema."""

from __future__ import annotations

from collections.abc import Mapping

from quire.model import rules as built_in
from quire.model.mapping import Atlas, SchemaMap
from quire.model.rendering import RuleTable, inherit, overlaid, read_rules
from quire.model.schema import Catalog
from quire.model.tree import DocumentError


class Book:
    """Rule tables by ``schema.target`` and, for a variant, ``schema.target.variant``: files first, then built-in ones."""

    def __init__(self, catalog: Catalog, files: Mapping[str, str] | None = None):
        self.catalog = catalog
        self.files = {name.removesuffix(".exo"): body for name, body in (files or {}).items()}
        self._own: dict[str, RuleTable | None] = {}
        self._whole: dict[tuple, RuleTable] = {}

    def get(self, name: str) -> RuleTable | None:
        """A table without what the schema's parents bring."""
        if name not in self._own:
            source, target, *variant = name.split(".")
            if name in self.files:
                self._own[name] = read_rules(self.files[name], self.catalog.schema(source))
            elif variant:
                self._own[name] = built_in.variant_of(source, target, variant[0], self.catalog)
            else:
                self._own[name] = built_in.built_in(source, target, self.catalog)
        return self._own[name]

    def table(self, source: str, target: str, variant: str | None = None) -> RuleTable:
        key = (source, target, variant)
        if key not in self._whole:
            made = inherit(self, self.catalog.schema(source), self.catalog, target)
            if variant is not None:
                over = self.get(f"{source}.{target}.{variant}")
                if over is None:
                    raise DocumentError("UnresolvableExo", f"{source}=>{target} variant `{variant}`")
                made = overlaid(made, over)
            self._whole[key] = made
        return self._whole[key]

    def renders(self, source: str, target: str) -> bool:
        """Can the table write a whole document?"""
        return ("structure", "document", "") in self.table(source, target).rules

    def candidates(self, target: str) -> list[str]:
        named = {n.split(".")[0] for n in self.files if n.count(".") == 1 and n.split(".")[1] == target}
        return sorted(named | set(built_in.named(target)))

    def choose(self, atlas: Atlas, source: str, target: str, variant: str | None = None) -> tuple[list[SchemaMap], RuleTable]:
        """The route to take first, and the table. Two schemas at the same least distance are an error."""
        if self.renders(source, target):
            return [], self.table(source, target, variant)
        found: list[tuple[int, str, list[SchemaMap]]] = []
        for name in self.candidates(target):
            try:
                if name == source or not self.renders(name, target):
                    continue
                route = atlas.known_route(source, name)
            except DocumentError as e:
                if e.kind not in ("UnresolvableDialektos", "UnresolvableMorph"):
                    raise
                continue
            found.append((len(route), name, route))
        least = min((f[0] for f in found), default=0)
        nearest = [f for f in found if f[0] == least]
        if len(nearest) > 1:
            raise DocumentError("AmbiguousMorphRoute", " | ".join(" => ".join([source, *(m.target.id for m in f[2])]) for f in nearest))
        if not nearest:
            raise DocumentError("UnresolvableExo", f"{source}=>{target}")
        return nearest[0][2], self.table(nearest[0][1], target, variant)
