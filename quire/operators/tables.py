"""Shorthand tables: cells of pipe rows, header rules, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_cells(row: Column) -> Column:
    """Trimmed cells of a pipe row; a separator after a backslash is content."""
    body = F.btrim(F.replace(row, F.lit("\\|"), F.lit("\x01")), F.lit("|"))
    return F.transform(F.split(body, r"\|"), lambda c: F.btrim(F.replace(c, F.lit("\x01"), F.lit("|"))))


def is_header_rule(row: Column) -> Column:
    """Dashes, separators, colons, pluses and blanks only, with a dash."""
    return row.rlike(r"^[-|+: \t]*-[-|+: \t]*$")


def pad(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cells))))
