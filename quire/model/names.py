"""Grammars of identifiers and the two sigils."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

SIGIL, ALIAS = "@", "\\"
_NUMBERS = {"Nd", "Nl", "No"}


@lru_cache(maxsize=1 << 16)
def alphanumeric(c: str) -> bool:
    """Letters and letter-like marks, and numbers of every kind."""
    return c.isalpha() or unicodedata.category(c) in _NUMBERS or (unicodedata.category(c) in ("Mn", "Mc", "So") and _other_alphabetic(c))


def _other_alphabetic(c: str) -> bool:
    return "ͅ" == c or "Ⓐ" <= c <= "ⓩ" or (unicodedata.category(c) == "Mc")


@lru_cache(maxsize=1 << 16)
def symbolic(c: str) -> bool:
    return not (alphanumeric(c) or c.isspace() or c in (SIGIL, ALIAS))


def valid_name(s: str) -> bool:
    return bool(s) and alphanumeric(s[0]) and alphanumeric(s[-1]) and all(alphanumeric(c) or c == "-" for c in s)


def valid_anchor(s: str) -> bool:
    """Alphanumeric runs joined by single marks of ``- _ : .``"""
    before = "-"
    for c in s:
        if not alphanumeric(c) and (c not in "-_:." or not alphanumeric(before)):
            return False
        before = c
    return bool(s) and alphanumeric(before)


def valid_point(s: str) -> bool:
    """Anchors joined by ``|``, after ``^|`` if it stands before the first coordinate."""
    s = s.removeprefix("^|")
    return bool(s) and all(valid_anchor(part) for part in s.split("|"))


def valid_class(s: str) -> bool:
    """Hyphenated runs without capitals, opening with a letter."""
    parts = s.split("-")
    return bool(s) and s[0].isalpha() and all(parts) and all(alphanumeric(c) and not c.isupper() for p in parts for c in p)


def opens_class(c: str) -> bool:
    return c.isalpha() and not c.isupper()
