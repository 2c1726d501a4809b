"""Column functions over text: layout, lines, words, cuts, slugs, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.alignment import CLAUSE, SENTENCE, WORD

#: White space that layout may vary (fixed value): space, tab, line feed, carriage return.
LAYOUT = r"[ \t\n\r]+"
#: Code points with the property White_Space (fixed value).
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Alphanumeric code points: letters, letter-like signs and numbers of every kind.
ALNUM = r"\p{IsAlphabetic}\p{Nd}\p{Nl}\p{No}"


def lines(text: Column) -> Column:
    """Lines end at LF or CRLF only."""
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))


def collapse_layout(text: Column) -> Column:
    """Runs of layout white space become one space; the edges are trimmed."""
    return F.btrim(F.regexp_replace(text, LAYOUT, " "))


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def slug(text: Column) -> Column:
    """Alphanumeric runs in lower case joined by hyphens."""
    return F.array_join(F.filter(F.split(F.lower(text), f"[^{ALNUM}]+"), lambda w: w != ""), "-")


def escape_once(text: Column, table: dict[str, str]) -> Column:
    """Each character replaced at most once, so that a replacement is never escaped again."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")


def hanging_prefix(text: Column, prefix: str) -> Column:
    """Every line but the first starts with the prefix, blank ones without its trailing blanks; a last newline stays."""
    safe = lambda s: "\n" + s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(F.regexp_replace(text, "\n(?=[^\n])", safe(prefix)), "\n(?=\n)", safe(prefix.rstrip()))


def decode_entities(text: Column) -> Column:
    """The named references; the ampersand last, so that nothing is decoded twice."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


#: Named character references (fixed values), in the order in which they are decoded.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "amp": "&"}


def closing_symbol(symbol: Column) -> Column:
    """An element's closing symbol: reversed, with brackets turned round."""
    return F.translate(F.reverse(symbol), "()[]{}<>", ")(][}{><")


def _pieces(text: Column, marks: str) -> Column:
    """What stands before and between the cuts: each piece ends with a mark and the white space behind it.

    The piece after the last cut is left out. A space, as a mark, is its own white space.
    """
    space = "*" if marks == WORD else "+"
    return F.regexp_extract_all(text, F.lit(rf"\G[\s\S]*?[{marks}]{WHITE}{space}(?=[^{WHITE[1:-1]}])"), F.lit(0))


def cut_count(text: Column, marks: str) -> Column:
    pieces = _pieces(text, marks)
    first = F.get(pieces, F.lit(0))
    return F.size(pieces) - F.when(_blank_before(first, marks), 1).otherwise(0)


def _blank_before(piece: Column, marks: str) -> Column:
    """Has a first piece nothing but blanks before its mark? Then there is no cut after it."""
    return F.coalesce(piece.rlike(rf"^{WHITE}*[{marks}]{WHITE}*$"), F.lit(False))


def nearest_cut(text: Column, marks: str) -> Column:
    """Offset of the cut nearest to the middle; of two at equal distance the earlier; null without cuts."""
    half = F.floor(F.length(text) / 2).cast("int")
    # the middle travels in the state, or each step would measure the text again
    start = F.struct(F.lit(0).alias("at"), half.alias("half"), F.lit(None).cast("struct<off:int,at:int>").alias("best"))

    def step(acc, piece):
        at = acc["at"] + F.length(piece)
        found = F.struct(F.abs(at - acc["half"]).alias("off"), at.alias("at"))
        lands = (acc["at"] > 0) | ~_blank_before(piece, marks)
        return F.struct(at.alias("at"), acc["half"].alias("half"), F.when(lands, F.least(acc["best"], found)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(_pieces(text, marks), start, step)["best"]["at"]


def is_url(text: Column) -> Column:
    return text.rlike("^https?://")


def resolve_url(base: Column, target: Column) -> Column:
    """A target against a base address: absolute, host-rooted, or beside the base's last segment."""
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(is_url(target), target).when(target.startswith("/"), F.concat(host, target)).otherwise(F.concat(folder, target))


def url_extension(url: Column) -> Column:
    """Extension of the last path segment in lower case; empty if it has none."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
