"""Line formats that DataFrame functions read: annotated tokens and numbered verses; and a bibliography reader."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.model.tree import Document, DocumentError, Node


def conllu_tokens(files: DataFrame) -> DataFrame:
    """files: doc, text. (doc, sent, sent_id, tok, form, space_after, lemma, pos, features, head, relation).

    Blank lines end sentences; rows of under eight fields and ids with ``-`` or ``.`` are skipped; head 0 and
    ``_`` are none. Everything happens inside the row of a file until its tokens are exploded.
    """
    parts = F.filter(F.split(F.replace("text", F.lit("\r"), F.lit("")), r"\n[ \t]*\n"), lambda s: F.trim(s) != "")
    sents = files.select("doc", F.posexplode(parts).alias("sent", "body"))
    sents = sents.withColumn("sent_id", F.nullif(F.regexp_extract("body", r"(?m)^#\s*sent_id\s*=\s*(.*?)\s*$", 1), F.lit("")))
    rows = sents.select("doc", "sent", "sent_id", F.posexplode(F.split("body", "\n")).alias("n", "row")).where(~F.col("row").startswith("#"))
    f = F.split("row", "\t")
    rows = rows.select("doc", "sent", "sent_id", "n", f.alias("f")).where((F.size("f") >= 8) & ~F.get("f", F.lit(0)).rlike(r"[-.]"))
    value = lambda k: F.when(F.get("f", F.lit(k)) != "_", F.get("f", F.lit(k)))
    pos = F.concat_ws("/", value(3), value(4))
    head = F.when(F.get("f", F.lit(6)).rlike("^[0-9]+$") & (F.get("f", F.lit(6)) != "0"), F.get("f", F.lit(6)).cast("int"))
    glued = F.coalesce(F.get("f", F.lit(9)).contains("SpaceAfter=No"), F.lit(False))
    return rows.select("doc", "sent", "sent_id", F.get("f", F.lit(0)).cast("int").alias("tok"), F.get("f", F.lit(1)).alias("form"), (~glued).alias("space_after"), value(2).alias("lemma"), F.nullif(pos, F.lit("")).alias("pos"), value(5).alias("features"), head.alias("head"), value(7).alias("relation"))


def token_heads(tokens: DataFrame) -> DataFrame:
    """Each token's head form; a head that is not there is none."""
    heads = tokens.select("doc", "sent", F.col("tok").alias("head"), F.col("form").alias("head_form"))
    return tokens.join(heads, ["doc", "sent", "head"], "left")


def conllu_text(tokens: DataFrame) -> DataFrame:
    """(doc, text): the tokens written back; a head that is not in its sentence is 0."""
    there = F.collect_set("tok").over(Window.partitionBy("doc", "sent"))
    head = F.when(F.array_contains(there, F.col("head")), F.col("head")).otherwise(0)
    blank = lambda c: F.coalesce(F.col(c), F.lit("_"))
    part = lambda k: F.coalesce(F.nullif(F.get(F.split("pos", "/"), F.lit(k)), F.lit("")), F.lit("_"))
    misc = F.when(F.col("space_after"), "_").otherwise("SpaceAfter=No")
    line = F.concat_ws("\t", "tok", "form", blank("lemma"), part(0), part(1), blank("features"), head.cast("string"), blank("relation"), F.lit("_"), misc)
    lines = tokens.select("doc", "sent", "sent_id", "tok", line.alias("line"))
    by = lines.groupBy("doc", "sent").agg(F.first("sent_id").alias("id"), F.array_sort(F.collect_list(F.struct("tok", "line"))).alias("ls"))
    body = F.concat(F.when(F.col("id").isNotNull(), F.concat(F.lit("# sent_id = "), "id", F.lit("\n"))).otherwise(""), F.array_join("ls.line", "\n"), F.lit("\n"))
    sents = by.select("doc", "sent", body.alias("body"))
    return sents.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("sent", "body")))["body"], "\n").alias("text"))


def numbered_verses(files: DataFrame) -> DataFrame:
    """files: doc, text of ``sura|aya|text`` lines. (doc, sura, aya, text, error): suras run on from 1 to 114."""
    lines = files.select("doc", F.posexplode(F.split("text", "\r?\n")).alias("n", "row")).where((F.trim("row") != "") & ~F.col("row").startswith("#"))
    f = F.split("row", r"\|", 3)
    rows = lines.select("doc", "n", F.get(f, F.lit(0)).try_cast("int").alias("sura"), F.get(f, F.lit(1)).try_cast("int").alias("aya"), F.get(f, F.lit(2)).alias("text"))
    w = Window.partitionBy("doc").orderBy("n")
    before_s, before_a = F.coalesce(F.lag("sura").over(w), F.lit(0)), F.coalesce(F.lag("aya").over(w), F.lit(0))
    follows = F.when(F.col("sura") == before_s, F.col("aya") == before_a + 1).otherwise((F.col("sura") == before_s + 1) & (F.col("aya") == 1))
    good = F.coalesce(follows & F.col("sura").between(1, 114) & F.col("text").isNotNull(), F.lit(False))
    return rows.select("doc", "sura", "aya", "text", F.when(~good, F.concat(F.lit("line "), F.col("n") + 1, F.lit(" is out of order"))).alias("error"))


_ENTRY = re.compile(r"@(\w+)\s*([{(])", re.S)


def read_bibtex(text: str) -> Document:
    """Entries with their key as head, their type as class and fields as children; string macros are rejected."""
    out, at = [], 0
    while m := _ENTRY.search(text, at):
        kind = m[1].lower()
        if kind in ("string", "preamble"):
            raise DocumentError("Syntax", f"bibtex import: @{kind} is not supported")
        body, at = _group(text, m.end(), "}" if m[2] == "{" else ")")
        if kind == "comment":
            continue
        key, _, rest = body.partition(",")
        fields = [_field(name, value) for name, value in _fields(rest)]
        out.append(Node("block", "&", head=[Node("text", text=key.strip())], body=fields, classes=[kind], is_block=True))
    return Document("bibliogramma", blocks=out)


def _field(name: str, value: str) -> Node:
    body = [Node("para", body=[Node("text", text=value)], is_block=True)] if value else []
    return Node("block", ":", head=[Node("text", text=name)], body=body, is_block=True)


def _group(text: str, at: int, close: str) -> tuple[str, int]:
    depth, start = 0, at
    while at < len(text):
        c = text[at]
        if c == close and not depth:
            return text[start:at], at + 1
        depth += (c == "{") - (c == "}")
        at += 1
    raise DocumentError("Syntax", "bibtex import: an entry is not closed")


def _fields(text: str):
    at = 0
    while m := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(text, at):
        at, parts = m.end(), []
        while True:
            if text.startswith("{", at):
                part, at = _group(text, at + 1, "}")
            elif text.startswith('"', at):
                end = text.index('"', at + 1)
                part, at = text[at + 1 : end], end + 1
            else:
                bare = re.compile(r"[^,#\s]*").match(text, at)
                part, at = bare[0], bare.end()
            parts.append(re.sub(r"\s+", " ", part.replace("{", "").replace("}", "")).strip())
            more = re.compile(r"\s*#\s*").match(text, at)
            if not more:
                break
            at = more.end()
        yield m[1].lower(), "".join(parts)
