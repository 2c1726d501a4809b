"""Parallel versions of works as rows (work, witness, pos, coord, text).

Slices meet in equi-joins on (work, coord), so a work of any length is spread over tasks; what compares two
slices runs inside one row. Only the merge of whole coordinate orders needs one work's coordinates together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import alignment


def repeated_coordinates(slices: DataFrame) -> DataFrame:
    return slices.groupBy("work", "witness", "coord").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def aligned_order(slices: DataFrame) -> DataFrame:
    """(work, coord, rank, error): the order that agrees with every witness's, witnesses in order of name."""
    trace = F.array_sort(F.collect_list(F.struct("pos", "coord")))
    traces = slices.groupBy("work", "witness").agg(trace.alias("t"))
    works = traces.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("witness", F.col("t.coord").alias("coords")))).alias("traces"))
    schema = pa.schema([("work", pa.string()), ("coord", pa.string()), ("rank", pa.int32()), ("error", pa.string())])

    def order(it):
        for b in it:
            out = []
            for work, traces in zip(b.column("work").to_pylist(), b.column("traces").to_pylist()):
                try:
                    found = alignment.merged_order([t["coords"] for t in traces])
                    out += [{"work": work, "coord": c, "rank": k, "error": None} for k, c in enumerate(found)]
                except ValueError as e:
                    out.append({"work": work, "coord": None, "rank": None, "error": str(e)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return works.select(F.col("work").cast("string").alias("work"), "traces").mapInArrow(order, "work string, coord string, rank int, error string")


def weave(slices: DataFrame) -> DataFrame:
    """Slices in woven order: coordinates in the aligned order, at each the witnesses by name."""
    order = aligned_order(slices).where("error IS NULL").select("work", "coord", "rank")
    return slices.withColumn("work", F.col("work").cast("string")).join(order, ["work", "coord"])


def collate(slices: DataFrame, base: str) -> DataFrame:
    """(work, coord, place, note, text): apparatus notes of all witnesses against the base."""
    one = F.col("witness") == base
    mine = slices.where(one).select("work", "coord", F.col("text").alias("base"))
    others = slices.where(~one).select("work", "coord", "witness", "text")
    pairs = others.join(mine, ["work", "coord"])
    by = pairs.groupBy("work", "coord").agg(F.first("base").alias("base"), F.array_sort(F.collect_list(F.struct("witness", "text"))).alias("others"))
    schema = pa.schema([("work", pa.string()), ("coord", pa.string()), ("place", pa.int32()), ("note", pa.string()), ("text", pa.string())])

    def run(it):
        for b in it:
            out = []
            for work, coord, text, others in zip(*(b.column(c).to_pylist() for c in ("work", "coord", "base", "others"))):
                words = (text or "").split()
                hunks = [(o["witness"], *h) for o in others for h in alignment.word_hunks(words, (o["text"] or "").split())]
                out += [dict(zip(schema.names, (work, coord, *x))) for x in alignment.apparatus(coord, base, words, hunks)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    keyed = by.select(F.col("work").cast("string").alias("work"), F.col("coord").cast("string").alias("coord"), "base", "others")
    return keyed.mapInArrow(run, "work string, coord string, place int, note string, text string")


def _per_coordinate(slices: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("witness", F.coalesce("text", F.lit("")).alias("text"))))
    return slices.groupBy("work", "coord").agg(parts.alias("parts")).select(F.col("work").cast("string").alias("work"), F.col("coord").cast("string").alias("coord"), "parts")


def subdivide(slices: DataFrame, most: int) -> DataFrame:
    """(work, coord, round, witness, text): slices of one coordinate halved in step until all are short."""
    schema = pa.schema([("work", pa.string()), ("coord", pa.string()), ("round", pa.int32()), ("witness", pa.string()), ("text", pa.string())])

    def run(it):
        for b in it:
            out = []
            for work, coord, parts in zip(*(b.column(c).to_pylist() for c in ("work", "coord", "parts"))):
                rounds = alignment.subdivide([(p["witness"], p["text"]) for p in parts], most)
                out += [{"work": work, "coord": coord, "round": k, "witness": w, "text": t} for k, r in enumerate(rounds) for w, t in r]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return _per_coordinate(slices).mapInArrow(run, "work string, coord string, round int, witness string, text string")


def cut_paths(slices: DataFrame, most: int) -> DataFrame:
    """(work, coord, witness, label, at): where coordinates ``coord|path`` would be put to subdivide in place."""
    schema = pa.schema([("work", pa.string()), ("coord", pa.string()), ("witness", pa.string()), ("label", pa.string()), ("at", pa.int32())])

    def run(it):
        for b in it:
            out = []
            for work, coord, parts in zip(*(b.column(c).to_pylist() for c in ("work", "coord", "parts"))):
                join = "." if "|" in coord else "|"
                for p, plan in zip(parts, alignment.plan_cuts([p["text"] for p in parts], most)):
                    out += [{"work": work, "coord": coord, "witness": p["witness"], "label": f"{coord}{join}{path}", "at": at} for path, at in plan]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return _per_coordinate(slices).mapInArrow(run, "work string, coord string, witness string, label string, at int")
